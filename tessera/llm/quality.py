"""Quality classifier: a generalised additive model with pairwise interactions.

Whole texts are measured by ``FEATURES`` (no label, language, source or id among
them).  A model is a lookup table per feature over quantile bins, plus a table
per selected pair of features over coarser bins.  Tables are learned by cyclic
boosting: in turn, each feature gets a shallow tree (at most four leaves) fitted
to the gradient and curvature of the logistic loss in its bins, times a small
rate.  Then the pairs whose best two-by-two cut explains most of what is left
are boosted alike.  Scoring digitises a batch of feature vectors and adds bins.

Training runs on the driver from a bounded sample: at most about ``max_rows``
labelled feature vectors outside the held-out fold; the texts stay where they are.

Defined results: a text of any length is measured whole; a null text is measured
as an empty one, and both get the score of the model's bins for zeros; without labels, or with one label only, every
score is that label's share (0.5 without any); equal texts score equally; a
document labelled more than once counts once per label; labels other than 0 and
1, and null, are not learned from; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, materialize, small_batches

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "marks", "sentence_ends", "commas", "high_bytes",
    "distinct_words", "top_word", "repeated_lines", "line_words", "short_words", "long_words", "repeated_triples",
)
MAX_ROWS = 20_000
BINS, PAIR_BINS = 48, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 80, 40, 6
RATE = 0.2
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:=_/\\@^~+[]{}()\"'`-"


def measure(text: str | None) -> list[float]:
    """The feature vector of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(FEATURES) - 1)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid, n, count = sum(map(len, words)), len(words), Counter(words)
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = Counter(zip(words, words[1:], words[2:], strict=False)) if n > 2 else {}
    of = lambda which: int(byte[np.frombuffer(which, np.uint8)].sum())
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(n)),
        solid / n,
        upper / max(1, upper + lower),
        int(byte[48:58].sum()) / solid,
        of(SYMBOLS) / solid,
        of(MARKS) / solid,
        int(byte[46] + byte[33] + byte[63]) / n,
        int(byte[44]) / n,
        int(byte[128:].sum()) / solid,
        len(count) / n,
        max(count.values()) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float((sizes <= 3).mean()),
        float((sizes >= 12).mean()),
        1 - len(triples) / (n - 2) if n > 2 else 0.0,
    ]


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([measure(t) for t in batch])

    return of.asNondeterministic()(text)


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of feature vectors: one bin of every table, added up."""
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles, between distinct values."""
    own = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    nxt = np.array([values[values > c].min(initial=np.inf) for c in own])
    return np.unique(((own + nxt) / 2)[np.isfinite(nxt)])


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """The best cut of bins lo..hi-1: (gain, first bin of the right side)."""
    if hi - lo < 2:
        return 0.0, lo
    gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    gain = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1])
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A depth-two tree over bins as a table of Newton steps."""
    edges = [0, len(g)]
    for _ in range(2):
        found = [_split(g, h, a, b) for a, b in zip(edges, edges[1:], strict=False)]
        edges = sorted({*edges, *(k for gain, k in found if gain > 1e-9)})
    step = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut in two by two, as (gain, table of Newton steps)."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarters = []
    for s in (gs, hs):
        ll, lt, tl, tt = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        quarters.append((ll, lt - ll, tl - ll, tt - lt - tl + ll))
    gain = sum(_gain(a, b) for a, b in zip(*quarters, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(g)
    for q, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[rows, cols] = quarters[0][q][i, j] / (quarters[1][q][i, j] + 1.0)
    return float(gain[i, j] - _gain(gs[-1, -1], hs[-1, -1])), step


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the tables to feature vectors and 0/1 labels by cyclic boosting."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return Model(0.0 if not len(y) else 30.0 * (2 * share - 1))
    model = Model(float(np.log(share / (1 - share))))
    model.cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    raw = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = slopes()
                step = RATE * _tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)))
                table += step
                raw += step[at[j]]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    size = [len(c) + 1 for c in model.pair_cuts]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * size[j] + coarse[j], values, size[i] * size[j]).reshape(size[i], size[j])

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-_pair_tree(grid(*p, g), grid(*p, h))[0], p))
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            table += step
            raw += step[coarse[i], coarse[j]]
    return model


def fit(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", label_col: str = "quality", fold: int = 1, folds: int = 3) -> Model:
    """Train on a bounded sample of the labelled rows of ``measured`` (id, x) outside fold ``fold``."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("y IN (0, 1)")
    known = known.filter(crc_mod("id", folds) != fold)
    n = known.count()
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    sample = known.filter(place < max_rows / max(n, 1)).join(measured.select(F.col(id_col).alias("id"), "x"), "id").toPandas().sort_values("id", kind="stable")
    x = np.array(sample["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return train(x, sample["y"].to_numpy(np.float64))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) for every document, written once and read again: texts are measured a single time."""
    small_batches(docs.sparkSession)
    return materialize(docs.select(id_col, features(F.col(text_col)).alias("x")), "features")


def scored(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with its score in place of x."""

    @F.pandas_udf("double")
    def of(batch: pd.Series) -> pd.Series:
        x = np.array(batch.tolist(), np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return measured.withColumn("score", of.asNondeterministic()(F.col("x"))).drop("x")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, score, predicted) for every row of ``docs``."""
    made = measured(docs, id_col, text_col)
    model = fit(made, labels, id_col=id_col, **options)
    return scored(made, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
