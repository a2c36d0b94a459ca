"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's letters, lower-cased, are read as character n-grams inside words with
their boundaries; each is hashed to one of ``buckets`` embeddings, the mean of
which goes through a linear softmax.  Both are trained together by stochastic
gradient descent in numpy, on the driver, from a bounded sample of labelled
texts: about ``per_language`` documents of each language, ``SAMPLE_DOCS`` in all,
and of each document segments of many lengths from all over the text, drawn in
the workers, ``SAMPLE_BYTES`` in all (at most ``DOC_BYTES`` a document).  Every
language that has labelled text is learned.  Embeddings start at zero, so subwords
never seen in training pull a text towards an even distribution.  A fifth of the
sample is held back to fit the softmax's temperature and two bounds below which a
text is rejected.  One is for the score: ``FALSE_REJECTIONS`` of the correctly
labelled segments lie below it, but it never exceeds chance by more than
``CHANCE_MARGIN`` of the way to certainty.  The other is for how familiar the text
is, since a softmax is sure of languages it has never met as well: the mean
log-frequency of its subwords, each in the language where it is most frequent,
with ``PRIOR`` subwords of median frequency added, which keep very short texts.
The bound lies ``FAR`` times as far below the median of the documents held back as
their ``FALSE_REJECTIONS`` quantile does.

For scoring, embeddings times softmax weights make one table of a few numbers a
bucket, which is what the workers get; whole texts are scored, however long.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; with no labelled text at all every text is; equal texts score
equally, ties go to the language first in code-point order; an empty table gives
an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, small_batches

BUCKETS = 1 << 16
WIDTH = 16
NGRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 500
SAMPLE_DOCS = 100_000
SAMPLE_BYTES = 64 << 20
DOC_BYTES = 16 << 10
FALSE_REJECTIONS = 0.001
CHANCE_MARGIN = 0.2
PRIOR = 400
FAR = 2.5
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)
_STEP = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(text: str, buckets: int = BUCKETS, ngrams=NGRAMS) -> np.ndarray:
    """Bucket numbers of a text's character n-grams."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one boundary after each word
    points = np.concatenate(([np.uint32(32)], np.where(is_letter, points, np.uint32(32))[keep], [np.uint32(32)]))
    inner, found = points != 32, []
    for n in ngrams:
        if len(points) < n:
            break
        size = len(points) - n + 1
        code, whole = np.full(size, n, np.uint32), np.ones(size, bool)
        for k in range(n):
            code = (code ^ points[k : k + size]) * _MIX
            code ^= code >> np.uint32(15)
            if 0 < k < n - 1 or n == 1:
                whole &= inner[k : k + size]
        if n == 2:
            whole &= inner[:size] | inner[1:]
        found.append((code[whole] % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket by language: what a subword adds to the mean logits; a last column: how familiar it is
    bias: np.ndarray
    temperature: float
    threshold: float
    familiar: float = -np.inf
    median: float = 0.0

    def measures(self, text: str) -> tuple[np.ndarray, float] | None:
        """(mean logits, familiarity) of a whole text, read in steps; None without a letter."""
        total, count, at = np.zeros(len(self.languages) + 1), 0, 0
        while at < len(text):
            end = at + _STEP  # steps end at white space where there is some
            if end < len(text):
                end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
            ids = subwords(text[at:end], len(self.table))
            total += self.table[ids].sum(0, dtype=np.float64)
            count, at = count + len(ids), end
        return (total[:-1] / count + self.bias, float((total[-1] + PRIOR * self.median) / (count + PRIOR))) if count else None

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether the text is rejected)."""
        found = self.measures(text) if text and self.languages else None
        if found is None:
            return UNKNOWN, 0.0, True
        logits, familiar = found
        odds = np.exp((logits - logits.max()) / self.temperature)
        best = int(odds.argmax())
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, score < self.threshold or familiar < self.familiar

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def _segments(text: str, rng: np.random.Generator) -> list[str]:
    words, at, out = text.split(" "), 0, []
    while at < len(words):
        n = int(4 * 2 ** rng.uniform(0, 6))
        out.append(" ".join(words[at : at + n]))
        at += n
    return out


def drawn_segments(text: str, most: int) -> list[str]:
    """Segments from all over a text, ``most`` bytes of it at most, by a draw that depends on the text alone."""
    raw = text.encode("utf-8", "surrogatepass")
    rng = np.random.default_rng(zlib.crc32(raw))
    step = max(1, most // 4)  # in characters; what has no spaces is cut as well
    parts = [part[i : i + step] for part in _segments(text, rng) for i in range(0, max(1, len(part)), step)]
    if len(raw) <= most:
        return parts
    sizes = np.array([len(p.encode("utf-8", "surrogatepass")) for p in parts])
    order = rng.permutation(len(parts))
    return [parts[k] for k in np.sort(order[np.cumsum(sizes[order]) <= most])]


def train(texts: list[str], labels: list[str], buckets: int = BUCKETS, width: int = WIDTH, epochs: int = 3, seed: int = 7) -> Model:
    """Fit a model to whole texts; the order of the examples matters, so callers sort them."""
    rng = np.random.default_rng(seed)
    return train_segments([_segments(t, rng) for t in texts], labels, buckets, width, epochs, seed)


def train_segments(texts: list[list[str]], labels: list[str], buckets: int = BUCKETS, width: int = WIDTH, epochs: int = 3, seed: int = 7) -> Model:
    """Fit a model to texts given as segments."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((buckets, 1), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    examples, held, documents = [], [], []
    narrow = np.uint16 if buckets <= 1 << 16 else np.int32  # the sample's subwords are all held at once
    for k, (parts, label) in enumerate(zip(texts, labels, strict=True)):
        own = [(ids.astype(narrow), languages.index(label)) for ids in (subwords(part, buckets) for part in parts) if len(ids)]
        (held if k % 5 == 4 else examples).extend(own)
        if own and k % 5 == 4:
            documents.append(np.concatenate([ids for ids, _ in own]))
    embed = np.zeros((buckets, width), np.float32)
    weight = rng.normal(0, 1, (width, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, batch = 0, 32
    total = max(1, epochs * len(examples) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), batch):
            chosen = [examples[j] for j in order[i : i + batch]]
            sizes = np.array([len(x) for x, _ in chosen])
            ids, goal = np.concatenate([x for x, _ in chosen]), np.array([y for _, y in chosen])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            mean = np.add.reduceat(embed[ids], starts, axis=0) / sizes[:, None]
            logits = mean @ weight + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            odds[np.arange(len(goal)), goal] -= 1
            rate = 0.5 * (1 - steps / total) + 0.01
            back = (odds @ weight.T) * np.float32(20 * rate / len(goal))  # a bucket is met in few examples: a larger step
            weight -= rate / len(goal) * (mean.T @ odds)
            bias -= rate / len(goal) * odds.sum(0)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], ids[by][1:] != ids[by][:-1])))
            moves = (back / sizes[:, None]).astype(np.float32) * 10
            embed[ids[by][first]] -= np.add.reduceat(np.repeat(moves, sizes, axis=0)[by], first, axis=0)
            steps += 1
    share = np.full(buckets, 0.5 / buckets)
    for k in range(len(languages)):
        own = [ids for ids, label in examples if label == k]
        met = np.bincount(np.concatenate(own), minlength=buckets) + 0.5 if own else np.ones(buckets)
        share = np.maximum(share, met / met.sum())
    model = Model(languages, np.concatenate((embed @ weight, np.log(share)[:, None].astype(np.float32)), 1), bias.astype(np.float64), 1.0, 0.0)
    held = held or examples
    return _calibrate(model, held, documents or [ids for ids, _ in held])


def _calibrate(model: Model, held: list[tuple[np.ndarray, int]], documents: list[np.ndarray]) -> Model:
    logits = np.array([model.table[ids, :-1].mean(0, dtype=np.float64) + model.bias for ids, _ in held])
    goal = np.array([y for _, y in held])

    def odds(t: float) -> np.ndarray:
        x = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return x / x.sum(1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(odds(t)[np.arange(len(goal)), goal], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.02, 20, 61), key=loss))
    best = odds(model.temperature)
    right = best.max(1)[best.argmax(1) == goal]
    chance = 1 / len(model.languages)
    most = chance + CHANCE_MARGIN * (1 - chance)
    sums, sizes = np.array([(model.table[ids, -1].sum(dtype=np.float64), len(ids)) for ids in documents]).reshape(-1, 2).T
    model.median = float(np.median(sums / sizes))
    least = float(np.quantile((sums + PRIOR * model.median) / (sizes + PRIOR), FALSE_REJECTIONS))
    model.familiar = model.median - FAR * (model.median - least)
    model.threshold = min(most, float(np.quantile(right, FALSE_REJECTIONS))) if len(right) else most
    return model


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 1, folds: int = 3) -> Model:
    """Train on a bounded sample of the labelled rows outside fold ``fold``: about ``per_language`` rows of each language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(crc_mod("id", folds) != fold).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], [])
    per_language = max(1, min(per_language, SAMPLE_DOCS // len(counts)))
    most = max(64, min(DOC_BYTES, SAMPLE_BYTES // (per_language * len(counts))))
    small_batches(docs.sparkSession)
    sizes = rows.sparkSession.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in counts.items()], "lang string, share double")
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    chosen = rows.select(F.col("id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), "text", place.alias("place"))
    chosen = chosen.join(F.broadcast(sizes), "lang").filter("place < share").select("id", "lang", "text")  # a row for each class that is learned

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "lang": batch["lang"], "parts": [drawn_segments(t, most) for t in batch["text"]]})

    sample = chosen.mapInPandas(draw, "id string, lang string, parts array<string>").toPandas()
    sample["parts"] = [list(p) for p in sample["parts"]]
    sample = sample.assign(order=[(i or "", p) for i, p in zip(sample["id"], sample["parts"], strict=True)]).sort_values("order", kind="stable")
    return train_segments(sample["parts"].tolist(), sample["lang"].tolist())


def prediction(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score, rejected) for a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([model.judge(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    return of.asNondeterministic()(text)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(doc, lang_pred, score, rejected): ``doc`` is the row as a struct."""
    small_batches(docs.sparkSession)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return row.withColumn("p", prediction(model, F.col(f"doc.`{text_col}`"))).select("doc", "p.*")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected."""
    return identify(docs, model or fit(docs)).filter("NOT rejected").select("doc.*")
