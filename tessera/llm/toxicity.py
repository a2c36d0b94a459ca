"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Texts are lower-cased (A-Z), freed of ASCII marks and split at white space.  A word's
input vector is the sum of two parts.  The *word* part is a row of a hashed table.  The *character* part adds rows for its n-grams (lengths
``GRAMS``) and its beginnings (lengths ``STARTS``) in UTF-8 with a boundary before
it, each hashed into a second table and added up over the root of their number.  Input weights are
multiplied in once per distinct word, and workers keep the products, so a word that
was met before costs a lookup.

Two gated recurrent layers of ``HIDDEN`` units, one from either side, read windows of
``WINDOW`` words that overlap (a new one begins every ``STRIDE`` words) and cover the
whole text.  A window's states are pooled by softmax attention, and a linear layer
gives its log-odds.  A document's log-odds are its worst window's, which is how it is
trained as well: the gradient of a document goes through its worst window.  Weights
are learned by Adam in numpy.  Then scale and offset of the log-odds are fitted to
held-back rows of the sample, each class weighed by its share of all labelled rows.

The sample is bounded: at most ``MAX_ROWS`` labelled rows, half of them toxic where
there are enough, of texts up to ``MAX_BYTES`` bytes; scoring covers all texts whole.

Defined results: a null text and one without words score as a window of no words,
which is the network's offset; without labels every score is 0.5, and with labels of
one kind that kind; labels other than 0 and 1, and null, are not learned from; a
document labelled more than once, or several of one id, count once per row; equal
texts score equally; a text of any length is walked window by window, in bounded
memory; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, small_batches

MAX_ROWS, MAX_BYTES = 4_000, 6_000
GRAMS, STARTS = (3, 5), (4, 6, 8, 9)
WORD_ROWS, GRAM_ROWS, WIDTH = 1 << 15, 1 << 17, 16
HIDDEN, WINDOW, STRIDE = 12, 48, 36
ROUNDS, PASSES, BATCH, RATE, DECAY = 8, 2, 64, 1e-2, 1e-4
LEAST_TEXTS, LEAST_STEPS = 10, 400
LANES, KEPT_WORDS = 1024, 1 << 18
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MIX = np.uint64(0x9E3779B97F4A7C15)


# -- words as numbers ---------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, MARKS).split()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def describe(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, rows of all their n-grams, where each word's n-grams begin)."""
    bare = [b"\x01" + w for w in words]
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(bare), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(bare)), sizes)
    place = np.arange(len(text)) - begins[owner]
    left = sizes[owner] - place
    rows, owners = [], []
    hashed = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(*GRAMS, *STARTS) + 1):
            if n > len(text):
                break
            end = len(text) - n + 1
            hashed[:end] = hashed[:end] * np.uint64(0x100000001B3) + text[n - 1 :] + np.uint64(1)
            for kind, wanted in ((0, n in GRAMS), (1, n in STARTS)):
                if wanted:
                    at = np.flatnonzero((left[:end] >= n) & (place[:end] == 0 if kind else True))
                    rows.append(_scramble(hashed[at] + np.uint64(kind * 64 + n) * _MIX) % np.uint64(GRAM_ROWS))
                    owners.append(owner[at])
        powers = np.uint64(0x100000001B3) ** place.astype(np.uint64)
        whole = np.add.reduceat(_scramble(text * _MIX + np.uint64(7)) * powers, begins) if len(bare) else np.zeros(0, np.uint64)
        word = (_scramble(whole) % np.uint64(WORD_ROWS)).astype(np.int32)
    grams, owners = np.concatenate(rows or [np.zeros(0, np.uint64)]).astype(np.int32), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(bare))
    return word, grams[order], np.cumsum(counts) - counts


def _sums(table: np.ndarray, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the rows of each word, over the root of their number; of no rows zeros."""
    out = np.zeros((len(begins), table.shape[1]), table.dtype)
    counts = np.diff(np.append(begins, len(rows)))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(table[rows], begins[some], axis=0) / np.sqrt(counts[some, None]).astype(table.dtype)
    return out


def windows(n: int) -> list[tuple[int, int]]:
    """(start, length) of the windows of a text of n words; at least one, and together they are the text."""
    starts = range(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else (0,)
    return [(s, min(WINDOW, n - s)) for s in starts]


# -- the network ---------------------------------------------------------------


def new_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "word": normal(0.3, WORD_ROWS, WIDTH), "gram": normal(0.3, GRAM_ROWS, WIDTH),
        "into": normal(WIDTH**-0.5, WIDTH, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, np.float32),
        "gates": normal(HIDDEN**-0.5, 2, HIDDEN, 2 * HIDDEN), "new": normal(HIDDEN**-0.5, 2, HIDDEN, HIDDEN),
        "look": normal(0.3, 2 * HIDDEN), "out": normal(0.3, 2 * HIDDEN), "offset": np.zeros(1, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run(w: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """Log-odds of windows.

    ``x`` is (words, 2, windows, 3 * HIDDEN), the products of inputs and weights
    (update, reset, new), of the layer from the left and, word by word from the end
    of each window, of the one from the right.  Columns are in falling order of
    length, so that step t needs the first ``alive[t]`` only.
    """
    steps, _, n, _ = x.shape
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.zeros((steps, 2, n, HIDDEN), np.float32)
    alive = [int((lengths > t).sum()) for t in range(steps)]
    trace = []
    for t in range(steps):
        a = alive[t]
        old = h[:, :a]
        both = old @ w["gates"]
        both += x[t, :, :a, : 2 * HIDDEN]
        both *= 0.5
        np.tanh(both, out=both)
        both += 1
        both *= 0.5
        update, reset = both[..., :HIDDEN], both[..., HIDDEN:]
        fresh = (reset * old) @ w["new"]
        fresh += x[t, :, :a, 2 * HIDDEN :]
        np.tanh(fresh, out=fresh)
        now = fresh - old
        now *= update
        now += old
        if keep:
            trace.append((old.copy(), update, reset, fresh))
        h[:, :a] = now
        states[t, :, :a] = now
    # the state of word k: from the left at step k, from the right at step length - 1 - k
    look = states @ w["look"].reshape(2, HIDDEN, 1)
    worth = states @ w["out"].reshape(2, HIDDEN, 1)
    flip = np.maximum(lengths - 1 - np.arange(steps)[:, None], 0)
    column = np.arange(n)
    scores = look[:, 0, :, 0] + look[flip, 1, column, 0]
    values = worth[:, 0, :, 0] + worth[flip, 1, column, 0]
    inside = np.arange(steps)[:, None] < lengths
    scores = np.where(inside, scores, -np.inf)
    top = np.where(lengths > 0, scores.max(0, initial=-1e30), 0)
    share = np.where(inside, np.exp(scores - top), 0)
    share = share / np.maximum(share.sum(0), 1e-30)
    odds = (share * values).sum(0) + w["offset"]
    return (odds, (states, alive, trace, flip, inside, share, values)) if keep else odds


def gradients(w: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, slope) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """(log-odds, gradients of the weights, gradient of ``x``) for the loss whose slope at the log-odds ``slope`` gives."""
    odds, (states, alive, trace, flip, inside, share, values) = run(w, x, lengths, keep=True)
    d = np.asarray(slope(odds), np.float32)
    steps, _, n, _ = x.shape
    column = np.arange(n)
    d_value = share * d
    d_score = share * (values - (share * values).sum(0)) * d
    g = {"offset": np.array([d.sum()], np.float32), "gates": np.zeros_like(w["gates"]), "new": np.zeros_like(w["new"])}
    # back in the order of steps: what word k gives goes to step k on the left, to its mirror on the right
    on = np.zeros((2, steps, 2, n), np.float32)
    for k, part in enumerate((d_score, d_value)):
        on[k, :, 0] = part
        on[k, flip[inside], 1, np.broadcast_to(column, inside.shape)[inside]] = part[inside]
    g["look"] = np.einsum("tdn,tdnh->dh", on[0], states).ravel()
    g["out"] = np.einsum("tdn,tdnh->dh", on[1], states).ravel()
    look, out = w["look"].reshape(2, 1, HIDDEN), w["out"].reshape(2, 1, HIDDEN)
    dx = np.zeros_like(x)
    dh = np.zeros((2, n, HIDDEN), np.float32)
    gates_t, new_t = w["gates"].transpose(0, 2, 1), w["new"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        old, update, reset, fresh = trace[t]
        now = dh[:, :a] + on[0, t, :, :a, None] * look + on[1, t, :, :a, None] * out
        d_fresh = now * update * (1 - fresh * fresh)
        d_update = now * (fresh - old) * update * (1 - update)
        through = d_fresh @ new_t
        d_reset = through * old * reset * (1 - reset)
        d_both = np.concatenate((d_update, d_reset), -1)
        dx[t, :, :a] = np.concatenate((d_both, d_fresh), -1)
        g["gates"] += old.transpose(0, 2, 1) @ d_both
        g["new"] += (reset * old).transpose(0, 2, 1) @ d_fresh
        dh[:, :a] = now * (1 - update) + through * reset + d_both @ gates_t
    return odds, g, dx


def laid_out(products: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``run``'s input for windows, given as word slots in falling order of length: (x, lengths, the slots from either side)."""
    lengths = np.fromiter(map(len, slots), np.int64, len(slots))
    steps = int(lengths.max(initial=0))
    index = np.zeros((2, steps, len(slots)), np.int64)
    if steps:
        inside = np.arange(steps)[:, None] < lengths
        flat = np.concatenate(slots)
        first = np.cumsum(lengths) - lengths
        at = np.arange(steps)[:, None]
        index[0] = np.where(inside, flat[np.minimum(first + at, len(flat) - 1)], 0)
        index[1] = np.where(inside, flat[np.clip(first + lengths - 1 - at, 0, len(flat) - 1)], 0)
    half = 3 * HIDDEN
    x = np.empty((steps, 2, len(slots), half), np.float32)
    x[:, 0], x[:, 1] = products[index[0], :half], products[index[1], half:]
    return x, lengths, index


# -- scoring -------------------------------------------------------------------


@dataclass
class Model:
    weights: dict[str, np.ndarray] | None = None
    scale: float = 1.0
    shift: float = 0.0
    known: dict[bytes, int] = field(default_factory=dict, repr=False)
    products: np.ndarray | None = field(default=None, repr=False)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Places of words in ``products``; words not met yet are added, and all are forgotten when they are too many."""
        known = self.known
        out = [known.get(x, -1) for x in words]
        new = list(dict.fromkeys(x for x, s in zip(words, out, strict=True) if s < 0))
        if not new and self.products is not None:
            return np.array(out, np.int64)
        if len(known) + len(new) > KEPT_WORDS and known:
            known.clear()
            return self.slots(words)
        w = self.weights
        word, grams, begins = describe(new)
        made = (w["word"][word] + _sums(w["gram"], grams, begins)) @ w["into"] + w["bias"]
        need = len(known) + len(new)
        if self.products is None or need > len(self.products):
            grown = np.zeros((max(need, 2 * len(known), 1 << 12), 6 * HIDDEN), np.float32)
            if known:
                grown[: len(known)] = self.products[: len(known)]
            self.products = grown
        self.products[len(known) : need] = made
        known.update(zip(new, range(len(known), need), strict=True))
        return np.array([known[x] for x in words], np.int64)

    def odds(self, texts: list[list[bytes]]) -> np.ndarray:
        """The log-odds of the worst window of each text, given as words; a bounded number of words at a time."""
        worst = np.full(len(texts), -np.inf)
        held: list[tuple[int, list[bytes]]] = []
        size, most = 0, STRIDE * LANES

        def settle() -> None:
            slots = self.slots([x for _, piece in held for x in piece])
            lanes, at = [], 0
            for d, piece in held:
                lanes += [(d, slots[at + s : at + s + n]) for s, n in windows(len(piece))]
                at += len(piece)
            lanes.sort(key=lambda x: -len(x[1]))
            for k in range(0, len(lanes), LANES):
                part = lanes[k : k + LANES]
                x, lengths, _ = laid_out(self.products, [s for _, s in part])
                np.maximum.at(worst, [d for d, _ in part], run(self.weights, x, lengths))
            held.clear()

        for d, words in enumerate(texts):
            for a in range(0, max(len(words) - (WINDOW - STRIDE), 1), most):  # stretches of a long text
                held.append((d, words[a : a + most + WINDOW - STRIDE]))
                size += len(held[-1][1])
                if size >= most:
                    settle()
                    size = 0
        settle()
        return worst

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), _sigmoid(np.array(self.shift)))
        return _sigmoid(self.scale * self.odds(texts) + self.shift)


# -- learning ------------------------------------------------------------------


class _Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.mean, self.square, self.step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0

    def take(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float, rows: dict[str, np.ndarray]) -> None:
        """One step; of hashed tables only ``rows`` move."""
        self.step += 1
        warm = (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step)
        for k, grad in g.items():
            at = rows.get(k, slice(None))
            self.mean[k][at] = 0.9 * self.mean[k][at] + 0.1 * grad
            self.square[k][at] = 0.99 * self.square[k][at] + 0.01 * grad * grad
            w[k][at] -= rate * (warm * self.mean[k][at] / (np.sqrt(self.square[k][at]) + 1e-7) + DECAY * w[k][at])


def _table_gradient(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the sum of the values of each)."""
    own, inverse = np.unique(rows, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    counts = np.bincount(inverse)
    return own, np.add.reduceat(values[order], np.cumsum(counts) - counts, axis=0)


def _inputs(w: dict[str, np.ndarray], word: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return w["word"][word] + _sums(w["gram"], grams, begins)


def _part(grams: np.ndarray, begins: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram rows of the words ``which``, where each one's begin)."""
    n = counts[which]
    first = np.cumsum(n) - n
    return grams[np.arange(int(n.sum())) + np.repeat(begins[which] - first, n)], first


def train(texts: list[list[bytes]], y: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights learned from texts (as words) and 0/1 labels; both kinds weigh alike.

    Every round finds each text's worst window as the weights are, and learns from
    those ``PASSES`` times in mixed order, oftener where that would be under ``LEAST_STEPS`` steps in all.
    """
    w, rng = new_weights(seed), np.random.default_rng(seed)
    vocabulary = list(dict.fromkeys(x for t in texts for x in t))
    number = {x: k for k, x in enumerate(vocabulary)}
    word, grams, begins = describe(vocabulary)
    counts = np.diff(np.append(begins, len(grams)))
    spelled = [np.array([number[x] for x in t], np.int64) for t in texts]
    lanes = sorted(((d, x[s : s + n]) for d, x in enumerate(spelled) for s, n in windows(len(x))), key=lambda v: -len(v[1]))
    of = np.array([d for d, _ in lanes])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    # what few texts have would be learned by heart; its rows are zero and stay so, as those of what is met later
    texts_with = np.bincount(np.concatenate([np.unique(x) for x in spelled] or [np.zeros(0, np.int64)]), minlength=len(vocabulary))
    seen = {"word": np.bincount(word, texts_with, WORD_ROWS) >= LEAST_TEXTS, "gram": np.bincount(grams, np.repeat(texts_with, counts), GRAM_ROWS) >= LEAST_TEXTS}
    for k, which in seen.items():
        w[k][~which] = 0
    batches = -(-len(texts) // BATCH)
    passes = max(PASSES, -(-LEAST_STEPS // (ROUNDS * batches)))
    adam, steps = _Adam(w), ROUNDS * passes * batches
    for _ in range(ROUNDS):
        products = np.zeros((max(len(vocabulary), 1), 6 * HIDDEN), np.float32)
        for k in range(0, len(vocabulary), 1 << 14):
            which = np.arange(k, min(k + (1 << 14), len(vocabulary)))
            products[which] = _inputs(w, word[which], *_part(grams, begins, counts, which)) @ w["into"] + w["bias"]
        odds = np.concatenate([run(w, *laid_out(products, [s for _, s in lanes[k : k + LANES]])[:2]) for k in range(0, len(lanes), LANES)])
        # the longer window of equal ones
        order = np.lexsort((np.arange(len(of)), -odds, of))
        worst = order[np.unique(of[order], return_index=True)[1]]
        for turn in (rng.permutation(len(worst)) for _ in range(passes)):
            for b in range(0, len(turn), BATCH):
                chosen = np.sort(worst[turn[b : b + BATCH]])
                who = of[chosen]
                own, inverse = np.unique(np.concatenate([lanes[k][1] for k in chosen]), return_inverse=True)
                slots = np.split(inverse, np.cumsum([len(lanes[k][1]) for k in chosen])[:-1])
                mine, first = _part(grams, begins, counts, own)
                vectors = _inputs(w, word[own], mine, first)
                x, lengths, index = laid_out(vectors @ w["into"] + w["bias"], slots)
                slope = lambda z: weight[who] * (_sigmoid(z) - y[who]) / len(who)  # noqa: B023, E731
                _, g, dx = gradients(w, x, lengths, slope)
                d_products, half = np.zeros((len(own), 6 * HIDDEN), np.float32), 3 * HIDDEN
                inside = np.arange(x.shape[0])[:, None] < lengths
                rows: dict[str, np.ndarray] = {}
                if len(own):
                    for side, part in ((0, slice(None, half)), (1, slice(half, None))):
                        at, grad = _table_gradient(index[side][inside], dx[:, side][inside])
                        d_products[at, part] = grad
                    d_vectors = d_products @ w["into"].T
                    rows["word"], g["word"] = _table_gradient(word[own], d_vectors * seen["word"][word[own]][:, None])
                    shared = d_vectors / np.sqrt(np.maximum(counts[own], 1))[:, None]
                    if len(mine):
                        rows["gram"], g["gram"] = _table_gradient(mine, (np.repeat(shared, counts[own], axis=0) * seen["gram"][mine][:, None]).astype(np.float32))
                g["into"], g["bias"] = vectors.T @ d_products, d_products.sum(0)
                adam.take(w, g, RATE * (1 - adam.step / steps) + 1e-4, rows)
    return w


def calibrated(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of log-odds that fit labels best, by damped Newton steps, drawn a little towards (1, 0)."""
    a, b = 1.0, 0.0
    z = np.clip(odds, -15, 15)
    for _ in range(50):
        p = _sigmoid(a * z + b)
        e, v = weight * (p - y), weight * p * (1 - p)
        g = np.array([(e * z).sum() + 0.5 * (a - 1), e.sum() + 0.05 * b])
        h = np.array([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.05), b


def fit_rows(texts: list[list[bytes]], y: np.ndarray, shares: tuple[float, float]) -> Model:
    """A model of labelled texts; ``shares`` are those of labels 0 and 1 among all labelled rows."""
    if len(y) == 0 or y.min() == y.max():
        return Model(shift=0.0 if len(y) == 0 else 30.0 * (2 * float(y[0]) - 1))
    held = np.arange(len(y)) % 5 == 4
    if min((y[held] == 1).sum(), (y[held] == 0).sum(), (y[~held] == 1).sum(), (y[~held] == 0).sum()) == 0:
        held = np.zeros(len(y), bool)
    model = Model(train([t for t, h in zip(texts, held, strict=True) if not h], y[~held]))
    check = held if held.any() else ~held
    z, k = model.odds([t for t, c in zip(texts, check, strict=True) if c]), y[check]
    weight = np.where(k == 1, shares[1] / max((k == 1).mean(), 1e-9), shares[0] / max((k == 0).mean(), 1e-9))
    model.scale, model.shift = calibrated(z, k, weight)
    model.known, model.products = {}, None
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 0, folds: int = 5) -> Model:
    """Train on a bounded sample of the labelled rows outside fold ``fold``.

    Ids are drawn by hash, at most about half of ``max_rows`` of either label, and
    meet the texts as a broadcast of that bounded size; of rows that share an id the
    bound is kept by order of a hash of the text.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)").filter(crc_mod("id", folds) != fold)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    if not total:
        return Model()
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    # rows that the other label leaves free are taken up
    want = {k: max(max_rows / 2, max_rows - n.get(1 - k, 0)) for k in (0, 1)}
    drawn = known.filter(place < F.when(F.col("y") == 1, want[1] / max(n.get(1, 0), 1)).otherwise(want[0] / max(n.get(0, 0), 1))).limit(2 * max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes)
    rows = texts.join(F.broadcast(drawn), "id").select("id", "y", "text", F.xxhash64("id", "text").alias("place"))
    sample = rows.orderBy("place", "id", "y", "text").limit(max_rows).toPandas()
    words = [words_of(t) for t in sample["text"]]
    return fit_rows(words, sample["y"].to_numpy(np.float64), (n.get(0, 0) / total, n.get(1, 0) / total))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: every window of every text is read."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score([words_of(t) for t in batch]), dtype="float64")

    return docs.withColumn("score", of.asNondeterministic()(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, score, predicted) for every row of ``docs``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    own = docs.select(F.col(id_col), F.col(text_col))
    return scored(own, model, text_col).select(id_col, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
