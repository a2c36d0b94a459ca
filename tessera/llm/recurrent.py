"""Language-model scoring with a gated recurrent network in numpy.

Model.  One gated recurrent layer over words.  The output is factored by class:
P(word) = P(class | state) * P(word | class, state), classes holding words of
similar frequency.  Words outside the vocabulary share ``GROUPS`` entries, by
their spelling: texts of the sample are clustered by their byte pairs, and a word
belongs to the cluster whose pairs make it likeliest.  Which word of its group it
is comes from a mixture of the counts in the training corpus and of the group's
byte trigrams, which can spell any word (its weight is the share of words met
once, as by Good and Turing), so every text has a probability.

Training is truncated backpropagation through time on segments of ``SEGMENT``
words of all training documents: first on the driver, on those that a hash puts
first, ``SAMPLE_TOKENS`` words or so of about ``sample_docs`` documents; then,
distributed, on all others, so no training word is left out.  Counts, groups'
masses and base cover every word, too.  The state is carried across windows, in
training within a segment, in scoring through the whole document, so a score is
the whole document's log-likelihood.

Texts become numbers once, in a table that training and scoring read.

Corpus counts.  The unigram base needs the count of every token over all training
documents.  Counts are combined in the workers before they are shuffled; the
``HEAD`` most frequent words travel to the workers with the model, and rarer
words meet their counts in a join, so nothing that grows with the corpus is
broadcast.

Tokens are the words of a text, A-Z lower-cased, and one end token, which is not
a word: it is kept apart from all texts' words as an empty string.

Documents are laid out in lanes, read window by window, so a batch with one very
long text holds its numbers and one window, not a rectangle.

Defined results: a null text is an empty one, its only token the end; a text of
any length is scored whole; documents without an id are in no fold in particular (crc32 of ``null``); equal texts score
equally up to rounding; without training documents the base is log10(1/1) for
every token and the network keeps its initial weights; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, materialize, small_batches, word_list

END = ""
HEAD = 100_000
VOCABULARY = 4000
CLASSES = 63
HIDDEN = 24
WIDTH = 16
#: Entries that words outside the vocabulary share; texts of fewer words don't shape them.
GROUPS = 16
GROUP_WORDS = 20
#: The sample: documents' worth of segments, and words at most, as expected; words a segment.
SAMPLE_DOCS = 1500
SAMPLE_TOKENS = 1_000_000
SEGMENT = 512
WINDOW = 24
LANES = 64
SCORE_LANES = 512
SCORE_WINDOW = 64
EPOCHS = 2
FLUSH = 4_000_000
SCORED_TOKENS = 2_000_000
#: The pass over the corpus: words that a worker trains on at once, in how many lanes after the first ones of a shard, its step, shards while few and later, sums of weights that reach the driver.
PASS_TOKENS, PASS_LANES = 200_000, 384
PASS_RATE = 0.003
SHARD_TOKENS, FEW_SHARDS, LARGE_SHARD_TOKENS = 500_000, 64, 4_000_000
PASS_SUMS = 16
#: How the rows of words are stored.
ROW = np.dtype("<i4")
ROW_BYTES = ROW.itemsize
WEIGHTS = ("embed", "inner", "recur", "bias", "to_class", "class_bias", "to_word", "word_bias")


# -- corpus counts -----------------------------------------------------------


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts, A-Z lower-cased, as bytes; how many each text has); Arrow's blanks are those of ``WORD``."""
    lowered = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    pieces = pc.ascii_split_whitespace(pc.if_else(pc.equal(lowered, ""), None, lowered))
    return pieces.flatten().cast(pa.binary()), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) partial counts of texts, flushed when many words are held."""

    def out() -> pa.RecordBatch:
        words, c = pc.value_counts(pa.chunked_array(held, pa.binary())).flatten()
        return pa.record_batch({"word": pa.concat_arrays([words, pa.array([END.encode()], pa.binary())]).cast(pa.string()), "c": pa.concat_arrays([c, pa.array([ends], pa.int64())])})

    held, size, ends = [], 0, 0
    for batch in batches:
        held.append(_words(batch.column("text"))[0])
        size, ends = size + len(held[-1]), ends + len(batch)
        if size > FLUSH:
            yield out()
            held, size, ends = [], 0, 0
    if ends:
        yield out()


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) for all tokens of a column ``text``; the end token is the empty string."""
    return texts.select("text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


# -- the network -------------------------------------------------------------


#: States lie in (-1, 1); if no logit can pass this, single precision holds the exponentials as they are.
SAFE_LOGIT = 80.0
#: Rows of logits that stay in a core's cache.
LOGIT_ROWS = 2048


def _safe(weights: np.ndarray, bias: np.ndarray) -> bool:
    return (np.abs(weights).sum(0) + np.abs(bias)).max() <= SAFE_LOGIT


def _by_class(cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by class, where each class begins in it)."""
    order = np.argsort(cls.astype(np.uint16 if len(starts) <= 1 << 16 else np.int64), kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=len(starts) - 1))))


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The weights, a row for each output, so that those of a class lie together; the bias comes last, met by a column of ones of the states."""
    out = np.empty((len(bias), len(weights) + 1), weights.dtype)
    out[:, :-1] = weights.T
    out[:, -1] = bias
    return out


def _in_order(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states in an order, with a column of ones."""
    out = np.ones((len(order), states.shape[1] + 1), states.dtype)
    out[:, :-1] = states.take(order, 0)
    return out


def _log_softmax(states: np.ndarray, weights: np.ndarray, goals: np.ndarray, safe: bool) -> np.ndarray:
    """Log-probability of one goal column for each state."""
    size = len(weights)
    ones = np.ones(size, states.dtype)
    out, firsts = np.empty(len(goals), states.dtype), np.arange(min(len(goals), LOGIT_ROWS)) * size
    for i in range(0, len(goals), LOGIT_ROWS):
        logits = states[i : i + LOGIT_ROWS] @ weights.T
        at = logits.reshape(-1).take(firsts[: len(logits)] + goals[i : i + LOGIT_ROWS])
        if not safe:
            top = logits.max(1)
            logits -= top[:, None]
            at = at - top
        np.exp(logits, out=logits)
        out[i : i + LOGIT_ROWS] = at - np.log(logits @ ones)
    return out


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """The sigmoid of -x, in place: an exponential costs half of what a tanh does. Callers ignore its overflow: 1 / inf is 0."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Cell:
    """The recurrent layer with a lane to a column, so that each gate of all lanes is one block of memory.

    Gates are worked out from exponentials, so what goes into update and reset has its sign turned, and what goes into
    the candidate is -2 times as much: tanh x is twice the sigmoid of 2x, less 1.
    """

    words: np.ndarray  # V x (WIDTH + 1), with a column of ones
    inner: np.ndarray  # 3H x (WIDTH + 1), with the bias
    both: np.ndarray  # 2H x H
    fresh: np.ndarray  # H x H

    def step(self, state: np.ndarray, given: np.ndarray):
        """(state after, gates); ``given``, a row for each lane, is from ``words``."""
        n = len(state)
        pre = self.inner @ given.T
        both, c = pre[: 2 * n], pre[2 * n :]
        both += self.both @ state
        _sigmoid_of_negative(both)
        z, r = both[:n], both[n:]
        c += self.fresh @ (r * state)
        _sigmoid_of_negative(c)
        c *= 2
        c -= 1
        after = state - c
        after *= z
        after += c
        return after, (z, r, c)


def _turned(hidden: int, dtype: np.dtype) -> np.ndarray:
    """What ``Cell`` takes the gates' weights times."""
    return np.repeat(np.array([-1, -2], dtype), [2 * hidden, hidden])


@dataclass
class Network:
    """Weights; row 0 of the words is the end token, then come the groups of words outside the vocabulary, then the vocabulary."""

    embed: np.ndarray  # V x WIDTH
    inner: np.ndarray  # WIDTH x 3H: update, reset, candidate
    recur: np.ndarray  # H x 3H
    bias: np.ndarray  # 3H
    to_class: np.ndarray  # H x C
    class_bias: np.ndarray
    to_word: np.ndarray  # H x V, words in class order
    word_bias: np.ndarray
    starts: np.ndarray  # class -> its first word; one more at the end
    class_of: np.ndarray  # word -> class

    def cell(self) -> Cell:
        n = self.recur.shape[0]
        turned = _turned(n, self.recur.dtype)
        words = np.ones((len(self.embed), self.embed.shape[1] + 1), self.embed.dtype)
        words[:, :-1] = self.embed
        recur = np.ascontiguousarray((self.recur * turned).T)
        return Cell(words, np.ascontiguousarray((np.concatenate((self.inner, self.bias[None])) * turned).T), recur[: 2 * n], recur[2 * n :])

    @np.errstate(over="ignore")
    def step(self, state: np.ndarray, word_in: np.ndarray):
        """One step of lanes in rows; word_in is the input's share of the gates (rows of ``gates()``)."""
        own = replace(self.cell(), inner=np.diag(_turned(state.shape[1], word_in.dtype)))
        after, gate = own.step(state.T, word_in)
        return after.T, tuple(x.T for x in gate)

    def gates(self) -> np.ndarray:
        """For every word, what it adds to the gates before activation."""
        return self.embed @ self.inner + self.bias

    def log_likelihood(self, states: np.ndarray, goals: np.ndarray) -> np.ndarray:
        """Natural log-probability of each goal word after its state."""
        cls = self.class_of[goals]
        order, edges = _by_class(cls, self.starts)
        states, goals = _in_order(states, order), goals[order]
        found = _log_softmax(states, _with_bias(self.to_class, self.class_bias), cls[order], _safe(self.to_class, self.class_bias))
        safe, to_word = _safe(self.to_word, self.word_bias), _with_bias(self.to_word, self.word_bias)
        for c in np.flatnonzero(np.diff(edges)):
            rows, a, b = slice(edges[c], edges[c + 1]), self.starts[c], self.starts[c + 1]
            if b - a > 1:
                found[rows] += _log_softmax(states[rows], to_word[a:b], goals[rows] - a, safe)
        out = np.empty_like(found)
        out[order] = found
        return out


def new_network(counts: np.ndarray, classes: int = CLASSES, hidden: int = HIDDEN, width: int = WIDTH, seed: int = 11) -> Network:
    """Initial weights; words (rows) come in order of class, ``counts`` set the biases.

    Classes split the vocabulary so that square roots of counts add up alike.
    """
    rng = np.random.default_rng(seed)
    n = len(counts)
    weight = np.cumsum(np.sqrt(counts.astype(np.float64) + 1))
    class_of = np.minimum((weight / weight[-1] * classes).astype(np.int64), classes - 1)
    class_of = np.unique(class_of, return_inverse=True)[1]
    k = int(class_of[-1]) + 1
    starts = np.searchsorted(class_of, np.arange(k + 1))
    mass = np.bincount(class_of, counts + 1.0, k)
    f32 = lambda x: x.astype(np.float32)
    return Network(
        f32(rng.normal(0, 0.3, (n, width))), f32(rng.normal(0, width**-0.5, (width, 3 * hidden))), f32(rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))),
        np.zeros(3 * hidden, np.float32), np.zeros((hidden, k), np.float32), f32(np.log(mass / mass.sum())), np.zeros((hidden, n), np.float32),
        f32(np.log((counts + 1.0) / mass[class_of])), starts, class_of,
    )


def _lanes(docs: list[np.ndarray], lanes: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows over documents laid out in lanes: (words in, goals, document or -1, fresh), each window x lanes in use.

    Documents follow each other in a lane; ``fresh`` marks a document's first
    step, where the state starts anew.  Longest documents are dealt first, and
    lanes are in order of their load, so those still in use are the first ones.
    """
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    free, rows = [(0, lane) for lane in range(lanes)], [[] for _ in range(lanes)]
    for k in order:
        load, lane = heapq.heappop(free)
        rows[lane].append(k)
        heapq.heappush(free, (load + len(docs[k]), lane))
    rows.sort(key=lambda own: -sum(len(docs[k]) for k in own))  # lanes that end early come last
    loads = np.array([sum(len(docs[k]) for k in own) for own in rows])
    listed = [k for own in rows for k in own if len(docs[k])]
    sizes = np.array([len(docs[k]) for k in listed], np.int64)
    goal = np.concatenate([docs[k] for k in listed] or [np.zeros(0)]).astype(np.int32)  # lane after lane
    owner, fresh = np.repeat(np.array(listed, np.int32), sizes), np.zeros(len(goal), bool)
    fresh[np.cumsum(sizes) - sizes] = True
    before = np.where(fresh, 0, np.roll(goal, 1)).astype(np.int32)
    starts = np.cumsum(loads) - loads
    for i in range(0, int(loads[0]), window):
        live = int(np.searchsorted(-loads, -i))
        step = np.arange(i, min(i + window, int(loads[0])))[:, None]
        at = starts[:live] + step
        if i + len(step) <= loads[live - 1]:
            yield before[at], goal[at], owner[at], fresh[at]
        else:
            ended = step >= loads[:live]
            at[ended] = 0
            yield np.where(ended, 0, before[at]), np.where(ended, 0, goal[at]), np.where(ended, -1, owner[at]), fresh[at] & ~ended


@np.errstate(over="ignore")
def score_documents(net: Network, docs: list[np.ndarray], gates: np.ndarray | None = None, lanes: int = SCORE_LANES) -> np.ndarray:
    """Natural log-likelihood of each document, a sequence of word numbers ending in 0; ``gates`` are not needed any more, as a step works out its own."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    lanes = min(lanes, len(docs))
    hidden = net.recur.shape[0]
    cell = net.cell()
    state = np.zeros((hidden, lanes), np.float32)
    for given, goals, doc, first in _lanes(docs, lanes, SCORE_WINDOW):
        state = np.ascontiguousarray(state[:, : goals.shape[1]])
        states, fresh = np.empty((*goals.shape, hidden), np.float32), first.any(1)
        for t in range(len(goals)):
            if fresh[t]:
                state[:, first[t]] = 0
            state, _ = cell.step(state, cell.words.take(given[t], 0))
            states[t] = state.T
        used = _used(doc >= 0)
        got = net.log_likelihood(states.reshape(-1, hidden)[used], goals.reshape(-1)[used])
        total += np.bincount(doc.reshape(-1)[used], got, len(docs))
    return total


def _used(cells: np.ndarray) -> np.ndarray | slice:
    """Where steps and lanes are in use, as an index."""
    return slice(None) if cells.all() else np.flatnonzero(cells)


def train(docs: list[np.ndarray], counts: np.ndarray, epochs: int = EPOCHS, lanes: int = LANES, window: int = WINDOW, rate: float = 0.01, seed: int = 11, **shape) -> Network:
    """A network that learned from documents, which are number sequences ending in 0."""
    return descend(new_network(counts, seed=seed, **shape), docs, epochs, lanes, window, rate)


def descend(net: Network, docs: list[np.ndarray], epochs: int = 1, lanes: int = LANES, window: int = WINDOW, rate: float = 0.01) -> Network:
    """Truncated backpropagation through time with Adam; changes ``net``."""
    m1, m2, one = ({k: np.zeros_like(getattr(net, k)) for k in WEIGHTS} for _ in range(3))
    steps = 0
    if not docs:
        return net
    lanes = min(lanes, len(docs))
    for epoch in range(epochs):
        state = np.zeros((lanes, net.recur.shape[0]), np.float32)
        for given, goals, doc, first in _lanes(docs, lanes, window):
            grads, state = gradients(net, state[: goals.shape[1]], given, goals, doc >= 0, first)
            steps += 1
            pace = rate * (1 - 0.8 * epoch / max(1, epochs))
            second = (0.01 / (1 - 0.99**steps)) ** 0.5
            pace *= 0.1 / (1 - 0.9**steps) / second
            for k in WEIGHTS:  # in place: at this size, fresh arrays cost more than the sums; moments are kept as plain sums
                g, a, w = grads[k], one[k], getattr(net, k)
                np.maximum(np.minimum(g, 1, out=a), -1, out=a)
                m1[k] *= 0.9
                m1[k] += a
                np.multiply(a, a, out=a)
                m2[k] *= 0.99
                m2[k] += a
                np.sqrt(m2[k], out=a)
                a += 1e-7 / second
                np.divide(m1[k], a, out=a)
                a *= pace
                w -= a
    return net


@np.errstate(over="ignore")
def gradients(net: Network, state: np.ndarray, given: np.ndarray, goals: np.ndarray, used: np.ndarray, first: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(gradients of the mean negative log-likelihood of the goals in use, state after) for one window."""
    size, lanes = goals.shape
    hidden, dtype = net.recur.shape[0], net.recur.dtype
    cell, words = net.cell(), given.reshape(-1)
    entry, after, gate = np.empty((size, hidden, lanes), dtype), np.empty((size, lanes, hidden), dtype), []
    rows = cell.words.take(given, 0)
    fresh, now = first.any(1), state.T
    for t in range(size):
        entry[t] = now
        if fresh[t]:
            entry[t][:, first[t]] = 0
        now, own = cell.step(entry[t], rows[t])
        after[t] = now.T
        gate.append(own)
    grads = {k: np.zeros_like(getattr(net, k)) for k in WEIGHTS}
    at, n = _used(used), max(1, used.sum())
    d_after = np.zeros((size * lanes, hidden), dtype)
    d_after[at] = _output_gradient(net, after.reshape(-1, hidden)[at], goals.reshape(-1)[at], grads) / n
    for k in ("to_class", "class_bias", "to_word", "word_bias"):
        grads[k] /= n
    d_after = d_after.reshape(size, lanes, hidden)
    to_both, to_fresh, inner = net.recur[:, : 2 * hidden].copy(), net.recur[:, 2 * hidden :].copy(), net.inner.T.copy()
    back, d_inner = np.zeros((hidden, lanes), dtype), np.zeros_like(cell.inner)
    d_gates, d_embed = np.empty((3 * hidden, lanes), dtype), np.empty((size, lanes, net.embed.shape[1]), dtype)
    dz, dr, dc = d_gates[:hidden], d_gates[hidden : 2 * hidden], d_gates[2 * hidden :]
    recur_both, recur_fresh = np.zeros_like(to_both), np.zeros_like(to_fresh)
    for t in range(size - 1, -1, -1):
        (z, r, c), h = gate[t], entry[t]
        back += d_after[t].T
        rest = 1 - z
        np.subtract(h, c, out=dz)
        dz *= back
        dz *= z
        dz *= rest
        np.multiply(c, c, out=dc)
        np.subtract(1, dc, out=dc)
        dc *= back
        dc *= rest
        d_reset, reset = to_fresh @ dc, r * h
        np.subtract(1, r, out=dr)
        dr *= reset
        dr *= d_reset
        recur_both += h @ d_gates[: 2 * hidden].T
        recur_fresh += reset @ dc.T
        d_inner += d_gates @ rows[t]
        d_embed[t] = d_gates.T @ inner
        back *= z
        d_reset *= r
        back += d_reset
        back += to_both @ d_gates[: 2 * hidden]
        if fresh[t]:
            back[:, first[t]] = 0
    grads["recur"], grads["inner"], grads["bias"] = np.concatenate((recur_both, recur_fresh), 1), d_inner[:, :-1].T, d_inner[:, -1]
    order = np.argsort(words.astype(np.uint16 if len(net.embed) <= 1 << 16 else words.dtype), kind="stable")
    words = words[order]
    starts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    grads["embed"][words[starts]] = np.add.reduceat(d_embed.reshape(len(words), -1)[order], starts, axis=0)
    return grads, now.T


def _output_gradient(net: Network, states: np.ndarray, goals: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
    """Adds the output weights' gradients of the negative log-likelihood; returns the states'."""
    cls = net.class_of[goals]
    order, edges = _by_class(cls, net.starts)
    sizes, ones = np.diff(net.starts), np.ones(max(len(net.starts), np.diff(net.starts).max()), states.dtype)
    found, named = np.empty_like(states), np.zeros_like(states)
    states, goals, cls = _in_order(states, order), goals[order], cls[order]

    def errors(own: np.ndarray, weights: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
        """Each state's probabilities, less 1 at the goal; ``at`` are flat places."""
        p = own @ weights.T
        if not safe:
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p *= np.reciprocal(p @ ones[: p.shape[1]])[:, None]
        p.reshape(-1)[at] -= 1
        return p

    weights, safe = _with_bias(net.to_class, net.class_bias), _safe(net.to_class, net.class_bias)
    grad, at = np.zeros(weights.shape, grads["to_class"].dtype), np.arange(min(len(goals), LOGIT_ROWS)) * len(weights)
    for i in range(0, len(goals), LOGIT_ROWS):
        own = states[i : i + LOGIT_ROWS]
        p = errors(own, weights, at[: len(own)] + cls[i : i + LOGIT_ROWS], safe)
        grad += p.T @ own
        np.matmul(p, weights[:, :-1], out=found[i : i + LOGIT_ROWS])
    grads["to_class"] += grad[:, :-1].T
    grads["class_bias"] += grad[:, -1]
    weights, safe = _with_bias(net.to_word, net.word_bias), _safe(net.to_word, net.word_bias)
    grad, at = np.zeros(weights.shape, grads["to_word"].dtype), (np.arange(len(goals)) - edges[cls]) * sizes[cls] + goals - net.starts[cls]
    for c in np.flatnonzero((np.diff(edges) > 0) & (sizes > 1)).tolist():  # of one word, it is certain, and nothing is to be learned
        rows, words = slice(edges[c], edges[c + 1]), slice(net.starts[c], net.starts[c + 1])
        own, to_word = states[rows], weights[words]
        p = errors(own, to_word, at[rows], safe)
        grad[words] = p.T @ own
        np.matmul(p, to_word[:, :-1], out=named[rows])
    grads["to_word"] += grad[:, :-1].T
    grads["word_bias"] += grad[:, -1]
    found += named
    out = np.empty_like(found)
    out[order] = found
    return out


# -- spelling ----------------------------------------------------------------


SYMBOLS = 64


@dataclass
class Speller:
    """A byte trigram model of words, over the most frequent bytes and a symbol for all others."""

    symbol: np.ndarray  # byte -> symbol
    table: np.ndarray  # natural log-probability by the two symbols before and the symbol
    other: float  # what a byte under the shared symbol costs besides

    def contexts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat index into the table of every byte of the words and of the line end that closes each; where others and words start."""
        raw = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", np.uint8)
        s = self.symbol[raw].astype(np.int64)
        end = self.symbol[10]
        one = s[:-1]
        two = np.where(one == end, end, np.concatenate(([end], s[:-2])))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return (two * SYMBOLS + one) * SYMBOLS + s[1:], s[1:] == SYMBOLS - 1, np.cumsum(sizes) - sizes, sizes

    def spell(self, words: list[bytes]) -> np.ndarray:
        """Natural log-probability of each word's spelling."""
        if not words:
            return np.zeros(0)
        at, odd, starts, _ = self.contexts(words)
        return np.add.reduceat(self.table[at] + self.other * odd, starts)


def speller(words: list[bytes]) -> Speller:
    """Trigrams interpolated with bigrams, and those with single symbols, learned from distinct words."""
    seen = np.bincount(np.frombuffer(b"\n".join(words) + b"\n", np.uint8), minlength=256)
    seen[10] = max(1, seen.max(initial=0)) + 1  # the line end always has a symbol of its own
    symbol = np.full(256, SYMBOLS - 1, np.uint8)
    symbol[np.argsort(-seen, kind="stable")[: SYMBOLS - 1]] = np.arange(SYMBOLS - 1)
    made = Speller(symbol, np.zeros(SYMBOLS**3), -float(np.log(256 - SYMBOLS + 1)))
    cube = np.zeros(SYMBOLS**3)
    if words:
        cube += np.bincount(made.contexts(words)[0], minlength=SYMBOLS**3)
    cube = cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pair = cube.sum(0)
    single = (pair.sum(0) + 0.5) / (pair.sum() + 0.5 * SYMBOLS)
    pair_p = (pair + 4 * single) / (pair.sum(1, keepdims=True) + 4)
    made.table = np.log((cube + 4 * pair_p) / (cube.sum(2, keepdims=True) + 4)).astype(np.float32).reshape(-1)
    return made


@dataclass
class Tail:
    """Words outside the vocabulary: their groups, and their probability within a group."""

    speller: Speller
    profile: np.ndarray  # byte pair x group: natural log-probability of the pair in the group's texts
    tables: np.ndarray  # group x byte trigram: the group's spelling
    seen: np.ndarray  # group: log10 of a counted word's share of the group, for each time it was counted
    new: np.ndarray  # group: log10 of the share that is spelled

    def groups(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        at, _, starts, _ = self.speller.contexts(words)
        return np.add.reduceat(self.profile[at % SYMBOLS**2], starts, axis=0).argmax(1)

    def spelled(self, words: list[bytes], groups: np.ndarray) -> np.ndarray:
        """log10 of the spelled share of each word's probability within its group."""
        if not words:
            return np.zeros(0)
        at, odd, starts, sizes = self.speller.contexts(words)
        return np.add.reduceat(self.tables[np.repeat(groups, sizes), at] + self.speller.other * odd, starts) / np.log(10) + self.new[groups]

    def chance(self, counts: np.ndarray, groups: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of each word's probability within its group."""
        return np.where(counts > 0, np.log10(10.0 ** self.seen[groups] * counts + 10.0**spelled), spelled)


def tail_groups(made: Speller, texts: list[list[bytes]], words: list[bytes], groups: int = GROUPS, seed: int = 11) -> Tail:
    """Groups of spelling, learned from texts and from the distinct ``words``; their masses are not known yet.

    Texts are clustered by the square roots of their shares of byte pairs.
    """
    texts = [t for t in texts if len(t) >= GROUP_WORDS]
    groups = max(1, min(groups, len(texts) // 8))
    pairs = np.array([np.bincount(made.contexts(t)[0] % SYMBOLS**2, minlength=SYMBOLS**2) for t in texts], np.float32).reshape(-1, SYMBOLS**2)
    x = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    rng = np.random.default_rng(seed)
    kind = np.zeros(len(x), np.int64)
    if groups > 1:
        centre = x[np.sort(rng.permutation(len(x))[:groups])]
        for _ in range(15):
            kind = (x @ centre.T).argmax(1)
            centre = np.array([x[kind == k].sum(0) if (kind == k).any() else x[rng.integers(len(x))] for k in range(groups)])
            centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-12
    every = pairs.sum(0, dtype=np.float64) + 1
    profile = np.array([pairs[kind == k].sum(0) + SYMBOLS / 2 * every / every.sum() for k in range(groups)])
    out = Tail(made, np.ascontiguousarray(np.log(profile / profile.sum(1, keepdims=True)).T.astype(np.float32)), np.zeros((groups, 0), np.float32), np.zeros(groups), np.zeros(groups))
    own = out.groups(words)
    cubes = [np.bincount(made.contexts(listed)[0], minlength=SYMBOLS**3) if (listed := [words[i] for i in np.flatnonzero(own == k)]) else np.zeros(SYMBOLS**3) for k in range(groups)]
    whole = np.exp(made.table.astype(np.float64)).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    for k, cube in enumerate(cubes):
        cube = cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        cubes[k] = np.log((cube + 8 * whole) / (cube.sum(2, keepdims=True) + 8)).astype(np.float32).reshape(-1)
    return replace(out, tables=np.array(cubes))


# -- scoring the corpus ------------------------------------------------------


@dataclass
class Model:
    """The network and what is known of the ``HEAD`` words, by rank; the first ones are the vocabulary."""

    net: Network
    gates: np.ndarray
    lexicon: Lexicon
    base: np.ndarray  # base log10 probability by rank; the last entry, for words outside the head, is 0
    rarer: np.ndarray  # log10 probability within its group, by rank; 0 in the vocabulary
    base_end: float


@dataclass
class Lexicon:
    """From words to rows of the network."""

    rank: dict[bytes, int]
    vocabulary: int
    tail: Tail
    row: np.ndarray  # by rank

    def numbers(self, words: list[bytes], ended: bool = True) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
        """(rows for words and the end, ranks with -1 for words outside the head, groups of those)."""
        ranks = _ranks(self.rank, words)
        at = np.flatnonzero(ranks < 0)
        other = list(dict.fromkeys(words[i] for i in at))
        groups = dict(zip(other, self.tail.groups(other).tolist(), strict=True))
        out = np.zeros(len(words) + ended, np.int32)
        out[: len(words)] = self.row[ranks]
        if len(at):
            out[at] = [1 + groups[words[i]] for i in at]
        return out, ranks, groups


def frequent_words(counts: DataFrame, head: int) -> list:
    """Rows (word, c) of at most ``head`` words, down to a count that takes in whole ties; most frequent first."""
    above = 0
    least = None
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head).collect():
        above += r["n"]
        if above > head:
            break
        least = r["c"]
    if least is None:
        return []
    return sorted(counts.filter((F.col("c") >= least) & (F.col("word") != END)).collect(), key=lambda r: (-r["c"], r["word"]))


def _own_name(doc: str | None, text: bytes) -> str:
    """What a document's segments are drawn by."""
    from xxhash import xxh64_intdigest

    return f"{doc}:{xxh64_intdigest(text)}"


def _place(own: str, k: int) -> float:
    """A number in [0, 1) for the segment of a document that starts at its word k."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{own}:{k}") / 2.0**64


def _segments(batches: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
    """(place, text, ended): the segments of texts whose place lies below ``share``."""
    names = ["place", "text", "ended"]
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            own = _own_name(doc, (text or "").encode("utf-8", "surrogatepass"))
            most = (len(text or "") + 1) // 2  # a word takes a character and a blank
            drawn = [(place, k) for k in range(0, most + 1, SEGMENT) if (place := _place(own, k)) < share]
            words = word_list(text, lower=True) if drawn else []  # few texts are cut up for a small share
            out += [(place, b" ".join(words[k : k + SEGMENT]), k + SEGMENT > len(words)) for place, k in drawn if k <= len(words)]
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)


def _numbered_segments(batches: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
    """(place, numbers): the other segments, of documents (own, numbers) whose words and end are rows of the network."""
    for batch in batches:
        out = []
        for own, numbers in zip(batch["own"], batch["numbers"], strict=True):
            for k in range(0, len(numbers) // ROW_BYTES, SEGMENT):
                place = _place(own, k)
                if place >= share:
                    out.append((place, numbers[k * ROW_BYTES : (k + SEGMENT) * ROW_BYTES]))
        yield pd.DataFrame(out, columns=["place", "numbers"])


def fit(
    texts: DataFrame, counts: DataFrame, total: int, distinct: int, sample_docs: int = SAMPLE_DOCS, head: int = HEAD, vocabulary: int = VOCABULARY, groups: int = GROUPS, **options
) -> tuple[Model, float]:
    """(a model that has learned from the first segments of ``texts`` (doc_id, text), by place, and their share); vocabulary, masses and base come from all counts."""
    frequent = frequent_words(counts, head)
    norm = float(np.log10(max(1, total + distinct + 1)))
    ends = next((r["c"] for r in counts.filter(F.col("word") == END).collect()), 0)
    words = [r["word"].encode("utf-8", "surrogatepass") for r in frequent]
    c = np.array([r["c"] for r in frequent], np.float64)
    vocabulary = min(vocabulary, len(words))
    rank = {w: k for k, w in enumerate(words)}
    first = min(1.0, sample_docs / max(1, ends), SAMPLE_TOKENS / max(1, total))  # every training document has one end
    drawn = texts.select(F.col("doc_id").cast("string"), "text").mapInPandas(lambda batches: _segments(batches, first), "place double, text binary, ended boolean")
    sample = drawn.toPandas().sort_values(["place", "text"], kind="stable")
    parts = [bytes(t).split() for t in sample["text"]]
    tail = tail_groups(speller(words[vocabulary:]), parts, words[vocabulary:], groups)
    mass, once = group_masses(counts, rank, vocabulary, tail)
    spelled = np.where(mass > 0, np.clip(once / np.maximum(mass, 1), 0.01, 0.9), 1.0)
    tail = replace(tail, seen=np.log10(np.where(mass > 0, (1 - spelled) / np.maximum(mass, 1), 1e-300)), new=np.log10(spelled))
    own = tail.groups(words[vocabulary:])
    rows = np.concatenate((1 + len(mass) + np.arange(vocabulary), 1 + own, [0])).astype(np.int32)
    lexicon = Lexicon(rank, vocabulary, tail, rows)
    docs = [lexicon.numbers(w, e)[0] for w, e in zip(parts, sample["ended"].tolist(), strict=True)]
    net = train([d for d in docs if len(d)], np.concatenate(([ends], mass, c[:vocabulary])), **options)
    rarer = tail.chance(c[vocabulary:], own, tail.spelled(words[vocabulary:], own))
    return Model(net, net.gates(), lexicon, np.concatenate((np.log10(c + 1) - norm, [0.0])), np.concatenate((np.zeros(vocabulary), rarer, [0.0])), float(np.log10(ends + 1) - norm)), first


def group_masses(counts: DataFrame, rank: dict[bytes, int], vocabulary: int, tail: Tail) -> tuple[np.ndarray, np.ndarray]:
    """By group: how often words outside the vocabulary were counted, and how many were counted once."""
    sent = counts.sparkSession.sparkContext.broadcast((list(rank)[:vocabulary], tail))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tail = sent.value
        known, n = pa.array([END.encode(), *known], pa.binary()), tail.profile.shape[1]
        mass, once = np.zeros(n), np.zeros(n)
        for batch in batches:
            words = batch.column("word").cast(pa.binary())
            batch = batch.filter(pc.invert(pc.is_in(words, value_set=known)))
            own, c = tail.groups(batch.column("word").cast(pa.binary()).to_pylist()), batch.column("c").to_numpy().astype(np.float64)
            mass += np.bincount(own, c, n)
            once += np.bincount(own, c == 1, n)
        yield pa.record_batch({"group": pa.array(np.arange(n, dtype=np.int32)), "mass": mass, "once": once})

    found = counts.mapInArrow(add, "group int, mass double, once double").groupBy("group").agg(F.sum("mass").alias("mass"), F.sum("once").alias("once"))
    mass, once = np.zeros(tail.profile.shape[1]), np.zeros(tail.profile.shape[1])
    for r in found.collect():
        mass[r["group"]], once[r["group"]] = r["mass"], r["once"]
    return mass, once


def _dealt(segments: DataFrame, shards: int) -> DataFrame:
    """(numbers, shard): each shard in a partition of its own, in order."""
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int"))
    return dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "numbers").select("numbers", "shard")


def whole_pass(net: Network, segments: DataFrame, total: int) -> Network:
    """``net`` after one pass over ``segments`` (place, numbers): shards train from it apart, and their weights are averaged by tokens.

    Shards and their order depend on the rows alone, not on how they were partitioned.
    """
    shards = max(1, min(FEW_SHARDS, -(-total // SHARD_TOKENS)), -(-total // LARGE_SHARD_TOKENS))
    sent = segments.sparkSession.sparkContext.broadcast(net)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = sent.value
        fresh = lambda: replace(first, **{k: getattr(first, k).copy() for k in WEIGHTS})
        own, held, size, tokens, shard = fresh(), [], 0, 0, -1

        def out() -> pd.DataFrame:
            descend(own, held, lanes=PASS_LANES if tokens else LANES, rate=PASS_RATE)
            flat = np.concatenate([getattr(own, k).reshape(-1) for k in WEIGHTS]).astype(np.float64)
            return pd.DataFrame({"part": [shard % PASS_SUMS], "shard": [shard], "n": [tokens + size], "w": [flat.tobytes()]})

        for batch in batches:
            for row, at in zip(batch["numbers"], batch["shard"].tolist(), strict=True):
                if at != shard:
                    if tokens + size:
                        yield out()
                    own, held, size, tokens, shard = fresh(), [], 0, 0, at
                held.append(np.frombuffer(row, ROW))
                size += len(held[-1])
                if size >= PASS_TOKENS:
                    descend(own, held, lanes=PASS_LANES if tokens else LANES, rate=PASS_RATE)
                    held, size, tokens = [], 0, tokens + size
        if tokens + size:
            yield out()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums by part of a stream in order of part and shard; one sum is held at a time."""
        part, n, total = -1, 0, np.zeros(0)
        for batch in batches:
            for at, tokens, w in zip(batch["part"].tolist(), batch["n"].tolist(), batch["w"], strict=True):
                if at != part:
                    if n:
                        yield pd.DataFrame({"part": [part], "n": [n], "w": [total.tobytes()]})
                    part, n, total = at, 0, 0.0
                n, total = n + tokens, total + tokens * np.frombuffer(w)
        if n:
            yield pd.DataFrame({"part": [part], "n": [n], "w": [total.tobytes()]})

    learned = _dealt(segments, shards).mapInPandas(learn, "part int, shard int, n long, w binary")
    ordered = learned.repartition("part").sortWithinPartitions("part", "shard")
    sums = sorted(ordered.mapInPandas(add, "part int, n long, w binary").collect(), key=lambda r: r["part"])
    if not sums:
        return net
    mean, at, found = sum(np.frombuffer(r["w"]) for r in sums) / sum(r["n"] for r in sums), 0, {}
    for k in WEIGHTS:
        old = getattr(net, k)
        found[k] = mean[at : at + old.size].reshape(old.shape).astype(old.dtype)
        at += old.size
    return replace(net, **found)


def _ranks(rank: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(rank.get, words, repeat(-1)), np.int32, len(words))


def _encode_batches(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: tokens, tokens in the head, their base score, what they cost within their groups, the other words' counts, groups and spelling, and all tokens as rows of the network.

    A batch's words are looked up together, and each other word is spelled once a batch.
    """
    lexicon = model.lexicon
    tail, head = lexicon.tail, pa.array(list(lexicon.rank), pa.binary())
    for batch in batches:
        texts = batch.column("text")
        words, sizes = _words(texts)
        n, owner = len(batch), np.repeat(np.arange(len(batch)), sizes)
        ranks = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy(zero_copy_only=False)
        rows = lexicon.row[ranks]
        at = np.flatnonzero(ranks < 0)
        met = words.take(pa.array(at)).dictionary_encode()
        other, which = met.dictionary.to_pylist(), met.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        groups = tail.groups(other)
        rows[at] = 1 + groups[which]
        spelled = tail.spelled(other, groups)
        pairs, times = np.unique(owner[at] * max(1, len(other)) + which, return_counts=True)
        of, which = np.divmod(pairs, max(1, len(other)))
        numbers = np.zeros(len(words) + n, ROW)  # each text's end is left 0
        numbers[np.arange(len(words)) + owner] = rows
        offsets = lambda lengths: np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        listed = lambda values: pa.ListArray.from_arrays(pa.array(offsets(np.bincount(of, minlength=n))), values)  # noqa: E731, B023
        raw = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
        yield pa.record_batch({
            "uid": batch.column("uid"), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
            "own": pa.array([_own_name(doc, text) for doc, text in zip(batch.column("doc_id").to_pylist(), raw, strict=True)], pa.string()),
            "n_tokens": pa.array(sizes + 1), "head_tokens": pa.array(np.bincount(owner, ranks >= 0, n).astype(np.int64) + 1),
            "head_base": pa.array(model.base_end + np.bincount(owner, model.base[ranks], n)), "odd": pa.array(np.bincount(owner, model.rarer[ranks], n)),
            "words": listed(met.dictionary.take(pa.array(which)).cast(pa.string())), "ns": listed(pa.array(times.astype(np.int64))),
            "groups": listed(pa.array(groups[which].astype(np.int32))), "spelled": listed(pa.array(spelled[which])),
            "numbers": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets((sizes + 1) * ROW_BYTES)), pa.py_buffer(numbers)]),
        })


def _score_batches(model: Model, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_score_numbers`` of texts."""
    encoded = _encode_batches(model, (pa.RecordBatch.from_pandas(batch, preserve_index=False) for batch in batches))
    yield from _score_numbers(model.net, (batch.to_pandas() for batch in encoded))


def _score_numbers(net: Network, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The network's score of texts that are numbers, and the other columns but for what it is made of.

    Many are scored together: a long document runs beside others instead of alone.
    """
    held, size = [], 0

    def out() -> pd.DataFrame:
        got = pd.concat(held, ignore_index=True)
        numbers = [np.frombuffer(x, ROW) for x in got.pop("numbers")]
        return got.assign(score=score_documents(net, numbers) / np.log(10) + got.pop("odd"))

    for batch in batches:
        held.append(batch)
        size += int(batch["n_tokens"].sum())
        if size > SCORED_TOKENS:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``; fold ``fold`` is not learned from."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held_out = crc_mod("doc_id", folds) == fold
    learned = rows.filter(~held_out)
    counts = materialize(token_counts(learned), "counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = totals["n"] or 0, totals["v"]
    model, first = fit(learned, counts, total, distinct, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encode_batches(sent.value, batches)

    id_type = docs.schema[id_col].dataType
    made = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("string"), held_out.alias("held_out"), "text").mapInArrow(
        encode,
        "uid long, doc_id string, held_out boolean, own string, n_tokens long, head_tokens long, head_base double, odd double, "
        "words array<string>, ns array<long>, groups array<int>, spelled array<double>, numbers binary",
    )
    encoded = materialize(made, "encoded")
    net = model.net
    if first < 1:
        segments = encoded.filter("NOT held_out").select("own", "numbers").mapInPandas(lambda b: _numbered_segments(b, first), "place double, numbers binary")
        net = whole_pass(net, segments, int(total * (1 - first)))
    learned_net = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _score_numbers(learned_net.value, batches)

    given = encoded.select("uid", "doc_id", "held_out", "n_tokens", "head_tokens", "head_base", "odd", "numbers")
    done = given.mapInPandas(run, "uid long, doc_id string, held_out boolean, n_tokens long, head_tokens long, head_base double, score double")
    scored = materialize(done.withColumn("doc_id", F.col("doc_id").cast(id_type)), "scores")
    norm = float(np.log10(max(1, total + distinct + 1)))
    rare = encoded.select("uid", F.explode(F.arrays_zip("words", "ns", "groups", "spelled")).alias("e")).select(
        "uid", F.col("e.words").alias("word"), F.col("e.ns").alias("n"), F.col("e.groups").alias("grp"), F.col("e.spelled").alias("spelled")
    )
    met = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    shares = F.array(*[F.lit(float(10.0**x)) for x in model.lexicon.tail.seen])
    by_count = F.log10(F.element_at(shares, F.col("grp") + 1) * F.col("c") + F.pow(F.lit(10.0), F.col("spelled")))
    named = F.when(F.col("c") > 0, by_count).otherwise(F.col("spelled"))
    sums = met.groupBy("uid").agg(
        F.sum(F.col("n") * named).alias("tail_score"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 1) - norm)).alias("tail_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known")
    )
    if total == 0:  # nothing was learned, so no token is known, the end included
        scored = scored.withColumn("head_tokens", F.lit(0).cast("long"))
    joined = scored.join(sums, "uid", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_tokens") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
    )
