"""A log-bilinear language model, trained with noise-contrastive estimation, and scores of whole texts.

Tokens are words (A-Z lower-cased) and one end for each text. A text's next token is predicted in up to three steps,
each a log-bilinear softmax of one predicted vector: its class (the commonest words, the end, and 64 classes of all
other words by their last bytes); in a tail class, the group of GROUP words of the broadcast table, ordered by count, or
the rest of the class; and in a group, the word. The predicted vector is q = sum of c_i * V[word_i] over the four words
before, and the score of a choice is q . R[choice] + b[choice]. Every word of the table has a vector of its own as
context (added to its class's) and as choice, so the model's vocabulary grows with the counted one, up to COMMON. A word
of the rest has there the share (c + 1) / (N_k + V_k + 1), with N_k tokens and V_k words of the class's rest in training;
words never seen share the 1. So probabilities over known words and one unknown word for each class add up to one.

Every text is read twice: words are counted by 64-bit hashes, then written as ids. Counts of the words above a threshold,
at most COMMON of them, go to all tasks; the others stay in a table, which the documents' rare words are joined with.

Training is by noise-contrastive estimation at each step: noise is shared by a batch for classes, and drawn within the
class or group below. Training texts are dealt by a hash into shards of about SHARD tokens, and those into about as many
rounds as the square root of their number; each shard of a round makes one pass from the same start, and changes are
averaged after it, so more data give more rounds. Shards, their order and their noise depend on the rows alone, so the
model is the same however the input is partitioned. Scores come from batched matrix products, normalised over all choices
of each step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bucket, number_slices, shared_dir, slices, text_ends, written
from corvane.llm.shingles import U, mix, word_hashes

#: The most words whose counts are broadcast and that have vectors (16 and 132 bytes each).
COMMON = 131_072
#: Words with a class of their own, tail classes, dimensions of a vector, words of context.
OWN, TAILS, SIZE, CONTEXT = 127, 64, 16, 4
CLASSES = OWN + 1 + TAILS
END = OWN
BATCH, NOISE, RATE = 2048, 48, 0.1
#: Bits of a hash that say where in the table it may be.
PARTS = 19
#: Counts of words that a task holds before it adds up equal ones (24 bytes each), and hands them on if as many are left.
MERGED = 1_000_000
#: Words of a group, and draws of noise for each token within a class or group.
GROUP, INNER_NOISE = 64, 4
#: Tokens of a shard, of an array of vectors; parts in which a shard's changes are averaged.
SHARD, SLICE, CHUNKS = 1 << 20, 1 << 18, 16
#: Rows of a matrix of all classes when texts are scored, which the processor's cache holds.
ROWS = 256
#: Where sums of squared gradients begin, for classes and for words and groups, which are seen more seldom.
SQUARES, RARE_SQUARES = 1e-6, 1e-8


def tail_of(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The tail class of words by their last three bytes."""
    return (mix(last.astype(U)) % U(TAILS)).astype(np.int64)


def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail class of every word, and where each text's words begin."""
    h, at = word_hashes(texts)
    ends = text_ends(texts)
    if not len(h):
        return h, np.zeros(0, np.int64), at
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    last = ~blank
    last[:-1] &= blank[1:] | cut[1:-1]
    stops = np.flatnonzero(last)
    first = ~blank
    first[1:] &= blank[:-1] | cut[1:-1]
    starts = np.flatnonzero(first)
    low = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
    three = low[stops].astype(np.int64)
    for k in (1, 2):
        p = stops - k
        three |= np.where(p >= starts, low[np.maximum(p, 0)], 0).astype(np.int64) << 8 * k
    return h, tail_of(h, three), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, tails, counts, held, most = [], [], [], 0, MERGED

    def merged():
        k, t, c = np.concatenate(keys), np.concatenate(tails), np.concatenate(counts)
        u, first, inv = np.unique(k, return_index=True, return_inverse=True)
        return u, t[first], np.bincount(inv, c, len(u)).astype(np.int64)

    for whole in batches:
        for b in slices(whole, "text", 1 << 18):
            h, tail, _ = read(b.column(0))
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            keys, tails, counts = [*keys, u], [*tails, tail[first]], [*counts, c]
            held += len(u)
            if held > most:
                u, t, c = merged()
                keys, tails, counts, held, most = [u], [t], [c], len(u), MERGED + len(u)
                if len(u) > MERGED:
                    yield _counts(u, t, c)
                    keys, tails, counts, held, most = [], [], [], 0, MERGED
    if keys:
        yield _counts(*merged())


def _counts(u: np.ndarray, t: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(t.astype(np.int32)), pa.array(c)], ["h", "tail", "c"])


class Table:
    """What tasks know of words: hashes in order, counts, classes of the commonest, groups of the others.

    A word's id is its class if it has one of its own, else CLASSES + 1 and its place among the others by class, count
    and hash. Words outside the table have their tail class as id. Choices within a tail class are numbered on, the
    class's groups and then its rest.
    """

    def __init__(self, h: np.ndarray, c: np.ndarray, tail: np.ndarray):
        order = np.lexsort((h, -c))
        own, rest = order[:OWN], order[OWN:]
        rest = rest[np.argsort(tail[rest], kind="stable")]
        ids = np.empty(len(h), np.int64)
        ids[own], ids[rest] = np.arange(len(own)), CLASSES + 1 + np.arange(len(rest))
        at = np.argsort(h)
        self.h, self.c, self.ids, self.words = h[at], c[at], ids[at], len(rest)
        self.starts = np.searchsorted(self.h, np.arange(1 << PARTS, dtype=U) << U(64 - PARTS))
        self.starts = np.r_[self.starts, len(self.h)]
        self.own_counts, self.counts = c[own], c[rest].astype(np.float64)
        kinds = tail[rest].astype(np.int64)
        n = np.bincount(kinds, minlength=TAILS)
        first = np.cumsum(n) - n
        groups = -(-n // GROUP)
        self.n_choices = groups + 1
        self.first_choice = np.cumsum(self.n_choices) - self.n_choices
        self.choices = int(self.n_choices.sum())
        place = np.arange(len(rest)) - first[kinds]
        group = place // GROUP
        self.first_word = first[kinds] + group * GROUP
        self.n_words = np.minimum(GROUP, n[kinds] - group * GROUP)
        self.in_class = np.bincount(kinds, self.counts, TAILS)
        self.class_of = np.r_[np.arange(CLASSES + 1), OWN + 1 + kinds]
        self.choice_of = np.r_[np.full(OWN + 1, -1), self.first_choice + groups, -1, self.first_choice[kinds] + group]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in the table, and whether it is there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        part = (h >> U(64 - PARTS)).astype(np.int64)
        at = self.starts.take(part)
        there = self.h.take(at, mode="clip") == h
        # a part of the hashes' range that has several words
        more = np.flatnonzero(~there & (self.starts.take(part + 1) > at + 1))
        at[more] = np.searchsorted(self.h, h[more])
        np.minimum(at, len(self.h) - 1, out=at)
        there[more] = self.h[at[more]] == h[more]
        return at, there

    def identify(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, their places in the table, and whether they are there."""
        at, there = self.find(h)
        return np.where(there, self.ids[at] if len(self.ids) else -1, OWN + 1 + tail), at, there


def sequence(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one row, CONTEXT ids CLASSES before each and an end behind; places of the tokens in it; where each text's tokens begin among them."""
    n = np.diff(at) + 1
    begin = np.r_[0, np.cumsum(n)]
    places = np.arange(begin[-1]) + CONTEXT * (1 + np.repeat(np.arange(len(n)), n))
    row = np.full(begin[-1] + CONTEXT * len(n), CLASSES, np.int64)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    row[places[inside]] = ids
    row[places[begin[1:] - 1]] = END
    return row, places, begin


class Model:
    """Parameters in one vector of 32-bit floats: R, Q, C, b of classes; then, of the words in groups, vectors as context, as choice and b; R and b of choices in a class."""

    def __init__(self, flat: np.ndarray, words: int = 0, choices: int = 0):
        self.flat, self.words, self.choices = flat, words, choices
        at = 0
        for name, shape in (("r", (CLASSES, SIZE)), ("q", (CLASSES + 1, SIZE)), ("c", (CONTEXT, SIZE)), ("b", (CLASSES,)), ("wq", (words, SIZE)), ("wr", (words, SIZE)), ("wb", (words,)), ("gr", (choices, SIZE)), ("gb", (choices,))):
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
            if name == "b":
                self.dense = at

    @classmethod
    def start(cls, share: np.ndarray, table: Table | None = None, rest: np.ndarray | None = None) -> Model:
        """Random vectors of classes, none of words, and b by shares: of the classes, and of what is in a class by `rest`, its N + V + 1 outside the table."""
        rng = np.random.default_rng(2)
        n = CLASSES * SIZE + (CLASSES + 1) * SIZE
        dense = np.concatenate([rng.normal(0, 0.1, n), np.full(CONTEXT * SIZE, 0.5), np.log(np.maximum(share, 1e-12))])
        if table is None:
            return cls(dense.astype(np.float32))
        w, g = table.words, table.choices
        model = cls(np.concatenate([dense, np.zeros(w * (2 * SIZE + 1) + g * (SIZE + 1))]).astype(np.float32), w, g)
        choice, kind = table.choice_of[CLASSES + 1 :], np.repeat(np.arange(TAILS), table.n_choices)
        total = np.bincount(choice, table.counts + 1, g)
        model.wb[:] = np.log((table.counts + 1) / total[choice])
        total[table.first_choice + table.n_choices - 1] = rest
        model.gb[:] = np.log(total / np.bincount(kind, total, TAILS)[kind])
        return model

    def contexts(self, table: Table | None) -> np.ndarray:
        """The context vectors of all ids."""
        return self.q if table is None else np.concatenate([self.q, self.q[table.class_of[CLASSES + 1 :]] + self.wq])

    def predict(self, vectors: np.ndarray) -> np.ndarray:
        """Predictions for all places of a row but the first CONTEXT, from the vectors of the row's ids."""
        n = len(vectors) - CONTEXT
        q = vectors[CONTEXT - 1 : CONTEXT - 1 + n] * self.c[0]
        for k in range(1, CONTEXT):
            q += vectors[CONTEXT - 1 - k : CONTEXT - 1 - k + n] * self.c[k]
        return q

    def log10(self, row: np.ndarray, places: np.ndarray, table: Table | None = None) -> np.ndarray:
        """log10 of the normalised probability of the ids at some places of a row; of a class as a whole where the id is a tail class and there is no table, else of its rest."""
        vectors, targets = self.contexts(table), row.take(places)
        classes = targets if table is None else table.class_of.take(targets)
        r, gr, wr = (np.concatenate([x, y[:, None]], axis=1) for x, y in ((self.r, self.b), (self.gr, self.gb), (self.wr, self.wb)))
        r, q, z = np.ascontiguousarray(r.T), np.ones((len(places), SIZE + 1), np.float32), np.empty((ROWS, CLASSES), np.float32)
        own, sums, ones = np.empty(len(places), np.float32), np.empty(len(places), np.float32), np.ones(CLASSES, np.float32)
        for a in range(0, len(places), 1024):
            here = places[a : a + 1024]
            part = self.predict(vectors.take(row[here[0] - CONTEXT : here[-1] + 1], axis=0))
            q[a : a + 1024, :SIZE] = part if len(part) == len(here) else part.take(here - here[0], axis=0)
        at = np.arange(0, z.size, CLASSES)
        for a in range(0, len(places), len(z)):  # short enough to stay in the processor's cache
            part = np.matmul(q[a : a + len(z)], r, out=z[: len(places) - a])
            own[a : a + len(z)] = part.ravel().take(classes[a : a + len(z)] + at[: len(part)])
            sums[a : a + len(z)] = _log_sums(part, ones)
        out = (own - sums).astype(np.float64)
        if table is not None:
            inner = np.flatnonzero(classes > OWN)
            choice = table.choice_of.take(targets.take(inner))
            # in the order of choices, words of a group stand together, and choices of a class too
            order = np.argsort(choice.astype(np.uint16) if table.choices <= 1 << 16 else choice, kind="stable")
            inner, choice = inner.take(order), choice.take(order)
            tail, word, q = classes.take(inner) - OWN - 1, targets.take(inner) - CLASSES - 1, q.take(inner, axis=0)
            more = _log_shares(q, gr, choice, ((a, z, int(table.first_choice[tail[a]]), int(table.n_choices[tail[a]])) for a, z in _equal(tail)))
            known = np.flatnonzero(word >= 0)
            if len(known):
                word, q = (word, q) if len(known) == len(word) else (word[known], q.take(known, axis=0))
                more[known] += _log_shares(q, wr, word, ((a, z, int(table.first_word[word[a]]), int(table.n_words[word[a]])) for a, z in _equal(choice[known])))
            out[inner] += more
        return out / np.log(10)

    def train(self, row: np.ndarray, places: np.ndarray, share: np.ndarray, squares: Squares, rng: np.random.Generator, table: Table) -> None:
        """A step of noise-contrastive estimation over some places of a row; noise by the classes' shares, and evenly among the choices below."""
        n = len(places)
        row, places = row[places[0] - CONTEXT : places[-1] + 1], places - places[0]
        targets = row.take(places + CONTEXT)
        kinds, words = table.class_of.take(row), np.flatnonzero(row > CLASSES)
        word_rows = row.take(words) - CLASSES - 1
        vectors = self.q.take(kinds, axis=0)
        if len(words):
            vectors += self.wq.take(np.maximum(row - (CLASSES + 1), 0), axis=0) * (row > CLASSES).astype(np.float32)[:, None]
        classes = kinds[CONTEXT:].take(places)
        # what rng.choice(CLASSES, NOISE, p=share) draws
        up_to = share.cumsum()
        noise = (up_to / up_to[-1]).searchsorted(rng.random(NOISE), side="right")
        bias = self.b - np.log(NOISE * np.maximum(share, 1e-12)).astype(np.float32)
        q, rt, rn = self.predict(vectors).take(places, axis=0), self.r.take(classes, axis=0), self.r[noise]
        d = _inverse(np.einsum("nd,nd->n", q, rt) + bias.take(classes), 1)
        q_one = np.ones((n, SIZE + 1), np.float32)
        q_one[:, :SIZE] = q
        e = _inverse(q_one @ -np.concatenate([rn, bias[noise, None]], axis=1).T, -1)
        of_noise = e.T @ q_one
        grad = squares.grad
        grad.flat.fill(0)
        _scatter(grad.r, classes, d[:, None] * q)
        _scatter(grad.r, noise, np.ascontiguousarray(of_noise[:, :SIZE]))
        grad.b[:] = np.bincount(classes, d, CLASSES) + np.bincount(noise, of_noise[:, SIZE], CLASSES)
        dq = d[:, None] * rt + e @ rn
        inner = np.flatnonzero(classes > OWN)
        if len(inner):
            tail, choice = classes.take(inner) - OWN - 1, table.choice_of.take(targets.take(inner))
            _scatter(dq, inner, _contrast(q.take(inner, axis=0), choice, table.first_choice.take(tail), table.n_choices.take(tail), (self.gr, self.gb), squares.g, n, rng))
            inner = inner[targets.take(inner) > CLASSES]
        if len(inner):
            word = targets.take(inner) - CLASSES - 1
            _scatter(dq, inner, _contrast(q.take(inner, axis=0), word, table.first_word.take(word), table.n_words.take(word), (self.wr, self.wb), squares.w, n, rng))
        back = np.zeros((len(row) - CONTEXT, SIZE), np.float32)
        back[places] = dq
        each, m, part = np.zeros_like(vectors), len(back), np.empty_like(back)
        for k in range(CONTEXT):
            a = CONTEXT - 1 - k
            each[a : a + m] += np.multiply(back, self.c[k], out=part)
            grad.c[k] = np.einsum("nd,nd->d", back, vectors[a : a + m])
        _scatter(grad.q, kinds, each)
        each = each.take(words, axis=0)
        each /= np.float32(n)
        np.add.at(squares.wq, word_rows, np.einsum("nd,nd->n", each, each) / np.float32(SIZE))
        each *= (np.float32(RATE) / np.sqrt(squares.wq.take(word_rows)))[:, None]
        _scatter(self.wq, word_rows, each)
        g = grad.flat / n
        squares.flat += g * g
        self.flat[: self.dense] += RATE * g / np.sqrt(squares.flat)


class Squares:
    """Sums of squared gradients: of every parameter of the classes, and the mean over a vector of each word's and choice's; of words (w) and choices (g) as complex numbers, the vector's and b's. And room for a step's gradients of the classes."""

    def __init__(self, flat: np.ndarray, table: Table):
        self.flat, self.grad = flat, Model(np.zeros(len(flat), np.float32))
        self.wq = np.full(table.words, RARE_SQUARES, np.float32)
        self.w, self.g = (np.full(n, complex(RARE_SQUARES, RARE_SQUARES), np.complex64) for n in (table.words, table.choices))


def _inverse(z: np.ndarray, x: float) -> np.ndarray:
    """x / (1 + exp(z)) in place of z."""
    np.clip(z, -30, 30, out=z)
    np.exp(z, out=z)
    z += 1
    return np.divide(x, z, out=z)


def _contrast(q: np.ndarray, target: np.ndarray, first: np.ndarray, size: np.ndarray, values: tuple, squares: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A step of noise-contrastive estimation for choices among `size` ones from `first` on; returns the gradients of q."""
    r, b = values
    ids = np.empty((len(q), INNER_NOISE + 1), np.int64)
    ids[:, 0] = target
    noise = first[:, None] + (rng.random((len(q), INNER_NOISE), np.float32) * size[:, None]).astype(np.int64)
    np.minimum(noise, (first + size - 1)[:, None], out=ids[:, 1:])
    flat = ids.ravel()
    vectors = r.take(ids, axis=0)
    z = np.einsum("nkd,nd->nk", vectors, q)
    z += b.take(ids)
    z -= np.log(INNER_NOISE / size).astype(np.float32)[:, None]
    d = _inverse(np.negative(z, out=z), -1)
    d[:, 0] += 1
    if size.min() == 1:
        d[size == 1] = 0
    dq = np.einsum("nk,nkd->nd", d, vectors)
    d *= np.float32(1 / n)
    square = np.empty((*d.shape, 2), np.float32)
    np.multiply(d, d, out=square[:, :, 1])
    np.multiply(square[:, :, 1], (np.einsum("nd,nd->n", q, q) / np.float32(SIZE))[:, None], out=square[:, :, 0])
    np.add.at(squares, flat, square.ravel().view(np.complex64))
    rates = np.sqrt(squares.take(flat).view(np.float32), out=square.ravel()).reshape(square.shape)
    np.divide(np.float32(RATE), rates, out=rates)
    np.add.at(b, flat, (d * rates[:, :, 1]).ravel())
    d *= rates[:, :, 0]
    np.einsum("nk,nd->nkd", d, q, out=vectors)
    _scatter(r, flat, vectors)
    return dq


def _equal(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)] if len(x) else [0]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _log_sums(z: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of each row's sum of exp(z); z is overwritten. Where no z is beyond 80, sums of exponentials fit in 32 bits as they are."""
    top = None
    if not (z.max() < 80 and z.min() > -80):
        top = z.max(axis=1)
        z -= top[:, None]
    np.exp(z, out=z)
    sums = np.log(z @ ones)
    return sums if top is None else sums + top


def _log_shares(q: np.ndarray, r: np.ndarray, target: np.ndarray, runs: Iterator[tuple[int, int, int, int]]) -> np.ndarray:
    """log of the probability of each target, a row of r, among the n choices from f on, for each run (a, z, f, n) of rows of q; matrix products of bounded size."""
    sums, rt, ones = np.empty(len(q), np.float32), np.ascontiguousarray(r.T), np.ones(len(r), np.float32)
    for a, z, f, n in runs:
        for k in range(a, z, 4 * ROWS):
            to = min(z, k + 4 * ROWS)
            sums[k:to] = _log_sums(q[k:to] @ rt[:, f : f + n], ones[:n])
    return (np.einsum("nd,nd->n", q, r.take(target, axis=0)) - sums).astype(np.float64)


_PAIRS = np.tile(np.arange(SIZE // 2), 4 * BATCH)


def _scatter(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to rows of 32-bit floats, two at once as a complex number; rows may repeat."""
    pairs = np.repeat(rows * (SIZE // 2), SIZE // 2)
    pairs += _PAIRS[: len(pairs)] if len(pairs) <= len(_PAIRS) else np.tile(_PAIRS[: SIZE // 2], len(rows))
    np.add.at(out.reshape(-1).view(np.complex64), pairs, values.reshape(-1).view(np.complex64))


_SUMS = "chunk int, shard bigint, n bigint, p binary, s binary"
_CHANGES = [("chunk", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("p", pa.binary()), ("s", pa.binary())]


def _changes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), _CHANGES, strict=True)], [n for n, _ in _CHANGES])


def _fit(batches: Iterator[pa.RecordBatch], start: np.ndarray, before: np.ndarray, table: Table, share: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each shard (shard, ids), whose rows stand together: tokens seen, changes of all parameters as 16-bit floats in CHUNKS parts, and the sums of squared gradients of the classes' parameters."""
    shard, model, squares, rng, seen = None, None, None, None, 0

    def close() -> Iterator[pa.RecordBatch]:
        if seen:
            parts = np.array_split((model.flat - start).astype(np.float16), CHUNKS)
            yield _changes([(k, shard, seen, x.tobytes(), squares.flat.tobytes() if k == 0 else b"") for k, x in enumerate(parts)])

    for whole in batches:
        shards = whole.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == z:
                continue
            if shards[a] != shard:
                yield from close()
                shard, seen, rng = int(shards[a]), 0, np.random.default_rng((3, int(shards[a])))
                model, squares = Model(start.copy(), table.words, table.choices), Squares(before.copy(), table)
            for ids, at, _, _ in number_slices(whole.column(1).slice(a, z - a), SLICE):
                row, places, _ = sequence(ids, at)
                for k in range(0, len(places), BATCH):
                    model.train(row, places[k : k + BATCH], share, squares, rng, table)
                seen += len(places)
    yield from close()


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Averages by tokens for each chunk, whose rows stand together; a change over the shards that changed the parameter, as a rare word is not met by all."""
    chunk, n, total, weight, squares = None, 0, 0.0, 0.0, 0.0

    def close() -> Iterator[pa.RecordBatch]:
        if n:
            yield _changes([(chunk, 0, n, (total / np.maximum(weight, 1)).astype(np.float16).tobytes(), (squares / np.float32(n)).tobytes())])

    for b in batches:
        for c, k, p, s in zip(*(b.column(i) for i in (0, 2, 3, 4)), strict=True):
            if c.as_py() != chunk:
                yield from close()
                chunk, n, total, weight, squares = c.as_py(), 0, 0.0, 0.0, 0.0
            k, x = k.as_py(), np.frombuffer(p.as_buffer(), np.float16).astype(np.float32)
            n, squares = n + k, squares + np.frombuffer(s.as_buffer(), np.float32) * np.float32(k)
            total, weight = total + x * np.float32(k), weight + np.where(x != 0, np.float32(k), np.float32(0))
    yield from close()


_ENCODED = "row bigint, doc_id bigint, held_out boolean, order bigint, ids binary, rare array<bigint>, times array<bigint>"


def _encode(batches: Iterator[pa.RecordBatch], table: Table) -> Iterator[pa.RecordBatch]:
    """Ids of all words, 4 bytes each, and of words outside the table the hash, with how often it occurs and its tail class in one number."""
    for whole in batches:
        for b in slices(whole, "text", 1 << 18):
            hashes, tail, at = read(b.column("text"))
            ids, _, there = table.identify(hashes, tail)
            out = np.flatnonzero(~there)
            row = np.searchsorted(at, out, side="right") - 1
            order = np.lexsort((hashes[out], row))
            out, row = out[order], row[order]
            first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(hashes[out]) != 0)]) if len(out) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(out)]) << 6 | tail[out[first]]
            ends = np.searchsorted(row[first], np.arange(len(at)))
            lists = [(ends, hashes[out[first]].view(np.int64)), (ends, times.astype(np.int64))]
            numbers = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(4 * at.astype(np.int64)), pa.py_buffer(ids.astype("<i4"))]).cast(pa.binary())
            columns = [b.column(n) for n in ("row", "doc_id", "held_out", "order")] + [numbers] + [pa.ListArray.from_arrays(e.astype(np.int32), pa.array(x)) for e, x in lists]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ENCODED.split(", ")])


_SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _dealt(encoded: DataFrame, folder: str, tokens: int) -> list[DataFrame]:
    """The training rows (shard, ids) of each round, written as one folder, a file for each shard."""
    shards = max(2, -(-tokens // SHARD))
    rounds = math.ceil(math.sqrt(shards))
    path = f"{folder}/dealt"
    shard = F.pmod("order", F.lit(shards)).cast("int")
    rows = encoded.where("not held_out").select((shard % rounds).alias("round"), shard.alias("shard"), "order", "ids")
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("round", "shard", "order")
    rows.select("round", F.col("shard").cast("bigint").alias("shard"), "ids").write.partitionBy("round").parquet(path)
    dealt = encoded.sparkSession.read.schema("shard bigint, ids binary, round int").parquet(path)
    return [dealt.where(F.col("round") == k).select("shard", "ids") for k in range(rounds)]


def most_frequent(counts: DataFrame, most: int) -> Column:
    """The condition for the words of the table: of counts (h, c), those of the greatest, at most `most`.

    Counts are told apart up to 2^20, greater ones by their first ten bits, so the driver gets a bounded number of steps
    at any size. A step is taken whole or not at all; of a first one that is too large, the words of the least hashes are.
    """
    drop = F.expr("if(length(bin(c)) > 20, length(bin(c)) - 10, 0)")
    step = drop.cast("bigint") * F.lit(1 << 20) + F.expr("shiftright(c, if(length(bin(c)) > 20, length(bin(c)) - 10, 0))")
    least, reached = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if reached + r.n > most:
            if not reached:
                part = F.shiftrightunsigned("h", 44)
                for p in counts.where(step == r.step).groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
                    reached += p.n
                    if reached > most:
                        return (step == r.step) & (part < p.part)
            break
        least, reached = r.step, reached + r.n
    return F.lit(False) if least is None else step >= least


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs (doc_id, text, ...).

    Rows whose crc32(doc_id as text) modulo `folds` is `held_out` are scored but not learned from; a null doc_id counts
    as 0. base_score adds log10((c + 1) / (N + V + 1)) of all tokens; score is the model's log10 probability of the
    text. A null or empty text is an end alone. Without training texts c, N and V are 0, and the model is the uniform
    one that it starts from. Repeated rows get equal results, words of equal count are told apart by their hashes; texts
    of any length are scored whole, their ids held at once (12 bytes a word); other columns are ignored. Results don't
    depend on how docs is partitioned, but for the rounding of sums.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    sc = spark.sparkContext
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (bucket("doc_id", folds) == held_out).alias("held_out"))
    training = d.where("not held_out")
    counts = training.select("text").mapInArrow(_count, "h bigint, tail int, c bigint").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))
    counts = written(counts, folder, "counts")
    texts = training.count()
    frequent = most_frequent(counts, COMMON)
    common = counts.where(frequent).toArrow()
    reached = len(common)
    h = common.column("h").to_numpy().view(U) if reached else np.zeros(0, U)
    c = common.column("c").to_numpy() if reached else np.zeros(0, np.int64)
    table = Table(h, c, common.column("tail").to_numpy() if reached else np.zeros(0, np.int64))
    tails = np.zeros((2, TAILS))
    for r in counts.where(~frequent).groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tails[:, r.tail] = r.n, r.v
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = words + texts, kinds + (texts > 0)
    share = np.concatenate([np.zeros(OWN), [texts], tails[0] + table.in_class])
    share[: len(table.own_counts)] = table.own_counts
    share = (share + 1e-3) / (share + 1e-3).sum()
    model = Model.start(share, table, tails.sum(axis=0) + 1)
    flat, squares = model.flat, np.full(model.dense, SQUARES, np.float32)
    known = sc.broadcast(table)
    rows = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", F.xxhash64("doc_id", "text").alias("order"), "text")
    encoded = written(rows.mapInArrow(lambda b: _encode(b, known.value), _ENCODED), folder, "encoded")
    for part in _dealt(encoded, folder, int(n)) if texts else []:
        start = sc.broadcast((flat, squares))
        changes = part.mapInArrow(lambda b, s=start: _fit(b, *s.value, known.value, share), _SUMS)
        found = changes.repartitionById(CHUNKS, F.col("chunk")).sortWithinPartitions("chunk", "shard").mapInArrow(_averaged, _SUMS).collect()
        if found:
            found.sort(key=lambda r: r.chunk)
            flat, squares = flat + np.concatenate([np.frombuffer(r.p, np.float16) for r in found]), np.frombuffer(found[0].s, np.float32)
        start.destroy()
    final = sc.broadcast(flat)
    log_n = float(np.log10(n + v + 1))
    log_k = np.log10(tails.sum(axis=0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.value
        model = Model(final.value, t.words, t.choices)
        # what a word adds to base_score; words outside the table are dealt with apart
        plain = np.full(len(t.class_of), 0.0)
        plain[: len(t.own_counts)] = np.log10(t.own_counts + 1) - log_n
        plain[CLASSES + 1 :] = np.log10(t.counts + 1) - log_n
        there = plain < 0
        for b in batches:
            for ids, at, a, z in number_slices(b.column("ids"), SLICE):
                row, places, begin = sequence(ids, at)
                lm = np.add.reduceat(model.log10(row, places, t), begin[:-1])
                base = _sums(plain[ids], at) + np.log10(texts + 1) - log_n
                seen = np.diff(np.r_[0, np.cumsum(there[ids])][at]) + (texts > 0)
                meta = [b.column(n).slice(a, z - a) for n in ("row", "doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*meta, *map(pa.array, (np.diff(at) + 1, seen.astype(np.int64), base, lm))], [x.split()[0] for x in _SCORED.split(", ")])

    scored = encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(run, _SCORED)
    each = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.shiftright("w.times", 6).alias("k"), F.col("w.times").bitwiseAND(63).cast("int").alias("tail"))
    count = F.coalesce("c", F.lit(0))
    tail_log = F.element_at(F.array(*(F.lit(float(x)) for x in log_k)), F.col("tail") + 1)
    joined = each.join(counts.where(~frequent).select("h", "c"), "h", "left")
    more = joined.groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(F.col("k") * (F.log10(count + 1) - F.lit(log_n))).alias("more_base"),
        F.sum(F.col("k") * (F.log10(count + 1) - tail_log)).alias("more_score"),
    )
    zero = F.lit(0.0)
    return scored.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(x)]
    return total[at[1:]] - total[at[:-1]]
