"""Periodic runs of words by Karp-Miller-Rosenberg naming, and texts without the repeats.

The words of a text get numbers (level 0). A name of level k + 1 stands for the pair of names of level k that lie 2^k
words apart, so equal names mean equal stretches of 2^(k+1) words: names are ranks of pairs, nothing is hashed and no
suffixes are sorted. How far two places agree, forwards or backwards, is read off the names by descending levels.

A run of period q and length max(LEAST, TIMES * q) or more has that many less q places i in a row whose word equals the
one q further on, so one of them lies on a grid of that step. Every grid place where words agree and eight words before
or behind them do is extended both ways; what is long enough is a run, and the least period of equal stretches is the
run's own. The grids of all periods have O(n log n) places together.

Texts of a slice are named together, with numbers of their own for the words of each, so that nothing agrees across texts.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import slices, utf8

#: A run has LEAST words and TIMES its period at least.
LEAST, TIMES = 24, 3
#: Candidates that are extended at once, and bytes of texts that are named together.
BLOCK, SLICE = 1 << 18, 1 << 20


def named(words: np.ndarray) -> list[np.ndarray]:
    """Names of each level, for all places where 2^level words fit. Stretches that occur once get negative names, one for each place."""
    n = len(words)
    seen = np.bincount(words, minlength=1)
    name = np.where(seen[words] > 1, words, -1 - np.arange(n)).astype(np.int64)
    levels = []
    while len(name) and (name >= 0).any():
        levels.append(name.astype(np.int32) if n < 1 << 31 else name)
        width = 1 << (len(levels) - 1)
        left, right = name[:-width], name[width:]
        if not len(left):
            break
        here = np.flatnonzero((left >= 0) & (right >= 0))
        following = -1 - np.arange(len(left))
        if len(here):
            _, rank, count = np.unique(left[here] * (int(name.max()) + 1) + right[here], return_inverse=True, return_counts=True)
            again = count[rank] > 1
            following[here[again]] = (np.cumsum(count > 1) - 1)[rank[again]]
        name = following
    return levels


def ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i < j)."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        at, to = i + same, j + same
        fits = to < len(name)
        to[~fits] = 0
        at[~fits] = 0
        same += (fits & (name[at] == name[to])).astype(np.int64) << k
    return same


def behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (i < j)."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, width = levels[k], 1 << k
        at = i - same - width
        fits = at >= 0
        to = np.where(fits, j - same - width, 0)
        at[~fits] = 0
        same += (fits & (name[at] == name[to])).astype(np.int64) << k
    return same


def _candidates(words: np.ndarray, eight: np.ndarray, longest: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) on the grids where the word agrees with the one a period on and so do eight words from it or before it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for q in range(1, longest // times + 1):
        step = max(least, times * q) - q
        at = np.flatnonzero(words[: len(words) - q : step] == words[q::step]) * step
        if not len(at):
            continue
        to = np.minimum(at, len(eight) - 1 - q) if len(eight) > q else None
        if to is None:
            break
        near = (at == to) & (eight[to] == eight[to + q])
        back = np.maximum(at - 8, 0)
        near |= (at >= 8) & (back + q < len(eight)) & (eight[np.minimum(back, len(eight) - 1)] == eight[np.minimum(back + q, len(eight) - 1)])
        at = at[near]
        if len(at):
            held.append((np.full(len(at), q, np.int64), at))
            n += len(at)
            if n >= BLOCK:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def runs(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs, by start and period; words: numbers, none of which two texts share; longest: words of the longest text.

    least - least // times must be 16 or more, and times 3 or more (the period of a run is then its least one, and one
    of eight words before or behind every grid place agrees).
    """
    if times < 3 or least - least // times < 16:
        raise ValueError("runs need 24 words and three periods at least")
    levels = named(words)
    if len(levels) < 4:
        return np.zeros((0, 3), np.int64)
    found = []
    for q, at in _candidates(words, levels[3], longest, least, times):
        start = at - behind(levels, at, at + q)
        length = at + q + ahead(levels, at, at + q) - start
        good = length >= np.maximum(least, times * q)
        # a long run is met at many grid places of its period
        found.append(np.unique(np.stack([start[good], length[good], q[good]], 1), axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    all_ = np.concatenate(found)
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
    first = np.ones(len(all_), bool)
    first[1:] = (all_[1:, :2] != all_[:-1, :2]).any(axis=1)
    out = all_[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word of all texts, equal for equal words of one text only."""
    count = itertools.count()
    out = []
    for words in texts:
        number: dict[bytes, int] = defaultdict(count.__next__)
        out.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def best(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first, then that of the least period."""
    top = None
    for start, length, period in found.tolist():
        if top is None or length * top[2] > top[1] * period:
            top = (start, length, period)
    return top


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not len(found):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    return list(itertools.compress(words, (np.cumsum(cover)[:-1] == 0).tolist()))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by crc32 of its id goes on periodically from some word on; the others, and a null id's, stay."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


_OUT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, words bigint, kept bigint, text string"


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, words, kept, text), one row for each row of docs (doc_id, text, ...).

    Words are the stretches between spaces and 0x09-0x0D, compared byte by byte. A run is a stretch with least period q
    of at least max(24, 3 q) words that can't be extended. start, length, period and exponent_milli tell of the run with
    the greatest length / period and are null without one; runs_sha256 covers all runs, collapsed_sha256 the words left
    when each run keeps its first period (`kept` of `words`); text holds them if `texts`. `change` may alter a
    document's words first. Null, empty and blank texts have no words and no runs; repeated rows get equal rows; a null
    doc_id stays null; an empty table gives an empty one; other columns are ignored. Texts are named whole however long:
    memory is 4 bytes a word and level, at most log2 of the words' number levels, fewer unless long stretches repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                ids = b.column(0).to_pylist()
                split = [x.split() for x in utf8(b.column(1))]
                if change:
                    split = [change(i, w) for i, w in zip(ids, split, strict=True)]
                ends = np.cumsum([0, *map(len, split)])
                found = runs(numbered(split), int(np.diff(ends).max(initial=0)))
                bound = np.searchsorted(found[:, 0], ends)
                cols: list[list] = [[] for _ in range(10)]
                for k, w in enumerate(split):
                    own = found[bound[k] : bound[k + 1]] - np.array([ends[k], 0, 0])
                    top, rest = best(own), collapsed(w, own)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
                    joined = b" ".join(rest)
                    row = (len(own), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(joined).hexdigest(), len(w), len(rest), joined.decode() if texts else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [f.split()[0] for f in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)
