"""Benchmark decontamination by greedy string tiling.

Texts become words of letters and digits, lower-cased. A document and a test item meet through shared seeds, SEED words
in a row, found by a join of the document's seeds with an index of all items' seeds. A pair goes on if the item's words
that lie in shared seeds reach the threshold, since every tile consists of shared seeds. Tiling then marks, again and
again, the longest common runs of unmarked words, which Karp-Rabin hashes of shrinking length find; each word of
either text lies in one tile at most, and runs shorter than a seed don't count. An item is covered by the share of its
words in tiles, in whatever order its parts stand in the document.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import strings
from corvane.llm.shingles import U, mix

#: Words of a seed, which is the shortest tile too.
SEED = 4
#: Share of an item's words that tiles must cover.
THRESHOLD = 0.6
#: Words of the items whose index is broadcast at once (about 100 bytes each); more items take more passes.
INDEXED = 500_000
_WORD = re.compile(r"[^\W_]+")
_B = 0x9E3779B97F4A7C15
_OUT = "doc_id bigint, item_id bigint, coverage double, matched bigint, item_words bigint, tiles array<struct<doc_start: bigint, item_start: bigint, length: bigint>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n numbers."""
    if len(x) < n:
        return np.zeros(0, U)
    h = np.zeros(len(x) - n + 1, U)
    power = 1
    sums = mix((x + 1).astype(U))
    if n <= 8:
        for k in range(n):
            h = h * U(_B) + sums[k : k + len(h)]
        return h
    for k in range(n - 1, -1, -1):
        h += sums[k : k + len(h)] * U(power)
        power = power * _B & (1 << 64) - 1
    return h


#: Pairs of equal windows that are followed one by one; where there are more, all diagonals are followed together.
_FEW = 20_000


def _runs(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(-length, start in doc, start in item) of the longest runs of equal free words, of `size` words or more."""
    blocked_i, blocked_d = np.r_[0, np.cumsum(~free_i)], np.r_[0, np.cumsum(~free_d)]
    mine, theirs = _windows(item, size), _windows(doc, size)
    at_item: dict[int, list[int]] = {}
    for t, h in enumerate(mine.tolist()):
        if blocked_i[t + size] == blocked_i[t]:
            at_item.setdefault(h, []).append(t)
    if not at_item or not len(theirs):
        return []
    here = np.flatnonzero(np.isin(theirs, np.array(list(at_item), U)) & (blocked_d[size:] == blocked_d[:-size]))
    if sum(len(at_item[h]) for h in theirs[here].tolist()) > _FEW:
        return _all_runs(doc, item, free_d, free_i, size)
    runs, ends = [], {}
    for p in here.tolist():
        for t in at_item[int(theirs[p])]:
            if ends.get(p - t, -1) > p:  # inside a run that has been followed on this diagonal
                continue
            k = 0
            while p + k < len(doc) and t + k < len(item) and free_d[p + k] and free_i[t + k] and doc[p + k] == item[t + k]:
                k += 1
            ends[p - t] = p + k
            if k >= size:
                runs.append((-k, p, t))
    return runs


def _all_runs(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """The same, for texts of few different words: word by word of the item, the runs that end at each word of the document."""
    runs, before = [], np.zeros(len(doc) + 1, np.int32)
    for t in range(len(item) + 1):
        now = np.zeros(len(doc) + 1, np.int32)
        if t < len(item) and free_i[t]:
            now[1:] = np.where(free_d & (doc == item[t]), before[:-1] + 1, 0)
        # runs up to the word before that don't go on
        over = before >= size
        over[:-1] &= now[1:] == 0
        for p in np.flatnonzero(over).tolist():
            k = int(before[p])
            runs.append((-k, p - k, t - k))
        before = now
    return runs


def tile(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the tiles; words are numbers, negative ones match nothing.

    The longest run of free words comes first, of equal ones the first in the document, then in the item. What is left
    of a run that longer ones cut into is put back in its place.
    """
    free_d, free_i = doc >= 0, item >= 0
    tiles = []
    size = least
    while size * 2 <= len(item):
        size *= 2
    while size >= least and free_i.any():
        runs = _runs(doc, item, free_d, free_i, size)
        heapq.heapify(runs)
        while runs:
            k, p, t = heapq.heappop(runs)
            free = free_d[p : p - k] & free_i[t : t - k]
            if free.all():
                free_d[p : p - k] = free_i[t : t - k] = False
                tiles.append((p, t, -k))
                if not free_i.any():
                    break
                continue
            cut = np.flatnonzero(np.diff(np.r_[False, free, False]))
            for a, z in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):
                if z - a >= size:
                    heapq.heappush(runs, (a - z, p + a, t + a))
        size //= 2
    return sorted(tiles)


class Index:
    """Seeds of a block of items: where each stands."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.number: dict[str, int] = {}
        self.ids, self.items = [], []
        seeds, owner, place = [], [], []
        for item_id, text in items:
            x = np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text)], np.int64)
            h = _windows(x, SEED)
            seeds.append(h)
            owner.append(np.full(len(h), len(self.items)))
            place.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.items.append(x)
        h = np.concatenate([np.zeros(0, U), *seeds])
        order = np.argsort(h, kind="stable")
        self.owner, self.place = np.concatenate([np.zeros(0, np.int64), *owner])[order], np.concatenate([np.zeros(0, np.int64), *place])[order]
        # items of fewer words than a seed, by their number of words: they are found as wholes
        self.short: dict[int, dict[int, list[int]]] = {}
        for o, x in enumerate(self.items):
            if 0 < len(x) < SEED:
                self.short.setdefault(len(x), {}).setdefault(int(_windows(x, len(x))[0]), []).append(o)
        self.seeds, self.begin = np.unique(h[order], return_index=True)
        self.begin = np.r_[self.begin, len(h)]

    def matches(self, text: str, threshold: float) -> list[tuple[int, float, int, int, list[tuple[int, int, int]]]]:
        get = self.number.get
        doc = np.array([get(w, -1) for w in words_of(text)], np.int64)
        whole: dict[int, int] = {}
        for n, owners in self.short.items():
            h = _windows(doc, n)
            for p in np.flatnonzero(np.isin(h, np.array(list(owners), U))).tolist():
                for o in owners[int(h[p])]:
                    if (doc[p : p + n] == self.items[o]).all():
                        whole.setdefault(o, p)
        out = [(self.ids[o], 1.0, len(self.items[o]), len(self.items[o]), [(p, 0, len(self.items[o]))]) for o, p in whole.items()]
        h = _windows(doc, SEED)
        if not len(h) or not len(self.seeds):
            return out
        h = np.unique(h[np.convolve(doc < 0, np.ones(SEED, int), "valid") == 0])
        at = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        at = at[self.seeds[at] == h]
        if not len(at):
            return out
        rows = np.concatenate([np.arange(self.begin[k], self.begin[k + 1]) for k in at])
        owner, place = self.owner[rows], self.place[rows]
        for o in np.unique(owner):
            x = self.items[o]
            inside = np.zeros(len(x), bool)
            for k in range(SEED):
                inside[place[owner == o] + k] = True
            if inside.sum() < threshold * len(x):
                continue
            tiles = tile(doc, x)
            n = sum(k for *_, k in tiles)
            if n >= threshold * len(x):
                out.append((self.ids[o], n / len(x), n, len(x), tiles))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(words_of(r.text))
        if size >= INDEXED:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, coverage, matched, item_words, tiles) for every document and item whose coverage reaches the threshold.

    Clean documents have no row. Items of fewer than SEED words are found only where they stand as a whole; items without
    words, and null or empty texts, match nothing; texts of any length are searched whole. Words with other marks or in other letter case are equal. A document or item that repeats gives a row each time; null
    identifiers stay null; other columns are ignored; without items the result is empty. Documents are read once for
    each block of items (500,000 words), whole, and nothing is shuffled.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), kind]
            for b in batches:
                found = [(i, *m[:4], [dict(zip(("doc_start", "item_start", "length"), x, strict=True)) for x in m[4]]) for i, t in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True) for m in sent.value.matches(t, threshold)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [x.split()[0] for x in _OUT.split(", ")[:5]] + ["tiles"])

        part = d.mapInArrow(run, _OUT)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], _OUT) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, the same columns, without the rows that cover an item to the threshold.

    Null and empty texts cover nothing and stay, repeated rows share their fate, texts of any length are searched whole,
    an empty table or benchmark changes nothing, and columns other than text may have any names.
    """
    at = docs.columns.index("text")
    for index in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not sent.value.matches(t, threshold) for t in strings(b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
