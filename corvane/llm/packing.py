"""Packing token ids into sequences of fixed capacity by multiway Karmarkar-Karp differencing.

Documents longer than a sequence give full sequences first; what remains of each document, cut into pieces of at most
a quarter of the capacity, is packed in groups (the last, smaller pieces let windows come out nearly equal). A group is divided into windows of nearly equal sums: every piece
starts as a partition with one filled window, the two partitions with the largest differences are merged with opposing
imbalances (largest window with smallest), until one is left. If its largest window exceeds the capacity, the group is
divided again into one window more. Pieces that a task has left when its documents end are packed together with those of
other tasks, so that padding doesn't grow with the number of partitions.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corvane.llm.common import shared_dir, slices, strings, written
from corvane.llm.tokens import encoder

#: Pieces that are packed together.
GROUP = 2048
_OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """The indices of the sizes in each window; empty windows are left out.

    A partition is held as its filled windows, largest first, each a sum above the smallest window and a tree of
    indices; windows at the smallest sum stand after them, and count only in number.
    """
    if windows <= 1 or not sizes:
        return [list(range(len(sizes)))] if sizes else []
    # (negative difference, number, sums in descending order, contents); sums are relative to the smallest window
    heap = [(-n, k, [n], [k]) for k, n in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, ca = heapq.heappop(heap)
        _, _, b, cb = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            sums, held = a + b, ca + cb
        else:
            # the last `over` windows of a meet the last ones of b, its smallest with a's largest of these
            la, lb = len(a) - over, len(b) - over
            sums = a[:la] + [x + y for x, y in zip(a[la:], reversed(b[lb:]), strict=True)] + b[:lb]
            held = ca[:la] + list(zip(ca[la:], reversed(cb[lb:]), strict=True)) + cb[:lb]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, held = [sums[k] for k in order], [held[k] for k in order]
        if len(sums) == windows and sums[-1]:
            least = sums[-1]
            sums = [x - least for x in sums]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == windows else 0)), number, sums, held))
        number += 1
    out = []
    for tree in heap[0][3]:
        flat, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                flat.append(t)
        out.append(sorted(flat))
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity` for sizes of at most that; their number rises while a window exceeds it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        most = max((sum(sizes[k] for k in w) for w in found), default=0)
        if most <= capacity:
            return found
        windows += 1


def _rows(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32
    used = 0
    last = np.array([end], "<u4").tobytes()
    part = max(1, capacity // 4)
    held: list[tuple] = []
    out: list[tuple] = []

    def close() -> None:
        nonlocal used
        for window in pack([h[2] for h in held], capacity):
            at = 0
            for k in window:
                out.append((*held[k], first + used, at))
                at += held[k][2]
            used += 1
        held.clear()

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _OUT.split(", ")])

    for whole in batches:
        for b in slices(whole, "text"):
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(strings(b.column(1))), strict=True):
                ids += last
                n, at = len(ids) // 4, 0
                while n - at >= capacity:
                    out.append((doc, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, first + used, 0))
                    used += 1
                    at += capacity
                while at < n:
                    size = min(part, n - at)
                    held.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                    at += size
                if len(held) >= GROUP:
                    close()
            if len(out) > 10_000:
                yield batch()
    out += [(*h, None, None) for h in held]
    if out:
        yield batch()


def _left(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Places for the pieces that tasks had left; sequence ids from 2^62 on."""
    task = TaskContext.get()
    first, held = (1 << 62) + ((task.partitionId() if task else 0) << 32), []

    def close() -> pa.RecordBatch:
        nonlocal first
        out = []
        for window in pack([h[2] for h in held], capacity):
            at = 0
            for k in window:
                out.append((*held[k], first, at))
                at += held[k][2]
            first += 1
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
            held.append(row)
            if len(held) >= GROUP:
                yield close()
    if held:
        yield close()


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1) -> DataFrame:
    """Pieces of all documents' token ids and their places in sequences of at most `capacity` ids.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a document's ids are those of its text (null:
    none) and then `end`; start counts its ids before the piece; pieces of a sequence follow each other from offset 0
    without gaps. Each row of docs (doc_id, text, ...) is a document of its own, also with a repeated or null doc_id;
    other columns are ignored; an empty table gives an empty result. Texts of any length are encoded whole and cut; which
    of two equal pieces goes where depends on the order of rows. Each partition packs its own documents as they come, a
    task holds one group; the last ones of all tasks, a few numbers for each piece, are read again by as many tasks as
    they fill eight groups, and packed there. Nothing is shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = written(texts.mapInArrow(lambda b: _rows(b, tokenizer, capacity, end), _OUT), shared_dir(docs.sparkSession), "placed")
    left = placed.where("sequence_id is null")
    tasks = -(-left.count() // (8 * GROUP))
    return placed.where("sequence_id is not null").unionByName(left.coalesce(max(1, tasks)).mapInArrow(lambda b: _left(b, capacity), _OUT))
