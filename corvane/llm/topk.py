"""Exact top-k by inner product: branch and bound over dimension blocks in vertical layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16
#: Queries that are held by a task at once; with 1,000 dimensions 32 MB.
QUERIES = 4096
_OUT = "query_id bigint, vec_id bigint, score bigint"


def quantized(column: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as double; null if any component is null or not finite."""
    x = column.cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(whole, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, least: dict[int, int] | None = None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best among the vectors, ties to smaller ids, a query's own id left out.

    Vectors lie dimension by dimension. For each query, dimensions come in the order of the query's weight. After each
    block, a vector goes on only if its sum so far plus the product of the lengths that both have left reaches the
    k-th best full score of the candidates that led after the first block, or `least`, the k-th best score of the query
    in vectors searched before, if that is higher. All values are whole numbers below 2^53 in
    doubles, so sums are exact; the bound is raised by a millionth against rounding of lengths.
    """
    if not len(vectors) or not len(queries):
        return []
    out = []
    dims = vectors.shape[1]
    columns = np.ascontiguousarray(vectors.T, np.float64)
    norms = (columns**2).sum(axis=0)
    for q, own in zip(queries.astype(np.float64), query_ids, strict=True):
        order = np.argsort(-np.abs(q), kind="stable")
        alive = np.flatnonzero(ids != own)
        sums = np.zeros(len(alive))
        left_v = norms[alive]
        left_q = float((q**2).sum())
        floor = before = float((least or {}).get(int(own), -np.inf))
        for at in range(0, dims, block):
            d = order[at : at + block]
            part = columns[np.ix_(d, alive)]
            sums = sums + q[d] @ part
            left_v = left_v - (part**2).sum(axis=0)
            left_q -= float((q[d] ** 2).sum())
            if at + block >= dims or (len(alive) <= k and before == -np.inf):
                continue
            if len(alive) <= k:
                floor = before
            elif floor == before:
                lead = np.argpartition(-sums, k - 1)[:k]
                floor = max(before, float((q @ columns[:, alive[lead]]).min()))
            most = sums + np.sqrt(np.maximum(left_v, 0) * max(left_q, 0)) * (1 + 1e-6) + 1e-3
            stay = most >= floor
            alive, sums, left_v = alive[stay], sums[stay], left_v[stay]
        best = np.lexsort((ids[alive], -sums))[:k]
        out += [(int(own), int(ids[alive[b]]), int(sums[b])) for b in best]
    return out


def _exact(queries: list[tuple[int, list[int]]], rows: list[tuple[int, list[int]]], k: int) -> list[tuple[int, int, int]]:
    """For components too large for doubles: whole numbers of Python, scores held within a long."""
    low, high = -(2**63), 2**63 - 1
    out = []
    for i, q in queries:
        s = sorted(((-min(max(sum(a * b for a, b in zip(q, v, strict=True)), low), high), j) for j, v in rows if j != i and len(v) == len(q)))
        out += [(i, j, -x) for x, j in s[:k]]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k vectors with the highest inner product of floor(scale * x).

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id; vectors of
    another length than the query's are not compared with it. Sums that doubles can't hold exactly are added up as whole
    numbers of any size, and scores beyond 64 bits are held at the ends of that range. Every remaining row but those with the query's own id is
    a candidate, repeated rows too; a repeated query id counts once (its least vector). Fewer candidates give fewer
    rows. Queries come in blocks of 4096, each against all rows in a pass of its own: a task holds a block and a batch
    of vectors, and hands on k rows for each query. Without queries or candidates the result is empty.
    """
    spark = vectors.sparkSession
    ready = vectors.select(F.col(id_column).cast("bigint").alias("id"), quantized(F.col(vector_column), scale).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_column).cast("bigint").alias("id"), quantized(F.col(vector_column), scale).alias("v")).where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    bounds = _bounds(asked)
    found = None
    for low, high in bounds:
        block = [(r.id, r.v) for r in asked.where((F.col("id") >= low) & (F.col("id") <= high)).toLocalIterator()]
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by_dim: dict[int, list] = {}
            for i, v in sent.value:
                by_dim.setdefault(len(v), []).append((i, v))
            held: dict[int, list[tuple[int, int]]] = {}
            for batch in batches:
                ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                values, begins = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]
                for dim, qs in by_dim.items():
                    here = np.flatnonzero(lengths == dim)
                    if not len(here):
                        continue
                    x = values[begins[here][:, None] + np.arange(dim)]
                    q = np.array([v for _, v in qs], object if any(abs(c) > 2**62 for _, v in qs for c in v) else np.int64)
                    if dim and max(np.abs(x.astype(float)).max(), np.abs(q.astype(float)).max()) ** 2 * dim >= 2.0**53:
                        got = _exact(qs, [(int(i), [int(c) for c in v]) for i, v in zip(ids[here], x, strict=True)], k)
                    else:
                        got = search(q.astype(np.int64).reshape(len(qs), dim), np.array([i for i, _ in qs]), x.reshape(len(here), dim), ids[here], k, least={i: -h[k - 1][0] for i, h in held.items() if len(h) >= k})
                    for i, j, s in got:
                        held.setdefault(i, []).append((-s, j))
                for i in held:
                    if len(held[i]) > k:
                        held[i] = sorted(held[i])[:k]
            if held:
                rows = [(i, j, -s) for i, best in held.items() for s, j in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

        part = ready.mapInArrow(run, _OUT)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], _OUT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounds(asked: DataFrame) -> list[tuple[int, int]]:
    """Ranges of ids with at most about QUERIES queries each."""
    n, low, high = asked.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if not n:
        return []
    if n <= QUERIES:
        return [(low, high)]
    parts = -(-n * 5 // (4 * QUERIES))
    cuts = sorted({int(c) for c in asked.approxQuantile("id", [k / parts for k in range(1, parts)], 1 / (10 * parts))})
    return list(zip([low, *(c + 1 for c in cuts)], [*cuts, high], strict=True))
