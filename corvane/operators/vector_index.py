"""An inverted file of vectors: cells of a k-means, product-quantised residuals, exact scores for the pool.

build() fits cells and codes to a bounded sample, then writes every vector into the folder of its cell, as codes of one
byte for each PART dimensions and as it is. nearest() reads the codes of the cells nearest to a question only, keeps the
`pool` of the best by their codes, reads these rows' vectors and scores them exactly. How many cells a wanted recall
needs is measured on the sample and kept with the index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.best import Best
from corvane.storage import shared_folder, written

#: Cells at most, sampled vectors for each cell and in all, dimensions of a code, rounds of a k-means.
CELLS, PER_CELL, SAMPLE, PART, ROUNDS = 4096, 64, 65_536, 4, 10
#: Sampled questions and neighbours that recall is measured with; questions of one scan.
PROBED, NEIGHBOURS, QUESTIONS = 256, 50, 512
#: Scores of a block of rows that a task holds at once, questions times rows.
SCORES = 1 << 21
#: Pooled candidates for each row asked for, and at least.
POOL_FACTOR, POOL_LEAST = 24, 400


@dataclass(frozen=True)
class Index:
    """A written index; `recall[p - 1]` is the share of true neighbours in the p nearest cells, as measured on the sample."""

    path: str
    centroids: np.ndarray
    codebooks: np.ndarray
    recall: np.ndarray
    keep: tuple[str, ...]

    def probes(self, recall: float) -> int:
        """The least number of cells that the wanted recall needs."""
        return min(int(np.searchsorted(self.recall, recall - 1e-12)) + 1, len(self.centroids))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids of the rows by Lloyd's rounds; a centroid without rows moves to a row far from its own."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near, far = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far, kind="stable")[np.arange(len(empty)) % len(x)]]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid, and its squared distance."""
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), 4096):
        d = (c * c).sum(axis=1) - 2 * (x[a : a + 4096] @ c.T)
        near[a : a + 4096] = d.argmin(axis=1)
        far[a : a + 4096] = d.min(axis=1) + (x[a : a + 4096] ** 2).sum(axis=1)
    return near, far


def _encoded(residual: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """A byte for each part of each row."""
    size = codebooks.shape[2]
    return np.stack([_nearest(residual[:, p * size : (p + 1) * size], book)[0] for p, book in enumerate(codebooks)], 1).astype(np.uint8)


def _padded(x: np.ndarray) -> np.ndarray:
    """Rows with zeros behind, to a whole number of parts."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PART)))


def _ready(vectors: DataFrame, id_column: str, vector_column: str, keep: Sequence[str]) -> DataFrame:
    """(id, vector, kept columns) of vectors with a direction: not null, all components finite, not all zero."""
    v = F.col(vector_column).cast("array<double>")
    largest = F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.when(x.isNull() | F.isnan(x), F.lit(float("inf"))).otherwise(F.abs(x))))
    return vectors.where(F.col(id_column).isNotNull() & (largest > 0) & (largest < float("inf"))).select(F.col(id_column).cast("bigint").alias("id"), v.alias("vector"), *keep)


def build(vectors: DataFrame, path: str, id_column: str = "id", vector_column: str = "embedding", keep: Sequence[str] = (), cells: int | None = None, seed: int = 1) -> Index:
    """Writes the index of all vectors that have a direction below `path`; `keep` names further columns for filters.

    All vectors have as many dimensions as most (others fail). Cells: the square root of the rows' number unless given,
    CELLS at most. The sample, PER_CELL vectors a cell and SAMPLE at most, is drawn by a hash of the id and goes to the
    driver. Rows are dealt by cell and id, so a cell of many equal vectors is written by many tasks. Vectors may repeat
    ids; an empty table gives an index without cells.
    """
    spark = vectors.sparkSession
    ready = _ready(vectors, id_column, vector_column, keep)
    n = ready.count()
    rng = np.random.default_rng(seed)
    k = min(CELLS, max(1, n), cells or max(1, round(n**0.5)))
    most = min(SAMPLE, PER_CELL * k)
    share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 1.2 * most / max(1, n)) * (1 << 30)) + 1
    x = _unit(np.array([r.vector for r in ready.where(share).orderBy(F.xxhash64("id", F.lit(seed)), "id").select("vector").limit(most).collect()]) if n else np.zeros((0, 1)))
    if not len(x):
        return Index(path, np.zeros((0, 1)), np.zeros((0, 256, PART)), np.zeros(0), tuple(keep))
    centroids = _k_means(x, k, rng)
    near, _ = _nearest(x, centroids)
    residual = _padded(x - centroids[near])
    codebooks = np.stack([_k_means(residual[:, p : p + PART], 256, rng) for p in range(0, residual.shape[1], PART)])
    model = spark.sparkContext.broadcast((centroids, codebooks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, books = model.value
        for b in batches:
            rows = _unit(np.array(b.column("vector").to_pylist(), np.float64).reshape(b.num_rows, -1))
            cell, _ = _nearest(rows, c)
            codes = _encoded(_padded(rows - c[cell]), books)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in codes], pa.binary()), *b.columns], ["cell", "codes", *b.schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema)
    placed = ready.mapInArrow(run, f"cell int, codes binary, {kinds}")
    # ranges of (cell, hash) rather than cells: a crowded cell is many ranges
    placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    asked = rng.permutation(len(x))[:PROBED]
    close = x[asked] @ x.T
    close[np.arange(len(asked)), asked] = -np.inf
    found = np.argsort(-close, axis=1)[:, : min(NEIGHBOURS, max(1, len(x) - 1))]
    distance = (centroids**2).sum(axis=1) - 2 * (x[asked] @ centroids.T)
    place = np.argsort(np.argsort(distance, axis=1), axis=1)
    recall = np.cumsum(np.bincount(np.take_along_axis(place, near[found], axis=1).ravel(), minlength=k)) / found.size
    spark.createDataFrame([(bytearray(centroids.tobytes()), bytearray(codebooks.tobytes()), bytearray(recall.tobytes()), k, codebooks.shape[0], list(keep))], "centroids binary, codebooks binary, recall binary, cells int, parts int, keep array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return Index(path, centroids, codebooks, recall, tuple(keep))


def opened(spark: SparkSession, path: str) -> Index:
    """The index that build() wrote there."""
    r = spark.read.parquet(f"{path}/model").first()
    return Index(path, np.frombuffer(r.centroids).reshape(r.cells, -1), np.frombuffer(r.codebooks).reshape(r.parts, 256, PART), np.frombuffer(r.recall), tuple(r.keep))


def pool_of(k: int) -> int:
    return max(POOL_FACTOR * k, POOL_LEAST)


def _scan(index: Index, rows: DataFrame, asked: np.ndarray, probed: np.ndarray | None, pool: int) -> DataFrame:
    """(question, id, score): each task's best candidates. By codes in the probed cells, or exactly in all if probed is None."""
    model = rows.sparkSession.sparkContext.broadcast((index.centroids, index.codebooks, asked, probed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, books, q, of_cell = model.value
        best = Best([pool] * len(q))
        padded, places, step = _padded(q), np.arange(len(books)), max(1, SCORES // max(1, len(q)))
        if of_cell is not None:
            asks = np.zeros((len(q), len(centroids)), bool)
            np.put_along_axis(asks, of_cell, True, axis=1)
            middles = _padded(centroids)
        for b in batches:
            ids = b.column("id").to_numpy()
            if of_cell is None:
                scores = _unit(np.array(b.column("vector").to_pylist(), np.float64).reshape(b.num_rows, -1)) @ q.T
                for k in range(len(q)):
                    best.add(k, ids, scores[:, k])
                continue
            cells = b.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for a in range(0, b.num_rows, step):
                cell = cells[a : a + step]
                # what the codes stand for; a product with it adds up the products with cell and parts
                near = middles[cell] + books[places, codes[a : a + step]].reshape(len(cell), -1)
                own = np.flatnonzero(asks[:, np.unique(cell)].any(axis=1))
                may = asks[own][:, cell]
                for k, s, m in zip(own.tolist(), padded[own] @ near.T, may, strict=True):
                    best.add(k, ids[a : a + step][m], s[m])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], ["question", "id", "score"])

    return rows.mapInArrow(run, "question int, id bigint, score double")


def nearest(spark: SparkSession, index: Index, questions: DataFrame, k: int, recall: float = 0.95, probes: int | None = None, pool: int | None = None, where: str | None = None, folder: str | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): each question's k nearest vectors by cosine, ties to smaller ids.

    questions (query_id, vector), one a query_id; those without a direction get no rows. `where` is a condition over kept
    columns, applied before anything is scored. `probes` cells are read for a question, or as many as `recall` needs (for
    questions like the vectors; others, in regions with few vectors, may need more);
    pool -1 scores all vectors exactly. A question that gets fewer than k rows is asked again over all cells, exactly.
    Questions go to the driver and out again QUESTIONS at a time, each with one scan of the cells it needs.
    """
    if not len(index.centroids):
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, similarity double")
    ready = _ready(questions, "query_id", "vector", ())
    folder = folder or shared_folder(spark)
    take = len(index.centroids) if pool == -1 else probes or index.probes(recall)
    take, held = min(take, len(index.centroids)), max(k, pool_of(k) if pool in (None, -1) else pool)
    rows = spark.read.parquet(f"{index.path}/cells")
    rows = rows.where(where) if where else rows
    done = []

    def ask(ids: list[int], vectors: np.ndarray, exact: bool, name: str) -> DataFrame:
        lookup = F.broadcast(spark.createDataFrame([(i, q, v.tolist()) for i, (q, v) in enumerate(zip(ids, vectors, strict=True))], "question int, query_id bigint, asked array<double>"))
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        if exact:
            scored = _scan(index, rows.select("id", "vector"), vectors, None, k).withColumn("similarity", F.round("score", 9)).join(lookup.select("question", "query_id"), "question")
        else:
            distance = (index.centroids**2).sum(axis=1) - 2 * (vectors @ index.centroids.T)
            probed = np.argsort(distance, axis=1, kind="stable")[:, :take]
            cells = rows.where(F.col("cell").isin(np.unique(probed).tolist()))
            top = _scan(index, cells.select("id", "cell", "codes"), vectors, probed, held)
            ranked = top.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))).where(F.col("n") <= held)
            # QUESTIONS times the pool rows of two numbers at most
            few = F.broadcast(written(ranked.select("question", "id").distinct(), folder, f"{name}-pool"))
            near = cells.select("id", "vector").join(few, "id").join(lookup, "question")
            dot = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
            scored = near.withColumn("similarity", F.round(dot / norm, 9))
        best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
        return written(best, folder, name)

    def blocks() -> Iterator[tuple[list[int], np.ndarray]]:
        ids, vectors = [], []
        for r in ready.toLocalIterator():
            ids.append(r.id)
            vectors.append(r.vector)
            if len(ids) == QUESTIONS:
                yield ids, _unit(np.array(vectors))
                ids, vectors = [], []
        if ids:
            yield ids, _unit(np.array(vectors))

    for b, (ids, vectors) in enumerate(blocks()):
        found = ask(ids, vectors, pool == -1, f"block-{b}")
        full = {r.query_id for r in found.groupBy("query_id").count().where(f"count >= {k}").collect()}
        short = [i for i, q in enumerate(ids) if q not in full]
        if short and pool != -1:
            again = ask([ids[i] for i in short], vectors[short], True, f"again-{b}")
            found = found.where(F.col("query_id").isin([ids[i] for i in range(len(ids)) if i not in set(short)])).unionByName(again)
        done.append(found)
    if not done:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, similarity double")
    # the blocks' results lie side by side; one read takes them all
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
