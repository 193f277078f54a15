"""Hybrid evidence retrieval: BM25 and cosine arms, rank fusion, roll-up, caps, promotion, validity passes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.best import Best
from corvane.storage import written

K1, B = 1.2, 0.75
RRF_K = 60
LEXICAL_WEIGHT = 0.5
POOL = 50
DOC_CAP = 3
#: Terms that are counted in columns of their own; more are looked up.
COLUMNS = 64
#: Weights of a block of documents that are held at once, terms times documents.
BLOCK = 1 << 22


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; accents stay."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "), " "), lambda t: t != "")


def weighted(post: DataFrame, df: DataFrame, stats: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, score) from postings (term, id, f, dl, keys), document frequencies (term, df) and one row (n, avgdl). Both of these have a row for each query term at most."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return post.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy(*keys, "id").agg(F.sum(weight).alias("score"))


def counted(docs: DataFrame, terms: list[str], id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (term, id, f, dl), document frequencies and statistics for some terms, without an index.

    The texts are read once: a document's length and its counts of the terms are written, a few numbers each.
    """
    t = docs.select(F.col(id_column).alias("id"), tokens(F.col(text_column)).alias("t"))

    def count(term: str) -> Column:
        return F.size(F.filter("t", lambda x: x == term))

    if len(terms) <= COLUMNS:
        counts = F.array(*map(count, terms)) if terms else F.array().cast("array<int>")
        t = written(t.select("id", F.size("t").alias("dl"), counts.alias("f")))
        post = t.select("id", "dl", F.posexplode("f").alias("k", "f")).where("f > 0").select("id", "dl", "f", F.element_at(F.array(*map(F.lit, terms or [""])), F.col("k") + 1).alias("term"))
    else:
        t = term_counts(docs, terms, id_column, text_column).table
        post = t.select("id", "dl", F.explode(F.arrays_zip("k", "f")).alias("p")).select("id", "dl", "p.f", F.element_at(F.array(*map(F.lit, terms)), F.col("p.k") + 1).alias("term"))
    return post, post.groupBy("term").agg(F.count("*").alias("df")), t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


@dataclass(frozen=True)
class Counts:
    """How often documents hold some terms: a written table (id, dl, k, f) of every document, k places in `terms`."""

    table: DataFrame
    terms: list[str]

    def postings(self) -> DataFrame:
        """(k, id, f, dl): a row for each term that a document holds."""
        return self.table.select("id", "dl", F.explode(F.arrays_zip("k", "f")).alias("p")).select("p.k", "id", "p.f", "dl")

    def unique(self) -> bool:
        return self.table.groupBy("id").count().where("count > 1").isEmpty()


def term_counts(docs: DataFrame, terms: list[str], id_column: str = "doc_id", text_column: str = "text") -> Counts:
    """Counts of the terms, taken where the texts are read: one pass, no shuffle, and a few small numbers written for each document."""
    known = docs.sparkSession.sparkContext.broadcast(list(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(known.value, pa.string())
        for b in batches:
            words = b.column(2)
            at = pc.index_in(words.flatten(), wanted)
            rows = pc.list_parent_indices(words).to_numpy().astype(np.int64)
            held = at.is_valid().to_numpy(zero_copy_only=False)
            pairs, f = np.unique(rows[held] * len(wanted) + at.drop_null().to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(b.num_rows + 1) * len(wanted)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(wanted)), f))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["id", "dl", "k", "f"])

    t = docs.select(F.col(id_column).alias("id"), tokens(F.col(text_column)).alias("t")).select("id", F.size("t").alias("dl"), "t")
    kind = t.schema["id"].dataType.simpleString()
    return Counts(written(t.mapInArrow(run, f"id {kind}, dl int, k array<int>, f array<int>")), list(terms))


def best_by_words(counts: Counts, groups: Sequence[Sequence[str]], most: Sequence[int], allowed: DataFrame | None = None) -> DataFrame:
    """(group, id, score) by BM25, rounded to nine digits: at least the `most` best documents of each group of terms.

    Tasks score whole documents and give their own best only. So what is shuffled grows with the tasks and groups, not with
    the pairs of group and document, which are nearly all pairs once a group has a common word. Ids must be unique.
    `allowed` (group, id) says which documents a group may have; without it all may be taken.
    """
    spark, place = counts.table.sparkSession, {t: k for k, t in enumerate(counts.terms)}
    stats = counts.table.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = np.zeros(len(counts.terms))
    for r in counts.postings().groupBy("k").count().collect():
        df[r.k] = r["count"]
    idf = np.log(1 + (stats.n - df + 0.5) / (df + 0.5))
    model = spark.sparkContext.broadcast((idf, float(stats.avgdl or 1.0), [np.array([place[t] for t in g], np.int64) for g in groups], list(most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, avgdl, groups, most = model.value
        best, step = Best(most), max(1, BLOCK // max(1, len(idf)))
        for b in batches:
            ids, dl = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            rows, k, f = (x.to_numpy() for x in (pc.list_parent_indices(b.column(2)), b.column(2).flatten(), b.column(3).flatten()))
            weights = idf[k] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl[rows] / avgdl))
            may = None
            if b.num_columns > 4:
                may = np.zeros((len(groups), b.num_rows), bool)
                may[b.column(4).flatten().to_numpy(), pc.list_parent_indices(b.column(4)).to_numpy()] = True
            for a in range(0, b.num_rows, step):
                first, end = np.searchsorted(rows, (a, a + step))
                held = np.zeros((len(idf), min(step, b.num_rows - a)))
                held[k[first:end], rows[first:end] - a] = weights[first:end]
                for g, of_group in enumerate(groups):
                    scores = np.add.reduce(held[of_group], axis=0)
                    near = scores > max(0.0, best.least[g] - 1e-9)
                    at = np.flatnonzero(near if may is None else near & may[g, a : a + step])
                    best.add(g, ids[a + at], np.round(scores[at], 9))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], ["group", "id", "score"])

    t = counts.table.where("id is not null and size(k) > 0").select(F.col("id").cast("bigint").alias("id"), "dl", "k", "f")
    if allowed is not None:
        t = t.join(allowed.groupBy("id").agg(F.collect_set(F.col("group").cast("int")).alias("groups")), "id")
    return t.mapInArrow(run, "group int, id bigint, score double")


def bm25(docs: DataFrame, query: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of the documents that hold a query term, without an index. For many queries over one corpus, build_postings() once."""
    return weighted(*counted(docs, list(dict.fromkeys(query)), id_column, text_column))


def build_postings(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", buckets: int = 256) -> str:
    """Writes the corpus's postings below `path`: (term, id, f, dl) in folders by a hash of the term and in its order, document frequencies alike, and the corpus's statistics.

    Terms are counted where the texts are read. A common term's postings are many rows of one key: rows go to tasks by
    ranges of (folder, term, document), so that a term is spread over as many tasks as its postings fill. Repeated ids are documents of their
    own; null and wordless texts count in the statistics only.
    """
    t = docs.select(F.col(id_column).alias("id"), tokens(F.coalesce(F.col(text_column), F.lit(""))).alias("t")).select("id", F.size("t").alias("dl"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(2)
            coded = words.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            pairs, f = np.unique(pc.list_parent_indices(words).to_numpy().astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(b.num_rows + 1) * size).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, x) for x in (coded.dictionary.take(pa.array(pairs % size)), pa.array(f.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["id", "dl", "terms", "f"])

    # a row for each document: statistics, and the ranges that rows are dealt by, come from it without the texts
    t = written(t.mapInArrow(run, f"id {t.schema['id'].dataType.simpleString()}, dl int, terms array<string>, f array<int>"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    post = t.select("id", "dl", F.explode(F.arrays_zip("terms", "f")).alias("p")).select("id", "dl", F.col("p.terms").alias("term"), "p.f")
    post.select("term", "id", "f", "dl", bucket).repartitionByRange("bucket", "term", F.xxhash64("id")).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    df = docs.sparkSession.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    df.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    return path


def read_postings(spark: SparkSession, path: str, terms: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, document frequencies and statistics for some terms: only their folders are read, and of these the row groups that can hold them."""
    stats = spark.read.parquet(f"{path}/statistics")
    n = stats.first().buckets
    folders = [r[0] for r in spark.createDataFrame([(x,) for x in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")).distinct().collect()]
    post, df = (spark.read.parquet(f"{path}/{x}").where(F.col("bucket").isin(folders) & F.col("term").isin(terms)) for x in ("postings", "terms"))
    return post.select("term", "id", "f", "dl"), df.select("term", "df"), stats.select("n", "avgdl")


def search_postings(spark: SparkSession, path: str, query: list[str]) -> DataFrame:
    """bm25() from postings."""
    return weighted(*read_postings(spark, path, list(dict.fromkeys(query))))


def cosine(vectors: DataFrame, query: list[float], id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, similarity) by exact cosine, in codegen."""
    v = F.col(vector_column).cast("array<double>")
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    length = sum(x * x for x in query) ** 0.5
    return vectors.select(F.col(id_column).alias("id"), (dot / (norm * F.lit(length))).alias("similarity"))


def arm(scored: DataFrame, score: str, k: int = POOL) -> DataFrame:
    """The k best with their rank, ties to smaller ids. The window runs over k rows only."""
    top = scored.orderBy(F.desc(score), F.asc("id")).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc("id"))))


def fuse(dense: DataFrame, sparse: DataFrame, weight: float = LEXICAL_WEIGHT, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: 1 / (k + rank) of the dense arm and weight / (k + rank) of the sparse one."""
    d = dense.select("id", F.col("rank").alias("dense_rank"))
    s = sparse.select("id", F.col("rank").alias("sparse_rank"))
    w = weight if weight > 0 else 1.0
    score = F.coalesce(1.0 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(F.lit(w) / (k + F.col("sparse_rank")), F.lit(0.0))
    return d.join(s, "id", "full").select("id", F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), F.coalesce("sparse_rank", F.lit(0)).alias("sparse_rank"), score.alias("score"))


def roll_up(hits: DataFrame, *keys: str) -> DataFrame:
    """The best hit of each key (id, score, keys...)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_per_document(hits: DataFrame, document: str, limit: int, cap: int = DOC_CAP) -> DataFrame:
    """At most `cap` hits of a document first, then the others in their order, `limit` in all, with their place."""
    w = Window.partitionBy(document).orderBy(F.desc("score"), F.asc("id"))
    marked = hits.withColumn("demoted", F.row_number().over(w) > cap).orderBy("demoted", F.desc("score"), F.asc("id")).limit(limit)
    return marked.withColumn("place", F.row_number().over(Window.orderBy("demoted", F.desc("score"), F.asc("id"))))


def promote(hits: DataFrame, group: str, shown: int, most: int = 2) -> DataFrame:
    """Groups that are not among the first `shown` hits, but whose three best hits, two at least, add up to more than the weakest shown."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))))
    top = ranked.where(F.col("rank") <= shown)
    weakest = top.agg(F.min("score").alias("weakest"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.asc("id"))
    sums = ranked.withColumn("_n", F.row_number().over(w)).where("_n <= 3").groupBy(group).agg(F.sum("score").alias("total"), F.count("*").alias("members"), F.min(F.struct("rank", "id")).alias("best"))
    fresh = sums.where("members >= 2").join(top.select(group).distinct(), group, "left_anti").join(F.broadcast(weakest)).where("total > weakest")
    return fresh.orderBy(F.desc("total"), F.asc("best.id")).limit(most).select(group, "total", "members", F.col("best.id").alias("id"))
