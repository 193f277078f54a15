"""Queries of the retrieval product, the relation graph and the parsers, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.html import html_text
from corvane.operators import graph, provisions, retrieval
from corvane.plans.dialect import Duck, Spark
from corvane.plans.relational import register
from corvane.plans.views import with_views
from corvane.storage import shared_folder, written
from corvane.streaming import ledger

TERMS = ["license", "the", "and", "token"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in _table(spark, sf_dir, "embeddings").where("vec_id = 7").first().embedding]


def _sparse(spark, sf_dir):
    return retrieval.bm25(_table(spark, sf_dir, "documents"), TERMS)


def _dense(spark, sf_dir):
    return retrieval.cosine(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).where("similarity is not null")


def _fused(spark, sf_dir):
    return retrieval.fuse(retrieval.arm(_dense(spark, sf_dir).withColumn("similarity", F.round("similarity", 9)), "similarity"), retrieval.arm(_sparse(spark, sf_dir).withColumn("score", F.round("score", 9)), "score"))


def r6_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


def r6_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse arm from an index: postings of all documents are written, then those of the query's terms read."""
    path = retrieval.build_postings(_table(spark, sf_dir, "documents"), shared_folder(spark))
    return retrieval.search_postings(spark, path, TERMS).select("id", F.round("score", 6).alias("score"))


def r5_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("id", F.round(F.col("similarity") + 0.0, 6).alias("similarity"))


def r8_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("id", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("sparse_rank").cast("long").alias("sparse_rank"), F.round("score", 9).alias("score"))


def _hits(spark, sf_dir):
    meta = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    # a hundred rows at most, read several times
    fused = F.broadcast(written(_fused(spark, sf_dir)))
    return written(meta.join(fused, "id").select("id", "lang", "source", F.round("score", 9).alias("score")))


def r10_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.roll_up(_hits(spark, sf_dir), "source")


def r12_document_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cap_per_document(_hits(spark, sf_dir), "lang", 20).select("id", "lang", "demoted", F.col("place").cast("long").alias("place"))


def r13_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.promote(_hits(spark, sf_dir), "source", 8).select("source", F.round("total", 9).alias("total"), "members", "id")


def r14_validity_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current hits, then hits of documents that are not current, the best three, badged."""
    register(spark, sf_dir)
    current = spark.sql(with_views("SELECT document_id AS id, status_class FROM current_validity", Spark()))
    hits = _hits(spark, sf_dir).join(current, "id").withColumn("is_current", F.col("status_class").isin("in_force", "partial"))
    old = hits.where("not is_current").orderBy(F.desc("score"), F.asc("id")).limit(3)
    return hits.where("is_current").unionByName(old).select("id", "status_class", "is_current", "score")


def _relation(spark, sf_dir):
    register(spark, sf_dir)
    return spark.sql(with_views("SELECT from_id, to_id FROM relation", Spark()))


def g2_amendment_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chain(_relation(spark, sf_dir)).select("base", "node", F.col("depth").cast("long").alias("depth"))


def x1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


def p10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provisions.chunks(_table(spark, sf_dir, "documents"))


def st_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additional coverage: windows over the events table by the operator that also runs on the stream."""
    return ledger.event_windows(_table(spark, sf_dir, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (r6_bm25, r6_postings, r5_cosine, r8_hybrid, r10_roll_up, r12_document_cap, r13_promotion, r14_validity_passes, g2_amendment_chain, x1_html_text, p10_chunks, st_event_windows)}

_BM25 = f"""tok AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda t: t <> '') AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT doc_id, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS f FROM tok, (SELECT unnest([{', '.join(f"'{t}'" for t in TERMS)}]) AS term) q),
dfs AS (SELECT term, count(*) AS df FROM post WHERE f > 0 GROUP BY term),
sparse AS (SELECT doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN dfs USING (term), st WHERE f > 0 GROUP BY doc_id)"""
_COS = """qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
dense AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS similarity FROM embeddings, qv)"""
_RRF = f"""{_BM25}, {_COS},
sa AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM sparse) WHERE rank <= 50),
da AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY round(similarity, 9) DESC, id) AS rank FROM dense) WHERE rank <= 50),
fused AS (SELECT coalesce(d.id, s.id) AS id, coalesce(d.rank, 0) AS dense_rank, coalesce(s.rank, 0) AS sparse_rank,
  round(coalesce(1.0 / (60 + d.rank), 0.0) + coalesce(0.5 / (60 + s.rank), 0.0), 9) AS score FROM da d FULL JOIN sa s ON d.id = s.id),
hits AS (SELECT id, lang, source, score FROM fused JOIN documents ON doc_id = id)"""
ORACLES = {
    "r6_postings": f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM sparse",
    "r6_bm25": f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM sparse",
    "r5_cosine": f"WITH {_COS} SELECT id, round(similarity, 6) AS similarity FROM dense",
    "r8_hybrid": f"WITH {_RRF} SELECT id, dense_rank, sparse_rank, score FROM fused",
    "r10_roll_up": f"WITH {_RRF} SELECT id, lang, source, score FROM hits QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) = 1",
    "r12_document_cap": f"WITH {_RRF}, m AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, id) > 3 AS demoted FROM hits) SELECT id, lang, demoted, place FROM (SELECT *, row_number() OVER (ORDER BY demoted, score DESC, id) AS place FROM m) WHERE place <= 20",
    "r13_promotion": f"""WITH {_RRF}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS m FROM hits),
        s AS (SELECT source, sum(score) AS total, count(*) AS members, arg_min(id, rank) AS id FROM r WHERE m <= 3 GROUP BY source)
        SELECT source, round(total, 9) AS total, members, id FROM s WHERE members >= 2 AND source NOT IN (SELECT source FROM r WHERE rank <= 8) AND total > (SELECT min(score) FROM r WHERE rank <= 8) ORDER BY s.total DESC, id LIMIT 2""",
    "r14_validity_passes": with_views(f"WITH {_RRF}, h AS (SELECT hits.id, status_class, status_class IN ('in_force', 'partial') AS is_current, score, row_number() OVER (PARTITION BY status_class IN ('in_force', 'partial') ORDER BY score DESC, hits.id) AS n FROM hits JOIN current_validity v ON v.document_id = hits.id) SELECT id, status_class, is_current, score FROM h WHERE is_current OR n <= 3", Duck()),
    "g2_amendment_chain": with_views("""WITH RECURSIVE c AS (SELECT from_id AS base, to_id AS node, 1 AS depth, [from_id, to_id] AS path FROM relation
        UNION ALL SELECT c.base, r.to_id, c.depth + 1, list_append(c.path, r.to_id) FROM c JOIN relation r ON r.from_id = c.node WHERE c.depth < 4 AND NOT list_contains(c.path, r.to_id))
        SELECT DISTINCT base, node, CAST(depth AS BIGINT) AS depth FROM c""".replace("WITH RECURSIVE c", "WITH c"), Duck()).replace("WITH relation", "WITH RECURSIVE relation", 1),
    "st_event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
