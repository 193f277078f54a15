"""Upserts in order over the observations of documents: the first of a key is stored, all others arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import folds
from corvane.plans.dialect import Duck, Spark
from corvane.plans.relational import register
from corvane.plans.views import with_views

_O = """SELECT doc_key, doc_id AS seq, row_number() OVER (PARTITION BY doc_key ORDER BY doc_id) AS rn, CAST(priority AS INT) AS metadata_priority, source AS title, CASE WHEN doc_id % 3 <> 0 THEN substring(text, 1, 12) END AS markdown, doc_id AS source_document_id,
  CASE WHEN doc_id % 5 < 2 THEN doc_id END AS document_id, CASE WHEN doc_id % 7 <> 0 THEN concat('label ', doc_id) END AS label, CASE doc_id % 3 WHEN 0 THEN 'vb' WHEN 1 THEN 'cb' END AS ref_source, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '2' END AS target, CASE WHEN doc_id % 4 < 3 THEN concat('v', doc_id) END AS src_ref,
  doc_id % 11 = 0 AS in_scope, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 < 4 THEN 'relation' ELSE concat('listing ', doc_id % 3) END AS provenance, CASE WHEN doc_id % 4 <> 0 THEN substring(text, 1, 1) END AS content_hash, CASE WHEN doc_id % 2 = 0 THEN concat('u', doc_id) END AS detail_url FROM observation"""


def _parts(spark: SparkSession, sf_dir: str, columns: str) -> tuple[DataFrame, DataFrame]:
    register(spark, sf_dir)
    o = spark.sql(with_views(f"SELECT {columns}, seq, rn FROM ({_O}) o", Spark()))
    return o.where("rn = 1").drop("rn", "seq"), o.where("rn > 1").drop("rn")


def d1_document_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after all upserts: fields by priority, texts, links."""
    return folds.documents(*_parts(spark, sf_dir, "doc_key, title, markdown, source_document_id, metadata_priority"), ["title"])


def d2_reference_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References after all upserts: resolved ones, labels, the pointer of the first target in its last version."""
    stored, incoming = _parts(spark, sf_dir, "doc_key AS ref_key, document_id, label, CASE WHEN src_ref IS NOT NULL THEN ref_source END AS source, CASE WHEN src_ref IS NOT NULL THEN target END AS target, src_ref")
    return folds.references(stored, incoming)


def d3_discovery_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows after all rediscoveries; changed hashes open them again."""
    stored, incoming = _parts(spark, sf_dir, "doc_key, in_scope, provenance, content_hash, detail_url, 'complete' AS state, CAST(3 AS BIGINT) AS artifacts_done")
    return folds.discoveries(stored, incoming, ["doc_key"], reset={"state": F.lit("discovered"), "artifacts_done": F.lit(0).cast("bigint")})


QUERIES = {f.__name__: f for f in (d1_document_folds, d2_reference_folds, d3_discovery_folds)}

_BEFORE = "(PARTITION BY doc_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORACLES = {
    "d1_document_folds": with_views(f"""WITH o AS ({_O}), w AS (SELECT *, max(metadata_priority) OVER {_BEFORE} AS before FROM o)
SELECT doc_key, arg_max(title, seq) FILTER (before IS NULL OR metadata_priority >= before) AS title, arg_max(markdown, seq) FILTER (markdown IS NOT NULL) AS markdown,
  arg_max(source_document_id, seq) FILTER (before IS NULL OR metadata_priority > before OR (metadata_priority >= before AND markdown IS NOT NULL)) AS source_document_id, max(metadata_priority) AS metadata_priority FROM w GROUP BY doc_key""", Duck()),
    # row by row, as the upsert itself does it
    "d2_reference_folds": "WITH RECURSIVE" + with_views(f"""WITH o AS (SELECT *, CASE WHEN src_ref IS NOT NULL THEN ref_source END AS s, CASE WHEN src_ref IS NOT NULL THEN target END AS t FROM ({_O}) x),
f AS (SELECT doc_key AS ref_key, rn, document_id, label, s AS source, t AS target, src_ref FROM o WHERE rn = 1
  UNION ALL SELECT ref_key, o.rn, coalesce(f.document_id, o.document_id), coalesce(o.label, f.label),
    CASE WHEN takes THEN o.s ELSE f.source END, CASE WHEN takes THEN o.t ELSE f.target END, CASE WHEN takes THEN o.src_ref ELSE f.src_ref END
  FROM f JOIN o ON o.doc_key = f.ref_key AND o.rn = f.rn + 1, LATERAL (SELECT (coalesce(f.source, '') = coalesce(o.s, '') AND coalesce(f.target, '') <> '' AND coalesce(f.target, '') = coalesce(o.t, '')) OR (coalesce(f.target, '') = '' AND coalesce(o.t, '') <> '') OR f.src_ref IS NULL AS takes) z)
SELECT ref_key, document_id, label, source, target, src_ref FROM f QUALIFY rn = max(rn) OVER (PARTITION BY ref_key)""", Duck()).removeprefix("WITH"),
    "d3_discovery_folds": with_views(f"""WITH o AS ({_O}), w AS (SELECT *, last_value(content_hash IGNORE NULLS) OVER {_BEFORE} AS before FROM o),
g AS (SELECT doc_key, bool_or(in_scope) AS in_scope, coalesce(arg_min(provenance, seq) FILTER (provenance NOT IN ('', 'relation')), arg_max(provenance, seq)) AS provenance, arg_max(content_hash, seq) FILTER (content_hash IS NOT NULL) AS content_hash, arg_max(detail_url, seq) FILTER (detail_url IS NOT NULL) AS detail_url, coalesce(bool_or(rn > 1 AND content_hash IS NOT NULL AND content_hash IS DISTINCT FROM before), false) AS reopened FROM w GROUP BY doc_key)
SELECT doc_key, in_scope, provenance, content_hash, detail_url, CASE WHEN reopened THEN 'discovered' ELSE 'complete' END AS state, CASE WHEN reopened THEN 0 ELSE CAST(3 AS BIGINT) END AS artifacts_done, reopened FROM g""", Duck()),
}
