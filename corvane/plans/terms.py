"""Many terms at once over all documents; the vocabularies come from the benchmark's items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import term_scan
from corvane.operators.term_scan import CLASSES, Vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def j10_many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every distinct word of six letters or more of the benchmark stands in each document."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-zà-ÿ]+")).alias("w")).where("length(w) >= 6").distinct()
    found = term_scan.occurrences(_table(spark, sf_dir, "documents"), [r.w for r in words.collect()])
    return found.select("id", "term", "first")


def r18_scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope gate with number, title and body: items' first two words are terms, the first alone for signals."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w")).collect()
    terms = [(r.w[0] if r.item_id % 4 == 3 else " ".join(r.w[: 1 if r.item_id % 4 == 2 else 2]), CLASSES[r.item_id % 4]) for r in rows]
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("doc_number"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"))
    return term_scan.scoped(docs, Vocabulary.of(terms), "doc_id").select(F.col("id").alias("doc_id"), "in_scope", F.array_join(F.array_sort(F.array_distinct("matched")), "|").alias("matched"))


QUERIES = {f.__name__: f for f in (j10_many_terms, r18_scope_gate)}

_NORMAL = "trim(regexp_replace(nfc_normalize(lower(coalesce({x}, ''))), '\\s+', ' ', 'g'))"
ORACLES = {
    "j10_many_terms": "WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) AS term FROM benchmark), t AS (SELECT term FROM w WHERE length(term) >= 6) SELECT doc_id AS id, term, CAST(strpos(lower(text), term) - 1 AS BIGINT) AS first FROM documents JOIN t ON contains(lower(text), term)",
    "r18_scope_gate": f"""WITH terms AS (SELECT DISTINCT item_id % 4 AS class, {_NORMAL.format(x="CASE WHEN item_id % 4 >= 2 THEN split_part(text, ' ', 1) ELSE split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) END")} AS term FROM benchmark),
d AS (SELECT doc_id, {_NORMAL.format(x="source || '/' || doc_id")} || chr(10) || {_NORMAL.format(x="substring(text, 1, 60)")} AS head, {_NORMAL.format(x="text")} AS body FROM documents),
s AS (SELECT doc_id, bool_or(class = 3 AND contains(head, term)) AS signal FROM d, terms GROUP BY doc_id),
m AS (SELECT DISTINCT d.doc_id, term FROM d JOIN s USING (doc_id), terms WHERE term <> '' AND ((class = 0 AND (contains(head, term) OR contains(body, term))) OR (class = 1 AND contains(head, term)) OR (class = 2 AND signal AND contains(head, term)))),
a AS (SELECT doc_id, array_to_string(list_sort(list(term)), '|') AS matched FROM m GROUP BY doc_id)
SELECT d.doc_id, a.doc_id IS NOT NULL AS in_scope, coalesce(matched, '') AS matched FROM d LEFT JOIN a USING (doc_id)""",
}
