"""Queries of the text functions, the dictionary, families and the stream, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import graph
from corvane.plans.evidence import _relation, _table
from corvane.storage import checkpoint_folder
from corvane.sources import readers

_DUCK_FOLD = "regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')"


def x2_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.folded(F.col("text")).alias("folded"))


def a10_bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every term; explode, then one aggregate that is combined before its shuffle."""
    t = _table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.folded_tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


def a11_dictionary(spark: SparkSession, sf_dir: str, least: int = 5, share: float = 0.6) -> DataFrame:
    """Folded words with a dominant accented form: at least `least` uses and `share` of them in one form that differs."""
    words = _table(spark, sf_dir, "documents").select(F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{Nd}]+", " "), " ")).alias("form")).where("form <> ''")
    forms = words.groupBy("form").agg(F.count("*").alias("n")).withColumn("folded", F.trim(T.folded(F.col("form"))))
    w = Window.partitionBy("folded")
    ranked = forms.withColumn("total", F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), F.asc("form"))))
    return ranked.where((F.col("place") == 1) & (F.col("total") >= least) & (F.col("n") >= share * F.col("total")) & (F.col("form") != F.col("folded"))).select("folded", "form", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def i1_document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    number = F.concat_ws("/", "source", "doc_id")
    return d.select("doc_id", T.document_number(number).alias("stored"), T.document_key(F.col("lang"), number, F.col("source"), F.col("doc_id").cast("string")).alias("doc_key"))


def r18_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.in_scope(F.col("text"), ["license"], ["token"], ["the", "der"]).alias("in_scope"))


def s_html_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of captured pages, as the listing reader finds them."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "html")
    found = readers.listing(pages, r'<a href="[^"]*">[^<]*</a>', {"link": r'href="([^"]*)"', "label": r">([^<]*)<"})
    return found.select("page_id", F.col("place").cast("long").alias("place"), "link", "label")


def st1_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("published"))
    empty = spark.createDataFrame([], "source string, watermark timestamp")
    return readers.advanced(empty, e, e.select("source"))


def g3_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_folder(spark)
    return graph.families(_relation(spark, sf_dir))


QUERIES = {f.__name__: f for f in (x2_folded, a10_bm25_statistics, a11_dictionary, i1_document_keys, r18_scope, s_html_listing, st1_watermarks, g3_families)}
_PAD = "concat(' ', " + _DUCK_FOLD.format(x="text") + ", ' ')"
ORACLES = {
    "x2_folded": f"SELECT doc_id, {_DUCK_FOLD.format(x='text')} AS folded FROM documents",
    "a10_bm25_statistics": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split({_DUCK_FOLD.format(x='text')}, ' ')) AS term FROM documents) WHERE term <> '' GROUP BY term",
    "a11_dictionary": f"""WITH w AS (SELECT unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' ')) AS form FROM documents),
        f AS (SELECT form, count(*) AS n, trim({_DUCK_FOLD.format(x='form')}) AS folded FROM w WHERE form <> '' GROUP BY form),
        r AS (SELECT *, sum(n) OVER (PARTITION BY folded) AS total, row_number() OVER (PARTITION BY folded ORDER BY n DESC, form) AS place FROM f)
        SELECT folded, form, round(n / total, 6) AS share FROM r WHERE place = 1 AND total >= 5 AND n >= 0.6 * total AND form <> folded""",
    "i1_document_keys": "SELECT doc_id, upper(source) || doc_id AS stored, upper(lang) || '|' || upper(source) || doc_id AS doc_key FROM documents",
    "r18_scope": f"SELECT doc_id, contains(p, ' license ') OR (contains(p, ' token ') AND (contains(p, ' the ') OR contains(p, ' der '))) AS in_scope FROM (SELECT doc_id, {_PAD} AS p FROM documents)",
    "s_html_listing": """WITH e AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS x FROM pages), u AS (SELECT page_id, unnest(range(len(x))) AS place, unnest(x) AS a FROM e)
        SELECT page_id, place, nullif(regexp_extract(a, 'href="([^"]*)"', 1), '') AS link, nullif(regexp_extract(a, '>([^<]*)<', 1), '') AS label FROM u""",
    "st1_watermarks": "SELECT event_type AS source, max(ts) AS watermark FROM events GROUP BY event_type",
}
