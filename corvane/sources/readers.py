"""Readers of captured payloads and of configuration, and the content-addressed sink."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the configuration tables that are seeded from CSV.
SEEDS = {
    "scope_term": "term string, term_class string, theme string",
    "discovery_keyword": "term string, source string",
    "issuer_code": "source string, code string, name string, in_scope boolean, is_sbv boolean",
    "relation_type": "source string, code string, label string, is_amending boolean, is_superseding boolean",
    "validity_status": "source string, code string, status_class string, is_current_law boolean",
    "setting": "key string, value string",
    "abbreviation_expand": "jurisdiction string, abbreviation string, expansion string",
}
_CITATION = "doc_number string, article string, clause string, point string, relation_ok boolean, alt_doc_numbers array<string>"
_GOLDEN = f"id string, question string, expected_citations array<struct<{_CITATION.replace(' ', ': ').replace(',: ', ', ')}>>, expect_abstain boolean, expect_fail boolean, notes string"


def seeds(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A seed CSV with a fixed schema; a malformed row fails the read."""
    return spark.read.csv(path, schema=SEEDS[table], header=True, mode="FAILFAST").withColumn("origin", F.lit("seed"))


def reload_seeds(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Seed rows are replaced; rows of users stay and win."""
    users = stored.where("origin = 'user'")
    return users.unionByName(fresh.dropDuplicates(keys).join(users, keys, "left_anti"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """A question set, a JSON array of cases. Refused: unknown fields, an empty set, a case without id or question or with an id that another has, one that expects an answer but no citation, a citation without a document. Sets are small files that the driver reads."""
    cases = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(cases, list) or not cases:
        raise ValueError(f"{path} holds no cases")
    of_case, of_citation = ["id", "question", "expected_citations", "expect_abstain", "expect_fail", "notes"], [x.split()[0] for x in _CITATION.split(", ")]
    seen = set()
    for k, c in enumerate(cases):
        cited = c.get("expected_citations") or []
        if extra := {*c} - {*of_case} | {x for e in cited for x in {*e} - {*of_citation}}:
            raise ValueError(f"case {k} has unknown fields {sorted(extra)}")
        if not c.get("id") or not c.get("question"):
            raise ValueError(f"case {k} has no id or no question")
        if c["id"] in seen:
            raise ValueError(f"case {c['id']} is there twice")
        if not c.get("expect_abstain") and not cited:
            raise ValueError(f"case {c['id']} expects neither citations nor abstention")
        if any(not e.get("doc_number") for e in cited):
            raise ValueError(f"case {c['id']} expects a citation without a document")
        seen.add(c["id"])
    rows = [tuple([tuple(map(e.get, of_citation)) for e in c.get(n) or []] if n == "expected_citations" else c.get(n) for n in of_case) for c in cases]
    return spark.createDataFrame(rows, _GOLDEN)


_CITED = "array<struct<doc_number: string, article: string>>"


def _json(spark: SparkSession, path: str):
    """A small JSON file, read whole by the driver."""
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def _cited(found: list | None) -> list[tuple]:
    return [(c.get("doc_number"), c.get("article")) for c in found or []]


def workflow_cases(spark: SparkSession, path: str) -> DataFrame:
    """Tasks for agents, a JSON array: (id, task, final_citations, must_check_relations, expect_abstain). Refused: an empty set, a case without id or task, an id that another has."""
    cases = _json(spark, path)
    if not isinstance(cases, list) or not cases:
        raise ValueError(f"{path} holds no cases")
    rows, seen = [], set()
    for k, c in enumerate(cases):
        if not c.get("id") or not c.get("task"):
            raise ValueError(f"case {k} has no id or no task")
        if c["id"] in seen:
            raise ValueError(f"case {c['id']} is there twice")
        seen.add(c["id"])
        e = c.get("expected") or {}
        rows.append((c["id"], c["task"], _cited(e.get("final_citations")), bool(e.get("must_check_relations")), bool(e.get("expect_abstain"))))
    return spark.createDataFrame(rows, f"id string, task string, final_citations {_CITED}, must_check_relations boolean, expect_abstain boolean")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """What agents did, a JSON array: (case_id, cited, abstained, tools); a case may have several."""
    rows = [(t.get("case_id"), _cited(t.get("cited")), bool(t.get("abstained")), [c.get("tool") for c in t.get("tool_calls") or []]) for t in _json(spark, path)]
    return spark.createDataFrame(rows, f"case_id string, cited {_CITED}, abstained boolean, tools array<string>")


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of captured RSS feeds: (title, link, published)."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path).select("title", "link", F.to_timestamp(F.regexp_replace("pubDate", r"^\w+, ", ""), "d MMM yyyy HH:mm:ss Z").alias("published"))


def listing(pages: DataFrame, row: str, fields: dict[str, str], column: str = "html") -> DataFrame:
    """Rows of captured listings: `row` is a pattern of one entry, each field a pattern with one group."""
    entries = pages.select(*[c for c in pages.columns if c != column], F.posexplode(F.regexp_extract_all(column, F.lit(row), 0)).alias("place", "entry"))
    return entries.select(*[c for c in entries.columns if c != "entry"], *(F.nullif(F.regexp_extract("entry", p, 1), F.lit("")).alias(n) for n, p in fields.items()))


def since(items: DataFrame, watermarks: DataFrame, time: str = "published", overlap_hours: int = 48) -> DataFrame:
    """Items of each source after its watermark less the overlap; a source without a watermark is read whole."""
    w = watermarks.select("source", F.col("watermark"))
    return items.join(w, "source", "left").where(F.col("watermark").isNull() | (F.col(time) > F.col("watermark") - F.expr(f"interval {overlap_hours} hours"))).drop("watermark")


def advanced(watermarks: DataFrame, items: DataFrame, complete: DataFrame, time: str = "published") -> DataFrame:
    """Watermarks after a run: the newest item of sources that were read completely; none goes back."""
    new = items.join(complete.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.max(time).alias("newest"))
    return watermarks.join(new, "source", "full").select("source", F.greatest("watermark", "newest").alias("watermark"))


def addressed(files: DataFrame, content: str = "content", extension: str = "bin") -> DataFrame:
    """Distinct contents under their address: sha256 and extension."""
    return files.withColumn("address", F.concat(F.sha2(content, 256), F.lit(f".{extension}"))).dropDuplicates(["address"])


def discovered(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("source", "external_id"), time: str = "published", overlap_hours: int = 48) -> DataFrame:
    """A stream of captured discovery listings (JSON lines), each item once although listings overlap: repeats within the overlap are dropped, later ones come again as rediscoveries."""
    return spark.readStream.schema(schema).json(path).withWatermark(time, f"{overlap_hours} hours").dropDuplicatesWithinWatermark(list(keys))
