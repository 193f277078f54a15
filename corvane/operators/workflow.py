"""Scores of agent transcripts against what their tasks expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(a: Column, b: Column) -> Column:
    return F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))


def scored(cases: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(case_id, citation_score, abstain_correct, followed_relations, tool_calls, searches, documents) for each transcript of a known case.

    cases: id, final_citations array<struct<doc_number, article>>, must_check_relations, expect_abstain; transcripts:
    case_id, cited (as final_citations), abstained, tools array<string>. An expected citation is found if a cited one has
    its document, and its article where one is expected; letter case and blanks around don't count. Where none is
    expected, citing none is right. Relations count as followed if they needn't be, or a document was opened.
    """
    none = F.array().cast("array<struct<doc_number:string,article:string>>")
    c = cases.select(F.col("id").alias("case_id"), F.coalesce("final_citations", none).alias("expected"), F.coalesce("must_check_relations", F.lit(False)).alias("must"), F.coalesce("expect_abstain", F.lit(False)).alias("expect"))
    t = transcripts.select("case_id", F.coalesce("cited", none).alias("cited"), F.coalesce("abstained", F.lit(False)).alias("abstained"), F.coalesce("tools", F.array().cast("array<string>")).alias("tools"))

    def found(e: Column) -> Column:
        return F.exists("cited", lambda x: _same(x.doc_number, e.doc_number) & ((F.coalesce(e.article, F.lit("")) == "") | _same(x.article, e.article)))

    hits = F.size(F.filter("expected", found))
    share = F.when(F.size("expected") == 0, (F.size("cited") == 0).cast("double")).otherwise(hits / F.greatest(F.size("expected"), F.lit(1)))

    def calls(tool: str) -> Column:
        return F.size(F.filter("tools", lambda x: x == tool))

    return t.join(c, "case_id").select(
        "case_id",
        share.alias("citation_score"),
        (F.col("abstained") == F.col("expect")).alias("abstain_correct"),
        (~F.col("must") | (calls("document") > 0)).alias("followed_relations"),
        F.size("tools").alias("tool_calls"),
        calls("search").alias("searches"),
        calls("document").alias("documents"),
        "must",
    )


def summary(scores: DataFrame) -> DataFrame:
    """One row over scored(): cases, mean citation score, share of right abstentions, relations followed where they must be (1 if nowhere), mean number of calls."""
    right = lambda x: F.avg(F.col(x).cast("double"))
    return scores.agg(
        F.count("*").alias("cases"),
        F.coalesce(F.avg("citation_score"), F.lit(0.0)).alias("citation_score"),
        F.coalesce(right("abstain_correct"), F.lit(0.0)).alias("abstention"),
        F.coalesce(F.avg(F.when(F.col("must"), F.col("followed_relations").cast("double"))), F.when(F.count("*") > 0, 1.0).otherwise(0.0)).alias("relations"),
        F.coalesce(F.avg("tool_calls"), F.lit(0.0)).alias("tool_calls"),
    )
