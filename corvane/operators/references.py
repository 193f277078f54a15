"""Reference resolution and chunks of related documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(refs: DataFrame, documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref_id, document_id, outcome) for refs (ref_id, document_id, alias, candidates array<string>).

    A known alias (alias, document_id) decides; else the first candidate, in order, that exactly one document
    (doc_key, document_id) has. A candidate that several documents share decides nothing. Outcomes: resolved (there was
    no pointer), corrected, unchanged, cleared (the pointer's reference is now ambiguous), ambiguous and unmatched
    (no pointer, or an unmatched one, which stays as it was).
    """
    keys = documents.groupBy("doc_key").agg(F.count_distinct("document_id").alias("n"), F.min("document_id").alias("found"))
    named = aliases.groupBy("alias").agg(F.count_distinct("document_id").alias("n"), F.min("document_id").alias("found")).where("n = 1").select("alias", F.col("found").alias("by_alias"))
    tried = refs.select("ref_id", F.posexplode("candidates").alias("place", "doc_key")).join(keys, "doc_key")
    best = tried.groupBy("ref_id").agg(F.min(F.when(F.col("n") == 1, F.struct("place", "found"))).alias("one"), F.max("n").alias("most"))
    r = refs.join(named, "alias", "left").join(best, "ref_id", "left")
    new = F.coalesce("by_alias", "one.found")
    many = new.isNull() & (F.coalesce("most", F.lit(0)) > 1)
    outcome = (
        F.when(new.isNotNull() & F.col("document_id").isNull(), "resolved")
        .when(new.isNotNull() & (new != F.col("document_id")), "corrected")
        .when(new.isNotNull(), "unchanged")
        .when(many & F.col("document_id").isNotNull(), "cleared")
        .when(many, "ambiguous")
        .otherwise("unmatched")
    )
    return r.select("ref_id", F.when(many, None).otherwise(F.coalesce(new, "document_id")).alias("document_id"), outcome.alias("outcome"))


def related_hits(hits: DataFrame, relations: DataFrame, binding: DataFrame, chunks: DataFrame, each: int = 2, limit: int = 10) -> DataFrame:
    """Chunks of documents that the hits' documents relate to: (chunk_id, document_id, source_rank, place).

    hits (document_id, rank), relations (from_id, to_id), binding (document_id) of the documents with binding text,
    chunks (chunk_id, document_id, distance). A target counts once, for its best source, and not if it is a hit itself;
    its `each` nearest chunks go on, and the `limit` best by (distance, source rank, chunk) are placed.
    """
    sources = hits.groupBy("document_id").agg(F.min("rank").alias("source_rank"))
    seeds = relations.join(sources, F.col("from_id") == F.col("document_id")).groupBy("to_id").agg(F.min("source_rank").alias("source_rank")).withColumnRenamed("to_id", "document_id")
    seeds = seeds.join(sources.select("document_id"), "document_id", "left_anti").join(binding.select("document_id").distinct(), "document_id", "left_semi")
    w = Window.partitionBy("document_id").orderBy("distance", "chunk_id")
    near = chunks.join(seeds, "document_id").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n")
    order = ["distance", "source_rank", "chunk_id"]
    top = near.orderBy(*order).limit(limit)
    return top.select("chunk_id", "document_id", "source_rank", F.row_number().over(Window.orderBy(*order)).alias("place"))
