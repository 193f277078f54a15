"""Writes as whole-table derivations: no MERGE on plain files, so a new snapshot comes of the old one and what arrives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING; of several incoming rows of a key one goes in, the least."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in incoming.columns))
    fresh = incoming.join(existing, keys, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return existing.unionByName(fresh)


def fill(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Each incoming column replaces the stored one unless it is null."""
    a, b = existing.alias("a"), incoming.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, on, "full").select(*(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in existing.columns))


def by_priority(existing: DataFrame, incoming: DataFrame, key: str, priority: str, columns: list[str], text: str) -> DataFrame:
    """Columns are replaced where the incoming priority is not lower; a text that is not null wins; the priority is the greater."""
    a, b = existing.alias("a"), incoming.alias("b")

    def of(c: str) -> Column:
        return F.when(F.col(f"a.{key}").isNull() | (F.coalesce(F.col(f"b.{priority}"), F.lit(-1)) >= F.col(f"a.{priority}")), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *(of(c).alias(c) for c in columns),
        F.coalesce(f"b.{text}", f"a.{text}").alias(text),
        F.greatest(f"a.{priority}", f"b.{priority}").alias(priority),
    )


def supersede(history: DataFrame, observed: DataFrame) -> DataFrame:
    """Validity history (document_id, status, eff_from, observed_at, superseded_at): open rows that an observation changes are closed at its time, then it is added; equal ones change nothing, and an observation without status never overrides a known one."""
    opened = history.where("superseded_at is null").select("document_id", F.col("status").alias("was"), F.col("eff_from").alias("was_from"))
    fresh = observed.join(opened, "document_id", "left").where("status is not null or was is null").where(~(F.col("status").eqNullSafe(F.col("was")) & F.col("eff_from").eqNullSafe(F.col("was_from"))) | F.col("was").isNull() & F.col("was_from").isNull())
    at = fresh.groupBy("document_id").agg(F.max("observed_at").alias("closed"))
    closed = history.join(at, "document_id", "left").withColumn("superseded_at", F.coalesce("superseded_at", "closed")).drop("closed")
    return closed.unionByName(fresh.select("document_id", "status", "eff_from", "observed_at", F.lit(None).cast("timestamp").alias("superseded_at")))


def pointers(existing: DataFrame, incoming: DataFrame, key: str = "ref_key") -> DataFrame:
    """References (key, document_id, src_ref): a pointer that is resolved never goes back to null, a source's own record wins over none."""
    a, b = existing.alias("a"), incoming.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.coalesce("b.document_id", "a.document_id").alias("document_id"), F.coalesce("b.src_ref", "a.src_ref").alias("src_ref"))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """Children of `parents` go, those that come in take their place; a parent without new children loses its old ones."""
    return existing.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(incoming.join(parents.select(parent).distinct(), parent, "left_semi"))
