"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import written


def _toward_least(edges: DataFrame, both: bool) -> DataFrame:
    """Links the neighbours of every node to the least of them: those above the node (both), or those below and the node itself."""
    e = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if both:
        e = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = e.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        out = e.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        least = e.groupBy("x").agg(F.min("y").alias("m"))
        out = e.join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.where("u > v")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for every node of the edges (u, v), root the least node of its component.

    Loops and repeated edges are allowed; without edges the result is empty. Every round's edges are written
    to the shared folder, so a lost executor costs one round at most. Rounds grow with the logarithm of the
    longest path. Edges of a hub are many rows with one key: the join leaves them to adaptive skew handling,
    the minimum is combined before it is shuffled.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = written(e, folder, f"{name}-0")
    step, before = 0, None
    while True:
        print_of = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == before or not print_of[0]:
            break
        before = print_of
        step += 1
        # the larger star gives a row for each edge at most, so only what is written is made distinct
        e = written(_toward_least(_toward_least(e, True), False).distinct(), folder, f"{name}-{step}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
