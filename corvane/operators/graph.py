"""Relation graphs: transitive chains of bounded depth, families as connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.components import components
from corvane.storage import shared_folder, written


def chain(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(base, node, depth) of what is reached from every base over edges (from_id, to_id), no node twice on a path, the base never.

    A join for each step: paths carry the nodes they have passed, four ids at most. Each step's paths are written, so
    that a step joins the last one's rows and none is computed twice.
    """
    e = edges.select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))
    path = e.select(F.col("u").alias("base"), F.col("v").alias("node"), F.lit(1).alias("depth"), F.array("u", "v").alias("path")).where("base <> node")
    folder = shared_folder(edges.sparkSession)
    path = written(path, folder, "paths-1")
    out = path
    for k in range(2, depth + 1):
        path = path.join(e, F.col("node") == F.col("u")).where(~F.array_contains("path", F.col("v"))).select("base", F.col("v").alias("node"), F.lit(k).alias("depth"), F.concat("path", F.array("v")).alias("path"))
        path = written(path, folder, f"paths-{k}")
        out = out.unionByName(path)
    return out.select("base", "node", "depth").distinct()


def families(edges: DataFrame) -> DataFrame:
    """(node, family) with the smallest node of each connected component of the edges (from_id, to_id); a loop alone is a family of one."""
    e = edges.selectExpr("from_id as u", "to_id as v").where("u is not null and v is not null")
    found = components(e, shared_folder(edges.sparkSession), "families")
    # whoever has an edge to another node was found
    alone = e.where("u = v").selectExpr("u as node").distinct().join(found.select("node"), "node", "left_anti")
    return found.select("node", F.col("root").alias("family")).unionByName(alone.select("node", F.col("node").alias("family")))
