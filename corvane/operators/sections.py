"""Provision trees as adjacency tables: pre-order, ancestors, appendix merge, and article text put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.storage import shared_folder, written

#: Levels of a tree; headings have six, legal trees with appendices a few more.
DEPTH = 16
#: Characters beyond which an article is pointed to and not shown.
LONGEST = 14_000


def preorder(sections: DataFrame, tree: str = "document_id", depth: int = DEPTH) -> DataFrame:
    """(tree, id, depth, path, ancestors): path sorts sections in reading order, ancestors are ids from the root down.

    sections (tree, id, parent_id, ordinal): a join of one level with the next, on the tree and the parent, until no
    level is left. Each level is written, so that a step joins the last one's rows and none is computed twice. Rows below
    a missing parent or in a circle are not reached. Trees deeper than `depth` raise.
    """
    step = F.lpad(F.col("ordinal").cast("string"), 8, "0")
    s = sections.select(tree, "id", "parent_id", step.alias("step"))
    level = s.where("parent_id is null").select(tree, "id", F.lit(0).alias("depth"), F.col("step").alias("path"), F.array().cast("array<bigint>").alias("ancestors"))
    below = s.where("parent_id is not null").select(F.col(tree).alias("t"), F.col("id").alias("child"), "parent_id", "step")
    folder = shared_folder(sections.sparkSession)
    level = written(level, folder, "level-0")
    out = level
    for k in range(1, depth + 1):
        level = level.join(below, (F.col(tree) == F.col("t")) & (F.col("id") == F.col("parent_id"))).select(
            tree, F.col("child").alias("id"), F.lit(k).alias("depth"), F.concat_ws("/", "path", "step").alias("path"), F.concat("ancestors", F.array(F.col("id").cast("bigint"))).alias("ancestors")
        )
        level = written(level, folder, f"level-{k}")
        if level.isEmpty():
            return out
        if k == depth:
            raise ValueError(f"a tree is deeper than {depth} levels")
        out = out.unionByName(level)
    return out


def merged_appendices(main: DataFrame, appendices: DataFrame, keys: tuple[str, ...] = ("document_id", "path")) -> DataFrame:
    """Sections of the main tree, and those of the appendices whose paths it has not."""
    return main.unionByName(appendices.join(main.select(*keys).distinct(), list(keys), "left_anti").select(*main.columns))


def _shared_lines(a: Column, b: Column) -> Column:
    """How many first lines two arrays of lines have in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x.eqNullSafe(y) & x.isNotNull() & y.isNotNull(), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def articles(chunks: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(document_id, article, chunks, characters, text) of chunks (document_id, article, ordinal, content).

    Chunks of an article stand in their order; first lines that a chunk repeats from the one before (its lead-in) are
    left out. Articles of more than `longest` characters have a null text: lengths are summed before any text is
    gathered, so no group is gathered beyond that bound.
    """
    w = Window.partitionBy("document_id", "article").orderBy("ordinal")
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    c = chunks.withColumn("_lines", lines).withColumn("_before", F.lag("_lines").over(w))
    shared = F.when(F.col("_before").isNull(), 0).otherwise(_shared_lines(F.col("_lines"), F.col("_before")))
    c = c.select("document_id", "article", "ordinal", F.array_join(F.slice("_lines", shared + 1, F.size("_lines") + 1), "\n").alias("rest"))
    size = c.groupBy("document_id", "article").agg(F.count("*").alias("chunks"), F.sum(F.length("rest")).alias("characters"))
    short = c.join(size.where(F.col("characters") <= longest).select("document_id", "article"), ["document_id", "article"], "left_semi").where("rest <> ''")
    text = short.groupBy("document_id", "article").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rest"))).alias("parts")).select("document_id", "article", F.array_join(F.col("parts.rest"), "\n").alias("text"))
    out = size.join(text, ["document_id", "article"], "left")
    return out.select("document_id", "article", "chunks", "characters", F.when(F.col("characters") <= longest, F.coalesce("text", F.lit(""))).alias("text"))
