"""Ranks of rows by a distributed least-significant-digit radix sort, as stable counting passes of DataFrame operators.

A pass orders rows by one digit and leaves those of equal digits as they were. Places are cut into blocks; each block
counts its rows by digit, and the exclusive sum of these counts, digit by digit and within it block by block, says where
the rows of a block with a digit begin. A row's new place is that beginning plus the rows of its block and digit before it.

The sums are taken by levels: FAN neighbours at once, then the sums of those, so that no task gets more than FAN numbers
of one group, however many rows, blocks or equal keys there are. Only keys and places are shuffled, once for each pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import written

#: Bits of a digit and of the places in a block; counts that are summed at once.
DIGIT, BLOCK, FAN = 16, 20, 1024


def digits(key: Column, bits: int) -> list[Column]:
    """The digits of a whole number of 0 or more with so many bits, least significant first."""
    return [F.shiftrightunsigned(key, at).bitwiseAND(F.lit((1 << DIGIT) - 1)) for at in range(0, bits, DIGIT)]


def signed_digits(key: Column) -> list[Column]:
    """The digits of a bigint; negative numbers come first."""
    return digits(key.bitwiseXOR(F.lit(-(1 << 63))), 64)


def begins(counts: DataFrame, top: int) -> DataFrame:
    """(k, begin) of counts (k, n), k from 0 to `top`: the sum of n over all smaller k."""
    if top < FAN:
        w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("k", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("begin"))
    c = counts.withColumn("group", F.expr(f"k div {FAN}"))
    above = begins(c.groupBy(F.col("group").alias("k")).agg(F.sum("n").alias("n")), top // FAN)
    w = Window.partitionBy("group").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inside = c.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return inside.join(above.select(F.col("k").alias("group"), "begin").hint("merge"), "group").select("k", (F.col("begin") + F.col("before")).alias("begin"))


def counting_pass(rows: DataFrame, digit: Column, top: int, folder: str, name: str) -> DataFrame:
    """rows (place, ...) with the places after ordering by digit; places are distinct and at most `top` before, and 0 to n - 1 after."""
    blocks = (top >> BLOCK) + 1
    r = rows.withColumn("k", digit * F.lit(blocks) + F.shiftright("place", BLOCK))
    counts = written(r.groupBy("k").agg(F.count("*").alias("n")), folder, f"{name}-counts")
    nth = F.row_number().over(Window.partitionBy("k").orderBy("place"))
    out = r.withColumn("nth", nth).join(begins(counts, (blocks << DIGIT) - 1).hint("merge"), "k")
    return written(out.select(*(c for c in rows.columns if c != "place"), (F.col("begin") + F.col("nth") - 1).alias("place")), folder, name)


def ranked(rows: DataFrame, passes: list[tuple[str, Column]], folder: str) -> DataFrame:
    """rows (place, ...) with the ranks 0 to n - 1 as places, by the digits of `passes` (name, digit), least significant first.

    Rows whose digits are all equal keep the order of their places, which must be distinct. Digits that are equal in all
    rows need no pass. `place`, `k`, `nth` and `begin` are the only names used here. An empty table stays empty.
    """
    ends = rows.agg(F.count("*").alias("n"), F.max("place").alias("place"), *(f(d).alias(f"{f.__name__}{i}") for i, (_, d) in enumerate(passes) for f in (F.min, F.max))).first()
    if not ends.n:
        return rows
    top = ends.place
    for i, (name, digit) in enumerate(passes):
        if ends[f"min{i}"] != ends[f"max{i}"]:
            rows = counting_pass(rows, digit, top, folder, name)
            top = ends.n - 1
    if top != ends.n - 1:
        rows = counting_pass(rows, F.lit(0).cast("bigint"), top, folder, "dense")
    return rows
