"""Session settings shared by the queries, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corvane", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; cluster settings win where they are given.

    `partitions` sets the number of shuffle partitions; adaptive execution merges small ones, so on a
    cluster it is best left to the submitter (about three times the cores).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return b.config(map=settings).getOrCreate()
