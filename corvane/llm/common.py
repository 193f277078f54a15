"""What several operators share: the shared folder, written tables, words of a text, spans of batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and 0x09-0x0D. bytes.split() without arguments splits at just these.
SPACES = b" \t\n\v\f\r"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver share.

    Only where that setting is absent, as in local tests, is a folder of this machine set instead. The
    folder goes when the driver's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/corvane-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI of the shared folder, and the path there. Spark's names of S3 are pyarrow's s3."""
    kind, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(("s3" if kind in ("s3a", "s3n") else kind) + mark + rest)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: its lineage ends there, and columns are pruned on reading."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of the table is called so in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo; null counts as bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null gives an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def text_ends(texts: pa.Array) -> np.ndarray:
    """Where each text begins in the column's bytes, and the end; of columns with 32-bit or 64-bit offsets."""
    if not len(texts):
        return np.zeros(1, np.int64)
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    elif pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        kind = np.int32
    else:
        raise TypeError(f"texts of type {texts.type}")
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that add up to about `most`, one row at least."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = min(max(int(np.searchsorted(ends, ends[at] + most, side="left")), at + 1), n)
        yield at, to
        at = to


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about `most` bytes, so that arrays over bytes stay small."""
    for a, z in _runs(text_ends(batch.column(column)), most):
        yield batch.slice(a, z - a)


def number_slices(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """32-bit numbers of a binary column, in runs of rows with about `most`: (numbers, where each row begins and the end, first row, row behind the last)."""
    ends = text_ends(column)
    values = np.frombuffer(column.buffers()[2], "<i4", (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] > ends[0] else np.zeros(0, "<i4")
    ends = (ends - ends[0]) // 4
    for a, z in _runs(ends, most):
        yield values[ends[a] : ends[z]], ends[a : z + 1] - ends[a], a, z
