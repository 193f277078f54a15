"""A table sorted into files of drifted schemas, and their rewrite into one evolved schema by field ids.

Ranks come from the radix sort (`radix`): the low digits first, client_id's, then its crc32's. Rows meet their ranks by a
number that was written with them, and each file is written by one task from rows that Spark has sorted, in a stream.

A file's columns are known by their Parquet field ids alone. The rewrite opens each file as a dataset fragment, derives a
projection expression for every field of the evolved schema from the ids in that file (the column of this id, whatever its
name, place and type, or a constant) and streams its scan into a new file. A task writes beside the folder and moves what
is complete into it, under a name that depends on the file only; old files go when all new ones are there. So tasks may
be repeated at any time.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import file_system, shared_dir, written
from corvane.llm.radix import digits, ranked, signed_digits

#: Rows of a row group and of a scanned batch.
GROUP = 1 << 16
_ID = b"PARQUET:field_id"
#: The evolved schema: field id, name, type here and in Spark.
FIELDS = (
    (1, "client_id", pa.int64(), "bigint"),
    (2, "master_id", pa.int64(), "bigint"),
    (3, "source", pa.string(), "string"),
    (4, "updated_at", pa.timestamp("us"), "timestamp_ntz"),
    (5, "name", pa.string(), "string"),
    (6, "email", pa.string(), "string"),
    (7, "city", pa.string(), "string"),
    (8, "nation_id", pa.int64(), "bigint"),
    (9, "segment", pa.string(), "string"),
    (10, "balance", pa.float64(), "double"),
)
#: What rows get where a file has no column of this id; other fields get nulls.
DEFAULTS = {8: -1, 9: "none"}


def field(number: int, name: str, kind: pa.DataType) -> pa.Field:
    return pa.field(name, kind, True, {_ID: str(number).encode()})


def evolved() -> pa.Schema:
    return pa.schema([field(i, name, kind) for i, name, kind, _ in FIELDS])


def id_of(f: pa.Field) -> int | None:
    return int(f.metadata[_ID]) if f.metadata and _ID in f.metadata else None


def version_of(file_no: int) -> int:
    v = zlib.crc32(b"19:%d" % file_no) % 24
    return 0 if v > 15 else v


def drifted(version: int) -> pa.Schema:
    """The evolved schema as files of a version have it: 1 swaps two names, 2 reverses the columns behind the first, 4 drops two, 8 narrows two."""
    names = {5: "email", 6: "name"} if version & 1 else {}
    kinds = {10: pa.float32(), 8: pa.int32()} if version & 8 else {}
    fields = [field(i, names.get(i, name), kinds.get(i, kind)) for i, name, kind, _ in FIELDS]
    if version & 2:
        fields = fields[:1] + fields[:0:-1]
    return pa.schema([f for f in fields if not (version & 4 and id_of(f) in DEFAULTS)])


def ranks(rows: DataFrame, folder: str) -> DataFrame:
    """(row, place) of rows (row, client_id, ...): ranks by unsigned crc32 of the decimal client_id, then client_id.

    Null ids come last. Rows of equal ids go by the 64-bit hash of all their columns, in four further passes that are
    only made where an id repeats, and rows that are equal in that too by their numbers.
    """
    keys = rows.select("row", "client_id")
    tied = not keys.groupBy("client_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    passes = []
    if tied:
        columns = [F.col(c) for c in rows.columns if c != "row"]
        keys = rows.select("row", "client_id", F.xxhash64(*columns, *(c.isNull() for c in columns)).alias("tie"))
        passes += [(f"tie{i}", d) for i, d in enumerate(digits(F.col("tie"), 64))]
    passes += [(f"id{i}", F.coalesce(d, F.lit(0))) for i, d in enumerate(signed_digits(F.col("client_id")))]
    passes += [(f"crc{i}", F.coalesce(d, F.lit(0))) for i, d in enumerate(digits(F.crc32(F.col("client_id").cast("string").cast("binary")), 32))]
    passes.append(("null", F.col("client_id").isNull().cast("bigint")))
    return ranked(keys.withColumn("place", F.col("row")), passes, folder).select("row", "place")


class _Writer:
    """A Parquet file that is written aside and moved to its place when complete."""

    def __init__(self, path: str, aside: str, schema: pa.Schema):
        self.fs, self.path = file_system(path)
        self.aside = f"{file_system(aside)[1]}/{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.aside)
        self.writer, self.schema = pq.ParquetWriter(self.stream, schema), schema
        self.held: list[pa.RecordBatch] = []
        self.n = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.n += batch.num_rows
        if self.n >= GROUP:
            self.flush()

    def flush(self) -> None:
        if self.n:
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema))
        self.held, self.n = [], 0

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.stream.close()
        try:
            self.fs.move(self.aside, self.path)
        except OSError:
            # another attempt of this task was faster; its file is the same
            if self.fs.get_file_info(self.path).type.name != "File":
                raise
            self.fs.delete_file(self.aside)


def narrowed(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Columns of the evolved schema, in its order, as those of a drifted one."""
    at = {i: k for k, (i, *_) in enumerate(FIELDS)}
    return pa.RecordBatch.from_arrays([pc.cast(batch.column(at[id_of(f)]), f.type, safe=f.type != pa.float32()) for f in schema], schema=schema)


_STARTS = "file_no bigint, version bigint, path string"


def write_drifted(rows: DataFrame, folder: str, aside: str, files: int) -> DataFrame:
    """(file_no, version, path) of the files written of rows (file_no, place, evolved columns): one a file_no, in order of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, str]] = []
        writer, now = None, -1
        for b in batches:
            numbers = b.column(0).to_numpy()
            cuts = [0, *((numbers[1:] != numbers[:-1]).nonzero()[0] + 1).tolist(), len(numbers)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if writer is None or now != int(numbers[a]):
                    if writer:
                        writer.close()
                    now = int(numbers[a])
                    version = version_of(now)
                    done.append((now, version, f"{folder}/part-{now:05d}-v{version}.parquet"))
                    writer = _Writer(done[-1][2], aside, drifted(version))
                part = b.slice(a, z - a)
                writer.add(narrowed(pa.RecordBatch.from_arrays(part.columns[2:], schema=pa.schema([field(i, n, k) for i, n, k, _ in FIELDS])), writer.schema))
        if writer:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else ((), (), ()), (pa.int64(), pa.int64(), pa.string()))], ["file_no", "version", "path"])

    dealt = rows.select("file_no", "place", *(F.col(name).cast(kind) for _, name, _, kind in FIELDS))
    return dealt.repartitionById(files, F.col("file_no").cast("int")).sortWithinPartitions("file_no", "place").mapInArrow(run, _STARTS)


def projection(have: pa.Schema, want: pa.Schema, defaults: dict[int, object]) -> dict[str, pc.Expression]:
    """For every wanted field an expression over a file's columns: that of the same id, cast, or a constant."""
    names = {id_of(f): f.name for f in have if id_of(f) is not None}
    return {f.name: pc.field(names[id_of(f)]).cast(f.type) if id_of(f) in names else pc.scalar(pa.scalar(defaults.get(id_of(f)), f.type)) for f in want}


def _fragment(path: str) -> ds.Fragment:
    fs, where = file_system(path)
    return ds.ParquetFileFormat().make_fragment(where, fs)


def _scanned(fragment: ds.Fragment, columns: dict[str, pc.Expression] | None = None) -> Iterator[pa.RecordBatch]:
    """A file's batches in order, few of them at a time."""
    return fragment.scanner(columns=columns, batch_size=GROUP, batch_readahead=1, fragment_readahead=1, use_threads=False).to_batches()


def rewrite(files: DataFrame, folder: str, aside: str, n: int, want: pa.Schema, defaults: dict[int, object]) -> DataFrame:
    """(file_no, version, path, start_path, start_columns, rewritten) of files (file_no, version, path) in the wanted schema.

    Files that have this very schema, ids included, stay; the others' rows are streamed into `folder`, the old files stay
    for `drop_old`. Columns are found by their ids; columns of other ids, or of none, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, columns, new = [], [], []
            for no, path in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                fragment = _fragment(path)
                have = fragment.physical_schema
                columns.append(",".join(have.names))
                new.append([(f.name, f.type, id_of(f)) for f in have] != [(f.name, f.type, id_of(f)) for f in want])
                paths.append(f"{folder}/part-{no:05d}.parquet" if new[-1] else path)
                if new[-1]:
                    writer = _Writer(paths[-1], aside, want)
                    for part in _scanned(fragment, projection(have, want, defaults)):
                        writer.add(pa.RecordBatch.from_arrays(part.columns, schema=want))
                    writer.close()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(paths, pa.string()), b.column(2), pa.array(columns, pa.string()), pa.array(new, pa.bool_())], ["file_no", "version", "path", "start_path", "start_columns", "rewritten"])

    dealt = files.select("file_no", "version", "path").repartitionById(n, F.col("file_no").cast("int"))
    return dealt.mapInArrow(run, "file_no bigint, version bigint, path string, start_path string, start_columns string, rewritten boolean")


def drop_old(done: DataFrame) -> None:
    """Removes the old files of `rewrite`, whose result must have been written; the driver gets their names, one a file."""
    for r in done.where("rewritten").select("start_path").collect():
        fs, path = file_system(r.start_path)
        if fs.get_file_info(path).type.name == "File":
            fs.delete_file(path)


def _milli(column: pa.Array) -> pa.Array:
    """floor(1048576 x) as text; values without one as `nan`, `inf` and `-inf`."""
    scaled = pc.floor(pc.multiply(column, 1048576.0))
    try:
        return pc.cast(pc.cast(scaled, pa.int64()), pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else str(math.floor(x)) if math.isfinite(x) else str(x) for x in scaled.to_pylist()], pa.string())


def lines(batch: pa.RecordBatch) -> bytes:
    """A line for each row: fields in order between `|`, null as `?`, times in microseconds, doubles as floor(1048576 x)."""
    texts = []
    for c in batch.columns:
        if pa.types.is_timestamp(c.type):
            c = pc.cast(c, pa.int64())
        texts.append(pc.fill_null(_milli(c) if pa.types.is_floating(c.type) else pc.cast(c, pa.string()), "?"))
    return "\n".join(pc.binary_join_element_wise(*texts, "|").to_pylist()).encode()


def described(files: DataFrame, n: int, key: str = "client_id") -> DataFrame:
    """files (file_no, path, ...) with n_rows, n_nulls, columns, and the digests of their ids and rows, read back in a stream."""
    out = "file_no bigint, columns string, n_rows bigint, n_nulls bigint, ids_sha256 string, rows_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for no, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fragment = _fragment(path)
                ids, rows, n_rows, n_nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
                for part in _scanned(fragment):
                    if not part.num_rows:
                        continue
                    between = n_rows > 0
                    ids.update(b"," * between + ",".join(pc.fill_null(pc.cast(part.column(key), pa.string()), "?").to_pylist()).encode())
                    rows.update(b"\n" * between + lines(part))
                    n_rows += part.num_rows
                    n_nulls += sum(c.null_count for c in part.columns)
                found.append((no, ",".join(fragment.physical_schema.names), n_rows, n_nulls, ids.hexdigest(), rows.hexdigest()))
            names = [f.split()[0] for f in out.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], pa.schema([(f.split()[0], pa.int64() if f.endswith("bigint") else pa.string()) for f in out.split(", ")]))

    return files.select("file_no", "path").repartitionById(n, F.col("file_no").cast("int")).mapInArrow(run, out)


def rewrite_clients(clients: DataFrame, most: int = 250) -> DataFrame:
    """(file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns, path, rewritten) of the final files of clients.

    Rows in order of `ranks`, 1 + n div `most` to a file, at most `most` files, first drift by version and are then
    rewritten in a new folder below spark.checkpoint.dir, where they stay. Nulls stay nulls in every column; a null
    client_id sorts last; repeated rows are all kept, in an order that the input's partitions don't change; texts of any
    length go through streams; extra columns are ignored whatever their names; an empty table gives no files and no rows.
    updated_at is taken without a zone, as UTC; balances that files hold as floats lose digits, and infinite or not
    representable ones show as `inf`, `-inf` and `nan`. Files are written and read by one task each, in a stream.
    """
    spark = clients.sparkSession
    work = shared_dir(spark)
    base = f"{work.rpartition('/')[0]}/evolved-{uuid.uuid4().hex}"
    folder, aside = f"{base}/clients", f"{base}/aside"
    rows = clients.select(*(F.col(name).cast(kind).alias(name) for _, name, _, kind in FIELDS))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), work, "rows")
    n = rows.count()
    each = 1 + n // most
    files = max(1, -(-n // each))
    for path in (folder, aside):
        fs, where = file_system(path)
        fs.create_dir(where)
    placed = rows.join(ranks(rows, work).hint("merge"), "row").withColumn("file_no", F.expr(f"place div {each}"))
    starts = written(write_drifted(placed, folder, aside, files), work, "starts")
    done = written(rewrite(starts, folder, aside, files, evolved(), DEFAULTS), work, "done")
    drop_old(done)
    fs, where = file_system(aside)
    fs.delete_dir(where)
    about = described(done, files)
    return done.join(about.hint("merge"), "file_no").select("file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")

