"""Ranks against sorted(), and the files of the rewrite against the contract computed row by row."""

import datetime
import hashlib
import math
import os
import random
import struct
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane.llm import radix, schema_rewrite
from corvane.llm.common import file_system, shared_dir
from corvane.llm.queries import QUERIES

NAMES = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
SCHEMA = "client_id bigint, master_id bigint, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def crc(x):
    return zlib.crc32(str(x).encode())


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(name, x):
    if x is None:
        return "?"
    if name == "updated_at":
        return str((x - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1))
    if name == "balance":
        return str(math.floor(1048576 * x)) if math.isfinite(x) else str(x)
    return str(x)


def plain(rows):
    """What the contract says of rows (dicts) with distinct ids."""
    rows = sorted(rows, key=lambda r: (r["client_id"] is None, crc(r["client_id"]), r["client_id"]))
    each, out = 1 + len(rows) // 250, {}
    for no in range(-(-len(rows) // each)):
        part = [dict(r) for r in rows[no * each : (no + 1) * each]]
        version = crc(f"19:{no}") % 24
        version = 0 if version > 15 else version
        names = list(NAMES)
        if version & 1:
            names[4:6] = ["email", "name"]
        if version & 2:
            names[1:] = names[:0:-1]
        if version & 4:
            names = [x for x in names if x not in ("nation_id", "segment")]
        for r in part:
            if version & 4:
                r["nation_id"], r["segment"] = -1, "none"
            if version & 8 and r["balance"] is not None:
                r["balance"] = struct.unpack("f", struct.pack("f", r["balance"]))[0]
        out[no] = (version, len(part), sum(r[x] is None for r in part for x in NAMES), digest(",".join(field("", r["client_id"]) for r in part)), digest("\n".join("|".join(field(x, r[x]) for x in NAMES) for r in part)), ",".join(names), ",".join(NAMES), version != 0)
    return out


def told(result):
    return {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in result}


@pytest.mark.parametrize("digit,block,fan", [(16, 20, 1024), (3, 4, 4)])
def test_ranks_equal_sorted(spark, monkeypatch, digit, block, fan):
    for name, value in (("DIGIT", digit), ("BLOCK", block), ("FAN", fan)):
        monkeypatch.setattr(radix, name, value)
    rnd = random.Random(digit)
    keys = [rnd.choice((rnd.randrange(40), 7, rnd.randrange(-(2**12), 2**12))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(keys)), "i bigint, key bigint").repartition(3).withColumn("place", F.col("i") * 5 + 3)
    low = radix.digits(F.col("key") + F.lit(1 << 12), 14)
    got = radix.ranked(rows, [(f"d{i}", d) for i, d in enumerate(low)], shared_dir(spark)).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.place)] == sorted(range(150), key=lambda i: (keys[i], i))
    assert sorted(r.place for r in got) == list(range(150))


def test_signed_digits_order_all_numbers(spark):
    numbers = [-(2**63), -(2**40), -1, 0, 1, 65_535, 65_536, 2**31, 2**63 - 1]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(reversed(numbers))], "place bigint, n bigint")
    got = radix.ranked(rows, [(f"d{i}", d) for i, d in enumerate(radix.signed_digits(F.col("n")))], shared_dir(spark)).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.place)] == numbers
    assert radix.ranked(rows.where("n is null"), [("d", F.col("n"))], shared_dir(spark)).count() == 0


def made(n, seed=1):
    rnd = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    rows = [dict(zip(NAMES, (i * 37 - 500, rnd.choice((None, i)), rnd.choice(("crm", "", None)), rnd.choice((None, day + datetime.timedelta(microseconds=rnd.randrange(10**13)))), rnd.choice((None, "Zoë|x", "a\nb")), rnd.choice((None, "e@x")), "c", rnd.choice((None, 3, 0)), rnd.choice((None, "retail")), rnd.choice((None, 0.1, -0.0, -17.3, 1e17)))))  for i in range(n)]
    return rows


@pytest.mark.parametrize("n", [1, 260])
def test_files(spark, n):
    rows = made(n)
    df = spark.createDataFrame([tuple(r[x] for x in NAMES) for r in rows], SCHEMA)
    for name in ("row", "place", "k", "file_no", "tie", "Client_ID2", "version"):
        df = df.withColumn(name, F.lit("x"))
    result = schema_rewrite.rewrite_clients(df.repartition(3)).collect()
    assert told(result) == plain(rows)
    fs, folder = file_system(result[0].path.rpartition("/")[0])
    assert sorted(os.listdir(folder)) == sorted(r.path.rpartition("/")[2] for r in result)
    assert os.listdir(os.path.dirname(folder)) == ["clients"]
    for r in result[:20]:
        schema = pq.read_schema(file_system(r.path)[1])
        assert [(schema_rewrite.id_of(f), f.name, f.type, f.nullable) for f in schema] == [(i, name, kind, True) for i, name, kind, _ in schema_rewrite.FIELDS]


def test_repeated_null_and_odd_rows(spark):
    rows = [*made(30), *made(30), {**made(1)[0], "client_id": None}, dict.fromkeys(NAMES), {**made(2)[1], "balance": math.nan}, {**made(3)[2], "balance": -math.inf, "name": "long " * 200_000}]
    results, folders = [], set()
    for parts in (1, 5):
        df = spark.createDataFrame([tuple(r[x] for x in NAMES) for r in rows], SCHEMA).repartition(parts)
        result = schema_rewrite.rewrite_clients(df).collect()
        results.append(told(result))
        folders.add(os.path.dirname(result[0].path))
    assert results[0] == results[1] and len(folders) == 2 and sum(x[1] for x in results[0].values()) == len(rows)
    ids = [r["client_id"] for r in rows]
    want = sorted(ids, key=lambda i: (i is None, crc(i), i))
    assert [x[3] for _, x in sorted(results[0].items())] == [digest(field("", i)) for i in want]
    assert schema_rewrite.rewrite_clients(spark.createDataFrame([], SCHEMA)).collect() == []


def test_projection_goes_by_ids():
    have = pa.schema([schema_rewrite.field(7, "a", pa.int32()), pa.field("b", pa.string()), schema_rewrite.field(2, "c", pa.float32())])
    want = pa.schema([schema_rewrite.field(2, "a", pa.float64()), schema_rewrite.field(7, "b", pa.int64()), schema_rewrite.field(9, "c", pa.string()), schema_rewrite.field(8, "d", pa.string())])
    table = pa.table([pa.array([1, None], pa.int32()), pa.array(["x", "y"]), pa.array([0.5, 1], pa.float32())], schema=have)
    import pyarrow.dataset as ds

    got = ds.dataset(table).to_table(columns=schema_rewrite.projection(have, want, {9: "none"}))
    assert got.to_pydict() == {"a": [0.5, 1.0], "b": [1, None], "c": ["none", "none"], "d": [None, None]}


def test_a_task_may_be_repeated(spark, tmp_path):
    os.makedirs(tmp_path / "aside")
    for _ in range(2):
        w = schema_rewrite._Writer(f"file://{tmp_path}/x.parquet", f"file://{tmp_path}/aside", schema_rewrite.drifted(0))
        w.add(pa.RecordBatch.from_pylist([], schema_rewrite.drifted(0)))
        w.close()
    assert sorted(os.listdir(tmp_path)) == ["aside", "x.parquet"] and not os.listdir(tmp_path / "aside")


def test_query(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/clients.parquet").collect()]
    result = QUERIES["op11_schema_rewrite"](spark, sf_dir).collect()
    assert told(result) == plain(rows)
