"""The vector index against an exact comparison of all vectors: recall, filters, files read, repeats."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import vector_index
from corvane.storage import shared_folder


def exact(x, q, k, ids=None):
    """The k nearest rows of each question, ties to smaller ids."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ unit.T, 9)
    ids = np.arange(len(x)) if ids is None else ids
    return [ids[np.lexsort((ids, -row))[:k]].tolist() for row in s]


def clustered(n, seed=3, dims=18):
    rng = np.random.default_rng(seed)
    return np.random.default_rng(0).normal(size=(40, dims))[rng.integers(0, 40, n)] * 2 + rng.normal(size=(n, dims))


@pytest.fixture(scope="module")
def made(spark):
    x = clustered(3000)
    df = spark.createDataFrame([(i, v.tolist(), "even" if i % 2 == 0 else "odd") for i, v in enumerate(x)], "id bigint, embedding array<double>, side string")
    return x, vector_index.build(df, shared_folder(spark), keep=["side"])


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def questions(spark, q):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<double>")


def test_recall_for_three_settings(spark, made):
    x, index = made
    q = clustered(60, seed=4)
    want, probes = exact(x, q, 50), []
    for wanted in (0.9, 0.95, 0.99):
        got = answers(vector_index.nearest(spark, index, questions(spark, q), 50, recall=wanted))
        assert np.mean([len(set(got[i]) & set(w)) / 50 for i, w in enumerate(want)]) >= 0.9
        probes.append(index.probes(wanted))
    assert probes == sorted(probes) and probes[0] < len(index.centroids) // 2


def test_all_vectors_exactly_and_the_index_read_again(spark, made):
    x, index = made
    again = vector_index.opened(spark, index.path)
    q = clustered(5, seed=5)
    got = answers(vector_index.nearest(spark, again, questions(spark, q), 10, pool=-1))
    assert [got[i] for i in range(5)] == exact(x, q, 10) and np.array_equal(again.recall, index.recall) and again.keep == ("side",)


def test_only_probed_cells_are_read(spark, made):
    _, index = made
    rows = spark.read.parquet(f"{index.path}/cells")
    cells = rows.where(F.col("cell").isin(3, 5)).select("id", "cell", "codes")
    files = {f.split("cell=")[1].split("/")[0] for f in (r[0] for r in cells.select(F.input_file_name()).distinct().collect())}
    plan = cells._jdf.queryExecution().toString()
    assert files == {"3", "5"} and "PartitionFilters: [cell#" in plan and "vector" not in plan.split("ReadSchema")[1]


def test_filters_come_first_and_short_answers_are_completed(spark, made):
    x, index = made
    q = clustered(6, seed=6)
    odd = np.arange(1, 3000, 2)
    got = answers(vector_index.nearest(spark, index, questions(spark, q), 20, recall=0.99, where="side = 'odd'"))
    want = exact(x[odd], q, 20, odd)
    assert all(i % 2 for ids in got.values() for i in ids) and np.mean([len(set(got[i]) & set(w)) / 20 for i, w in enumerate(want)]) >= 0.9
    few = answers(vector_index.nearest(spark, index, questions(spark, q), 20, probes=1, where="id % 500 = 1"))
    some = np.arange(1, 3000, 500)
    assert [few[i] for i in range(6)] == exact(x[some], q, 20, some)


def test_blocks_of_questions(spark, made, monkeypatch):
    _, index = made
    q = clustered(9, seed=7)
    whole = answers(vector_index.nearest(spark, index, questions(spark, q), 5))
    monkeypatch.setattr(vector_index, "QUESTIONS", 4)
    assert answers(vector_index.nearest(spark, index, questions(spark, q), 5)) == whole


def test_odd_vectors_repeats_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), *((100 + i, [0.5, 0.5, 0.1]) for i in range(30))]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    index = vector_index.build(df, shared_folder(spark))
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0])], "query_id bigint, vector array<double>")
    got = answers(vector_index.nearest(spark, index, asked, 4))
    assert got == {1: [1, 2, 100, 101]}
    empty = vector_index.build(df.where("id is null and id is not null"), shared_folder(spark))
    assert vector_index.nearest(spark, empty, asked, 4).count() == 0
    assert vector_index.nearest(spark, index, asked.where("query_id > 5"), 4).count() == 0


def test_scan_takes_blocks_of_cells(monkeypatch):
    """A question takes the rows of all its cells in a block at once, and scores are those of cell and codes."""
    calls, found = [], {}

    class Best:
        def __init__(self, pools):
            pass

        def add(self, q, ids, scores):
            calls.append(q)
            found.update({(q, int(i)): float(s) for i, s in zip(ids, scores, strict=True)})

        def rows(self):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)

    class Rows:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def mapInArrow(self, f, schema):
            return f

    rng = np.random.default_rng(4)
    centroids, books, q = rng.normal(size=(30, 6)), rng.normal(size=(2, 256, vector_index.PART)), rng.normal(size=(5, 6))
    books[1, :, 2:] = 0
    cells, codes = np.repeat(np.arange(30), 10), rng.integers(0, 256, (300, 2)).astype(np.uint8)
    probed = np.array([rng.permutation(30)[:20] for _ in q])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes])], ["id", "cell", "codes"])
    monkeypatch.setattr(vector_index, "Best", Best)
    list(vector_index._scan(SimpleNamespace(centroids=centroids, codebooks=books), Rows(), q, probed, 10)(iter([batch])))
    plain = {(k, i): float(q[k] @ (centroids[cells[i]] + np.concatenate([books[0, codes[i, 0]], books[1, codes[i, 1]]])[:6])) for k in range(5) for i in range(300) if cells[i] in probed[k]}
    assert len(calls) == 5 and found == pytest.approx(plain)
