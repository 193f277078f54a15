"""Upserts, readers and watermarks over small tables."""

import datetime as dt
import json

import pytest

from corvane.operators import upsert
from corvane.sources import readers
from corvane.streaming import ledger
from tests.conftest import DATA


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_keep_first_and_fill(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, x string, n int")
    b = spark.createDataFrame([(2, None, 6), (3, "c", 1), (3, "d", 0)], "k int, x string, n int")
    assert got(upsert.keep_first(a, b, ["k"])) == [(1, "a", None), (2, "b", 5), (3, "c", 1)]
    assert got(upsert.fill(a, b.where("k = 2 or n = 1"), ["k"])) == [(1, "a", None), (2, "b", 6), (3, "c", 1)]


def test_priority(spark):
    schema = "k string, title string, md string, p int"
    a = spark.createDataFrame([("A", "old", "text", 7), ("B", "old", None, 5)], schema)
    b = spark.createDataFrame([("A", "low", None, 5), ("B", "new", "md", 10), ("C", "c", None, 5)], schema)
    assert got(upsert.by_priority(a, b, "k", "p", ["title"], "md")) == [("A", "old", "text", 7), ("B", "new", "md", 10), ("C", "c", None, 5)]


def test_supersede(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    schema = "document_id int, status string, eff_from date, observed_at timestamp, superseded_at timestamp"
    h = spark.createDataFrame([(1, "in_force", None, t[0], None), (2, "in_force", None, t[0], None), (3, "expired", None, t[0], None)], schema)
    o = spark.createDataFrame([(1, "expired", None, t[1]), (2, "in_force", None, t[1]), (3, None, None, t[1]), (4, "partial", None, t[2])], "document_id int, status string, eff_from date, observed_at timestamp")
    assert [(r.document_id, r.status, r.superseded_at) for r in upsert.supersede(h, o).orderBy("document_id", "observed_at").collect()] == [(1, "in_force", t[1]), (1, "expired", None), (2, "in_force", None), (3, "expired", None), (4, "partial", None)]


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("key,value\na,1\nb,2\n")
    s = readers.seeds(spark, str(tmp_path / "s.csv"), "setting")
    users = spark.createDataFrame([("a", "9", "user"), ("z", "0", "seed")], "key string, value string, origin string")
    assert got(readers.reload_seeds(users, s, ["key"])) == [("a", "9", "user"), ("b", "2", "seed")]
    case = {"id": "1", "question": "q", "expected_citations": [{"doc_number": "12/2020"}], "expect_abstain": False, "notes": ""}
    (tmp_path / "g.json").write_text(json.dumps([case]))
    assert readers.golden(spark, str(tmp_path / "g.json")).first().expected_citations[0].doc_number == "12/2020"
    (tmp_path / "h.json").write_text(json.dumps([case, case]))
    with pytest.raises(ValueError):
        readers.golden(spark, str(tmp_path / "h.json"))
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>t</title><link>l</link><pubDate>Tue, 2 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>")
    assert got(readers.feed(spark, str(tmp_path / "f.xml"))) == [("t", "l", dt.datetime(2024, 1, 2, 3, 4, 5))]
    files = spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "content binary")
    assert readers.addressed(files).count() == 2


def test_watermarks(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 5, 9)]
    items = spark.createDataFrame([("s", t[0]), ("s", t[1]), ("s", t[2]), ("n", t[0])], "source string, published timestamp")
    w = spark.createDataFrame([("s", dt.datetime(2024, 1, 6)), ("p", t[0])], "source string, watermark timestamp")
    assert got(readers.since(items, w)) == [("n", t[0]), ("s", t[1]), ("s", t[2])]
    done = spark.createDataFrame([("s",)], "source string")
    assert got(readers.advanced(w, items, done)) == [("p", t[0]), ("s", t[2])]


def test_stream_equals_batch(spark, tmp_path):
    batch = ledger.event_windows(spark.read.parquet(f"{DATA}/events.parquet"))
    stream = ledger.drained(spark, DATA, str(tmp_path))
    key = lambda df: sorted((r.window_start, r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(stream) == key(batch)


def test_planted_statutes_take_a_documents_line_once(spark):
    from corvane.plans import planted

    plan = planted.p8_jurisdictions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
