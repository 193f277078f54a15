"""Readers of captured payloads on small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import captures

D = dt.date(2024, 2, 1)


def nested(path: str, value):
    for s in reversed(path.split(".")):
        value = {s: value}
    return value


@pytest.mark.parametrize("source", sorted(captures.FORMATS))
def test_json(spark, source):
    where, path, fields = captures.FORMATS[source]
    item: dict = {}
    for c, f in fields.items():
        at = item
        *heads, last = f.split(".")
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = {"issued_at": "2024-02-01T00:00:00", "effective_at": "01/02/2024"}.get(c, f" {c} ")
    p = spark.createDataFrame([(json.dumps(nested(path, [item, {}])),), ("{",), (None,), ("[]",)], "payload string")
    got = captures.json_items(p, source).collect()
    assert len(got) == 1
    for c in captures.COLUMNS[1:]:
        assert got[0][c] == ((D if c.endswith("_at") else c) if c in fields else None), c
    assert spark.range(1).select(captures.jurisdiction(F.lit(source))).first()[0] == where


def test_rows_links_and_sitemap(spark, tmp_path):
    p = spark.createDataFrame([(json.dumps({"aaData": [['<a href="/x">T <b>1</b></a>', "7/2024", "s", "", "", "", "1 February 2024", "ok"], ["no link"]]}),)], "payload string")
    (r,) = captures.ojk_rows(p).collect()
    assert (r.external_id, r.title, r.number, r.issued_at, r.status) == ("/x", "T 1", "7/2024", D, "ok")
    html = '<a href="/a.pdf">First\n doc</a> <td>01-02-2024</td><a class="c" href="/b.PDF?x">Second</a><a href="/about">no</a><a href="/a.pdf">again</a>'
    got = sorted((r.external_id, r.issued_at) for r in captures.links(spark.createDataFrame([(html,), (None,)], "html string"), "bnm").collect())
    # of the two links to /a.pdf the one with the lesser title stays, "First doc", with its date
    assert got == [("/a.pdf", D), ("/b.PDF?x", None)]
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://x/1</loc><lastmod>2024-02-01</lastmod></url><url><lastmod>2024-02-01</lastmod></url></urlset>")
    assert [(r.url, r.issued_at) for r in captures.sitemap(spark, str(tmp_path / "s.xml")).collect()] == [("http://x/1", D)]


def test_legacy_pages(spark):
    f = spark.createDataFrame([(bytes("<a href='x.pdf'>ไทย</a>".encode("cp874")),)], "content binary")
    assert captures.links(captures.legacy_pages(f), "sec").first().title == "ไทย"


def test_dates(spark):
    days = ["2024-02-01", "2024-02-01T10:00:00Z", "1/2/2024", "01-02-2024", "01 Feb 2024", "31/02/2024", "x", None]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in days], "d string").select(captures.date_of(F.col("d"))).collect()]
    assert got == [D] * 5 + [None] * 3
