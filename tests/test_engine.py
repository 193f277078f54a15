"""The engine's queries against DuckDB, and its text operators against small cases."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from corvane.functions.html import text_of
from corvane.operators import graph, provisions, retrieval
from corvane.plans import registry
from corvane.plans.views import TABLES
from tests.conftest import DATA, ROOT


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    cur = duck.execute(registry.ORACLES[name])
    there = [d[0] for d in cur.description]
    assert sorted(there) == names
    want = sorted(tuple(plain(r[there.index(n)]) for n in names) for r in cur.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_html_text():
    assert text_of("<head><title>t</title></head><p>a  b<br>c</p><script>x</script><table><tr><td>1</td><td>2</td></tr></table><p></p><p></p><p>d&amp;e</p>") == "a b\nc\n1 2\n\nd&e"
    assert text_of(None) == ""


def test_provisions():
    rows = provisions.parse("Chương I. Chung\nĐiều 1. Phạm vi\nđoạn\n1. một\na) điểm\n2. hai\nĐiều 1. lại\n“Điều 9. trích”")
    assert [(r[2], r[4], r[6]) for r in rows] == [("chapter", "I", "chapter-I"), ("article", "1", "chapter-I/article-1"), ("clause", "1", "chapter-I/article-1/clause-1"), ("point", "a", "chapter-I/article-1/clause-1/point-a"), ("clause", "2", "chapter-I/article-1/clause-2"), ("article", "1", "chapter-I/article-1~2")]
    assert provisions.parse("plain\ntext") == [(0, None, "document", 1, "", "plain\ntext", "document")]
    assert provisions.parse("") == []
    assert all(len(p) <= 100 for p in provisions.split_words("word " * 200 + "x" * 500, 50))


def test_chain_and_families(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (9, 8)], "from_id bigint, to_id bigint")
    got = {(r.base, r.node, r.depth) for r in graph.chain(e).collect()}
    assert {(n, d) for b, n, d in got if b == 1} == {(2, 1), (3, 2), (4, 3), (5, 4)}
    assert {r.node: r.family for r in graph.families(e).collect()} == {**dict.fromkeys(range(1, 7), 1), 8: 8, 9: 8}


def test_references(spark):
    from corvane.functions.text import references

    df = spark.createDataFrame([("See 12/2020/NĐ-CP, Act 123 and act 123; 1/2",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(references(df.t)).collect()] == [["12/2020/nđ-cp", "act 123"], [], None]


def test_fusion(spark):
    d = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, rank int")
    s = spark.createDataFrame([(2, 1), (3, 2)], "id bigint, rank int")
    got = {r.id: r.score for r in retrieval.fuse(d, s).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 0.5 / 61, 3: 0.5 / 62})


def test_entry_works_without_the_llm_folders(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; q = e.queries(); assert 'r6_bm25' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run(["cp", "-r", f"{ROOT}/corvane", f"{ROOT}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/corvane/llm"], check=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)


def test_rounds_of_families_shuffle_little(spark):
    """A round makes its edges distinct once, when it is written; only loops are looked up among those found."""
    from corvane.operators import components

    e = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (9, 4)], "u long, v long")
    larger = components._toward_least(e, True)
    assert sorted(map(tuple, larger.collect())) == [(2, 1), (3, 1), (3, 1), (9, 4)]
    e = spark.createDataFrame([(2, 1), (2, 2), (5, 5), (5, 5)], "from_id long, to_id long")
    assert {r.node: r.family for r in graph.families(e).collect()} == {1: 1, 2: 1, 5: 5}
