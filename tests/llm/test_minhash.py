import random

import numpy as np
import pyarrow as pa

from corvane.llm import minhash
from corvane.llm.components import components
from corvane.llm.common import shared_dir
from tests.llm.helpers import documents, rows, words


def brute(pairs):
    """component_id by comparing all pairs."""
    sets = []
    for _, t in pairs:
        w = words(t)
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(pairs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(pairs)), key=str)


def copies(seed, families=12, members=12, length=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    out = []
    for _ in range(families):
        base = [word() for _ in range(length)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def test_matches_all_pairs(spark):
    texts = copies(1) + [None, "", "  \n", "one two", "ONE\ttwo", "one two three four five", "a b c d", "a b c d", "Ä b", "ä b"]
    pairs = list(enumerate(texts))
    assert rows(minhash.near_duplicates(documents(spark, texts, extra=True)), "doc_id", "n_shingles", "component_id", "kept") == brute(pairs)


def test_small_regions_and_blocks_lose_nothing(spark, monkeypatch):
    texts = copies(2, families=4, members=40)
    import pytest

    with pytest.MonkeyPatch.context() as m:  # blocks are sized on the driver
        m.setattr(minhash, "BLOCK", 1500)
        m.setattr(minhash, "BORDER", 5)
        got = rows(minhash.near_duplicates(documents(spark, texts)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute(list(enumerate(texts)))


def batch_of(tails, nodes=None):
    n = len(tails)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array([t.tobytes() for t in tails], pa.binary()), pa.array(np.arange(n) if nodes is None else nodes)], ["tree", "head", "tail", "node"])


def groups(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


def edges_of(batches, border=0):
    out = pa.Table.from_batches(minhash._candidates(iter(batches), 32, border), pa.schema([("u", pa.int64()), ("v", pa.int64()), ("tree", pa.int32()), ("head", pa.int64()), ("tail", pa.binary())])).to_pylist()
    return [(r["u"], r["v"]) for r in out if r["tail"] is None], [r for r in out if r["tail"] is not None]


def test_candidates_of_a_crowded_region_stay_connected():
    rng = np.random.default_rng(0)
    tails = np.repeat(rng.integers(0, 255, (1, 64), dtype=np.uint8), 30_000, axis=0)
    tails[np.arange(30_000), rng.integers(2, 64, 30_000)] = 1
    tails = tails[np.lexsort(tails.T[::-1])]
    batch = batch_of(tails)
    edges, _ = edges_of([batch.slice(0, 5000), batch.slice(5000)])
    assert len(set(groups(30_000, edges))) == 1


def test_candidates_leave_as_stars():
    rng = np.random.default_rng(4)
    tails = [rng.integers(0, 256, 64).astype(np.uint8)]
    for k in range(3000):  # each a copy of the last with one value changed
        tails.append(tails[-1].copy())
        tails[-1][63 - k % 62] = rng.integers(0, 256)
    found, _ = edges_of([batch_of(np.array(sorted(tails, key=bytes)))])
    assert len(found) > 2000
    assert not {v for _, v in found} & {u for u, _ in found}
    path = [(k + 1, k) for k in rng.permutation(5000).tolist()] + [(7000, 7000), (9002, 9001)]
    assert sorted(minhash._stars(path)) == [(0, k) for k in range(1, 5001)] + [(9001, 9002)]


def test_recall_in_a_crowded_region():
    """20,000 sets that share a passage and agree in the first values; every tenth has a near copy, which one tree finds in most cases."""
    rng = np.random.default_rng(1)
    n = 20_000
    shared = rng.integers(0, 255, 64, dtype=np.uint8)
    tails = rng.integers(0, 255, (n, 64), dtype=np.uint8)
    tails = np.where(rng.random((n, 64)) < 0.2, shared, tails)
    copies_ = np.arange(0, n, 10)
    near = np.where(rng.random((len(copies_), 64)) < 0.76, tails[copies_], rng.integers(0, 255, (len(copies_), 64), dtype=np.uint8))
    near_there = (near == tails[copies_]).sum(axis=1) >= 32
    every = np.concatenate([tails, near])
    missed = np.ones(len(copies_), bool)
    for t in range(minhash.TREES):
        turned = np.roll(every, -4 * t, axis=1)
        inside = np.flatnonzero(rng.random(len(every)) < 2)  # all of them share the head
        turned[:, :2] = 0
        order = inside[np.lexsort(turned.T[::-1])]
        edges, _ = edges_of([batch_of(turned[order], order)])
        group = np.array(groups(len(every), edges))
        missed &= group[copies_] != group[n + np.arange(len(copies_))]
    assert (missed & near_there).mean() < 0.02


def test_regions_across_shards_are_joined():
    rng = np.random.default_rng(2)
    tails = np.repeat(rng.integers(0, 255, (1, 64), dtype=np.uint8), 500, axis=0)
    tails[np.arange(500), rng.integers(2, 64, 500)] = 1
    batch = batch_of(tails[np.lexsort(tails.T[::-1])])
    edges, ends = [], []
    for a in range(0, 500, 100):
        e, rest = edges_of([batch.slice(a, 60), batch.slice(a + 60, 40)], border=3)
        edges, ends = edges + e, ends + rest
    assert len(set(groups(500, edges))) == 5 and len(ends) == 30
    ends.sort(key=lambda r: (r["tail"], r["u"]))
    more, none = edges_of([batch_of([np.frombuffer(r["tail"], np.uint8) for r in ends], [r["u"] for r in ends])])
    assert len(set(groups(500, edges + more))) == 1 and not none


def test_names_of_columns_and_partitions(spark):
    texts = copies(5, families=3, members=6) + ["x y", None, ""]
    docs = documents(spark, texts)
    for name in ("near_id", "_near_id", "place", "block", "late", "grp", "shingles", "n_shingles", "kept", "component_id", "u", "v", "tree", "n"):
        docs = docs.selectExpr("*", f"'x' as {name}")
    want = sorted((i,) for i, _, _, kept in brute(list(enumerate(texts))) if kept)
    got = minhash.deduplicated(docs.repartition(7))
    assert sorted(rows(got, "doc_id")) == want and got.columns == docs.columns
    assert minhash.deduplicated(docs.limit(0)).count() == 0


def test_wide_offsets(spark):
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert rows(minhash.near_duplicates(documents(spark, ["a b c d e f", "a b c d e f", None])), "doc_id", "component_id") == [(0, 0), (1, 0), (2, 2)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")


def test_repeats_nulls_and_empty(spark):
    docs = documents(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f"), (9, None)])
    assert rows(minhash.near_duplicates(docs)) == sorted([(7, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True), (None, 2, None, True), (9, 0, 9, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_text_and_signature_bits(spark):
    long = " ".join(f"w{i % 5000}x{i}" for i in range(300_000))
    got = rows(minhash.near_duplicates(documents(spark, [long, long + " end", "x"])), "doc_id", "n_shingles", "component_id")
    assert got == [(0, 299_996, 0), (1, 299_997, 0), (2, 1, 2)]


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (5, 5)], "u bigint, v bigint")
    got = dict(rows(components(e, shared_dir(spark), "path")))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
