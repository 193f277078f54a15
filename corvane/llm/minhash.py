"""Near-duplicate documents by an LSH forest over MinHash signatures, with links confirmed on full shingle sets.

1. Each text gives its set of distinct five-word shingles, a 64-value MinHash signature and a 128-bit hash of the
   set. Texts with equal sets are one class from here on; its smallest doc_id stands for it.
2. The forest has 16 trees. Tree t sorts all classes by the signature rotated to begin at its value 4t. Classes that
   agree in the first two values form a region. In a region of at most REGION classes, all that agree in half of their
   signature values are candidates (a pair at 0.75 has less than 5 chances in a million to fall below). A larger one goes
   as deep as it must: it is parted by the next values until its parts are small enough; besides, each class meets its
   WINDOW next neighbours in the order, which have the longest common prefixes with it. The order is sharded by ranges;
   the classes at both ends of every shard are compared in a step of their own, so that no region is cut. Of the
   candidates only stars with the same components leave the task, so that few rounds join them.
3. Components of those candidates hold together whatever can be linked. The full sets of their classes meet once,
   in blocks of bounded size, where all links are found exactly. A component of several blocks takes its smallest
   member into each block; classes outside its largest group then meet the other blocks that can hold a set linked with
   them: such a set shares one of their rarest shingles, as many as may be missing and one more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import partitions, shared_dir, slices, unused, written
from corvane.llm.components import components
from corvane.llm.shingles import U, mix, shingle_sets

VALUES, TREES, DEPTH = 64, 16, 2
#: Classes of one region, or part of one, that are compared all with all; neighbours that others meet; rows at each end of a shard that meet those of the next.
REGION, WINDOW, BORDER = 2048, 32, 64
#: Shingles of one block of full sets (8 bytes each).
BLOCK = 1 << 20
_rng = np.random.default_rng(9)
_A = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) | U(1)
_B = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_FEATURES = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, tail binary, heads array<bigint>"


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each of the 64 hash functions over a set."""
    least = np.full(VALUES, 2**32 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(least, ((s[at : at + 4096, None] * _A + _B) >> U(32)).min(axis=0), out=least)
    return least


def _features(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    first = np.arange(TREES) * (VALUES // TREES)
    for whole in batches:
        for batch in slices(whole, "text", 1 << 18):
            sets = shingle_sets(batch.column(1), size)
            least = np.array([signature(s) for s in sets])
            heads = mix((least[:, first] << U(32)) | least[:, first + 1]).view(np.int64)
            s1 = np.array([mix(s).sum(dtype=U) if len(s) else 0 for s in sets], U).view(np.int64)
            s2 = np.array([np.bitwise_xor.reduce(mix(s + U(77))) if len(s) else 0 for s in sets], U).view(np.int64)
            tail = (least & U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(s1),
                    pa.array(s2),
                    pa.array([x.tobytes() for x in tail], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * TREES, pa.array(heads.ravel())),
                ],
                ["doc_id", "n_shingles", "s1", "s2", "tail", "heads"],
            )


def _spanning(tails: np.ndarray, nodes: np.ndarray, agree: int) -> list[tuple[int, int]]:
    """Edges that join what can be reached over pairs with `agree` equal values."""
    edges, left = [], np.arange(len(nodes))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            hit = (tails[left] == tails[u]).sum(axis=1) >= agree
            if hit.any():
                near = left[hit]
                edges += [(nodes[u], nodes[v]) for v in near]
                front += list(near)
                left = left[~hit]
    return edges


def _neighbours(tails: np.ndarray, nodes: np.ndarray, agree: int) -> list[tuple[int, int]]:
    """Edges between neighbours in the order, up to WINDOW apart: those of chains, and one for each two chains that meet."""
    n = len(nodes)
    near = (tails[1:] == tails[:-1]).sum(axis=1) >= agree
    chain = np.r_[0, np.cumsum(~near)]
    pairs = [np.flatnonzero(near)[:, None] + [0, 1]]
    for k in range(2, min(WINDOW, n - 1) + 1):
        other = np.flatnonzero(chain[k:] != chain[:-k])
        other = other[(tails[other] == tails[other + k]).sum(axis=1) >= agree]
        if len(other):
            pairs.append(other[:, None] + [0, k])
    pairs = np.concatenate(pairs)
    own = chain[pairs[:, 0]] == chain[pairs[:, 1]]
    _, first = np.unique(np.sort(chain[pairs[~own]], axis=1), axis=0, return_index=True)
    return [(nodes[a], nodes[b]) for a, b in np.concatenate([pairs[own], pairs[~own][first]]).tolist()]


def _region(tails: np.ndarray, nodes: np.ndarray, agree: int) -> list[tuple[int, int]]:
    """Candidates of a region in the order of its tails."""
    if len(nodes) <= REGION:
        return _spanning(tails, nodes, agree)
    edges, parts = _neighbours(tails, nodes, agree), [(0, len(nodes), DEPTH)]
    while parts:
        a, b, depth = parts.pop()
        if b - a <= REGION:
            edges += _spanning(tails[a:b], nodes[a:b], agree)
        elif depth < VALUES:  # deeper; what agrees in all values are neighbours anyway
            cuts = np.r_[a, a + 1 + np.flatnonzero(tails[a + 1 : b, depth] != tails[a : b - 1, depth]), b].tolist()
            parts += [(x, y, depth + 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1]
    return edges


def _stars(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges with the same components, from the least node of each to its others: no path is longer than two."""
    above: dict[int, int] = {}

    def least(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for a, b in edges:
        a, b = least(a), least(b)
        above[max(a, b)] = min(a, b)
    return [(r, x) for x in list(above) if (r := least(x)) != x]


_CANDIDATES = "u bigint, v bigint, tree int, head bigint, tail binary"


def _candidates(batches: Iterator[pa.RecordBatch], agree: int, border: int) -> Iterator[pa.RecordBatch]:
    """Stars of a shard's regions, in rows (u, v); and as rows (u, tree, head, tail) the first and last `border` classes of the shard."""
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    ends: list[list[tuple]] = [[], []]
    for batch in batches:
        if not batch.num_rows:
            continue
        if border:
            if len(ends[0]) < border:
                ends[0] += zip(*(c.to_pylist() for c in batch.slice(0, border - len(ends[0])).columns), strict=True)
            ends[1] = (ends[1] + list(zip(*(c.to_pylist() for c in batch.slice(max(0, batch.num_rows - border)).columns), strict=True)))[-border:]
        key = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)
        tails = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, VALUES)
        nodes = batch.column(3).to_numpy()
        if held is not None:
            key, tails, nodes = np.concatenate([held[0], key]), np.concatenate([held[1], tails]), np.concatenate([held[2], nodes])
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        edges = []
        for k in np.flatnonzero(np.diff(edge)[:-1] > 1):
            a, b = edge[k], edge[k + 1]
            edges += _region(tails[a:b], nodes[a:b], agree)
        a = edge[-2]
        held = key[a:], tails[a:], nodes[a:]
        if edges:
            yield _with_ends(_stars(edges), [])
    edges = _region(held[1], held[2], agree) if held is not None and len(held[2]) > 1 else []
    rows = {r: None for r in ends[0] + ends[1]}
    if edges or rows:
        yield _with_ends(_stars(edges), list(rows))


def _with_ends(edges: list[tuple[int, int]], ends: list[tuple]) -> pa.RecordBatch:
    e = np.array(edges, np.int64).reshape(-1, 2)
    none = [None] * len(e)
    columns = [
        pa.array(np.r_[e.max(axis=1, initial=-(2**63)), np.array([r[3] for r in ends], np.int64)]),
        pa.array([*e.min(axis=1, initial=2**63 - 1).tolist(), *(None for _ in ends)], pa.int64()),
        pa.array([*none, *(r[0] for r in ends)], pa.int32()),
        pa.array([*none, *(r[1] for r in ends)], pa.int64()),
        pa.array([*none, *(r[2] for r in ends)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _CANDIDATES.split(", ")])


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e.max(axis=1)), pa.array(e.min(axis=1))], ["u", "v"])


_SETS = "root bigint, block int, late int, grp bigint, node bigint, shingles binary"


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 18):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), size)]
            keep = [batch.column(n) for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sets, pa.binary())], [*(n for n in batch.schema.names if n != "text"), "shingles"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, block, node, n, w): a row for each shingle w of the sets, which have n."""
    for whole in batches:
        for b in slices(whole, "shingles"):
            raw = [np.frombuffer(x, np.int64) for x in b.column("shingles").to_pylist()]
            n = np.array([len(x) for x in raw], np.int64)
            row = pa.array(np.repeat(np.arange(len(raw)), n))
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(row) for x in ("root", "block", "node")), pa.array(np.repeat(n, n)), pa.array(np.concatenate(raw))], ["root", "block", "node", "n", "w"])


class _Block:
    """Full sets of one block: the links among them, and those to further sets."""

    def __init__(self, nodes: list[int], groups: list[int], sets: list[np.ndarray]):
        self.nodes, self.groups = np.array(nodes, np.int64), np.array(groups, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.words, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids, self.begins = ids.astype(np.int32), np.r_[0, np.cumsum(self.sizes)[:-1]]

    def near(self, own: np.ndarray, size: int, among: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets `among` are linked with the one that has the ids `own`."""
        mark = np.zeros(len(self.words), np.int32)
        mark[own] = 1
        if len(among) * 2 < len(self.nodes):
            both = np.array([mark[self.ids[a : a + n]].sum() for a, n in zip(self.begins[among], self.sizes[among], strict=True)], np.int64)
        else:
            both = np.add.reduceat(mark[self.ids], self.begins)[among]
        return 100 * both >= percent * (size + self.sizes[among] - both)

    def links(self, percent: int) -> list[tuple[int, int]]:
        """Stars of what the links among the sets hold together."""
        edges, left = [], np.arange(len(self.nodes))
        while len(left) > 1:
            front, left = [left[0]], left[1:]
            while front and len(left):
                u = front.pop()
                hit = self.near(self.ids[self.begins[u] : self.begins[u] + self.sizes[u]], self.sizes[u], left, percent)
                if hit.any():
                    edges += [(self.nodes[u], self.nodes[v]) for v in left[hit]]
                    front += list(left[hit])
                    left = left[~hit]
        return _stars(edges)

    def links_to(self, node: int, group: int, s: np.ndarray, percent: int) -> list[tuple[int, int]]:
        at = np.searchsorted(self.words, s)
        at[at == len(self.words)] = 0
        own = at[self.words[at] == s]
        others = np.flatnonzero(self.groups != group)
        if not len(others) or not len(own):
            return []
        hit = self.near(own, len(s), others, percent)
        return [(node, v) for v in self.nodes[others[hit]]]


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, block, late, grp, node, shingles) in the order of the first three. Rows with late = 0 are a block; late ones are compared with it."""
    key, block, rows = None, None, []

    def close() -> list[tuple[int, int]]:
        nonlocal block
        if block is None and rows:
            block = _Block([r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows])
            return block.links(percent) if fresh else []
        return []

    fresh = True
    for batch in batches:
        edges = []
        for root, sub, late, group, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, sub) != key:
                edges += close()
                key, block, rows = (root, sub), None, []
            s = np.frombuffer(raw, U)
            fresh = group is None
            if not len(s):
                continue
            if not late:
                rows.append((-1 if group is None else group, node, s))
            else:
                close()
                if block is not None:
                    edges += block.links_to(node, group, s, percent)
        if edges:
            yield _pairs(edges)
    if last := close():
        yield _pairs(last)


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets; component_id is the
    smallest doc_id that links reach. Null or wordless texts have no shingles and their own doc_id. Rows that share
    a doc_id count as one document with several texts. Rows with a null doc_id take no part: component_id null, kept
    true. Ties need no rule, texts of any length are compared whole, an empty table gives an empty result, and further columns are ignored.
    """
    spark, folder, n = docs.sparkSession, shared_dir(docs.sparkSession), partitions(docs.sparkSession)
    agree = VALUES // 2
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = written(texts.mapInArrow(lambda b: _features(b, size), _FEATURES), folder, "features")
    classes = written(
        features.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("tail").alias("tail"), F.first("heads").alias("heads")),
        folder,
        "classes",
    )
    step = VALUES // TREES
    forest = classes.select("node", "tail", F.posexplode("heads").alias("tree", "head")).select(
        "tree",
        "head",
        F.concat(F.expr(f"substring(tail, tree * {step} + 1, {VALUES})"), F.expr(f"substring(tail, 1, tree * {step})")).alias("tail"),
        "node",
    )
    order = ["tree", "head", "tail", "node"]
    forest = forest.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = written(forest.mapInArrow(lambda b: _candidates(b, agree, BORDER), _CANDIDATES), folder, "candidates")
    ends = found.where("tail is not null").select("tree", "head", "tail", F.col("u").alias("node"))
    across = ends.repartition("tree").sortWithinPartitions(*order).mapInArrow(lambda b: _candidates(b, agree, 0), _CANDIDATES)
    near = components(found.where("tail is null").select("u", "v").unionByName(across.select("u", "v")), folder, "near")
    sized = near.join(classes.groupBy("node").agg(F.sum("n_shingles").alias("n")), "node")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = written(near.join(blocks, "root").select("node", "root", "blocks"), folder, "members")

    def sets_of(rows: DataFrame) -> DataFrame:
        """The full sets of the rows (node, root, block, late, grp)."""
        # beyond test sizes neither side can be broadcast: one plan for all sizes
        with_text = texts.join(rows.hint("merge"), F.col("doc_id") == F.col("node")).select("root", "block", "late", "grp", "node", "text")
        return with_text.mapInArrow(lambda b: _sets(b, size), _SETS)

    def exact(sets: DataFrame, name: str) -> DataFrame:
        """Links within blocks, or, where groups are given, of late rows with sets of other groups."""
        sets = sets.repartition(n, "root", "block").sortWithinPartitions("root", "block", "late", "node")
        return written(sets.mapInArrow(lambda b: _confirm(b, percent), "u bigint, v bigint"), folder, name)

    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    first = members.select("node", "root", F.explode(F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"), F.lit(0).alias("late"), F.lit(None).cast("bigint").alias("grp"))
    links = exact(sets_of(first), "links")
    roots = components(links, folder, "linked")
    large = members.where("blocks > 1")
    if not large.isEmpty():
        grouped = large.join(roots.withColumnRenamed("root", "grp"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        count = grouped.groupBy("root", "grp").agg(F.count("*").alias("n"))
        most = count.groupBy("root").agg(F.max_by("grp", F.struct("n", "grp")).alias("most"))
        grouped = grouped.join(most, "root").select("node", "root", own.alias("block"), (F.col("grp") != F.col("most")).cast("int").alias("late"), "grp")
        sets = written(sets_of(grouped), folder, "sets")
        late = sets.where("late = 1")
        # of each shingle of a component, how many sets and which blocks have it
        each = "root bigint, block int, node bigint, n bigint, w bigint"
        held = sets.mapInArrow(_shingles, each).groupBy("root", "w", "block").agg(F.count("*").alias("c")).groupBy("root", "w").agg(F.sum("c").alias("df"), F.collect_list("block").alias("blocks"))
        rarest = Window.partitionBy("node").orderBy("df", "w")
        asked = late.mapInArrow(_shingles, each).join(held, ["root", "w"]).withColumn("k", F.row_number().over(rarest))
        asked = asked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("node", F.explode("blocks").alias("block")).distinct()
        to = late.drop("block").join(asked.hint("merge"), "node").select(*sets.columns)
        again = sets.withColumn("late", F.lit(0)).join(to.select("root", "block").distinct(), ["root", "block"], "left_semi").select(*sets.columns)
        roots = components(links.unionByName(exact(again.unionByName(to), "links-again")), folder, "linked-again")
    named = classes.join(roots, "node", "left").select("s1", "s2", "n_shingles", F.coalesce("root", "node").alias("root"))
    named = written(named, folder, "named")
    return features.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2", "n_shingles"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
        F.expr("doc_id <=> if(doc_id is null, null, coalesce(root, doc_id))").alias("kept"),
    )


def deduplicated(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """docs, the same columns, with one document of each group of near duplicates: the one with the smallest doc_id.

    Null, empty and wordless texts stay, as they are near nothing; texts of any length are compared whole; equal texts
    are ties that the smallest doc_id wins; an empty table stays empty. Rows with a null doc_id stay. A doc_id identifies a document: of rows that share one that stays, the one with the
    smallest text does.
    """
    near_id, place = (unused(docs, x) for x in ("near_id", "place"))
    near = near_duplicates(docs, percent, size).select("doc_id", "kept")
    near = written(near, shared_dir(docs.sparkSession), "near").withColumnRenamed("doc_id", near_id)
    ids = near.where(F.col("kept") & F.col(near_id).isNotNull())
    twice = near.where(F.col(near_id).isNotNull()).groupBy(near_id).agg(F.count("*").alias("n")).where("n > 1").select(near_id)
    nameless = docs.where(F.col("doc_id").isNull())
    out = docs.join(ids.select(near_id).distinct().hint("merge"), docs["doc_id"] == F.col(near_id), "left_semi")
    if not twice.isEmpty():
        same = out.join(twice, out["doc_id"] == F.col(near_id), "left_semi")
        one = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
        least = same.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).drop(place)
        out = out.join(twice, out["doc_id"] == F.col(near_id), "left_anti").unionByName(least)
    return out if near.where(F.col(near_id).isNull()).isEmpty() else out.unionByName(nameless)
