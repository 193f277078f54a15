"""Searches as one job: options, scope, filters, rewriting, both arms, fusion, hydration, roll-up, cap, promotion, other validity, gaps.

search_many() answers many questions with one scan of the corpus for each arm; search() is the same for one. An arm keeps
WIDE times the pool of a question's best chunks before anything is filtered. Only these chunks, and their documents, are
looked up; conditions on documents and validity are tested on them. A question whose list was cut and then lost too many
rows to its conditions is asked again among the chunks that fulfil them. So no table of the corpus is shuffled for a
question that most of the corpus may answer.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import citations, query
from corvane.functions.query import DEFAULTS, Options
from corvane.functions.text import in_scope
from corvane.operators import retrieval, vector_index
from corvane.storage import shared_folder, written

# Statuses that count as current law, and the least similarity of a hit that is evidence.
CURRENT = ("in_force", "partial")
LEAST_SIMILARITY = 0.3
#: Candidates of each arm for every hit asked for; hits of other validity, texts that are named as gaps, at most.
OVERFETCH, OTHERS, TEXT_GAPS = 8, 3, 5
#: What an arm keeps of a question before conditions are tested, as a multiple of its pool.
WIDE = 4
BLOCKING = ("out_of_domain", "no_evidence", "low_confidence")


@dataclass(frozen=True)
class Filters:
    """What documents a search may use; empty settings allow all. Issuers match as parts of names, letter case apart."""

    issuers: tuple[str, ...] = ()
    excluded_issuers: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    issued_from: str | None = None
    issued_to: str | None = None
    citation: str | None = None

    def condition(self) -> Column:
        """Over chunks with their document: doc_number, issuer, doc_type, citation, and issued_at if dates are asked for."""
        issuer = F.lower(F.coalesce("issuer", F.lit("")))
        out = F.lit(True)
        if self.issuers:
            out &= _any(issuer.contains(x.lower()) for x in self.issuers)
        if self.excluded_issuers:
            out &= ~_any(issuer.contains(x.lower()) for x in self.excluded_issuers)
        if self.doc_types:
            out &= F.lower("doc_type").isin(*(x.lower() for x in self.doc_types))
        if self.numbers:
            out &= F.lower("doc_number").isin(*(x.lower() for x in self.numbers))
        if self.issued_from:
            out &= F.col("issued_at") >= F.lit(self.issued_from).cast("date")
        if self.issued_to:
            out &= F.col("issued_at") <= F.lit(self.issued_to).cast("date")
        if self.citation:
            out &= F.lower("citation").contains(self.citation.lower())
        return F.coalesce(out, F.lit(False))

    def narrows(self) -> bool:
        """Whether documents are asked for by issuer, type or date; such a search has no pass for other validity."""
        return bool(self.issuers or self.doc_types or self.issued_from or self.issued_to)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


@dataclass(frozen=True)
class Corpus:
    """Tables of a corpus; those that are None are not used.

    document (id, doc_number, title, issuer, doc_type, ...); chunk (id, document_id, citation, content, and section_id
    where there is section validity); validity, the current row of each document (document_id, status_class, and eff_from,
    eff_to for searches as of a date); embedding of chunks (id, embedding), or a vector index of them; relation (from_id,
    to_id or null, and id if relations have one); text (document_id, is_binding, needs_review, and markdown for gaps of
    texts that aren't indexed); sections (section_id), those with a validity row of their own. `postings` is a folder of
    build_postings() over chunks.
    """

    document: DataFrame
    chunk: DataFrame
    validity: DataFrame
    embedding: DataFrame | None = None
    relation: DataFrame | None = None
    text: DataFrame | None = None
    postings: str | None = None
    words: dict[str, str] = field(default_factory=dict)
    pairs: dict[str, str] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)
    #: Strong terms, weak terms and signals of the corpus's domain; without them every query is in it.
    scope: tuple[Sequence[str], Sequence[str], Sequence[str]] | None = None
    vectors: vector_index.Index | None = None
    sections: DataFrame | None = None


@dataclass(frozen=True)
class Question:
    """A question with its own vector, options and filters; ids tell questions apart."""

    id: int
    text: str
    vector: Sequence[float] | None = None
    options: Options = Options()
    filters: Filters = Filters()


@dataclass(frozen=True)
class Result:
    """hits in their order; gaps (kind, document_id, relation_id, blocking), which are looked for when first asked for. Both are small written tables."""

    hits: DataFrame
    find_gaps: Callable[[], DataFrame]

    @functools.cached_property
    def gaps(self) -> DataFrame:
        return self.find_gaps()

    def abstain(self) -> bool:
        """Whether a gap forbids an answer."""
        return not self.gaps.where("blocking").isEmpty()


@dataclass(frozen=True)
class _Plan:
    """A question with its settings resolved: `kind` numbers its condition, `strict` asks for current law."""

    question: Question
    options: Options
    terms: list[str]
    numbers: list[str]
    scoped: bool
    strict: bool
    others: bool
    kind: int

    @property
    def pool(self) -> int:
        return max(self.options.pool, OVERFETCH * self.options.top_k)


def _current() -> Column:
    return F.coalesce(F.col("status_class").isin(*CURRENT), F.lit(False))


def _as_of(date: str) -> Column:
    day = F.lit(date).cast("date")
    return F.coalesce((F.col("eff_from") <= day) & (F.col("eff_to").isNull() | (F.col("eff_to") > day)), F.lit(False))


def _plans(corpus: Corpus, questions: Sequence[Question], config: Options) -> tuple[list[_Plan], list[Column], DataFrame]:
    """Plans, the conditions of their kinds, and the documents that questions name: (query_id, scope_id)."""
    spark = corpus.document.sparkSession
    named = [(q.id, n) for q in questions for n in query.named_documents(q.text)]
    scope, found = spark.createDataFrame([], "query_id bigint, scope_id bigint"), set()
    if named:
        names = spark.createDataFrame(named, "query_id bigint, number string")
        scope = written(corpus.document.select(F.col("id").cast("bigint").alias("scope_id"), F.lower("doc_number").alias("number")).join(F.broadcast(names), "number").select("query_id", "scope_id").distinct())
        found = {r.query_id for r in scope.select("query_id").distinct().collect()}
    kinds: dict[tuple, int] = {}
    plans = []
    for q in questions:
        s, scoped = q.options.over(config, DEFAULTS), q.id in found
        as_of = s.as_of
        strict = not as_of and (bool(q.options.in_force_only) if scoped else s.in_force_only)
        others = bool(strict and s.other_pass and q.options.in_force_only is None and not scoped and not q.filters.narrows() and s.mode == "hybrid")
        kind = kinds.setdefault((q.filters, strict, as_of), len(kinds))
        rewritten = query.expanded(query.restored(q.text, corpus.words, corpus.pairs), corpus.abbreviations)
        terms = list(dict.fromkeys(re.findall(r"[^\W_]+", rewritten.lower()))) if s.mode != "vector" else []
        plans.append(_Plan(q, s, terms, [n for i, n in named if i == q.id], scoped, strict, others, kind))
    conditions = [f.condition() & (_as_of(as_of) if as_of else _current() if strict else F.lit(True)) for f, strict, as_of in kinds]
    return plans, conditions, scope


def _dense(corpus: Corpus, plans: list[_Plan]) -> DataFrame | None:
    """(query_id, id, score): at least the best of each question with a vector."""
    asked = [p for p in plans if p.question.vector is not None and p.options.mode != "bm25"]
    if not asked or (corpus.embedding is None and corpus.vectors is None):
        return None
    spark = corpus.chunk.sparkSession
    if corpus.vectors is not None:
        questions = spark.createDataFrame([(p.question.id, [float(x) for x in p.question.vector]) for p in asked], "query_id bigint, vector array<double>")
        return vector_index.nearest(spark, corpus.vectors, questions, WIDE * max(p.pool for p in asked)).select("query_id", "id", F.col("similarity").alias("score"))
    if len(asked) == 1:
        near = retrieval.cosine(corpus.embedding, list(asked[0].question.vector), "id", "embedding")
        return near.where("similarity is not null").select(F.lit(asked[0].question.id).cast("bigint").alias("query_id"), "id", F.round("similarity", 9).alias("score"))
    ids = np.array([p.question.id for p in asked])
    q = np.array([p.question.vector for p in asked], np.float64)
    most = WIDE * max(p.pool for p in asked)
    vectors = spark.sparkContext.broadcast(q / np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            norm = np.sqrt((x * x).sum(axis=1))
            s = np.round((x @ vectors.value.T) / np.where(norm, norm, np.nan)[:, None], 9).T
            at = [np.flatnonzero(~np.isnan(row)) for row in s]
            if b.num_rows > most:
                at = [a[np.lexsort((b.column(0).to_numpy()[a], -row[a]))[:most]] for a, row in zip(at, s, strict=True)]
            rows = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(a) for a in at])), b.column(0).take(pa.array(rows)), pa.array(np.concatenate([row[a] for row, a in zip(s, at, strict=True)]))], ["query_id", "id", "score"])

    whole = corpus.embedding.where("embedding is not null and not exists(embedding, x -> x is null)")
    return whole.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "query_id bigint, id bigint, score double")


class _Words:
    """The arm of words: (query_id, id, score) of chunks that hold a term of the question."""

    def __init__(self, corpus: Corpus, plans: list[_Plan]):
        self.spark, self.plans = corpus.chunk.sparkSession, [p for p in plans if p.terms]
        self.terms = list(dict.fromkeys(t for p in self.plans for t in p.terms))
        self.counts, self.every = None, None
        if corpus.postings:
            self.every = self._weighted(*retrieval.read_postings(self.spark, corpus.postings, self.terms))
            return
        counts = retrieval.term_counts(corpus.chunk, self.terms, "id", "content")
        if counts.unique():
            self.counts = counts
        else:
            # rows of one id add up, so no task knows a chunk's score
            post = counts.postings().withColumn("term", F.element_at(F.array(*map(F.lit, self.terms)), F.col("k") + 1))
            self.every = self._weighted(post, post.groupBy("term").agg(F.count("*").alias("df")), counts.table.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))

    def _weighted(self, post: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
        asked = F.broadcast(self.spark.createDataFrame([(p.question.id, t) for p in self.plans for t in p.terms], "query_id bigint, term string"))
        return retrieval.weighted(post.join(asked, "term"), df, stats, "query_id").withColumn("score", F.round("score", 9))

    def best(self) -> DataFrame:
        """At least WIDE times the pool of each question; questions of the same terms are scored once."""
        if self.counts is None:
            return self.every
        most: dict[tuple[str, ...], int] = {}
        for p in self.plans:
            most[tuple(p.terms)] = max(most.get(tuple(p.terms), 0), WIDE * p.pool)
        group = {terms: g for g, terms in enumerate(most)}
        names = self.spark.createDataFrame([(group[tuple(p.terms)], p.question.id) for p in self.plans], "group int, query_id bigint")
        return retrieval.best_by_words(self.counts, list(most), list(most.values())).join(F.broadcast(names), "group").select("query_id", "id", "score")

    def among(self, allowed: DataFrame, questions: set[int]) -> DataFrame:
        """At least the pool of each of the questions, among its allowed chunks (query_id, id)."""
        if self.counts is None:
            return allowed.join(self.every, ["query_id", "id"]).select("query_id", "id", "score")
        mine = [p for p in self.plans if p.question.id in questions]
        names = F.broadcast(self.spark.createDataFrame([(g, p.question.id) for g, p in enumerate(mine)], "group int, query_id bigint"))
        found = retrieval.best_by_words(self.counts, [p.terms for p in mine], [p.pool for p in mine], allowed.join(names, "query_id").select("group", "id"))
        return found.join(names, "group").select("query_id", "id", "score")


def _top(scored: DataFrame, n: Column | int, *keys: str) -> DataFrame:
    """The n best of each question (and key), with their rank; tasks cut their own rows first."""
    w = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


class _Search:
    """One block of questions over a corpus; every table below is small, and written if it is read again, but those of the corpus."""

    def __init__(self, corpus: Corpus, questions: Sequence[Question], config: Options):
        self.corpus, self.spark, self.folder = corpus, corpus.document.sparkSession, shared_folder(corpus.document.sparkSession)
        self.plans, self.conditions, self.scope = _plans(corpus, questions, config)
        rows = [(p.question.id, p.kind, p.scoped, p.others, p.pool, p.options.top_k, p.options.doc_cap, p.options.rrf_k, query.lexical_weight(p.question.text), p.options.roll_up) for p in self.plans]
        self.settings = F.broadcast(self.spark.createDataFrame(rows, "query_id bigint, kind int, scoped boolean, others boolean, pool int, top_k int, doc_cap int, rrf_k int, weight double, roll_up string"))

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, self.folder, name)

    @functools.cached_property
    def status(self) -> DataFrame:
        """The validity of each document, written once: up to three steps join it."""
        validity = self.corpus.validity
        return self.kept(validity.groupBy("document_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("status_class", "eff_from", "eff_to") if c in validity.columns)), "status")

    def fulfilled(self) -> Column:
        """Whether a row (kind, scoped, scope_id, and chunk and document columns) fulfils its question's condition."""
        of_kind = F.lit(False)
        for k, c in enumerate(self.conditions):
            of_kind = F.when(F.col("kind") == k, c).otherwise(of_kind)
        return of_kind & (~F.col("scoped") | F.col("scope_id").isNotNull())

    def looked_up(self, found: DataFrame, name: str) -> DataFrame:
        """found (query_id, id, ...) with chunk, document and status of each, and whether it may be shown, or is of other validity."""
        chunks = self.corpus.chunk.join(F.broadcast(found.select("id").distinct()), "id", "left_semi")
        chunks = self.kept(chunks, f"{name}-chunks")
        ids = F.broadcast(chunks.select("document_id").distinct())
        documents = self.corpus.document.join(ids, F.col("id") == F.col("document_id"), "left_semi").withColumnRenamed("id", "document_id")
        status = self.status.join(ids, "document_id", "left_semi")
        known = documents.join(status, "document_id", "left")
        known = known.select("document_id", *(c for c in known.columns if c not in {"document_id", *chunks.columns}))
        rows = found.join(self.settings, "query_id").join(chunks, "id").join(F.broadcast(self.kept(known, f"{name}-known")), "document_id")
        rows = self._scoped(rows)
        other = F.col("others") & F.col("status_class").isNotNull() & ~_current()
        return rows.withColumn("fulfilled", self.fulfilled()).withColumn("other", other)

    def _scoped(self, rows: DataFrame) -> DataFrame:
        scope = self.scope.select(F.col("query_id").alias("_q"), "scope_id")
        return rows.join(F.broadcast(scope), (F.col("query_id") == F.col("_q")) & (F.col("document_id") == F.col("scope_id")), "left").drop("_q")

    def candidates(self) -> DataFrame:
        """(query_id, arm, id, score, rank) and what looked_up adds: each arm's pool of rows that fulfil the question's condition."""
        dense = _dense(self.corpus, self.plans)
        words = _Words(self.corpus, self.plans) if any(p.terms for p in self.plans) else None
        lists = {k: v for k, v in (("dense", dense), ("sparse", words and words.best())) if v is not None}
        empty = self.spark.createDataFrame([], "query_id bigint, arm string, id bigint, score double, rank int")
        wide = empty
        for arm, scored in lists.items():
            mine = scored.join(self.settings.select("query_id", "pool"), "query_id")
            wide = wide.unionByName(_top(mine, WIDE * F.col("pool")).select("query_id", F.lit(arm).alias("arm"), "id", "score", "rank"))
        wide = self.kept(wide, "wide")
        rows = self.kept(self.looked_up(wide, "first"), "rows")
        # the pass for other validity takes its rows from the dense list
        passes = rows.where("fulfilled").unionByName(rows.where("other and arm = 'dense'").withColumn("arm", F.lit("other")))
        length = wide.groupBy("query_id", "arm").agg(F.count("*").alias("length"))
        length = length.unionByName(length.where("arm = 'dense'").withColumn("arm", F.lit("other"))).join(self.settings, "query_id").where("arm <> 'other' or others")
        left = passes.groupBy("query_id", "arm").agg(F.count("*").alias("left"))
        short = length.join(left, ["query_id", "arm"], "left").where(f"length >= {WIDE} * pool and coalesce(left, 0) < pool").select("query_id", "arm").collect()
        if short:
            again = self.again({(r.query_id, r.arm) for r in short}, dense, words)
            gone = F.broadcast(self.spark.createDataFrame([tuple(r) for r in short], "query_id bigint, arm string"))
            passes = passes.join(gone, ["query_id", "arm"], "left_anti").unionByName(again)
        return _top(passes.drop("rank"), F.col("pool"), "arm")

    def again(self, short: set[tuple[int, str]], dense: DataFrame | None, words: _Words | None) -> DataFrame:
        """The pools of (question, arm) pairs, chosen among all rows that fulfil the conditions."""
        asked = F.broadcast(self.spark.createDataFrame(sorted(short), "query_id bigint, arm string"))
        known = self.corpus.document.withColumnRenamed("id", "document_id").join(self.status, "document_id", "left")
        chunks = self.corpus.chunk.select("id", "document_id", "citation")
        chunks = chunks.join(known.select("document_id", *(c for c in known.columns if c not in {"document_id", "citation", "title"})), "document_id")
        # the questions that fell short, a stated set, against all chunks
        rows = self._scoped(chunks.join(asked.join(self.settings, "query_id")))
        other = F.col("others") & F.col("status_class").isNotNull() & ~_current()
        allowed = rows.where(F.when(F.col("arm") == "other", other).otherwise(self.fulfilled())).select("query_id", "arm", "id", "pool")
        scored = []
        if any(arm != "sparse" for _, arm in short):
            scored.append(allowed.where("arm <> 'sparse'").join(dense, ["query_id", "id"]).select("query_id", "arm", "id", "score"))
        if mine := {q for q, arm in short if arm == "sparse"}:
            scored.append(words.among(allowed.where("arm = 'sparse'").select("query_id", "id"), mine).select("query_id", F.lit("sparse").alias("arm"), "id", "score"))
        scored = (scored[0] if len(scored) == 1 else scored[0].unionByName(scored[1])).join(self.settings.select("query_id", "pool"), "query_id")
        found = self.kept(_top(scored, F.col("pool"), "arm").drop("pool"), "again")
        return self.looked_up(found, "again")

    def hits(self, rows: DataFrame) -> DataFrame:
        """The hits of all questions: shown ones, promoted ones, those of other validity."""
        ranked = rows.groupBy("query_id", "id").agg(
            F.max(F.when(F.col("arm") == "dense", F.col("rank"))).alias("dense_rank"),
            F.max(F.when(F.col("arm") == "sparse", F.col("rank"))).alias("sparse_rank"),
            F.max(F.when(F.col("arm") != "sparse", F.col("score"))).alias("similarity"),
            F.max(F.when(F.col("arm") == "other", F.col("rank"))).alias("other_rank"),
        )
        about = rows.drop("arm", "rank", "score").dropDuplicates(["query_id", "id"])
        zero = F.lit(0.0)
        score = F.coalesce(1.0 / (F.col("rrf_k") + F.col("dense_rank")), zero) + F.coalesce(F.col("weight") / (F.col("rrf_k") + F.col("sparse_rank")), zero)
        up_to = {level: F.when(F.col("citation").contains(part), citations.citation_up_to(F.col("citation"), part)) for level, part in (("article", "Article"), ("clause", "Clause"))}
        parent = F.when(F.col("roll_up") == "none", F.concat(F.lit("#"), F.col("id"))).when(F.col("roll_up") == "clause", F.coalesce(up_to["clause"], up_to["article"])).otherwise(up_to["article"])
        everything = ranked.join(about, ["query_id", "id"]).withColumn("score", F.round(score, 9))
        everything = everything.withColumn("section", F.concat_ws("|", "document_id", F.coalesce(parent, F.col("citation"), F.lit(""))))
        everything = self.kept(everything, "everything")
        primary = everything.where("dense_rank is not null or sparse_rank is not null")
        order = [F.desc("score"), F.asc("id")]
        rolled = primary.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "section").orderBy(*order))).where("n = 1")
        late = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(*order)) > F.col("doc_cap")
        shown = rolled.withColumn("late", late).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("late", *order))).where("place <= top_k")
        shown = shown.withColumn("badge", F.when(_current(), "").otherwise(F.coalesce("status_class", F.lit("unknown"))))
        # groups that are not shown, but whose best hits together are worth more than the weakest of the first
        natural = primary.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        first = natural.where("at <= top_k")
        weakest = first.groupBy("query_id").agg(F.min("score").alias("weakest"))
        three = natural.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "section").orderBy(*order))).where("n <= 3")
        sums = three.groupBy("query_id", "section").agg(F.sum("score").alias("total"), F.count("*").alias("members"), F.min(F.struct("at", "id")).alias("best"))
        fresh = sums.where("members >= 2").join(first.select("query_id", "section").distinct(), ["query_id", "section"], "left_anti").join(F.broadcast(weakest), "query_id").where("total > weakest")
        fresh = fresh.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total"), F.asc("best.id")))).where("n <= 2")
        fresh = fresh.join(shown.select("query_id", "section"), ["query_id", "section"], "left_anti").select("query_id", F.col("best.id").alias("id"), "n")
        promoted = primary.join(F.broadcast(fresh), ["query_id", "id"]).withColumn("place", F.lit(1_000_000) + F.col("n")).withColumn("badge", F.lit("promoted"))
        each = Window.partitionBy("query_id", "document_id").orderBy(F.desc("similarity"), "id")
        other = everything.where("other_rank is not null").withColumn("n", F.row_number().over(each)).where("n = 1")
        other = other.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("n") <= F.least(F.lit(OTHERS), F.col("top_k")))
        other = other.withColumn("place", F.lit(2_000_000) + F.col("n")).withColumn("score", F.lit(0.0)).withColumn("badge", F.col("status_class"))
        columns = ["query_id", "place", "id", "document_id", "doc_number", "title", "citation", "content", "status_class", "score", "similarity", "badge"] + (["section_id"] if "section_id" in everything.columns else [])
        out = shown.select(*columns).unionByName(promoted.select(*columns)).unionByName(other.select(*columns))
        # a chunk shows once, at its first place
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("place"))).where("n = 1").drop("n")
        return self.kept(out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))), "hits")

    def gaps(self, hits: DataFrame) -> DataFrame:
        """(query_id, kind, document_id, relation_id, blocking): what is missing for an answer; a row for each kind and document, or relation."""
        corpus, spark = self.corpus, self.spark
        asked = spark.createDataFrame([(p.question.id, p.question.text) for p in self.plans], "query_id bigint, text string")
        nothing = F.lit(None).cast("bigint")
        found: list[DataFrame] = []

        def add(kind: str, rows: DataFrame, document: Column | str = "document_id", relation: Column = nothing) -> None:
            document = F.col(document) if isinstance(document, str) else document
            found.append(rows.select("query_id", F.lit(kind).alias("kind"), document.alias("document_id"), relation.alias("relation_id")).distinct())

        if corpus.scope is not None:
            add("out_of_domain", asked.where(~in_scope(F.col("text"), *map(list, corpus.scope))), nothing)
        top = asked.join(hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("top")), "query_id", "left")
        add("no_evidence", top.where("n is null"), nothing)
        add("low_confidence", top.where((F.col("top") > 0) & (F.col("top") < LEAST_SIMILARITY)), nothing)
        add("validity_unknown", hits.where("status_class is null"))
        partial = hits.where("status_class = 'partial'")
        if corpus.sections is not None:
            partial = partial.join(corpus.sections.select("section_id").distinct(), "section_id", "left_anti")
        add("partial_uncertain", partial)
        pairs = F.broadcast(hits.select("query_id", "document_id").distinct())
        if corpus.text is not None:
            texts = corpus.text.join(F.broadcast(hits.select("document_id").distinct()), "document_id", "left_semi").groupBy("document_id").agg(F.max("is_binding").alias("binding"), F.max("needs_review").alias("review"))
            texts = hits.select("query_id", "document_id").distinct().join(texts, "document_id", "left")
            add("no_binding_text", texts.where(~F.coalesce("binding", F.lit(False))))
            add("needs_review", texts.where("review"))
            if "markdown" in corpus.text.columns:
                found.append(self._unindexed())
        if corpus.relation is not None:
            relation_id = F.col("id").cast("bigint") if "id" in corpus.relation.columns else nothing
            own = corpus.relation.withColumn("relation_id", relation_id).join(pairs, F.col("from_id") == F.col("document_id")).drop("document_id")
            own = self.kept(own.select("query_id", "from_id", "to_id", "relation_id"), "relations")
            add("unresolved_relation", own.where("to_id is null"), "from_id", F.col("relation_id"))
            targets = F.broadcast(own.where("to_id is not null").select("to_id").distinct())
            without = own.where("to_id is not null").join(corpus.chunk.select("document_id").join(targets, F.col("document_id") == F.col("to_id"), "left_semi"), F.col("to_id") == F.col("document_id"), "left_anti")
            if corpus.text is not None:
                without = without.join(corpus.text.where("is_binding").select(F.col("document_id").alias("to_id")).join(targets, "to_id", "left_semi"), "to_id", "left_anti")
            add("relation_target_text_gap", without, "to_id", F.col("relation_id"))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return self.kept(out.withColumn("blocking", F.col("kind").isin(*BLOCKING)), "gaps")

    def _unindexed(self) -> DataFrame:
        """Gaps of documents with texts that bind nobody and no chunks, that a question names or that hold a strong term of it; TEXT_GAPS a question."""
        strong = list(self.corpus.scope[0]) if self.corpus.scope else []
        looked = [(p.question.id, n.lower()) for p in self.plans for n in {*p.numbers, *(t for t in strong if query.fold(t) in query.fold(p.question.text))}]
        asked = F.broadcast(self.spark.createDataFrame(looked, "query_id bigint, part string"))
        filled = F.length(F.trim(F.coalesce("markdown", F.lit("")))) > 0
        texts = self.corpus.text.groupBy("document_id").agg(F.max(F.col("is_binding") & filled).alias("binding"), F.max(~F.col("is_binding") & filled).alias("other"), F.max("needs_review").alias("review"), F.array_join(F.array_sort(F.collect_list(F.lower("markdown"))), "\n").alias("bodies"))
        texts = texts.where("other and not binding").join(self.corpus.chunk.select("document_id").distinct(), "document_id", "left_anti")
        texts = texts.join(self.corpus.document.select(F.col("id").alias("document_id"), "doc_number", F.lower("title").alias("name")), "document_id")
        held = F.concat_ws("\n", F.lower("doc_number"), "name", "bodies").contains(F.col("part"))
        # a few parts of questions against the documents that have nothing else
        rows = texts.join(asked, held).select("query_id", "document_id", "review", "doc_number").distinct()
        w = Window.partitionBy("query_id").orderBy(F.desc("review"), "doc_number", "document_id")
        rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= TEXT_GAPS)
        return rows.select("query_id", F.lit("known_binding_text_gap").alias("kind"), "document_id", F.lit(None).cast("bigint").alias("relation_id"))


def search_many(corpus: Corpus, questions: Sequence[Question], config: Options = Options()) -> Result:  # noqa: B008
    """search() for many questions in one job; hits and gaps carry a query_id. Questions are a bounded list that the driver holds."""
    if len({q.id for q in questions}) < len(questions):
        raise ValueError("questions share an id")
    run = _Search(corpus, questions, config)
    hits = run.hits(run.candidates())
    return Result(hits, lambda: run.gaps(hits))


def search(corpus: Corpus, text: str, vector: Sequence[float] | None = None, options: Options = Options(), filters: Filters = Filters(), config: Options = Options()) -> Result:  # noqa: B008
    """The best chunks for a query, and what speaks against relying on them.

    Options go before config, config before DEFAULTS. A query that names documents of the corpus is answered from them
    alone: the filter on validity is lifted unless the options ask for it. Hits of other validity follow those of current
    law, unless the options set in_force_only either way or ask for a date or one arm only, the filters ask for issuers,
    types or dates, or documents are named. As of a date, documents count whose current validity row has begun and not
    ended by then. Without a vector (or embeddings) the arm of words stands alone. Of equal scores smaller ids go first.
    """
    r = search_many(corpus, [Question(0, text, vector, options, filters)], config)
    return Result(r.hits.drop("query_id"), lambda: r.gaps.drop("query_id"))


def detailed(hits: DataFrame, level: str) -> DataFrame:
    """Hits by level of detail, compact, standard or full: columns only, never their order or number."""
    compact = ["query_id", "place", "id", "document_id", "doc_number", "citation", "status_class", "badge", "score"]
    names = {"compact": compact, "standard": [*compact, "title", "similarity", "snippet"], "full": [*hits.columns, "snippet"]}[level]
    return hits.withColumn("snippet", F.substring("content", 1, 300)).select(*(c for c in [*hits.columns, "snippet"] if c in names))

