"""Evaluation of a question set: all questions are searched in one job, and their hits scored by joins.

A case expects citations (document number and, where given, article, clause and point) or that the search abstains. The
searches of all cases read the corpus once for each arm; scores come from the small tables of hits and expectations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.query import Options
from corvane.operators.search import CURRENT, Corpus, Filters, Question, search_many
from corvane.storage import written

# Long forms of document types and their short ones, longer phrases first, and words of numbers that tell nothing.
SHORT_FORMS = (
    ("PERATURAN PEMERINTAH PENGGANTI UNDANG-UNDANG", "PERPPU"),
    ("PERATURAN KEPALA PUSAT PELAPORAN DAN ANALISIS TRANSAKSI KEUANGAN", "PPATK"),
    ("PERATURAN PUSAT PELAPORAN DAN ANALISIS TRANSAKSI KEUANGAN", "PPATK"),
    ("PERATURAN MENTERI KOMUNIKASI DAN INFORMATIKA", "KOMINFO"),
    ("PERATURAN MENTERI KOMUNIKASI DAN DIGITAL", "KOMDIGI"),
    ("PERATURAN BADAN SIBER DAN SANDI NEGARA", "BSSN"),
    ("SURAT EDARAN OTORITAS JASA KEUANGAN", "SEOJK"),
    ("PERATURAN OTORITAS JASA KEUANGAN", "POJK"),
    ("PERATURAN ANGGOTA DEWAN GUBERNUR", "PADG"),
    ("PERATURAN LEMBAGA PENJAMIN SIMPANAN", "LPS"),
    ("SURAT EDARAN BANK INDONESIA", "SEBI"),
    ("PERATURAN BANK INDONESIA", "PBI"),
    ("PERATURAN MENTERI KEUANGAN", "PMK"),
    ("PERATURAN PEMERINTAH", "PP"),
    ("PERATURAN PRESIDEN", "PERPRES"),
    ("UNDANG-UNDANG", "UU"),
)
FILLERS = ("NOMOR", "TAHUN", "NO")


@dataclass(frozen=True)
class Matcher:
    """The words before labels in a jurisdiction's citations; where one is empty, labels of that level stand in brackets."""

    article: str = "article"
    clause: str = "clause"
    point: str = "point"


def number_key(number: Column) -> Column:
    """A document number in capitals, long types as short ones, without words that tell nothing, letters and digits only."""
    out = F.upper(F.trim(F.coalesce(number, F.lit(""))))
    for long, short in SHORT_FORMS:
        out = F.replace(out, F.lit(long), F.lit(short))
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{Nd}}])(?:{'|'.join(FILLERS)})(?![\p{{L}}\p{{Nd}}])", " ")
    return F.regexp_replace(out, r"[^\p{L}\p{Nd}]", "")


def same_number(a: Column, b: Column) -> Column:
    """Whether two numbers name one document: equal keys, or one that holds the other; nothing equals an empty number but an empty one."""
    x, y = number_key(a), number_key(b)
    return (x == y) | ((F.length(x) > 0) & (F.length(y) > 0) & (x.contains(y) | y.contains(x)))


def cites(citation: Column, word: str, label: Column) -> Column:
    """Whether a citation holds the label: behind the level's word, or in brackets if it has none. An empty label asks for nothing."""
    tokens = F.filter(F.split(F.lower(F.coalesce(citation, F.lit(""))), r"[,\s]+"), lambda t: t != "")
    want = F.lower(F.coalesce(label, F.lit("")))
    if word:
        pairs = F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))).alias("b"))
        held = F.exists(pairs, lambda p: (p["a"] == word.lower()) & (F.regexp_replace(p["b"], r"^[().]+|[().]+$", "") == want))
    else:
        held = F.array_contains(tokens, F.concat(F.lit("("), want, F.lit(")")))
    return (want == "") | F.coalesce(held, F.lit(False))


def expectations(cases: DataFrame) -> DataFrame:
    """(case_id, n, expected_number, others, article, clause, point, relation_ok) of cases (id, expected_citations)."""
    e = cases.select(F.col("id").alias("case_id"), F.posexplode("expected_citations").alias("n", "e"))
    return e.select("case_id", "n", F.col("e.doc_number").alias("expected_number"), F.coalesce("e.alt_doc_numbers", F.array().cast("array<string>")).alias("others"), "e.article", "e.clause", "e.point", F.coalesce("e.relation_ok", F.lit(False)).alias("relation_ok"))


def matches(expected: DataFrame, hits: DataFrame, matcher: Matcher, related: DataFrame | None = None) -> DataFrame:
    """(case_id, n, place): which hits (case_id, place, document_id, doc_number, citation) fulfil which expectations.

    related (document_id, doc_number) are the documents that a hit's document has confirmed relations with: an expectation
    of a whole document that allows it is fulfilled by those, too.
    """
    rows = expected.join(hits, "case_id")
    direct = same_number(F.col("expected_number"), F.col("doc_number")) | F.exists("others", lambda o: same_number(o, F.col("doc_number")))
    for word, level in ((matcher.article, "article"), (matcher.clause, "clause"), (matcher.point, "point")):
        direct &= cites(F.col("citation"), word, F.col(level))
    out = rows.where(direct).select("case_id", "n", "place")
    if related is not None:
        whole = rows.where("relation_ok and coalesce(article, '') = '' and coalesce(clause, '') = '' and coalesce(point, '') = ''").drop("doc_number")
        by = whole.join(F.broadcast(related.join(F.broadcast(hits.select("document_id").distinct()), "document_id", "left_semi")), "document_id")
        ok = same_number(F.col("expected_number"), F.col("doc_number")) | F.exists("others", lambda o: same_number(o, F.col("doc_number")))
        out = out.unionByName(by.where(ok).select("case_id", "n", "place"))
    return out.distinct()


def scored(cases: DataFrame, hits: DataFrame, abstained: DataFrame, matcher: Matcher = Matcher(), related: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """A row for each case: found and wanted citations, rank of the first, hits of current law, abstention, and the same of the pool.

    hits (case_id, place, document_id, doc_number, citation, status_class); abstained (case_id). Hits of other validity at
    the end, which a search shows apart, don't count against the share of current law, unless no hit is current.
    """
    expected = expectations(cases)
    current = F.coalesce(F.col("status_class").isin(*CURRENT), F.lit(False))
    last = hits.groupBy("case_id").agg(F.max(F.when(current, F.col("place"))).alias("last"), F.max("place").alias("end"))
    precision = hits.join(last, "case_id").where(F.col("place") <= F.coalesce("last", "end")).groupBy("case_id").agg(F.count_if(current).alias("hits_in_force"), F.count("*").alias("hits_total"))

    def found(of: DataFrame, hits_name: str, rank_name: str) -> DataFrame:
        return matches(expected, of, matcher, related).groupBy("case_id").agg(F.count_distinct("n").alias(hits_name), F.min("place").alias(rank_name))

    c = cases.select(F.col("id").alias("case_id"), F.coalesce("expect_abstain", F.lit(False)).alias("expect_abstain"), F.coalesce("expect_fail", F.lit(False)).alias("expect_fail"), F.greatest(F.size("expected_citations"), F.lit(0)).cast("bigint").alias("recall_want"))
    out = c.join(found(hits, "recall_hits", "rank"), "case_id", "left").join(precision, "case_id", "left").join(abstained.select("case_id", F.lit(True).alias("abstained")), "case_id", "left")
    columns = ["recall_hits", "hits_in_force", "hits_total"]
    if pool is not None:
        out = out.join(found(pool, "pool_hits", "pool_rank"), "case_id", "left").withColumn("pool_want", F.col("recall_want"))
        columns.append("pool_hits")
    out = out.fillna(0, columns).fillna(False, ["abstained"])
    return out.withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).withColumn("abstain_correct", F.col("abstained") == F.col("expect_abstain"))


def summary(results: DataFrame) -> DataFrame:
    """One row of metrics over scored cases: sums over sums, cases that are expected to fail apart; 0 where no case counts."""
    r = results if "pool_hits" in results.columns else results.withColumn("pool_hits", F.lit(0)).withColumn("pool_want", F.lit(0))
    live, wants = ~F.col("expect_fail"), ~F.col("expect_fail") & (F.col("recall_want") > 0)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    def total(name: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(name))), F.lit(0))

    return r.agg(
        F.count("*").alias("cases"),
        F.count_if("expect_fail").alias("expect_fail_cases"),
        F.count_if(F.col("expect_fail") & (F.col("recall_want") > 0) & (F.col("recall_hits") == F.col("recall_want"))).alias("gap_pass_cases"),
        F.count_if(wants).alias("recall_cases"),
        ratio(total("recall_hits", wants), total("recall_want", wants)).alias("recall"),
        ratio(total("reciprocal_rank", wants), F.count_if(wants)).alias("mrr"),
        F.count_if(live & (F.col("hits_total") > 0)).alias("in_force_cases"),
        ratio(total("hits_in_force", live), total("hits_total", live)).alias("in_force_precision"),
        ratio(F.count_if(live & F.col("abstain_correct")), F.count_if(live)).alias("abstain_accuracy"),
        F.count_if(live & (F.col("pool_want") > 0)).alias("pool_cases"),
        ratio(total("pool_hits", live), total("pool_want", live)).alias("pool_recall"),
    )


def coverage(cases: DataFrame, corpus: Corpus) -> DataFrame:
    """(doc_number, cases, state) of the documents that cases expect: missing from the corpus, present without chunks, or indexed.

    A case whose document is missing can't be answered by any search.
    """
    expected = expectations(cases).where("trim(expected_number) <> ''").groupBy(F.lower(F.trim("expected_number")).alias("doc_number")).agg(F.array_sort(F.collect_set("case_id")).alias("cases"))
    held = corpus.document.where("coalesce(doc_number, '') <> ''").select("id", F.col("doc_number").alias("stored"))
    # the numbers that a question set names, a small table, against all documents
    found = held.join(F.broadcast(expected), same_number(F.col("stored"), F.col("doc_number"))).select("doc_number", "id")
    found = written(found)
    indexed = found.join(corpus.chunk.join(F.broadcast(found.select(F.col("id").alias("document_id")).distinct()), "document_id", "left_semi").select(F.col("document_id").alias("id")).distinct(), "id", "left_semi")
    state = found.groupBy("doc_number").agg(F.lit(True).alias("there")).join(indexed.select("doc_number", F.lit(True).alias("searched")).distinct(), "doc_number", "left")
    return expected.join(state, "doc_number", "left").select("doc_number", "cases", F.when(F.col("there").isNull(), "missing").when(F.col("searched").isNull(), "not indexed").otherwise("indexed").alias("state"))


def diagnosis(results: DataFrame) -> DataFrame:
    """Scored cases with why citations are missing: `ranking` if the pool holds them all, `retrieval` if not."""
    short = F.col("recall_hits") < F.col("recall_want")
    return results.withColumn("failure", F.when(short & (F.col("pool_hits") >= F.col("recall_want")), "ranking").when(short, "retrieval"))


def report_lines(results: DataFrame) -> DataFrame:
    """(case_id, line): a line of text for each scored case."""
    mark = F.when(F.col("recall_hits") == F.col("recall_want"), "ok  ").otherwise("MISS")
    rank = F.coalesce(F.col("rank").cast("string"), F.lit("-"))
    text = F.format_string("%s %-24s recall %d/%d rank %s current %d/%d abstain %s", mark, F.col("case_id"), F.col("recall_hits"), F.col("recall_want"), rank, F.col("hits_in_force"), F.col("hits_total"), F.when(F.col("abstain_correct"), "ok").otherwise("WRONG"))
    return results.select("case_id", text.alias("line"))


def evaluate(corpus: Corpus, cases: DataFrame, vectors: DataFrame | None = None, options: Options = Options(), matcher: Matcher = Matcher(), pool_k: int = 0, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """scored() of a question set (as readers.golden() gives it), each question searched as search() would.

    vectors (id, vector) are those of the questions. With pool_k, a second search of that many hits without a cap per
    document tells what the candidates hold. Question sets are small files, so the driver holds the questions.
    """
    spark = corpus.document.sparkSession
    # read by several joins: how expectations were found is not computed again
    cases = written(cases)
    known = {r.id: r.vector for r in vectors.select("id", "vector").collect()} if vectors is not None else {}
    ids: Sequence[tuple[str, str]] = [(r.id, r.question) for r in cases.select("id", "question").orderBy("id").collect()]
    # the probe's questions are searched with the others: one pass over the corpus serves both
    runs = [options] + ([replace(options, top_k=pool_k, doc_cap=pool_k, other_pass=False)] if pool_k else [])
    numbered = [(k, run, i, text) for k, (run, (i, text)) in enumerate((run, c) for run in range(len(runs)) for c in ids)]
    names = F.broadcast(spark.createDataFrame([(k, run, i) for k, run, i, _ in numbered], "query_id bigint, run int, case_id string"))
    r = search_many(corpus, [Question(k, text, known.get(i), runs[run], filters) for k, run, i, text in numbered])
    hits = r.hits.where("badge <> 'promoted'").join(names, "query_id").select("run", "case_id", "place", "document_id", "doc_number", "citation", "status_class")
    shown, pool = hits.where("run = 0").drop("run"), hits.where("run = 1").drop("run") if pool_k else None
    abstained = r.gaps.where("blocking").select("query_id").distinct().join(names.where("run = 0"), "query_id").select("case_id")
    related = None
    if corpus.relation is not None:
        both = corpus.relation.where("to_id is not null").select(F.col("from_id").alias("document_id"), F.col("to_id").alias("other"))
        both = both.unionByName(both.select(F.col("other").alias("document_id"), F.col("document_id").alias("other")))
        both = both.join(F.broadcast(shown.select("document_id").distinct()), "document_id", "left_semi")
        related = written(both.join(corpus.document.select(F.col("id").alias("other"), "doc_number"), "other").select("document_id", "doc_number").distinct())
    return scored(cases, shown, abstained, matcher, related, pool)
