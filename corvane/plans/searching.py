"""The whole search over the driver's tables, and the same stated in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.query import Options
from corvane.operators import evaluation, vector_index
from corvane.operators.search import Corpus, Filters, Question, Result, search_many
from corvane.operators.search import search as run
from corvane.plans.dialect import Duck, Spark
from corvane.plans.evidence import _query_vector
from corvane.plans.relational import register
from corvane.plans.views import with_views
from corvane.storage import shared_folder

QUERY, TOP_K, DOC_CAP = "license the and token", 20, 3


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    register(spark, sf_dir)

    def view(body: str) -> DataFrame:
        return spark.sql(with_views(body, Spark()))

    return Corpus(
        view("SELECT id, doc_number, title, issuer, doc_type FROM document"),
        view("SELECT id, document_id, citation, content FROM chunk"),
        view("SELECT document_id, status_class, eff_from, CAST(eff_from + INTERVAL 9 DAYS AS DATE) AS eff_to FROM current_validity"),
        view("SELECT vec_id * 100000 AS id, embedding FROM embeddings"),
        view("SELECT from_id, to_id FROM relation"),
        view("SELECT document_id, is_binding, needs_review FROM document_text"),
    )


def _result(spark: SparkSession, sf_dir: str) -> Result:
    return run(_corpus(spark, sf_dir), QUERY, _query_vector(spark, sf_dir), Options(top_k=TOP_K, doc_cap=DOC_CAP))


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current hits, capped by document, then the best hits of other validity."""
    hits = _result(spark, sf_dir).hits.where("badge <> 'promoted'")
    return hits.select("id", "document_id", "citation", "badge", F.round("score", 7).alias("score"))


def search_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against these hits."""
    return _result(spark, sf_dir).gaps.select("kind", "document_id", "blocking")


def search_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words alone, as of several dates, all questions in one job."""
    questions = [Question(k, QUERY, None, Options(top_k=TOP_K, doc_cap=DOC_CAP, as_of=day)) for k, day in enumerate(DAYS)]
    hits = search_many(_corpus(spark, sf_dir), questions).hits.where("badge <> 'promoted'")
    return hits.select("query_id", "place", "id", "document_id", F.round("score", 7).alias("score"))


def search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector arm within issuers, with another issuer and within types of documents; no hits of other validity."""
    vector = _query_vector(spark, sf_dir)
    filters = [Filters(issuers=("SRC1", "rc2")), Filters(excluded_issuers=("src0",), doc_types=("DE", "fr")), Filters(doc_types=("en",))]
    questions = [Question(k, QUERY, vector, Options(top_k=TOP_K, doc_cap=DOC_CAP, mode="vector", roll_up="none"), f) for k, f in enumerate(filters)]
    hits = search_many(_corpus(spark, sf_dir), questions).hits.where("badge <> 'promoted'")
    return hits.select("query_id", "place", "id", "document_id", F.round("similarity", 7).alias("similarity"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a question; it expects the documents that hold its first six words, the first two of them, or abstention if there is none."""
    corpus = _corpus(spark, sf_dir)
    holding = "SELECT b.item_id, d.id, d.doc_number FROM (SELECT item_id, array_join(slice(split(text, ' '), 1, 6), ' ') AS head FROM benchmark) b JOIN document d ON contains(d.text, b.head)"
    found = spark.sql(with_views(holding, Spark())).groupBy("item_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("id", "doc_number"))), 1, 2).alias("docs"))
    none = F.lit(None).cast("string")
    cited = F.transform(F.coalesce("docs", F.array().cast("array<struct<id: bigint, doc_number: string>>")), lambda d: F.struct(d["doc_number"].alias("doc_number"), none.alias("article"), none.alias("clause"), none.alias("point"), F.lit(False).alias("relation_ok"), F.lit(None).cast("array<string>").alias("alt_doc_numbers")))
    cases = spark.sql("SELECT item_id, text AS question FROM benchmark").join(found, "item_id", "left")
    cases = cases.select(F.col("item_id").cast("string").alias("id"), "question", cited.alias("expected_citations"), F.col("docs").isNull().alias("expect_abstain"), (F.col("item_id") % 9 == 0).alias("expect_fail"))
    return evaluation.evaluate(corpus, cases, options=Options(top_k=10, doc_cap=DOC_CAP, in_force_only=False, roll_up="none"), pool_k=40)


def r28_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question set of the benchmark's items, case by case, with a probe of 40 candidates."""
    return _evaluated(spark, sf_dir).select("case_id", "recall_want", "recall_hits", "rank", "hits_in_force", "hits_total", "abstained", "abstain_correct", "pool_hits", "pool_rank")


def r28_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its metrics."""
    rates = ("recall", "mrr", "in_force_precision", "abstain_accuracy", "pool_recall")
    m = evaluation.summary(_evaluated(spark, sf_dir))
    return m.select(*(F.round(c, 7).alias(c) if c in rates else c for c in m.columns))


def l3_vector_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 20, by an index of all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = vector_index.build(vectors, shared_folder(spark), "vec_id", "embedding", keep=["label"])
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index.nearest(spark, index, asked, 10, recall=0.95).select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


DAYS = ("2024-01-29", "2024-01-31", "2024-02-08")
QUERIES = {f.__name__: f for f in (search, search_gaps, search_as_of, search_scoped, r28_evaluation, r28_metrics, l3_vector_pool)}

_HITS = f"""tok AS (SELECT id, document_id, citation, list_filter(string_split(regexp_replace(lower(content), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda t: t <> '') AS t FROM chunk),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT id, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS f FROM tok, (SELECT unnest(string_split('{QUERY}', ' ')) AS term) q),
dfs AS (SELECT term, count(*) AS df FROM post WHERE f > 0 GROUP BY term),
words AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM post JOIN dfs USING (term), st WHERE f > 0 GROUP BY id),
near AS (SELECT vec_id * 100000 AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 9) AS similarity FROM embeddings),
known AS (SELECT c.id, c.document_id, c.citation, v.status_class, coalesce(v.status_class IN ('in_force', 'partial'), false) AS is_current FROM chunk c JOIN document d ON d.id = c.document_id LEFT JOIN current_validity v ON v.document_id = c.document_id),
sparse AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM words JOIN known USING (id) WHERE is_current QUALIFY rank <= {8 * TOP_K}),
dense AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM near JOIN known USING (id) WHERE is_current AND similarity IS NOT NULL QUALIFY rank <= {8 * TOP_K}),
fused AS (SELECT coalesce(d.id, s.id) AS id, d.similarity, round(coalesce(1.0 / (60 + d.rank), 0.0) + coalesce(1.0 / (60 + s.rank), 0.0), 9) AS score FROM dense d FULL JOIN sparse s ON d.id = s.id),
capped AS (SELECT f.*, k.document_id, k.citation, k.status_class, row_number() OVER (PARTITION BY k.document_id ORDER BY score DESC, f.id) > {DOC_CAP} AS late FROM fused f JOIN known k ON k.id = f.id),
shown AS (SELECT *, '' AS badge FROM capped QUALIFY row_number() OVER (ORDER BY late, score DESC, id) <= {TOP_K}),
other AS (SELECT n.id, similarity, document_id, citation, status_class FROM near n JOIN known k ON k.id = n.id WHERE status_class IS NOT NULL AND NOT is_current AND similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY similarity DESC, n.id) = 1),
best AS (SELECT *, status_class AS badge FROM other QUALIFY row_number() OVER (ORDER BY similarity DESC, id) <= 3),
hits AS (SELECT id, document_id, citation, status_class, badge, score, similarity FROM shown UNION ALL SELECT id, document_id, citation, status_class, badge, 0.0, similarity FROM best)"""
_GAPS = """texts AS (SELECT document_id, bool_or(is_binding) AS binding, bool_or(needs_review) AS review FROM document_text GROUP BY document_id)
SELECT DISTINCT 'partial_uncertain' AS kind, document_id, false AS blocking FROM hits WHERE status_class = 'partial'
UNION ALL SELECT DISTINCT 'validity_unknown', document_id, false FROM hits WHERE status_class IS NULL
UNION ALL SELECT DISTINCT 'no_binding_text', h.document_id, false FROM hits h LEFT JOIN texts t ON t.document_id = h.document_id WHERE NOT coalesce(binding, false)
UNION ALL SELECT DISTINCT 'needs_review', h.document_id, false FROM hits h JOIN texts t ON t.document_id = h.document_id WHERE review
UNION ALL SELECT DISTINCT 'relation_target_text_gap', r.to_id, false FROM relation r JOIN hits h ON h.document_id = r.from_id WHERE r.to_id NOT IN (SELECT document_id FROM chunk) AND r.to_id NOT IN (SELECT document_id FROM document_text WHERE is_binding)
UNION ALL SELECT 'no_evidence', NULL, true FROM hits HAVING count(*) = 0
UNION ALL SELECT 'low_confidence', NULL, true FROM hits HAVING max(similarity) > 0 AND max(similarity) < 0.3"""
_WORDS = _HITS[: _HITS.index("near AS (")]
_TOKENS = _HITS[: _HITS.index("post AS (")]
_KNOWN = "known AS (SELECT c.id, c.document_id, c.citation, d.doc_number, d.issuer, d.doc_type, v.status_class, v.eff_from FROM chunk c JOIN document d ON d.id = c.document_id LEFT JOIN current_validity v ON v.document_id = c.document_id)"
_DATED = f"""{_WORDS}{_KNOWN},
asked AS (SELECT unnest(range({len(DAYS)})) AS query_id, CAST(unnest({list(DAYS)}) AS DATE) AS day),
sparse AS (SELECT query_id, id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM asked, words JOIN known USING (id) WHERE eff_from <= day AND day < eff_from + INTERVAL 9 DAYS QUALIFY rank <= {8 * TOP_K}),
fused AS (SELECT *, round(1.0 / (60 + rank), 9) AS score FROM sparse),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, id) > {DOC_CAP} AS late FROM fused)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, id) AS place, id, document_id, round(score, 7) AS score FROM capped QUALIFY place <= {TOP_K}"""
_NEAR = _HITS[_HITS.index("near AS (") : _HITS.index("known AS (")]
_SCOPED = f"""{_NEAR}{_KNOWN},
mine AS (SELECT unnest([0, 1, 2]) AS query_id),
dense AS (SELECT CAST(query_id AS BIGINT) AS query_id, id, document_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM mine, near JOIN known USING (id)
  WHERE similarity IS NOT NULL AND status_class IN ('in_force', 'partial') AND CASE query_id WHEN 0 THEN issuer LIKE '%src1%' OR issuer LIKE '%rc2%' WHEN 1 THEN issuer NOT LIKE '%src0%' AND doc_type IN ('de', 'fr') ELSE doc_type = 'en' END QUALIFY rank <= {8 * TOP_K}),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) > {DOC_CAP} AS late FROM dense)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS place, id, document_id, round(similarity, 7) AS similarity FROM capped QUALIFY place <= {TOP_K}"""
_CASES = rf"""{_TOKENS}{_KNOWN},
terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+')) AS term FROM benchmark),
asked AS (SELECT DISTINCT term FROM terms),
post AS (SELECT id, term, count(*) AS f, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) x JOIN asked USING (term) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
words AS (SELECT item_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM terms JOIN post USING (term) JOIN dfs USING (term), st GROUP BY item_id, id),
ranked AS (SELECT item_id, id, document_id, doc_number, status_class, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM words JOIN known USING (id)),
expected AS (SELECT item_id, doc_number FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS head FROM benchmark) b JOIN document d ON contains(d.text, b.head) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY d.id) <= 2),
wanted AS (SELECT b.item_id, count(e.doc_number) AS want FROM benchmark b LEFT JOIN expected e ON e.item_id = b.item_id GROUP BY b.item_id),
top10 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY late, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id, document_id ORDER BY rank) > {DOC_CAP} AS late FROM ranked WHERE rank <= 80) x QUALIFY place <= 10),
top40 AS (SELECT *, rank AS place FROM ranked WHERE rank <= 40),
same AS (SELECT 'top' AS which, h.item_id, e.doc_number, h.place FROM top10 h JOIN expected e ON e.item_id = h.item_id AND (contains(regexp_replace(upper(h.doc_number), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(e.doc_number), '[^A-Z0-9]', '', 'g')) OR contains(regexp_replace(upper(e.doc_number), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(h.doc_number), '[^A-Z0-9]', '', 'g')))
  UNION ALL SELECT 'pool', h.item_id, e.doc_number, h.place FROM top40 h JOIN expected e ON e.item_id = h.item_id AND (contains(regexp_replace(upper(h.doc_number), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(e.doc_number), '[^A-Z0-9]', '', 'g')) OR contains(regexp_replace(upper(e.doc_number), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(h.doc_number), '[^A-Z0-9]', '', 'g')))),
found AS (SELECT item_id, count(DISTINCT doc_number) FILTER (which = 'top') AS hits, min(place) FILTER (which = 'top') AS rank, count(DISTINCT doc_number) FILTER (which = 'pool') AS pool_hits, min(place) FILTER (which = 'pool') AS pool_rank FROM same GROUP BY item_id),
lasts AS (SELECT *, coalesce(max(place) FILTER (status_class IN ('in_force', 'partial')) OVER (PARTITION BY item_id), max(place) OVER (PARTITION BY item_id)) AS last FROM top10),
law AS (SELECT item_id, count(*) FILTER (status_class IN ('in_force', 'partial')) AS ok, count(*) AS total FROM lasts WHERE place <= last GROUP BY item_id),
scored AS (SELECT CAST(w.item_id AS VARCHAR) AS case_id, w.item_id % 9 = 0 AS expect_fail, want AS recall_want, coalesce(hits, 0) AS recall_hits, rank, coalesce(ok, 0) AS hits_in_force, coalesce(total, 0) AS hits_total, total IS NULL AS abstained, (total IS NULL) = (want = 0) AS abstain_correct, coalesce(pool_hits, 0) AS pool_hits, pool_rank FROM wanted w LEFT JOIN found f ON f.item_id = w.item_id LEFT JOIN law l ON l.item_id = w.item_id)"""
ORACLES = {
    "search_as_of": with_views(f"WITH {_DATED}", Duck()),
    "search_scoped": with_views(f"WITH {_SCOPED}", Duck()),
    "r28_evaluation": with_views(f"WITH {_CASES} SELECT * EXCLUDE (expect_fail) FROM scored", Duck()),
    "r28_metrics": with_views(f"""WITH {_CASES}, live AS (SELECT * FROM scored WHERE NOT expect_fail)
SELECT (SELECT count(*) FROM scored) AS cases, (SELECT count(*) FROM scored WHERE expect_fail) AS expect_fail_cases, (SELECT count(*) FROM scored WHERE expect_fail AND recall_want > 0 AND recall_hits = recall_want) AS gap_pass_cases,
  count(*) FILTER (recall_want > 0) AS recall_cases, round(sum(recall_hits) FILTER (recall_want > 0) / sum(recall_want), 7) AS recall, round(sum(coalesce(1.0 / rank, 0)) FILTER (recall_want > 0) / count(*) FILTER (recall_want > 0), 7) AS mrr,
  count(*) FILTER (hits_total > 0) AS in_force_cases, round(sum(hits_in_force) / sum(hits_total), 7) AS in_force_precision, round(count(*) FILTER (abstain_correct) / count(*), 7) AS abstain_accuracy, count(*) FILTER (recall_want > 0) AS pool_cases, round(sum(pool_hits) / sum(recall_want), 7) AS pool_recall FROM live""", Duck()),
    "search": with_views(f"WITH {_HITS} SELECT id, document_id, citation, badge, round(score, 7) AS score FROM hits", Duck()),
    "search_gaps": with_views(f"WITH {_HITS}, {_GAPS}", Duck()),
}
