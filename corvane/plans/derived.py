"""Queries of trees, resolution, related hits, articles, citations, parsers and the ledger's state machine, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import citations as C
from corvane.functions import repair
from corvane.operators import graph, mining, provisions, references, retrieval, sections
from corvane.plans import evidence
from corvane.plans.dialect import Duck, Spark
from corvane.plans.evidence import _table
from corvane.plans.relational import register
from corvane.plans.views import with_views
from corvane.sources import captures
from corvane.storage import checkpoint_folder
from corvane.streaming import ledger

_SECTIONS = """SELECT CAST(r_regionkey AS BIGINT) AS document_id, CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, CAST(r_regionkey AS BIGINT) AS ordinal FROM region
    UNION ALL SELECT CAST(n_regionkey AS BIGINT), 100 + CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation
    UNION ALL SELECT CAST(n_regionkey AS BIGINT), 1000 + c_custkey, 100 + CAST(n_nationkey AS BIGINT), c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_ARTICLES = "SELECT document_id, CAST(floor(ordinal / 10) AS BIGINT) AS article, ordinal, content FROM chunk"
_REFS = "SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS document_id, concat('a', o_orderkey % 50) AS alias, concat('en|', o_orderkey % 400) AS c1, concat('de|', o_orderkey % 300) AS c2 FROM orders"


def _sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(with_views(body, Spark()))


def g1_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of section trees."""
    return sections.preorder(_sql(spark, sf_dir, _SECTIONS)).select("document_id", "id", F.col("depth").cast("long").alias("depth"), "path")


def g8_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What encloses each section, from the root down."""
    return sections.preorder(_sql(spark, sf_dir, _SECTIONS)).select("id", F.array_join(F.col("ancestors").cast("array<string>"), ">").alias("ancestors"))


def p9_appendix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk stands in the main text; appendices repeat them three places on, and go on where the main text ends."""
    main = _sql(spark, sf_dir, "SELECT document_id, ordinal AS path, 'main' AS origin FROM chunk")
    return sections.merged_appendices(main, _sql(spark, sf_dir, "SELECT document_id, ordinal + 3 AS path, 'appendix' AS origin FROM chunk"))


def r17_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.articles(_sql(spark, sf_dir, _ARTICLES))


def g9_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _sql(spark, sf_dir, _REFS).select("ref_id", "document_id", "alias", F.array("c1", "c2").alias("candidates"))
    docs = _sql(spark, sf_dir, "SELECT doc_key, doc_id AS document_id FROM observation")
    return references.resolved(refs, docs, _sql(spark, sf_dir, "SELECT concat('a', doc_id) AS alias, doc_id AS document_id FROM documents"))


def r21_related_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.arm(evidence._sparse(spark, sf_dir).withColumn("score", F.round("score", 9)), "score", 200).select(F.col("id").alias("document_id"), "rank")
    near = evidence._dense(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.expr("id % 500").alias("document_id"), F.round(1 - F.col("similarity"), 9).alias("distance"))
    binding = _sql(spark, sf_dir, "SELECT document_id FROM document_text WHERE is_binding")
    relations = _sql(spark, sf_dir, "SELECT from_id, to_id FROM relation")
    return references.related_hits(hits, relations, binding, near).select("chunk_id", "document_id", F.col("source_rank").cast("long").alias("source_rank"), F.col("place").cast("long").alias("place"))


def r11_family_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each family; hits outside families stand alone."""
    checkpoint_folder(spark)
    hits = evidence._hits(spark, sf_dir)
    # a hundred hits at most look up their families
    families = graph.families(evidence._relation(spark, sf_dir)).join(F.broadcast(hits.select(F.col("id").alias("node"))), "node", "left_semi")
    named = hits.join(F.broadcast(families), hits["id"] == families["node"], "left").select("id", F.coalesce("family", "id").alias("family"), "score")
    return retrieval.roll_up(named, "family")


def x5_diacritic_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", C.diacritic_free(F.col("text")).alias("plain"))


def x17_article_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _sql(spark, sf_dir, "SELECT id, concat('Chapter ', ordinal % 3, ',  Article ', ordinal, ', Clause ', ordinal % 2) AS citation FROM chunk")
    return c.select("id", C.citation_up_to(F.col("citation"), "Article").alias("article"), C.citation_up_to(F.col("citation"), "Point").alias("whole"))


def x24_path_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT id, concat('chapter-', ordinal % 3, '/article-', ordinal, CASE WHEN ordinal % 5 = 0 THEN '~2' ELSE '' END) AS path FROM chunk").select("id", C.path_citation(F.col("path")).alias("citation"))


def x36_enacting_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT o_orderkey, concat('Hà Nội, ngày ', CASE WHEN o_orderkey % 10 = 0 THEN 31 ELSE day(o_orderdate) END, ' tháng ', CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE month(o_orderdate) END, ' năm ', year(o_orderdate)) AS text FROM orders"
    return _sql(spark, sf_dir, text).select("o_orderkey", C.enacting_date(F.col("text")).alias("enacted"))


def x37_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", C.titles_match(F.col("p_name"), F.concat(F.upper("p_name"), F.when(F.expr("p_partkey % 2 = 0"), " (x)").otherwise(" and further rules of conduct"))).alias("same"))


def x3_thai_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(repair.thai_clusters("text")).cast("long").alias("n_clusters"))


def x31_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", repair.cleaned("text").alias("text"))


def p7_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-party trees; here each line of a document is a node."""
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.struct(F.lit("line").alias("kind"), (k + 1).cast("string").alias("label"), x.alias("content")))
    rows = provisions.tree_provisions(_table(spark, sf_dir, "documents").select("doc_id", F.to_json(lines).alias("tree")))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "content", "path")


def p8_dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions, each document by the grammar of its jurisdiction."""
    by_lang = F.coalesce(*(F.when(F.col("lang") == k, g) for k, g in {"en": "sg", "de": "my", "fr": "kh", "es": "id"}.items()), F.lit("vn"))
    return provisions.provisions(_table(spark, sf_dir, "documents"), by_lang)


def p11_mined_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations found in texts; the documents get a sentence that amends another."""
    text = "SELECT doc_id, concat(substring(text, 1, 60), '. This amends Article 3 of ', 100 + doc_id % 900, '/2020/AB; ', text) AS text FROM documents WHERE text IS NOT NULL"
    return mining.mined_relations(_sql(spark, sf_dir, text)).select("doc_id", "number", "relation", "target", "start")


def p12_structured_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = _sql(spark, sf_dir, """SELECT event_id AS doc_id, concat('[{"type":"', event_type, '","number":" ', CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(user_id, '/2024') END, '"}]') AS json FROM events""")
    kinds = spark.sql("SELECT 'view' AS code, 'amends' AS label, true AS trusted UNION ALL SELECT 'click', 'guides', false")
    return mining.structured_relations(payloads, kinds)


def s1_json_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a JSON source, one for each order, read into discovered documents."""
    payload = """SELECT concat('{"success":true,"data":{"total":1,"items":[{"id":"', o_orderkey, '","docNum":" ', o_custkey, '/2024 ","title":"T","docType":{"name":"', o_orderstatus, '"},"issueDate":"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00"},{"title":"no id"}]}}') AS payload FROM orders"""
    return captures.json_items(_sql(spark, sf_dir, payload), "vbpl").select("external_id", "number", "doc_type", "issued_at", captures.jurisdiction(F.col("source")).alias("jurisdiction"))


def st3_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.replayed(ledger.actions_of(_table(spark, sf_dir, "events")))


QUERIES = {f.__name__: f for f in (g1_preorder, g8_ancestors, p9_appendix_merge, r17_articles, g9_resolved, r21_related_hits, r11_family_collapse, x5_diacritic_free, x17_article_citation, x24_path_citation, x36_enacting_date, x37_title_match, x3_thai_clusters, x31_cleaned, p7_trees, p8_dispatched, p11_mined_relations, p12_structured_relations, s1_json_capture, st3_state_machine)}
_WALK = f"""WITH RECURSIVE s AS ({_SECTIONS}), w AS (SELECT document_id, id, CAST(0 AS BIGINT) AS depth, lpad(CAST(ordinal AS VARCHAR), 8, '0') AS path, '' AS ancestors FROM s WHERE parent_id IS NULL
    UNION ALL SELECT s.document_id, s.id, w.depth + 1, w.path || '/' || lpad(CAST(s.ordinal AS VARCHAR), 8, '0'), CASE WHEN w.ancestors = '' THEN '' ELSE w.ancestors || '>' END || w.id FROM w JOIN s ON s.document_id = w.document_id AND s.parent_id = w.id)"""
_D = Duck()
ORACLES = {
    "g1_preorder": f"{_WALK} SELECT document_id, id, depth, path FROM w",
    "g8_ancestors": f"{_WALK} SELECT id, ancestors FROM w",
    "p9_appendix_merge": with_views("SELECT document_id, ordinal AS path, 'main' AS origin FROM chunk UNION ALL SELECT document_id, ordinal + 3, 'appendix' FROM chunk WHERE (document_id, ordinal + 3) NOT IN (SELECT (document_id, ordinal) FROM chunk)", _D),
    "r17_articles": with_views(f"""WITH a AS (SELECT *, lag(content) OVER (PARTITION BY document_id, article ORDER BY ordinal) AS before FROM ({_ARTICLES}) x), r AS (SELECT *, CASE WHEN content = before THEN '' ELSE content END AS rest FROM a)
        SELECT document_id, article, count(*) AS chunks, CAST(sum(length(rest)) AS BIGINT) AS characters, CASE WHEN sum(length(rest)) <= 14000 THEN coalesce(string_agg(rest, chr(10) ORDER BY ordinal) FILTER (WHERE rest <> ''), '') END AS text FROM r GROUP BY document_id, article""", _D),
    "g9_resolved": with_views(f"""WITH r AS ({_REFS}), k AS (SELECT doc_key, count(DISTINCT doc_id) AS n, min(doc_id) AS found FROM observation GROUP BY doc_key), al AS (SELECT concat('a', doc_id) AS alias, doc_id AS found FROM documents),
        j AS (SELECT r.ref_id, r.document_id AS old, coalesce(al.found, CASE WHEN k1.n = 1 THEN k1.found END, CASE WHEN k2.n = 1 THEN k2.found END) AS fresh, greatest(coalesce(k1.n, 0), coalesce(k2.n, 0)) > 1 AS shared FROM r LEFT JOIN al ON al.alias = r.alias LEFT JOIN k k1 ON k1.doc_key = r.c1 LEFT JOIN k k2 ON k2.doc_key = r.c2)
        SELECT ref_id, CASE WHEN fresh IS NULL AND shared THEN NULL ELSE coalesce(fresh, old) END AS document_id,
          CASE WHEN fresh IS NOT NULL THEN CASE WHEN old IS NULL THEN 'resolved' WHEN fresh <> old THEN 'corrected' ELSE 'unchanged' END WHEN shared THEN CASE WHEN old IS NULL THEN 'ambiguous' ELSE 'cleared' END ELSE 'unmatched' END AS outcome FROM j""", _D),
    "r21_related_hits": with_views(f"""WITH {evidence._BM25}, {evidence._COS}, hit AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM sparse) WHERE rank <= 200),
        seed AS (SELECT r.to_id AS document_id, min(h.rank) AS source_rank FROM relation r JOIN hit h ON h.id = r.from_id WHERE r.to_id NOT IN (SELECT id FROM hit) AND r.to_id IN (SELECT document_id FROM document_text WHERE is_binding) GROUP BY r.to_id),
        near AS (SELECT d.id AS chunk_id, s.document_id, s.source_rank, round(1 - d.similarity, 9) AS distance FROM dense d JOIN seed s ON s.document_id = d.id % 500 WHERE d.similarity IS NOT NULL),
        two AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY distance, chunk_id) <= 2)
        SELECT chunk_id, document_id, source_rank, place FROM (SELECT *, row_number() OVER (ORDER BY distance, source_rank, chunk_id) AS place FROM two) WHERE place <= 10""", _D),
    "x5_diacritic_free": "SELECT doc_id, strip_accents(lower(text)) = lower(text) AND NOT regexp_matches(lower(text), '\\p{Mn}') AS plain FROM documents",
    "x17_article_citation": with_views("SELECT id, concat('Chapter ', ordinal % 3, ', Article ', ordinal) AS article, concat('Chapter ', ordinal % 3, ', Article ', ordinal, ', Clause ', ordinal % 2) AS whole FROM chunk", _D),
    "x24_path_citation": with_views("SELECT id, concat('Chapter ', ordinal % 3, ', Article ', ordinal, CASE WHEN ordinal % 5 = 0 THEN ' [2]' ELSE '' END) AS citation FROM chunk", _D),
    "x36_enacting_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS enacted FROM orders",
    "x37_title_match": "SELECT p_partkey, p_partkey % 2 = 0 AND length(trim(regexp_replace(p_name, '[^\\p{L}\\p{Nd}]+', ' ', 'g'))) >= 0.85 * (2 + length(trim(regexp_replace(p_name, '[^\\p{L}\\p{Nd}]+', ' ', 'g')))) AS same FROM part",
    "p7_trees": "SELECT doc_id, k AS ordinal, string_split(text, chr(10))[k] AS content, 'line-' || k AS path FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL)",
    "p11_mined_relations": "SELECT doc_id, concat(100 + doc_id % 900, '/2020/ab') AS number, 'amends' AS relation, 'Article 3' AS target, length(substring(text, 1, 60)) + 27 AS start FROM documents WHERE text IS NOT NULL",
    "s1_json_capture": "SELECT CAST(o_orderkey AS VARCHAR) AS external_id, concat(o_custkey, '/2024') AS number, o_orderstatus AS doc_type, CAST(o_orderdate AS DATE) AS issued_at, 'vn' AS jurisdiction FROM orders",
    "p12_structured_relations": "SELECT event_id AS doc_id, concat(user_id, '/2024') AS number, CASE event_type WHEN 'view' THEN 'amends' WHEN 'click' THEN 'guides' ELSE event_type END AS relation, event_type = 'view' AS promoted FROM events WHERE event_id % 4 <> 0",
}
