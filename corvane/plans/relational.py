"""Relational operators stated once in SQL, run by Spark and checked by DuckDB: filters, joins, aggregates, windows, sets, writes, text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans.dialect import Duck, Spark
from corvane.plans.views import TABLES, with_views

#: Name to query, given a dialect. The operators' codes in the survey stand behind the names.
BODIES: dict[str, Callable] = {
    # filters and projections
    "f1_lookup_by_key": lambda d: "SELECT id, doc_number, title FROM document WHERE doc_number = 'src3/3'",
    "f2_current_law": lambda d: "SELECT document_id, status_class, status_class IN ('in_force', 'partial') AS is_current FROM current_validity",
    "f3_window_as_of": lambda d: "SELECT id, document_id, status_class FROM validity WHERE (eff_from IS NULL OR eff_from <= DATE '2024-01-10') AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '2024-01-10 00:00:00')",
    "f5_issue_range": lambda d: f"SELECT id, {d.day('discovered_at')} AS issued FROM fetch_doc WHERE CAST(discovered_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'",
    "f6_issuer_any": lambda d: "SELECT id, issuer FROM document WHERE lower(issuer) LIKE '%rc1%' ESCAPE '!' OR lower(issuer) LIKE '%c!_7%' ESCAPE '!'",
    "f7_doc_type_any": lambda d: "SELECT id, doc_type FROM document WHERE lower(doc_type) IN ('de', 'fr')",
    "f8_scoped_ids": lambda d: "SELECT id, title FROM document WHERE id IN (SELECT document_id FROM validity WHERE status_class = 'expired')",
    "f9_citation_filter": lambda d: "SELECT document_id, citation FROM chunk WHERE lower(citation) LIKE '%line 7%'",
    "f10_changed": lambda d: "SELECT a.doc_id, a.lang AS was, b.source AS became FROM documents a JOIN documents b ON a.doc_id = b.doc_id WHERE a.lang IS DISTINCT FROM b.source",
    "f11_not_blank": lambda d: "SELECT id, length(trim(coalesce(text, ''))) > 0 AS has_text FROM document",
    "f14_lead_verbs": lambda d: "SELECT document_id, ordinal FROM chunk WHERE lower(content) LIKE '%with%' OR lower(content) LIKE '%pour%'",
    "f15_article_match": lambda d: "SELECT document_id, citation FROM chunk WHERE citation = 'Line 7' OR citation LIKE concat('Line 7', ', %')",
    "f16_exclusions": lambda d: "SELECT d.id, d.issuer FROM document d LEFT ANTI JOIN (SELECT 'src1' AS issuer UNION ALL SELECT 'src2') x ON d.issuer = x.issuer" if d.name == "spark" else "SELECT id, issuer FROM document WHERE issuer NOT IN ('src1', 'src2')",
    "f17_json_predicate": lambda d: f"SELECT event_id, CAST({d.json('props', 'k')} AS BIGINT) AS k FROM events WHERE coalesce({d.json('props', 'k')}, '') <> ''",
    "f18_projection_defaults": lambda d: f"SELECT id, coalesce(doc_type, '') AS doc_type, substring({d.replaced('text', '[ \\t\\n]+', ' ')}, 1, 280) AS snippet FROM document",
    # joins
    "j1_inner_chain": lambda d: "SELECT r.from_id, r.to_id, o.o_orderstatus, p.p_brand FROM relation r JOIN orders o ON r.from_id = o.o_orderkey JOIN part p ON r.to_id = p.p_partkey",
    "j2_hydrate": lambda d: "SELECT d.id, d.doc_number, v.status_class, t.is_binding FROM document d LEFT JOIN current_validity v ON v.document_id = d.id LEFT JOIN document_text t ON t.document_id = d.id",
    "j3_section_override": lambda d: """WITH s AS (SELECT document_id, section_id, status_class FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_id ORDER BY observed_at DESC, id DESC) AS rn FROM validity WHERE superseded_at IS NULL) x WHERE rn = 1)
        SELECT c.id, coalesce(b.status_class, a.status_class) AS status_class FROM chunk c
        LEFT JOIN (SELECT * FROM s WHERE section_id IS NULL) a ON a.document_id = c.document_id
        LEFT JOIN (SELECT * FROM s WHERE section_id IS NOT NULL) b ON b.document_id = c.document_id AND b.section_id = c.document_id + c.ordinal""",
    "j4_semi": lambda d: "SELECT id, title FROM document d WHERE EXISTS (SELECT 1 FROM validity v WHERE v.document_id = d.id AND v.status_class = 'in_force')",
    "j5_existence": lambda d: "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer",
    "j6_anti": lambda d: "SELECT id FROM document d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.id)",
    "j7_either_missing": lambda d: "SELECT id FROM (SELECT d.id, max(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS a, max(CASE WHEN v.document_id IS NOT NULL THEN 1 ELSE 0 END) AS b FROM document d LEFT JOIN labels l ON l.doc_id = d.id LEFT JOIN current_validity v ON v.document_id = d.id GROUP BY d.id) x WHERE a = 0 OR b = 0",
    "j8_best_evidence": lambda d: "SELECT from_id, to_id, l_linenumber AS line, l_quantity AS confidence FROM (SELECT r.from_id, r.to_id, l.l_linenumber, l.l_quantity, row_number() OVER (PARTITION BY r.from_id, r.to_id ORDER BY l.l_quantity DESC, l.l_linenumber) AS rn FROM relation r JOIN lineitem l ON l.l_orderkey = r.from_id) x WHERE rn = 1",
    # the part before the first comma is the join's key, so that no document is compared with itself all with all
    "j9_prefix_residual": lambda d: f"SELECT a.document_id, a.article, b.citation AS part FROM (SELECT DISTINCT document_id, concat('Article ', CAST(floor(ordinal / 10) AS BIGINT)) AS article FROM chunk) a JOIN (SELECT document_id, concat('Article ', CAST(floor(ordinal / 10) AS BIGINT), CASE WHEN ordinal % 10 = 0 THEN '' ELSE concat(', Clause ', ordinal % 10) END) AS citation FROM chunk) b ON a.document_id = b.document_id AND {d.part('b.citation', ', ', 1)} = a.article",
    "j13_pair_in": lambda d: "SELECT doc_id, lang, source FROM documents WHERE (lang, source) IN (SELECT lang, source FROM documents GROUP BY lang, source HAVING count(*) >= 5)",
    "j14_better_sibling": lambda d: "SELECT doc_id, doc_key, priority, max(priority) OVER (PARTITION BY doc_key) > priority AS outranked FROM observation",
    "j16_status_row": lambda d: "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunk) AS chunks, (SELECT count(DISTINCT document_id) FROM validity) AS with_validity, (SELECT count(*) FROM relation) AS relations, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM document_text WHERE is_binding) AS binding",
    "j17_correlated_max": lambda d: "SELECT o.doc_id, m.best FROM observation o LEFT JOIN (SELECT doc_key, max(priority) AS best FROM observation GROUP BY doc_key) m ON o.doc_key = m.doc_key",
    # aggregates
    "a1_counts": lambda d: "SELECT source, count(*) AS n, count(lang) AS with_lang, count(DISTINCT lang) AS langs FROM documents GROUP BY source",
    "a2_state_rollup": lambda d: "SELECT source, count(*) AS n, count(*) FILTER (WHERE state = 'complete') AS complete, count(*) FILTER (WHERE state = 'partial') AS partial, count(*) FILTER (WHERE in_scope) AS in_scope FROM fetch_doc GROUP BY source",
    "a3_text_state": lambda d: f"SELECT document_id, bool_or(is_binding) AS binding, bool_or(needs_review) AS review, {d.agg('authority')} AS authorities, CAST(max(length(markdown)) AS BIGINT) AS longest FROM document_text GROUP BY document_id",
    "a5_issuer_list": lambda d: f"SELECT lang, {d.agg('source')} AS sources FROM documents GROUP BY lang",
    "a6_unique_lookup": lambda d: "SELECT title, min(id) AS id FROM document GROUP BY title HAVING count(*) = 1",
    "a7_latest_status": lambda d: ("SELECT document_id, max_by(status_class, struct(observed_at, id)) AS status_class" if d.name == "spark" else "SELECT document_id, arg_max(status_class, (observed_at, id)) AS status_class") + " FROM validity GROUP BY document_id",
    "a9_top_issuers": lambda d: "SELECT issuer, count(*) AS n FROM document GROUP BY issuer ORDER BY n DESC, issuer LIMIT 10",
    "a13_majority": lambda d: "SELECT document_id, status_class AS vote FROM (SELECT document_id, status_class, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, status_class) AS rn FROM validity GROUP BY document_id, status_class) x WHERE rn = 1",
    "a14_kind_stats": lambda d: "SELECT document_id, count(*) AS lines, count(*) FILTER (WHERE length(content) < 20) AS short, count(*) FILTER (WHERE length(content) >= 200) AS long FROM chunk GROUP BY document_id",
    "a15_collisions": lambda d: "SELECT document_id, id, n FROM (SELECT document_id, id, count(*) OVER (PARTITION BY document_id, content) AS n FROM chunk) x WHERE n > 1",
    # windows, paging, sets
    "w1_current_validity": lambda d: "SELECT document_id, id, status_class FROM current_validity",
    "w2_section_validity": lambda d: "SELECT document_id, section_id, id, status_class FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_id ORDER BY observed_at DESC, id DESC) AS rn FROM validity) x WHERE rn = 1",
    "w1_as_of_newest_then_window": lambda d: "SELECT document_id, id, status_class FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY observed_at DESC, id DESC) AS rn FROM validity) x WHERE rn = 1 AND eff_from IS NOT NULL AND eff_from <= DATE '2024-01-30'",
    "f4_as_of_window_then_newest": lambda d: "SELECT document_id, id, status_class FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY observed_at DESC, id DESC) AS rn FROM validity WHERE (eff_from IS NULL OR eff_from <= DATE '2024-01-20') AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '2024-01-20 00:00:00')) x WHERE rn = 1",
    "w3_candidate_pick": lambda d: "SELECT doc_key, doc_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY priority DESC, doc_id) AS rn FROM observation) x WHERE rn = 1",
    "w4_relations_per_base": lambda d: "SELECT base, other, direction, CAST(rn AS BIGINT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY direction, relation_type, other) AS rn FROM (SELECT from_id AS base, to_id AS other, relation_type, 'outgoing' AS direction FROM relation UNION ALL SELECT to_id, from_id, relation_type, 'incoming' FROM relation) u) x WHERE rn <= 8",
    "l6_page": lambda d: "SELECT id, doc_number FROM document ORDER BY id LIMIT 20 OFFSET 40",
    "l8_timeline": lambda d: f"SELECT document_id, {d.day('eff_from')} AS day, status_class, CAST(row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN eff_from IS NULL THEN 1 ELSE 0 END, eff_from, id) AS BIGINT) AS place FROM validity",
    "u1_both_directions": lambda d: "SELECT from_id AS base, to_id AS other, 'outgoing' AS direction FROM relation UNION ALL SELECT to_id, from_id, 'incoming' FROM relation",
    "u3_distinct": lambda d: "SELECT DISTINCT lang, source FROM documents",
    "g4_neighbourhood": lambda d: "SELECT u.base, u.other, u.direction, v.status_class, t.is_binding FROM (SELECT from_id AS base, to_id AS other, 'outgoing' AS direction FROM relation UNION ALL SELECT to_id, from_id, 'incoming' FROM relation) u LEFT JOIN current_validity v ON v.document_id = u.other LEFT JOIN document_text t ON t.document_id = u.other",
    "g5_second_hop": lambda d: "SELECT base, target, amended_by FROM (SELECT a.from_id AS base, a.to_id AS target, b.from_id AS amended_by, row_number() OVER (PARTITION BY a.from_id, a.to_id ORDER BY b.from_id) AS rn FROM relation a JOIN relation b ON b.to_id = a.to_id AND b.from_id <> a.from_id) x WHERE rn <= 8",
    "g6_superseded": lambda d: f"SELECT v.document_id, {d.agg('CAST(r.from_id AS VARCHAR(20))')} AS superseded_by FROM current_validity v JOIN relation r ON r.to_id = v.document_id AND r.relation_type = 'F' WHERE v.status_class IN ('in_force', 'partial') GROUP BY v.document_id",
    # writes and work selection, as whole derived tables
    "d1_document_merge": lambda d: "SELECT doc_key, max(priority) AS metadata_priority, min(CASE WHEN rn = 1 THEN doc_id END) AS document, min(CASE WHEN rn = 1 THEN lang END) AS lang, count(*) AS observations FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY priority DESC, doc_id DESC) AS rn FROM observation) x GROUP BY doc_key",
    "d7_supersede_then_insert": lambda d: f"SELECT id, document_id, status_class, {d.day('observed_at')} AS observed, {d.day('lead(observed_at) OVER (PARTITION BY document_id ORDER BY observed_at, id)')} AS superseded FROM validity",
    "d9_convergent_write": lambda d: "SELECT id, document_id, status_class FROM (SELECT *, lag(status_class) OVER (PARTITION BY document_id ORDER BY observed_at, id) AS before FROM validity) x WHERE before IS DISTINCT FROM status_class",
    "d10_completeness": lambda d: """SELECT f.id, count(a.ref_key) FILTER (WHERE NOT a.is_optional) AS expected, count(a.ref_key) FILTER (WHERE NOT a.is_optional AND a.state = 'done') AS done,
        CASE WHEN count(a.ref_key) FILTER (WHERE NOT a.is_optional) = 0 THEN f.state
             WHEN count(a.ref_key) FILTER (WHERE NOT a.is_optional AND a.state IN ('pending', 'error')) > 0 THEN 'fetching'
             WHEN count(a.ref_key) FILTER (WHERE NOT a.is_optional AND a.state = 'dead') > 0 THEN 'partial' ELSE 'complete' END AS new_state
        FROM fetch_doc f LEFT JOIN fetch_artifact a ON a.fetch_doc_id = f.id GROUP BY f.id, f.state""",
    "st3_claim_order": lambda d: "SELECT fetch_doc_id, ref_key, CAST(row_number() OVER (PARTITION BY fetch_doc_id ORDER BY CASE state WHEN 'pending' THEN 0 ELSE 1 END, updated_at, ref_key) AS BIGINT) AS claim FROM fetch_artifact WHERE state IN ('pending', 'error')",
    "st7_needs_index": lambda d: "SELECT d.id FROM document d JOIN document_text t ON t.document_id = d.id LEFT JOIN (SELECT DISTINCT label AS document_id FROM embeddings) e ON e.document_id = d.id WHERE e.document_id IS NULL AND t.is_binding",
    # text and other functions
    "x16_number_key": lambda d: f"SELECT id, {d.replaced("replace(lower(concat(doc_number, '/NĐ-CP É', id)), 'đ', 'd')", '[^\\p{L}\\p{Nd}]')} AS number_key FROM document",
    "x20_token_estimate": lambda d: "SELECT id, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(content) / 2.0) AS BIGINT)) END AS tokens FROM chunk",
    "x25_clamped": lambda d: f"SELECT doc_id, CASE WHEN length(s) > 200 THEN concat(substring(s, 1, 197), '...') ELSE s END AS snippet FROM (SELECT doc_id, trim({d.replaced('text', '[ \\t\\n]+', ' ')}) AS s FROM documents) x",
    "x26_status_label": lambda d: "SELECT document_id, CASE status_class WHEN 'in_force' THEN 'in force' WHEN 'partial' THEN 'partly in force' WHEN 'not_yet' THEN 'not yet in force' ELSE status_class END AS label FROM current_validity",
    "x40_content_hash": lambda d: f"SELECT doc_id, {d.sha('text')} AS sha256 FROM documents",
    "x44_redacted_url": lambda d: f"SELECT page_id, {d.replaced('url', '[?#].*$')} AS url, url LIKE '%utm_source%' AS tracked FROM pages",
    "discovery_hash": lambda d: f"SELECT id, {d.sha("concat_ws('|', doc_number, title, issuer, doc_type)")} AS content_hash FROM document",
    # products: gaps, status, evaluation
    "r20_gaps": lambda d: """SELECT d.id, 'no_binding_text' AS gap FROM document d LEFT JOIN (SELECT document_id, bool_or(is_binding) AS b FROM document_text GROUP BY document_id) t ON t.document_id = d.id WHERE coalesce(t.b, false) = false
        UNION ALL SELECT d.id, 'validity_unknown' FROM document d LEFT JOIN current_validity v ON v.document_id = d.id WHERE v.document_id IS NULL
        UNION ALL SELECT document_id, 'needs_review' FROM document_text WHERE needs_review""",
    "r25_corpus_status": lambda d: "SELECT issuer, count(*) AS documents, count(v.document_id) AS with_validity, count(*) FILTER (WHERE v.status_class IN ('in_force', 'partial')) AS current_law, CAST(sum(n_chars) AS BIGINT) AS characters FROM document d LEFT JOIN current_validity v ON v.document_id = d.id GROUP BY issuer",
    "r27_validity_usable": lambda d: "SELECT count(*) FILTER (WHERE status_class IN ('in_force', 'partial')) > 0 AS usable FROM current_validity",
    "r30_family_validity": lambda d: "SELECT to_id AS base, from_id AS member, CASE WHEN rn = 1 THEN coalesce(status_class, 'unknown') ELSE 'expired' END AS status_class FROM (SELECT r.from_id, r.to_id, v.status_class, row_number() OVER (PARTITION BY r.to_id ORDER BY o.o_orderdate DESC, r.from_id DESC) AS rn FROM relation r JOIN orders o ON o.o_orderkey = r.from_id LEFT JOIN current_validity v ON v.document_id = r.to_id) x",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def query_of(body: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(with_views(body(Spark()), Spark()))

    return run


QUERIES = {name: query_of(body) for name, body in BODIES.items()}
ORACLES = {name: with_views(body(Duck()), Duck()) for name, body in BODIES.items()}
