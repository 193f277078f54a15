"""Further relational operators in both dialects: retrieval filters and evidence, write rules, the ledger, status and worklists."""

from __future__ import annotations

from collections.abc import Callable

from corvane.plans.dialect import Duck
from corvane.plans.relational import query_of
from corvane.plans.views import with_views

#: A later snapshot of the ledger: two thirds of the documents found again, some with other contents.
_FOUND = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN concat(o_orderpriority, '*') ELSE o_orderpriority END AS source, o_totalprice > 150000 AS in_scope FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority <> '1-URGENT'"
_NEWEST = "SELECT document_id, id, eff_from, status_class FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY observed_at DESC, id DESC) AS rn FROM validity WHERE section_id IS NULL) n WHERE rn = 1"
#: Evaluation cases: a customer asks; the orders are what was retrieved, urgent ones what was expected.
_CASES = """SELECT c.c_custkey AS case_id, o.o_orderkey AS hit, o.o_orderpriority = '1-URGENT' AS expected, o.o_orderstatus IN ('F', 'O') AS current_law,
    row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS rank FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey"""
_MARKS = "[ÃÂ�]|â€"
#: The document whose parts r24_document lists.
_ONE = "SELECT id FROM document WHERE doc_number IN ('src3/3', 'src1/3', 'src0/3', 'src2/3', 'src4/3')"

BODIES: dict[str, Callable] = {
    # joins and aggregates
    "j11_named_keys": lambda d: f"SELECT id, number_key, concat(number_key, '|', doc_type) AS doc_key FROM (SELECT id, doc_type, {d.replaced('lower(doc_number)', '[^a-z0-9]')} AS number_key FROM document) x",
    "j12_parallel_lists": lambda d: "SELECT v.place, c.document_id, c.citation FROM (SELECT 1 AS place, 'Line 1' AS citation UNION ALL SELECT 2, 'Line 3' UNION ALL SELECT 3, 'Line 9') v JOIN chunk c ON c.citation = v.citation",
    "j15_resolution_map": lambda d: "SELECT o.doc_id, k.only AS resolved FROM observation o LEFT JOIN (SELECT doc_key, min(doc_id) AS only FROM observation GROUP BY doc_key HAVING count(*) = 1) k ON k.doc_key = o.doc_key",
    "a4_ordered_sets": lambda d: f"SELECT issuer, {d.agg('doc_type')} AS types, {d.agg("CASE WHEN t.is_binding THEN doc_type END")} AS binding_types FROM document LEFT JOIN document_text t ON t.document_id = id GROUP BY issuer",
    "a8_extremes": lambda d: "SELECT document_id, coalesce(max(id), 0) AS newest, min(id) FILTER (WHERE status_class = 'expired') AS first_expired FROM validity GROUP BY document_id",
    "a12_eval_metrics": lambda d: f"""SELECT round(sum(found) / greatest(1.0, sum(wanted)), 6) AS recall, round(CAST(sum(reciprocal) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE wanted > 0)), 6) AS mrr,
            round(sum(current_hits) / greatest(1.0, sum(shown)), 6) AS current_precision, round(CAST(count(*) FILTER (WHERE (shown = 0) = (wanted = 0)) AS DOUBLE) / greatest(1, count(*)), 6) AS abstention, count(*) AS cases
        FROM (SELECT case_id, CAST(count(*) FILTER (WHERE expected) AS DOUBLE) AS wanted, CAST(count(*) FILTER (WHERE expected AND rank <= 8) AS DOUBLE) AS found, CAST(count(hit) FILTER (WHERE rank <= 8) AS DOUBLE) AS shown,
            CAST(count(*) FILTER (WHERE current_law AND rank <= 8) AS DOUBLE) AS current_hits, coalesce(CAST(1 AS DOUBLE) / min(rank) FILTER (WHERE expected AND rank <= 8), 0) AS reciprocal FROM ({_CASES}) r GROUP BY case_id) s""",
    # orders, sets, windows
    "l4_nulls_last": lambda d: "SELECT id, document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_id ASC NULLS LAST, id) AS BIGINT) AS place FROM validity",
    "u2_known_either": lambda d: "SELECT p.p_partkey, k.id IS NOT NULL AS known FROM part p LEFT JOIN (SELECT from_id AS id FROM relation UNION SELECT to_id FROM relation) k ON k.id = p.p_partkey",
    "w5_two_per_relation": lambda d: "SELECT from_id, to_id, line, CAST(rn AS BIGINT) AS place FROM (SELECT r.from_id, r.to_id, l.l_linenumber AS line, row_number() OVER (PARTITION BY r.from_id, r.to_id ORDER BY l.l_extendedprice, l.l_linenumber) AS rn FROM relation r JOIN lineitem l ON l.l_orderkey = r.from_id) x WHERE rn <= 2",
    "w8_top_members": lambda d: "SELECT document_id, round(sum(w), 6) AS total, count(*) AS members FROM (SELECT user_id AS document_id, value AS w, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) x WHERE rn <= 3 GROUP BY document_id",
    "g10_backfill_frontier": lambda d: """SELECT target, via, l_quantity AS confidence FROM (SELECT r.to_id AS target, r.from_id AS via, l.l_quantity, row_number() OVER (PARTITION BY r.to_id ORDER BY l.l_quantity DESC, r.from_id) AS rn
        FROM relation r JOIN lineitem l ON l.l_orderkey = r.from_id AND l.l_linenumber = 1 WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = r.to_id AND o.o_orderstatus = 'F')
        AND NOT EXISTS (SELECT 1 FROM relation p WHERE p.to_id = r.from_id)) x WHERE rn = 1""",
    # retrieval
    "r2_prefilter": lambda d: f"SELECT d.id, v.status_class FROM document d JOIN ({_NEWEST}) v ON v.document_id = d.id WHERE lower(d.issuer) LIKE '%src%' AND lower(d.doc_type) IN ('en', 'de', 'fr') AND v.eff_from IS NOT NULL AND v.eff_from <= DATE '2024-02-01'",
    "r3_identifier_scope": lambda d: f"SELECT d.id, d.doc_number FROM document d WHERE {d.replaced('lower(d.doc_number)', '[^a-z0-9]')} IN ('src33', 'src18', 'src212')",
    "r9_hydrate": lambda d: f"""SELECT c.id, d.doc_number, d.title, coalesce(s.status_class, v.status_class, 'unknown') AS status_class, coalesce(t.is_binding, false) AS is_binding FROM chunk c JOIN document d ON d.id = c.document_id
        LEFT JOIN current_validity v ON v.document_id = c.document_id LEFT JOIN document_text t ON t.document_id = c.document_id
        LEFT JOIN (SELECT document_id, section_id, status_class FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_id ORDER BY observed_at DESC, id DESC) AS rn FROM validity WHERE section_id IS NOT NULL AND superseded_at IS NULL) y WHERE rn = 1) s
        ON s.document_id = c.document_id AND s.section_id = c.document_id + c.ordinal""",
    "r15_relations_once": lambda d: "SELECT id, document_id, rn = 1 AS carries_relations FROM (SELECT id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY observed_at DESC, id) AS rn FROM validity) x",
    "r19_known_reference": lambda d: "SELECT q.number, d.id IS NOT NULL AS known FROM (SELECT 'src3/3' AS number UNION ALL SELECT 'src9/99999999' UNION ALL SELECT 'src1/8') q LEFT JOIN document d ON d.doc_number = q.number",
    "r22_abstain": lambda d: f"""SELECT case_id, {d.agg('gap')} AS gaps, coalesce(bool_or(gap IN ('out_of_domain', 'no_evidence', 'low_confidence')), false) AS abstain FROM (
        SELECT c.c_custkey AS case_id, CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'out_of_domain' END AS gap FROM customer c
        UNION ALL SELECT c.c_custkey, CASE WHEN h.n IS NULL THEN 'no_evidence' WHEN h.best > 0 AND h.best < 0.3 THEN 'low_confidence' WHEN h.partials > 0 THEN 'partial_uncertain' END
        FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) / 500000 AS best, count(*) FILTER (WHERE o_orderstatus = 'P') AS partials FROM orders GROUP BY o_custkey) h ON h.o_custkey = c.c_custkey) g GROUP BY case_id""",
    "r24_document": lambda d: f"""WITH one AS ({_ONE})
        SELECT d.id, 'document' AS part, CAST(1 AS BIGINT) AS place, concat(d.doc_number, ': ', d.title) AS item FROM document d JOIN one ON one.id = d.id
        UNION ALL SELECT t.document_id, 'text', 1, CASE WHEN t.is_binding THEN 'binding' ELSE 'not binding' END FROM document_text t JOIN one ON one.id = t.document_id
        UNION ALL SELECT v.document_id, 'timeline', CAST(row_number() OVER (PARTITION BY v.document_id ORDER BY CASE WHEN v.eff_from IS NULL THEN 1 ELSE 0 END, v.eff_from, v.id) AS BIGINT), concat({d.day('v.eff_from')}, ' ', v.status_class) FROM validity v JOIN one ON one.id = v.document_id
        UNION ALL SELECT document_id, 'chunk', n, item FROM (SELECT c.document_id, CAST(row_number() OVER (PARTITION BY c.document_id ORDER BY c.ordinal) AS BIGINT) AS n, concat(c.citation, ' ', substring(c.content, 1, 280)) AS item FROM chunk c JOIN one ON one.id = c.document_id) y WHERE n <= 50
        UNION ALL SELECT base, 'relation', n, item FROM (SELECT u.base, CAST(row_number() OVER (PARTITION BY u.base ORDER BY u.direction, u.kind, u.other) AS BIGINT) AS n, concat(u.direction, ' ', u.kind, ' ', u.other) AS item FROM
            (SELECT from_id AS base, to_id AS other, relation_type AS kind, 'outgoing' AS direction FROM relation UNION ALL SELECT to_id, from_id, relation_type, 'incoming' FROM relation) u JOIN one ON one.id = u.base) z WHERE n <= 20
        UNION ALL SELECT base, 'amendment', n, substring(item, 1, 1500) FROM (SELECT r.to_id AS base, CAST(row_number() OVER w AS BIGINT) AS n, a.text AS item, sum(least(length(a.text), 1500)) OVER (PARTITION BY r.to_id ORDER BY r.from_id ROWS UNBOUNDED PRECEDING) AS used
            FROM relation r JOIN one ON one.id = r.to_id JOIN documents a ON a.doc_id = r.from_id WINDOW w AS (PARTITION BY r.to_id ORDER BY r.from_id)) q WHERE n <= 100 AND used <= 24000
        UNION ALL SELECT one.id, 'gap', 1, 'validity_unknown' FROM one LEFT JOIN current_validity v ON v.document_id = one.id WHERE v.document_id IS NULL""",
    "r26_quality_gaps": lambda d: f"""SELECT id, 'no_text' AS worklist FROM document WHERE length(trim(coalesce(text, ''))) = 0
        UNION ALL SELECT d.id, 'no_validity' FROM document d LEFT JOIN current_validity v ON v.document_id = d.id WHERE v.document_id IS NULL
        UNION ALL SELECT d.id, 'no_chunks' FROM document d LEFT JOIN (SELECT DISTINCT document_id FROM chunk) c ON c.document_id = d.id WHERE c.document_id IS NULL
        UNION ALL SELECT DISTINCT r.from_id, 'unresolved_relation' FROM relation r LEFT JOIN document d ON d.id = r.to_id WHERE d.id IS NULL
        UNION ALL SELECT id, 'incomplete' FROM fetch_doc WHERE state <> 'complete' AND in_scope
        UNION ALL SELECT id, 'damaged' FROM document WHERE {d.like('text', 'Ã[¡-ÿ]|�|â€')}""",
    "r31_binding_text": lambda d: f"""SELECT doc_key, doc_id, floor_met FROM (SELECT doc_key, doc_id, good >= 0.6 AS floor_met, row_number() OVER (PARTITION BY doc_key ORDER BY CASE WHEN good >= 0.6 THEN 0 ELSE 1 END, CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END, doc_id) AS rn
        FROM (SELECT doc_key, doc_id, source, CAST(length({d.replaced('text', '[^a-zA-Z]')}) AS DOUBLE) / greatest(1, length(text)) AS good FROM observation) o) x WHERE rn = 1""",
    "r32_extract_cascade": lambda d: "SELECT fetch_doc_id, ref_key, format FROM (SELECT fetch_doc_id, ref_key, format, row_number() OVER (PARTITION BY fetch_doc_id ORDER BY CASE format WHEN 'docx' THEN 0 WHEN 'html' THEN 1 WHEN 'doc' THEN 2 ELSE 3 END, ref_key) AS rn FROM (SELECT *, CASE ref_key % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' ELSE 'doc' END AS format FROM fetch_artifact WHERE state = 'done') a) x WHERE rn = 1",
    "r33_index_class": lambda d: "SELECT f.id, CASE WHEN NOT f.in_scope AND NOT coalesce(a.own, true) THEN 'relation_context' ELSE 'primary' END AS index_class FROM fetch_doc f LEFT JOIN (SELECT fetch_doc_id, bool_or(NOT is_optional) AS own FROM fetch_artifact GROUP BY fetch_doc_id) a ON a.fetch_doc_id = f.id",
    # writes
    "d2_reference_pointers": lambda d: "SELECT r.from_id, r.to_id, CASE WHEN d.id IS NOT NULL THEN d.id WHEN r.from_id % 2 = 0 THEN r.to_id END AS document_id FROM relation r LEFT JOIN document d ON d.id = r.to_id",
    "d3_rediscovered": lambda d: f"""SELECT coalesce(f.id, n.id) AS id, coalesce(f.in_scope, false) OR coalesce(n.in_scope, false) AS in_scope,
        CASE WHEN f.id IS NULL THEN 'discovered' WHEN n.id IS NULL OR n.hash = f.hash THEN f.state ELSE 'discovered' END AS state, n.id IS NOT NULL AND f.id IS NOT NULL AND n.hash <> f.hash AS reopened
        FROM (SELECT id, state, in_scope, {d.sha('source')} AS hash FROM fetch_doc WHERE state <> 'partial') f FULL JOIN (SELECT id, in_scope, {d.sha('source')} AS hash FROM ({_FOUND}) m) n ON n.id = f.id""",
    "d4_enqueued": lambda d: "SELECT a.fetch_doc_id, a.ref_key, CASE WHEN a.state IN ('done', 'dead') AND NOT (f.state = 'partial' AND f.in_scope) THEN a.state ELSE 'pending' END AS state FROM fetch_artifact a JOIN fetch_doc f ON f.id = a.fetch_doc_id",
    "d5_phase_fill": lambda d: "SELECT coalesce(a.id, b.document_id) AS id, coalesce(a.doc_type, b.authority) AS doc_type, coalesce(b.authority, a.issuer) AS authority FROM (SELECT * FROM document WHERE id NOT IN (SELECT document_id FROM document_text WHERE needs_review)) a FULL JOIN document_text b ON b.document_id = a.id",
    "d6_first_wins": lambda d: "SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT x.k, x.v FROM (SELECT c_custkey AS k, coalesce(min(o_orderpriority), 'none') AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) x WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = x.k AND c.c_mktsegment <> 'BUILDING')",
    "d8_replace_children": lambda d: "SELECT c.document_id, c.ordinal, 'kept' AS origin FROM chunk c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.document_id) UNION ALL SELECT t.document_id, CAST(0 AS BIGINT), 'replaced' FROM document_text t",
    # ledger
    "st2_reopened": lambda d: f"SELECT id, document_id, hash IS DISTINCT FROM before AS changed FROM (SELECT *, lag(hash) OVER (PARTITION BY document_id ORDER BY observed_at, id) AS before FROM (SELECT id, document_id, observed_at, {d.sha('status_class')} AS hash FROM validity) h) x",
    "st4_rechecks_due": lambda d: "SELECT fetch_doc_id, ref_key FROM fetch_artifact WHERE state IN ('error', 'pending') AND ref_key <= 5 AND updated_at + INTERVAL 24 HOUR <= TIMESTAMP '1998-01-01 00:00:00'",
    "st8_uncached": lambda d: f"SELECT hash, min(id) AS chunk_id, count(*) AS uses FROM (SELECT id, ordinal, {d.sha('content')} AS hash FROM chunk) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT {d.sha('content')} AS cached FROM chunk WHERE ordinal = 0) k WHERE k.cached = c.hash) GROUP BY hash",
    # text and codes
    "x29_supplement_only": lambda d: f"SELECT document_id, bool_and({d.like('lower(content)', '^(annex|appendix|supplement|schedule)')}) AS supplement FROM (SELECT document_id, content, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS rn FROM chunk) x WHERE rn <= 8 GROUP BY document_id",
    "x30_local_damage": lambda d: f"SELECT document_id, bool_or(n >= 12 AND marks >= 3 AND marks >= 0.08 * n) AS damaged FROM (SELECT document_id, length(content) AS n, length(content) - length({d.replaced('content', _MARKS)}) AS marks FROM chunk) x GROUP BY document_id",
    "x39_status_class": lambda d: "SELECT id, CASE WHEN c = '' THEN 'unknown' ELSE coalesce(m.status_class, 'in_force') END AS status_class FROM (SELECT o_orderkey AS id, upper(trim(CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(' ', lower(o_orderstatus)) END)) AS c FROM orders) o LEFT JOIN (SELECT 'F' AS code, 'expired' AS status_class UNION ALL SELECT 'P', 'partial') m ON m.code = o.c",
    "x41_reference_json": lambda d: f"SELECT event_id, {d.json('props', 'k')} AS k, {d.json('props', 'missing')} AS missing FROM events",
    "x42_canonical_match": lambda d: f"SELECT id, number = 'SRC33' OR (length(number) >= 4 AND 'SRC33' LIKE concat('%', number, '%')) AS matches FROM (SELECT id, upper({d.replaced('doc_number', '[^A-Za-z0-9]')}) AS number FROM document) x",
}

QUERIES = {name: query_of(body) for name, body in BODIES.items()}
ORACLES = {name: with_views(body(Duck()), Duck()) for name, body in BODIES.items()}
