"""Corpus tables derived from the driver's tables, as common table expressions in either dialect."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(d) -> dict[str, str]:
    """Name to definition, in an order in which each uses earlier ones only."""
    return {
        "document": "SELECT doc_id AS id, concat(source, '/', doc_id) AS doc_number, source AS issuer, lang AS doc_type, substring(text, 1, 60) AS title, text, n_chars FROM documents",
        "validity": """SELECT event_id AS id, user_id AS document_id, ts AS observed_at, CAST(ts AS DATE) AS eff_from,
            CASE event_type WHEN 'view' THEN 'in_force' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'expired' WHEN 'signup' THEN 'not_yet' ELSE 'suspended' END AS status_class,
            CASE WHEN value < 5 THEN ts END AS superseded_at,
            CASE WHEN event_id % 3 = 0 THEN user_id + event_id % 7 END AS section_id FROM events""",
        "current_validity": "SELECT document_id, id, observed_at, eff_from, status_class FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY observed_at DESC, id DESC) AS rn FROM validity WHERE section_id IS NULL AND superseded_at IS NULL) v WHERE rn = 1",
        "relation": "SELECT DISTINCT l_orderkey AS from_id, l_partkey AS to_id, l_linestatus AS relation_type FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_orderkey <> l_partkey",
        "document_text": "SELECT d.doc_id AS document_id, d.source AS authority, l.quality = 1 AS is_binding, l.toxic = 1 AS needs_review, d.text AS markdown FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
        "chunk": f"SELECT doc_id AS document_id, doc_id * 100000 + pos AS id, CAST(pos AS BIGINT) AS ordinal, concat('Line ', pos + 1) AS citation, line AS content FROM {d.lines('documents', 'doc_id')} x WHERE length(trim(line)) > 0",
        "fetch_doc": "SELECT o_orderkey AS id, o_orderpriority AS source, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'fetching' ELSE 'partial' END AS state, o_totalprice > 200000 AS in_scope, o_orderdate AS discovered_at FROM orders",
        "fetch_artifact": "SELECT l_orderkey AS fetch_doc_id, l_linenumber AS ref_key, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'dead' WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'A' THEN 'error' ELSE 'pending' END AS state, l_tax > 0.06 AS is_optional, l_shipdate AS updated_at FROM lineitem",
        "observation": "SELECT doc_id, source, coalesce(lang, '') AS lang, text, CASE WHEN source IN ('src0', 'src1') THEN 10 WHEN source IN ('src2', 'src3') THEN 7 ELSE 5 END AS priority, concat(lang, '|', doc_id % 300) AS doc_key FROM documents",
    }


def with_views(body: str, d) -> str:
    """The body, headed by the views that it uses, directly or through others."""
    import re

    known = views(d)
    need: set[str] = set()

    def collect(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                collect(known[name])

    collect(body)
    heads = [f"{n} AS ({q})" for n, q in known.items() if n in need]
    body = body.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {body[5:]}"
    return f"WITH {', '.join(heads)} {body}"
