"""Upserts applied in order, many to a key at once: what a row-by-row loop would leave, as aggregates.

Each rule of a row-by-row upsert has a closed form over the rows of its key in their order, stored row first, so that rows
are combined before they are shuffled and a key with any number of arrivals is never gathered in one place. `seq` orders
arrivals and must be distinct within a key; the stored row of a key, one at most, comes before them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STORED, _SEQ = "_stored", "_seq"


def _rows(stored: DataFrame, incoming: DataFrame, seq: str) -> DataFrame:
    """Both, with the order in which they came: stored rows first."""
    first = F.struct(F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"))
    old = stored.withColumn(_STORED, F.lit(True)).withColumn(_SEQ, first)
    new = incoming.withColumn(_STORED, F.lit(False)).withColumn(_SEQ, F.struct(F.lit(1).alias("a"), F.col(seq).cast("bigint").alias("b")))
    names = [*stored.columns, _STORED, _SEQ]
    return old.select(*names).unionByName(new.select(*names))


def _last(value: Column, where: Column | None = None) -> Column:
    """The value of the last row (that fulfils a condition), as it is, null or not, in a field v."""
    boxed = F.struct(value.alias("v"))
    return F.max_by(boxed, F.when(where, F.col(_SEQ)) if where is not None else F.col(_SEQ))


def _first(value: Column, where: Column | None = None) -> Column:
    boxed = F.struct(value.alias("v"))
    return F.min_by(boxed, F.when(where, F.col(_SEQ)) if where is not None else F.col(_SEQ))


def documents(stored: DataFrame, incoming: DataFrame, columns: Sequence[str], key: str = "doc_key", seq: str = "seq", priority: str = "metadata_priority", text: str = "markdown", link: str = "source_document_id") -> DataFrame:
    """Documents (key, columns, text, link, priority) after all upserts.

    Columns are replaced by rows of no lower priority than any before, so they are those of the last row of the greatest
    one. A text that isn't null replaces what was there. The link goes to rows of a strictly greater priority, or an equal
    one with a text: it is that of the last row of the greatest priority with a text, or else of the first of that priority.
    Priorities may not be null; null keys meet each other.
    """
    has_text = F.col(text).isNotNull()
    by_priority = _rows(stored, incoming, seq).groupBy(key, priority).agg(
        _last(F.struct(*columns)).alias("fields"),
        F.coalesce(_last(F.col(link), has_text), _first(F.col(link))).alias("link"),
        F.max(F.when(has_text, F.struct(_SEQ, text))).alias("text"),
    )
    out = by_priority.groupBy(key).agg(F.max(priority).alias(priority), F.max_by("fields", priority).alias("fields"), F.max_by("link", priority).alias("link"), F.max("text").alias("text"))
    return out.select(key, *(F.col(f"fields.v.{c}").alias(c) for c in columns), F.col(f"text.{text}").alias(text), F.col("link.v").alias(link), priority)


def references(stored: DataFrame, incoming: DataFrame, key: str = "ref_key", seq: str = "seq") -> DataFrame:
    """References (key, document_id, label, source, target, src_ref) after all upserts; source and target are those of src_ref.

    A resolved reference never becomes a stub again: the first document_id stays. The last label that isn't null counts.
    Of src_refs with a target the first one's source and target stay, in their last version; without targets the first
    src_ref counts. An empty target is none, and an empty source is like a null one.
    """
    r = _rows(stored, incoming, seq).withColumn("_t", F.coalesce("target", F.lit(""))).withColumn("_s", F.coalesce("source", F.lit("")))
    present = F.col("src_ref").isNotNull()
    groups = r.groupBy(key, "_s", "_t").agg(
        F.min(_SEQ).alias("begins"),
        F.min(F.when(present, F.col(_SEQ))).alias("first_at"),
        _first(F.struct("source", "target", "src_ref"), present).alias("first"),
        _last(F.struct("source", "target", "src_ref")).alias("last"),
        F.min(F.when(F.col("document_id").isNotNull(), F.struct(_SEQ, "document_id"))).alias("document"),
        F.max(F.when(F.col("label").isNotNull(), F.struct(_SEQ, "label"))).alias("label"),
    )
    aimed = F.col("_t") != ""
    out = groups.groupBy(key).agg(F.min("document").alias("document"), F.max("label").alias("label"), F.min_by("last", F.when(aimed, F.col("begins"))).alias("aimed"), F.min_by("first", F.when(~aimed, F.col("first_at"))).alias("plain"))
    ref = F.coalesce("aimed", "plain")
    return out.select(key, F.col("document.document_id").alias("document_id"), F.col("label.label").alias("label"), *(ref["v"][c].alias(c) for c in ("source", "target", "src_ref")))


def discoveries(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str = "seq", kept: Sequence[str] = (), reset: dict[str, Column] | None = None) -> DataFrame:
    """Ledger rows (keys, in_scope, provenance, content_hash, detail_url, kept columns, reset columns, reopened) after all rediscoveries.

    in_scope stays once set. A provenance other than '' and 'relation' stays once it is there; among those two the last
    counts. A content hash that differs from the one before reopens the row: columns of `reset` get their values then, and
    else stay as they were stored, as `kept` ones always do; a new key has the values of `reset`. Null hashes and URLs
    change nothing.
    """
    reset = reset or {}
    r = _rows(stored, incoming, seq)
    lasting = ~F.coalesce("provenance", F.lit("")).isin("", "relation")
    out = r.groupBy(*keys).agg(
        F.max(F.coalesce("in_scope", F.lit(False))).alias("in_scope"),
        F.coalesce(_first(F.col("provenance"), lasting), _last(F.coalesce("provenance", F.lit("")))).alias("provenance"),
        F.max(F.when(F.col("content_hash").isNotNull(), F.struct(_SEQ, "content_hash"))).alias("hash"),
        F.max(F.when(F.col("detail_url").isNotNull(), F.struct(_SEQ, "detail_url"))).alias("url"),
        F.min("content_hash").alias("least"),
        F.max("content_hash").alias("greatest"),
        _first(F.col("content_hash")).alias("begin"),
        _first(F.struct(_STORED, *kept, *reset)).alias("old"),
    )
    # hashes differ, or the first row had none and a later one has
    reopened = (F.col("least") != F.col("greatest")) | (F.col("begin.v").isNull() & F.col("greatest").isNotNull())
    out = out.withColumn("reopened", F.coalesce(reopened, F.lit(False)))
    fresh = F.col("reopened") | ~F.col(f"old.v.{_STORED}")
    return out.select(*keys, "in_scope", F.col("provenance.v").alias("provenance"), F.col("hash.content_hash").alias("content_hash"), F.col("url.detail_url").alias("detail_url"), *(F.col(f"old.v.{c}").alias(c) for c in kept), *(F.when(fresh, v).otherwise(F.col(f"old.v.{c}")).alias(c) for c, v in reset.items()), "reopened")
