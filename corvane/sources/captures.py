"""Captured payloads of the sites that publish documents, as one table of discovered documents.

A source of JSON is a row of FORMATS: where its items lie and which field is which. Sites without an API are listings
of links (readers.listing, here with what each page says about a link), sitemaps or feeds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.repair import decoded_thai

COLUMNS = ("source", "external_id", "number", "title", "doc_type", "issuer", "issued_at", "effective_at", "status", "url")
#: For each JSON source its jurisdiction, the path to its items, and its names of the fields.
FORMATS = {
    "vbpl": ("vn", "data.items", {"external_id": "id", "number": "docNum", "title": "title", "doc_type": "docType.name", "issuer": "agencyName", "issued_at": "issueDate", "effective_at": "effFrom", "status": "effStatus.code"}),
    "congbao": ("vn", "data", {"external_id": "id_van_ban", "number": "so_ky_hieu", "title": "trich_yeu", "doc_type": "loai_van_ban", "issued_at": "ngay_ban_hanh", "effective_at": "ngay_co_hieu_luc"}),
    "agclom": ("my", "records", {"external_id": "lgt_act_id", "number": "lgt_act_no", "title": "title", "url": "path"}),
    "bi": ("id", "Data", {"external_id": "PeraturanID", "number": "NomorPeraturan", "title": "Judul", "doc_type": "SingkatanJenisPeraturan", "issuer": "Teu", "issued_at": "TanggalPenetapan", "effective_at": "TanggalBerlaku", "status": "Status"}),
    "mas": ("sg", "response.docs", {"external_id": "itemid_s", "title": "document_title_string_s", "doc_type": "mas_contenttype_s", "issued_at": "mas_date_tdt", "url": "page_url_s"}),
    "pdpc": ("sg", "data", {"external_id": "id", "title": "title", "doc_type": "topic", "issued_at": "date", "url": "href"}),
    "ocs": ("th", "data", {"external_id": "lawCode", "title": "lawNameTh", "issued_at": "publishDate", "status": "state"}),
    "odc": ("kh", "result.results", {"external_id": "id", "number": "odm_document_number", "title": "title", "doc_type": "odm_document_type", "effective_at": "odm_effective_date", "status": "odm_laws_status"}),
}
#: Jurisdictions of the sources that are read from pages, sitemaps, feeds or rows without names.
OTHERS = {"vanban": "vn", "sbvhanoi": "vn", "bnm": "my", "sc": "my", "bpk": "id", "ojk": "id", "ojkweb": "id", "sso": "sg", "csa": "sg", "bot": "th", "sec": "th", "etda": "th", "nbc": "kh", "cdcgov": "kh", "serc": "kh"}
#: Patterns of dates, tried in order.
_DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy")


def date_of(text: Column) -> Column:
    """The date at the beginning of a text in any of the sources' forms; null if it is none."""
    day = F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{1,2} \p{L}+ \d{4})", 1)
    return F.coalesce(*(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit(p)) for p in _DATES)).cast("date")


def _ddl(fields: list[str]) -> str:
    """The type of an item with these fields, dotted ones nested, all strings."""
    nested: dict[str, list[str]] = {}
    for f in fields:
        head, _, rest = f.partition(".")
        nested.setdefault(head, []).append(rest)
    return "struct<" + ", ".join(f"`{k}`: " + (_ddl([r for r in v if r]) if any(v) else "string") for k, v in nested.items()) + ">"


def _table(items: DataFrame, source: str, found: dict[str, Column]) -> DataFrame:
    text = {c: F.nullif(F.trim(found[c]), F.lit("")) if c in found else F.lit(None).cast("string") for c in COLUMNS[1:]}
    for c in ("issued_at", "effective_at"):
        text[c] = date_of(text[c])
    return items.select(F.lit(source).alias("source"), *(text[c].alias(c) for c in COLUMNS[1:])).where("external_id is not null")


def json_items(payloads: DataFrame, source: str, column: str = "payload") -> DataFrame:
    """Discovered documents (COLUMNS) in payloads of a JSON source; what is no such JSON, and items without an id, give none."""
    _, path, fields = FORMATS[source]
    steps = path.split(".")
    kind = reduce(lambda t, s: f"struct<`{s}`: {t}>", reversed(steps), f"array<{_ddl(list(fields.values()))}>")
    parsed = payloads.select(F.explode(reduce(lambda c, s: c.getField(s), steps, F.from_json(column, kind))).alias("item"))
    return _table(parsed, source, {c: reduce(lambda x, s: x.getField(s), f.split("."), F.col("item")) for c, f in fields.items()})


def ojk_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Discovered documents of rows by place: a link, number, sector, ..., date (6), status (7)."""
    rows = payloads.select(F.explode(F.from_json(column, "struct<aaData: array<array<string>>>").getField("aaData")).alias("r"))
    link = F.regexp_extract(F.get("r", F.lit(0)), r'href="([^"]+)"', 1)
    title = F.regexp_replace(F.get("r", F.lit(0)), r"<[^>]*>", "")
    return _table(rows, "ojk", {"external_id": link, "url": link, "title": title, "number": F.get("r", F.lit(1)), "issued_at": F.get("r", F.lit(6)), "status": F.get("r", F.lit(7))})


def links(pages: DataFrame, source: str, wanted: str = r"\.(?:pdf|docx?)(?:$|\?)", column: str = "html") -> DataFrame:
    """Discovered documents of listing pages, each link once: links that match `wanted`, their text as title, and the first date that follows within 200 characters and before the next link."""
    # the look-ahead leaves what follows one link free for the next
    pattern = F.lit(r"""(?is)(<a\s[^>]*href=["'][^"']+["'][^>]*>.*?</a>)(?=(.{0,200}))""")
    entry = pages.select(F.explode(F.arrays_zip(F.regexp_extract_all(column, pattern, 1).alias("a"), F.regexp_extract_all(column, pattern, 2).alias("after"))).alias("e")).select("e.a", F.substring_index("e.after", "<a ", 1).alias("after"))
    title = F.trim(F.regexp_replace(F.regexp_replace("a", r"<[^>]*>", " "), r"\s+", " "))
    day = F.regexp_extract("after", r"(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{1,2} \p{L}+ \d{4})", 1)
    found = entry.select(F.regexp_extract("a", r"""(?i)href=["']([^"']+)["']""", 1).alias("link"), title.alias("title"), day.alias("day")).where(F.col("link").rlike("(?i)" + wanted))
    return _table(found, source, {"external_id": F.col("link"), "url": F.col("link"), "title": F.col("title"), "issued_at": F.col("day")}).groupBy("external_id").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")


def legacy_pages(files: DataFrame) -> DataFrame:
    """Pages of a source in the legacy Thai code page, from binary files (content), as html."""
    return files.select(decoded_thai("content").alias("html"))


def sitemap(spark: SparkSession, path: str, source: str = "csa") -> DataFrame:
    """Discovered documents of sitemaps."""
    urls = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return _table(urls, source, {"external_id": F.col("loc"), "url": F.col("loc"), "issued_at": F.col("lastmod")})


def jurisdiction(source: Column) -> Column:
    """The jurisdiction of a source; null for unknown ones."""
    pairs = {**{k: v[0] for k, v in FORMATS.items()}, **OTHERS}
    return F.element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), source)
