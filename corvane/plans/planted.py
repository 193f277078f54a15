"""Text operators on documents into which the cases they look for are planted, with oracles written apart from them.

Every document keeps its row. What is planted depends on doc_id, so that each rule is met on thousands of texts; the
oracles either compute the rule anew in DuckDB, or know what was planted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import citations, quality, repair
from corvane.functions import text as T
from corvane.operators import chunker, mining, provisions, workflow
from corvane.plans.relational import register

_LAW = "Điều 1. Ngân hàng Nhà nước Việt Nam quy định các điều kiện sau đây. "
_GARBLED = "NG√ÇN H√ÄNG NH√Ä N∆Ø·ªöC VI·ªÜT NAM "
_CYRILLIC = "Дҗiб»Ғu 1. Hб»“ sЖЎ Д‘б»Ғ nghб»Ӣ "
#: Texts by the kind of damage; {text} is the document's own.
_KINDS = (
    f"concat(repeat('{_LAW}', 6), {{text}})",
    f"concat(repeat('{_GARBLED}', 12), {{text}})",
    f"concat(repeat('{_CYRILLIC}', 12), substring({{text}}, 1, 40))",
    f"concat(repeat('{chr(0xE001)}{chr(0xE0FF)}', 10), substring({{text}}, 1, 300))",
    "'  Đang cập nhật  file đính kèm '",
    "concat(repeat('a ', 60), repeat(' ', 600))",
    f"concat({{text}}, repeat('lost {chr(0xFFFD)} ', 40))",
    "''",
    f"concat(repeat('{_LAW}', 3), '{_LAW}', substring({{text}}, 1, 100), ' văn bản (văn bản)')",
    "{text}",
    "concat('ĐANG CẬP NHẬT ', substring({text}, 1, 500))",
)
_TEXT = "coalesce(text, '')"
DAMAGED = "SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % {len(_KINDS)} = {k} THEN {x.format(text=_TEXT)}" for k, x in enumerate(_KINDS)) + " END AS text FROM documents"
REFERRING = f"SELECT doc_id, concat({_TEXT}, ' See 12/2020/AB-', doc_id % 50, ' and ACT ', doc_id % 90 + 1, ', again act ', doc_id % 90 + 1, '; 7/19/XY') AS text FROM documents"
#: A line of letters of the document, so that it holds no heading of its own.
_LINE = "concat('w', lower(substring(regexp_replace({text}, '[^A-Za-z]+', 'x'{every}), 1, 40)))"
_PROVISIONS = "concat('Article 1. Scope', chr(10), {line}, chr(10), '1. first', chr(10), {line}, chr(10), '2. second', chr(10), 'Article 2. Rules', chr(10), 'says “never closed', chr(10), 'Article 3. ', {line}) AS text"
_LEGACY, _THAI = "abcdefgh", "กขฃคฅฆงจ"


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(query)


def f12_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DAMAGED).select("doc_id", quality.cyrillic_mojibake(F.col("text")).alias("damaged"))


def f13_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DAMAGED).select("doc_id", T.repeats_a_word(F.col("text")).alias("repeats"))


def x27_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sql(spark, sf_dir, DAMAGED).select("doc_id", quality.assess(F.col("text")).alias("a"))
    return found.select("doc_id", F.round("a.confidence", 6).alias("confidence"), "a.ok", "a.reason")


def x28_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DAMAGED).select("doc_id", quality.official_placeholder(F.col("text")).alias("placeholder"), quality.source_unavailable(F.col("text")).alias("unavailable"))


def x14_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sql(spark, sf_dir, REFERRING).select("doc_id", F.filter(T.references(F.col("text")), lambda x: x.rlike("ab-|act")).alias("refs"))
    return found.select("doc_id", F.array_join("refs", ",").alias("refs"))


def s18_legacy_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters a to h stand for the first Thai letters of the legacy code page, which are its bytes from 0xA1 on."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    legacy = F.encode(F.translate(plain, _LEGACY, "".join(chr(0xA1 + k) for k in range(8))), "ISO-8859-1")
    return _sql(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", repair.decoded_thai(legacy).alias("text"))


def p1_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and clauses planted in every document; a quotation that nobody closes hides none of them."""
    line = _LINE.format(text=_TEXT, every="")
    rows = provisions.provisions(_sql(spark, sf_dir, f"SELECT doc_id, {_PROVISIONS.format(line=line)} FROM documents"), "common")
    return rows.select("doc_id", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "kind", "label", "content", "path")


#: Articles that fit, that are cut by clauses and by words, that repeat, and that are too short.
_CHUNKED = """concat('Chapter I. General', chr(10), 'Article 1. Scope', chr(10), {line}, chr(10), 'Article 2. Rules for banks', chr(10), 'Banks shall', chr(10), '1. ', repeat('alpha ', 120), {line}, chr(10), '2. ', repeat('beta ', 140), 'end', chr(10),
  'Chapter II. Special', chr(10), 'Article 1. Scope', chr(10), {line}, chr(10), 'Article 1. Other scope than before', chr(10), 'Article 3. No', chr(10), 'Article 4. Long', chr(10), '1. ', repeat('gamma ', 250), 'end') AS text"""


def p10_provision_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of articles planted in every document: whole, by clauses under their article's lead, by words; repeated and short ones."""
    docs = _sql(spark, sf_dir, f"SELECT doc_id, concat('N', doc_id % 9) AS doc_number, lang AS title, {_CHUNKED.format(line=_LINE.format(text=_TEXT, every=''))} FROM documents")
    return chunker.text_chunks(docs).drop("node")


#: A regulation as scans show it: letterheads, confused digits, merged headings, an article of another law in an amendment.
_SCANNED = """concat('DENGAN RAHMAT TUHAN', chr(10), 'BAB I', chr(10), 'KETENTUAN UMUM', chr(10), 'Pasal I', chr(10), {line}, chr(10), 'FRESIDEN', chr(10), 'REPUELIK INDONESIA', chr(10), '- ', doc_id % 90, ' -', chr(10),
  'Pasal2 (1) ', {line}, chr(10), '(2) terdiri atas:', chr(10), 'a. alfa', chr(10), 'b. ', {line}, chr(10), 'BABII', chr(10), 'PENUTUP', chr(10), 'Pasa1 3', chr(10), 'Ketentuan Pasal 4 diubah sehingga berbunyi sebagai berikut:', chr(10), 'Pasal 4', chr(10), {line}, chr(10),
  'Pasal 4. . .', chr(10), 'mulai berlaku', chr(10), 'PENJELASAN ATAS', chr(10), 'Pasal 1', chr(10), 'Cukup jelas', chr(10), 'LAMPIRAN I', chr(10), {line}) AS text"""


def p3_indonesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions of a scanned regulation planted in every document."""
    rows = provisions.provisions(_sql(spark, sf_dir, f"SELECT doc_id, {_SCANNED.format(line=_LINE.format(text=_TEXT, every=''))} FROM documents"), "id-scan")
    return rows.select("doc_id", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "kind", "label", "content", "path")


#: A statute in the layout of each jurisdiction, by a document's language: grammar, lines, and the nodes it has (parent, kind, label, content, path).
_STATUTES = {
    "en": ("sg", ("PART I PRELIMINARY", "1. Short title", "{line}", "(1) first", "(a) alpha", "(2) second", "FIRST SCHEDULE Forms", "{line}"),
           ((None, "part", "I", "'PRELIMINARY'", "part-I"), (0, "section", "1", "concat('Short title', chr(10), line)", "part-I/section-1"), (1, "subsection", "1", "'first'", "part-I/section-1/subsection-1"), (2, "paragraph", "a", "'alpha'", "part-I/section-1/subsection-1/paragraph-a"), (1, "subsection", "2", "'second'", "part-I/section-1/subsection-2"), (None, "schedule", "FIRST", "concat('Forms', chr(10), line)", "schedule-FIRST"))),
    "de": ("my", ("PART II", "CHAPTER 1 General", "14A. {line}", "(1) first", "(a) alpha"),
           ((None, "part", "II", "''", "part-II"), (0, "chapter", "1", "'General'", "part-II/chapter-1"), (1, "section", "14A", "line", "part-II/chapter-1/section-14A"), (2, "subsection", "1", "'first'", "part-II/chapter-1/section-14A/subsection-1"), (3, "paragraph", "a", "'alpha'", "part-II/chapter-1/section-14A/subsection-1/paragraph-a"))),
    "fr": ("th", ("หมวด ๑ บททั่วไป", "มาตรา ๑๒ {line}", "(๑) one", "มาตรา ๑๒/๑ two"),
           ((None, "chapter", "1", "'บททั่วไป'", "chapter-1"), (0, "section", "12", "line", "chapter-1/section-12"), (1, "paragraph", "1", "'one'", "chapter-1/section-12/paragraph-1"), (0, "section", "12/1", "'two'", "chapter-1/section-12/1"))),
    "es": ("kh", ("ជំពូក ១ General", "មាត្រា ៥ {line}", "១. one", "a. alpha"),
           ((None, "chapter", "1", "'General'", "chapter-1"), (0, "article", "5", "line", "chapter-1/article-5"), (1, "clause", "1", "'one'", "chapter-1/article-5/clause-1"), (2, "point", "a", "'alpha'", "chapter-1/article-5/clause-1/point-a"))),
    "": ("vn", ("Chương II QUY ĐỊNH", "Mục 1 Chung", "Điều 21b. {line}", "1. một", "đ) điểm", "Điều 21b. lại", "PHỤ LỤC I Mẫu", "{line}"),
         ((None, "chapter", "II", "'QUY ĐỊNH'", "chapter-II"), (0, "section", "1", "'Chung'", "chapter-II/section-1"), (1, "article", "21b", "line", "chapter-II/section-1/article-21b"), (2, "clause", "1", "'một'", "chapter-II/section-1/article-21b/clause-1"), (3, "point", "đ", "'điểm'", "chapter-II/section-1/article-21b/clause-1/point-đ"), (1, "article", "21b", "'lại'", "chapter-II/section-1/article-21b~2"), (None, "appendix", "I", "concat('Mẫu', chr(10), line)", "appendix-I"))),
}


def _statute(lines: tuple[str, ...], line: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"replace('{x}', '{{line}}', {line})" for x in lines) + ")"


def p8_jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statute planted in every document, laid out and parsed by the jurisdiction that its language stands for; a sixth has none."""
    # a column of its own: within CASE it would be found anew for each line of a statute
    line, lined = "line", f"(SELECT *, {_LINE.format(text=_TEXT, every='')} AS line FROM documents)"
    by = " ".join(f"WHEN coalesce(lang, '') = '{lang}' THEN {{}}" for lang in _STATUTES if lang)
    text = f"CASE WHEN doc_id % 6 = 5 THEN {_statute(_STATUTES[''][1], line)} " + by.format(*(_statute(x, line) for lang, (_, x, _) in _STATUTES.items() if lang)) + f" ELSE {_statute(_STATUTES[''][1], line)} END"
    grammar = "CASE WHEN doc_id % 6 = 5 THEN 'vn' " + by.format(*(f"'{g}'" for lang, (g, _, _) in _STATUTES.items() if lang)) + " ELSE 'vn' END"
    rows = provisions.provisions(_sql(spark, sf_dir, f"SELECT doc_id, {text} AS text, {grammar} AS grammar FROM {lined}"), F.col("grammar"))
    return rows.select("doc_id", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "kind", "label", "content", "path")


#: An amendment: emphasis, a reference that a line begins with, quoted provisions, an appendix with an article; or, for every third document, an older outline.
_AMENDING = """CASE WHEN doc_id % 3 = 0 THEN concat('I. CHUNG', chr(10), '1. ', {line}, chr(10), '1.1. nhỏ', chr(10), 'a) điểm', chr(10), 'II - SAU', chr(10), {line}) ELSE concat('Căn cứ', chr(10), '**Điều 1.** Sửa đổi', chr(10), '1. Sửa như sau:', chr(10), '“Điều 9. Cũ', chr(10), '1. ', {line}, '”', chr(10), '2. Bỏ', chr(10), 'Điều 7 của Luật này', chr(10), '## Điều 2. Hiệu lực', chr(10), {line}, chr(10), 'PHỤ LỤC II MẪU', chr(10), 'Điều 1. Trong mẫu') END AS text"""
_AMENDING_NODES = (
    ("<>", (None, "article", "1", "'Sửa đổi'", "article-1"), (0, "clause", "1", "concat('Sửa như sau:', chr(10), '“Điều 9. Cũ', chr(10), '1. ', line, '”')", "article-1/clause-1"), (0, "clause", "2", "concat('Bỏ', chr(10), 'Điều 7 của Luật này')", "article-1/clause-2"), (None, "article", "2", "concat('Hiệu lực', chr(10), line)", "article-2"), (None, "appendix", "II", "'MẪU'", "appendix-II"), (4, "article", "1", "'Trong mẫu'", "appendix-II/article-1")),
    ("=", (None, "chapter", "I", "'CHUNG'", "chapter-I"), (0, "clause", "1", "line", "chapter-I/clause-1"), (1, "clause", "1.1", "'nhỏ'", "chapter-I/clause-1/clause-1.1"), (2, "point", "a", "'điểm'", "chapter-I/clause-1/clause-1.1/point-a"), (None, "chapter", "II", "concat('SAU', chr(10), line)", "chapter-II")),
)


def p1_vietnamese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions of an amendment or an outline planted in every document."""
    rows = provisions.provisions(_sql(spark, sf_dir, f"SELECT doc_id, {_AMENDING.format(line=_LINE.format(text=_TEXT, every=''))} FROM documents"), "vn-text")
    return rows.select("doc_id", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "kind", "label", "content", "path")


#: Documents that are annexes only, that name an annex further on, and texts with a garbled line.
_ANNEXED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('Annex ', doc_id % 7, chr(10), 'Appendix II') WHEN 1 THEN concat('Article 1', chr(10), 'ANNEX') WHEN 2 THEN concat('SCHEDULE of fees ', doc_id % 3) ELSE 'no annexes' END AS text FROM documents"
_GARBLED_LINES = "SELECT doc_id, concat('a clean line of text', chr(10), CASE doc_id % 3 WHEN 0 THEN 'NgÃ¢n hÃ ng NhÃ  nÆ°á»c' WHEN 1 THEN 'one Ã only in a line' ELSE 'short ÃÃÃ' END) AS text FROM documents"


def x29_annexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's first lines are all headings of annexes."""
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0), 1, 8)
    return _sql(spark, sf_dir, _ANNEXED).select("doc_id", F.forall(lines, lambda x: F.lower(x).rlike("^(annex|appendix|supplement|schedule)")).alias("supplement"))


def x30_garbled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one line of a text is garbled, though the text as a whole is not."""
    return _sql(spark, sf_dir, _GARBLED_LINES).select("doc_id", citations.locally_damaged(F.col("text")).alias("damaged"))


#: A case for each conversation, and a transcript whose calls and citations come from its turns.
_CASES = "SELECT DISTINCT conv_id AS id, concat('D', conv_id % 7) AS one, CASE WHEN conv_id % 3 = 0 THEN '' ELSE concat('A', conv_id % 4) END AS article, concat('D', (conv_id + 1) % 7) AS two, conv_id % 2 = 0 AS must, conv_id % 5 = 0 AS abstain FROM conversations"
_TURNS = "SELECT conv_id, concat(' d', turn % 7, ' ') AS doc, concat('a', length(text) % 4) AS article, CASE role WHEN 'user' THEN 'search' WHEN 'assistant' THEN 'document' ELSE role END AS tool FROM conversations"


def _workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _sql(spark, sf_dir, _CASES).select("id", F.array(F.struct(F.col("one").alias("doc_number"), "article"), F.struct(F.col("two").alias("doc_number"), F.lit("").alias("article"))).alias("final_citations"), F.col("must").alias("must_check_relations"), F.col("abstain").alias("expect_abstain"))
    t = _sql(spark, sf_dir, _TURNS).groupBy(F.col("conv_id").alias("case_id")).agg(F.collect_list(F.struct(F.col("doc").alias("doc_number"), "article")).alias("cited"), (F.count("*") < 5).alias("abstained"), F.collect_list("tool").alias("tools"))
    return workflow.scored(c, t)


_TERMS = ["License", "token", "idiot"]
_HEADS = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(source, '/', doc_id) END AS number, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS title, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE concat(' Chapter ', doc_id, ' ') END AS chapter, lang AS section, CASE WHEN doc_id % 2 = 0 THEN DATE '2020-02-03' END AS effective FROM documents"


def j10_term_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT doc_id AS id, text FROM documents").select("id", F.explode(T.terms_in(F.col("text"), _TERMS)).alias("term"))


def x19_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _sql(spark, sf_dir, _HEADS).select("doc_id", citations.prefix(c("number"), c("title"), c("chapter"), c("section"), F.lit("Effective"), c("effective")).alias("prefix"))


def r29_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _workflow(spark, sf_dir)
    return s.select("case_id", "citation_score", "abstain_correct", "followed_relations", *(F.col(x).cast("long").alias(x) for x in ("tool_calls", "searches", "documents")))


def r29_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = workflow.summary(_workflow(spark, sf_dir))
    return s.select("cases", *(F.round(x, 6).alias(x) for x in ("citation_score", "abstention", "relations", "tool_calls")))


_EVIDENCE = "SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'official_tree' WHEN 1 THEN 'official_text' WHEN 2 THEN 'official_metadata' WHEN 3 THEN 'non_binding_transcription' WHEN 4 THEN 'unknown' END AS authority, event_type IN ('view', 'click') AS title_level, CASE WHEN value > 40 THEN 'sửa đổi' WHEN value > 20 THEN '  ' END AS word FROM events"


def x34_weak_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _sql(spark, sf_dir, _EVIDENCE)
    return e.select("event_id", mining.weak_confidence(F.col("authority"), F.col("title_level"), F.col("word")).alias("confidence"))


QUERIES = {f.__name__: f for f in (f12_mojibake, f13_repeated_words, x27_quality_gate, x28_placeholders, x14_references, s18_legacy_encoding, p1_provisions, p10_provision_chunks, p3_indonesian, p8_jurisdictions, p1_vietnamese, x29_annexes, x30_garbled_lines, r29_workflow, r29_summary, x34_weak_evidence, j10_term_scope, x19_prefix)}

_COUNTS = f"""t AS (SELECT doc_id, regexp_replace(text, '\\p{{L}}\\p{{Mn}}+', 'é', 'g') AS text FROM ({DAMAGED})),
c AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS n, len(list_filter(s, lambda x: regexp_full_match(x, '\\p{{L}}'))) AS letters,
  len(list_filter(s, lambda x: unicode(x) > 127 AND regexp_full_match(x, '\\p{{L}}'))) AS accented,
  len(list_filter(s, lambda x: unicode(x) = 65533 OR (unicode(x) < 32 AND unicode(x) NOT IN (9, 10, 12, 13)) OR unicode(x) BETWEEN 127 AND 159)) AS bad,
  len(list_filter(s, lambda x: unicode(x) BETWEEN 9 AND 13 OR unicode(x) = 133 OR regexp_full_match(x, '\\p{{Z}}'))) AS blank,
  len(list_filter(s, lambda x: unicode(x) BETWEEN 57344 AND 63743)) AS private,
  len(list_filter(s, lambda x: strpos('√∆·ªƒ∫≠‚ÄØ', x) > 0)) AS marks,
  len(list_filter(s, lambda x: unicode(x) BETWEEN 1024 AND 1279)) AS cyrillic
  FROM (SELECT doc_id, text, list_filter(string_split(text, ''), lambda x: x <> '') AS s FROM t)),
g AS (SELECT *, marks >= 8 AND marks / n > 0.005 AS garbled, cyrillic >= 8 AND cyrillic / n >= 0.005 AS slavic, letters >= 200 AND accented / letters < 0.02 AS plain FROM c),
s AS (SELECT *, greatest(0.0, least(1.0, 1.0 - CASE WHEN bad / n > 0.01 THEN 5.0 * bad / n ELSE 0.0 END - 0.3 * CAST(letters < 50 AS INTEGER) - 0.3 * CAST(blank / n > 0.4 AS INTEGER)
  - 0.5 * CAST(private / n > 0.005 AS INTEGER) - 0.7 * CAST(garbled AS INTEGER) - 0.7 * CAST(slavic AS INTEGER) - 0.5 * CAST(plain AS INTEGER))) AS confidence FROM g WHERE n > 0),
o AS (SELECT *, confidence >= 0.6 AND NOT (bad / n >= 0.01 OR private / n > 0.005 OR garbled OR slavic OR letters < 50) AS ok,
  concat_ws('; ', CASE WHEN bad / n > 0.01 THEN 'bad chars' END, CASE WHEN letters < 50 THEN 'too few letters' END, CASE WHEN blank / n > 0.4 THEN 'high whitespace' END, CASE WHEN private / n > 0.005 THEN 'PUA runes (TCVN3/VNI mojibake)' END,
  CASE WHEN garbled THEN 'UTF-8 mojibake markers' END, CASE WHEN slavic THEN 'Cyrillic mojibake (CP1251 double-encode)' END, CASE WHEN plain THEN 'low diacritic density' END) AS why FROM s)"""
_WORDS = f"SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}]+|[\\s(]+|[^\\p{{L}}\\s(]+') AS w FROM ({DAMAGED})"
_EACH = _LINE.format(text=_TEXT, every=", 'g'")
_NODES = (
    (0, "NULL", "article", "1", f"concat('Scope', chr(10), {_EACH})", "article-1"),
    (1, "0", "clause", "1", f"concat('first', chr(10), {_EACH})", "article-1/clause-1"),
    (2, "0", "clause", "2", "'second'", "article-1/clause-2"),
    (3, "NULL", "article", "2", "concat('Rules', chr(10), 'says “never closed')", "article-2"),
    (4, "NULL", "article", "3", _EACH, "article-3"),
)
_SCORED = f"""c AS ({_CASES}), t AS ({_TURNS}),
e AS (SELECT id, one AS doc, article FROM c UNION ALL SELECT id, two, '' FROM c),
h AS (SELECT e.id, e.doc, e.article, coalesce(bool_or(lower(trim(t.doc)) = lower(e.doc) AND (e.article = '' OR lower(t.article) = lower(e.article))), false) AS hit FROM e JOIN t ON t.conv_id = e.id GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS calls, count(*) FILTER (WHERE tool = 'search') AS searches, count(*) FILTER (WHERE tool = 'document') AS documents FROM t GROUP BY conv_id),
s AS (SELECT c.id AS case_id, (SELECT sum(CAST(hit AS INTEGER)) / 2.0 FROM h WHERE h.id = c.id) AS citation_score, (calls < 5) = abstain AS abstain_correct, NOT must OR documents > 0 AS followed_relations, calls AS tool_calls, searches, documents, must FROM c JOIN n ON n.conv_id = c.id)"""
_CUT = "CASE WHEN length({x}) > 220 THEN concat(trim(substring({x}, 1, 217)), '...') ELSE {x} END"
_GAMMA = ("concat('1. ', trim(repeat('gamma ', 170)))", "concat(repeat('gamma ', 80), 'end')")
_PARTS = (
    ("Chapter I, Article 1", "Chapter I General", "concat('Article 1. Scope', chr(10), line)"),
    ("Article 2, Clause 1", "Chapter I General", "concat('Article 2. Rules for banks', chr(10), 'Banks shall', chr(10), '1. ', repeat('alpha ', 120), line)"),
    ("Article 2, Clause 2", "Chapter I General", "concat('Article 2. Rules for banks', chr(10), 'Banks shall', chr(10), '2. ', repeat('beta ', 140), 'end')"),
    ("Article 1 [2]", "Chapter II Special", "'Article 1. Other scope than before'"),
    ("Article 4, Clause 1, Paragraph 2", "Chapter II Special", _GAMMA[0]),
    ("Article 4, Clause 1, Paragraph 3", "Chapter II Special", _GAMMA[1]),
)
_SCAN_NODES = (
    (0, None, "chapter", "I", "'KETENTUAN UMUM'", "chapter-i"),
    (1, 0, "article", "1", "line", "chapter-i/article-1"),
    (2, 0, "article", "2", "''", "chapter-i/article-2"),
    (3, 2, "clause", "1", "line", "chapter-i/article-2/clause-1"),
    (4, 2, "clause", "2", "'terdiri atas:'", "chapter-i/article-2/clause-2"),
    (5, 4, "point", "a", "'alfa'", "chapter-i/article-2/clause-2/point-a"),
    (6, 4, "point", "b", "line", "chapter-i/article-2/clause-2/point-b"),
    (7, None, "chapter", "II", "'PENUTUP'", "chapter-ii"),
    (8, 7, "article", "3", "concat('Ketentuan Pasal 4 diubah sehingga berbunyi sebagai berikut:', chr(10), 'Pasal 4', chr(10), line)", "chapter-ii/article-3"),
    (9, 7, "article", "4", "'mulai berlaku'", "chapter-ii/article-4"),
    (10, None, "notes", "", "concat('Pasal 1', chr(10), 'Cukup jelas')", "notes"),
    (11, None, "appendix", "I", "line", "appendix-i"),
)
ORACLES = {
    "j10_term_scope": f"SELECT doc_id AS id, term FROM documents, (SELECT unnest({_TERMS}) AS term) WHERE contains(lower(text), lower(term))",
    "x19_prefix": f"SELECT doc_id, concat_ws(chr(10), nullif(concat_ws(': ', nullif(number, ''), nullif({_CUT.format(x='t')}, '')), ''), nullif(trim(chapter), ''), nullif(section, ''), CASE WHEN effective IS NOT NULL THEN 'Effective: 03/02/2020' END) AS prefix FROM (SELECT *, trim(coalesce(title, ''), ' ') AS t FROM ({_HEADS}))",
    "x34_weak_evidence": f"SELECT event_id, CAST(CASE WHEN a LIKE 'official%' THEN CASE WHEN title_level THEN 0.5 ELSE 0.45 END + CASE WHEN NOT op THEN 0.0 WHEN title_level THEN 0.15 ELSE 0.1 END WHEN a LIKE 'non%' THEN CASE WHEN title_level THEN 0.35 ELSE 0.25 END + CASE WHEN op THEN 0.1 ELSE 0.0 END WHEN title_level THEN 0.3 ELSE 0.2 END AS DECIMAL(3, 2))::DOUBLE AS confidence FROM (SELECT *, coalesce(authority, '') AS a, trim(coalesce(word, '')) <> '' AS op FROM ({_EVIDENCE}))",
    "r29_workflow": f"WITH {_SCORED} SELECT case_id, citation_score, abstain_correct, followed_relations, tool_calls, searches, documents FROM s",
    "r29_summary": f"WITH {_SCORED} SELECT count(*) AS cases, round(avg(citation_score), 6) AS citation_score, round(avg(CAST(abstain_correct AS DOUBLE)), 6) AS abstention, round(avg(CAST(followed_relations AS DOUBLE)) FILTER (WHERE must), 6) AS relations, round(avg(tool_calls), 6) AS tool_calls FROM s",
    "f12_mojibake": f"SELECT doc_id, n >= 8 AND n >= 0.005 * length(text) AS damaged FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\\p{{Cyrillic}}')) AS n FROM ({DAMAGED}))",
    "f13_repeated_words": f"SELECT doc_id, len(list_filter(range(1, len(w) - 1), lambda i: length(w[i]) >= 2 AND regexp_full_match(w[i], '\\p{{L}}+') AND regexp_full_match(w[i + 1], '[\\s(]+') AND w[i + 2] = w[i] AND NOT regexp_matches(coalesce(w[i - 1], ''), '[\\p{{N}}_]$') AND NOT regexp_matches(coalesce(w[i + 3], ''), '^[\\p{{N}}_]'))) > 0 AS repeats FROM ({_WORDS})",
    "x27_quality_gate": f"WITH {_COUNTS} SELECT doc_id, round(confidence, 6) AS confidence, ok, CASE WHEN ok THEN '' WHEN why = '' THEN 'below confidence threshold' ELSE why END AS reason FROM o UNION ALL SELECT doc_id, 0.0, false, 'empty text' FROM c WHERE n = 0",
    "x28_placeholders": f"SELECT doc_id, p AS placeholder, p OR t = '' AS unavailable FROM (SELECT doc_id, t, l <= 200 AND contains(t, 'dang cap nhat') AND (contains(t, 'file') OR contains(t, 'dinh kem') OR l < 80) AS p FROM (SELECT doc_id, t, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS l FROM (SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\\s+', ' ', 'g')) AS t FROM ({DAMAGED}))))",
    "x14_references": "SELECT doc_id, concat('12/2020/ab-', doc_id % 50, ',act ', doc_id % 90 + 1) AS refs FROM documents",
    "s18_legacy_encoding": f"SELECT doc_id, translate(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '{_LEGACY}', '{_THAI}') AS text FROM documents",
    "p1_provisions": " UNION ALL ".join(f"SELECT doc_id, CAST({n} AS BIGINT) AS node, CAST({p} AS BIGINT) AS parent, '{k}' AS kind, '{l}' AS label, {c} AS content, '{x}' AS path FROM documents" for n, p, k, l, c, x in _NODES),
    "p10_provision_chunks": "WITH p AS (SELECT doc_id, " + _LINE.format(text=_TEXT, every=", 'g'") + " AS line, concat('N', doc_id % 9) || CASE WHEN coalesce(lang, '') <> '' THEN ': ' || lang ELSE '' END AS head FROM documents), c AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {n} AS n, '{c}' AS citation, concat(head, chr(10), '{h}') AS prefix, {x} AS content FROM p" for n, (c, h, x) in enumerate(_PARTS))
    + "), kept AS (SELECT * FROM c WHERE length(content) >= 21) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS ordinal, citation, prefix, content, CAST((length(prefix) + 1 + length(content)) // 2 AS BIGINT) AS tokens FROM kept",
    "p3_indonesian": "WITH p AS (SELECT doc_id, " + _LINE.format(text=_TEXT, every=", 'g'") + " AS line FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, CAST({n} AS BIGINT) AS node, CAST({'NULL' if p is None else p} AS BIGINT) AS parent, '{k}' AS kind, '{label}' AS label, {c} AS content, '{x}' AS path FROM p" for n, p, k, label, c, x in _SCAN_NODES),
    "x29_annexes": "SELECT doc_id, doc_id % 4 IN (0, 2) AS supplement FROM documents",
    "x30_garbled_lines": "SELECT doc_id, doc_id % 3 = 0 AS damaged FROM documents",
    "p8_jurisdictions": "WITH p AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 OR coalesce(lang, '') NOT IN ('en', 'de', 'fr', 'es') THEN '' ELSE lang END AS j, " + _LINE.format(text=_TEXT, every=", 'g'") + " AS line FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, CAST({n} AS BIGINT) AS node, CAST({'NULL' if above is None else above} AS BIGINT) AS parent, '{kind}' AS kind, '{label}' AS label, {content} AS content, '{path}' AS path FROM p WHERE j = '{j}'" for j, (_, _, nodes) in _STATUTES.items() for n, (above, kind, label, content, path) in enumerate(nodes)),
    "p1_vietnamese": "WITH p AS (SELECT doc_id, " + _LINE.format(text=_TEXT, every=", 'g'") + " AS line FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, CAST({n} AS BIGINT) AS node, CAST({'NULL' if above is None else above} AS BIGINT) AS parent, '{kind}' AS kind, '{label}' AS label, {content} AS content, '{path}' AS path FROM p WHERE doc_id % 3 {sign} 0" for sign, *nodes in _AMENDING_NODES for n, (above, kind, label, content, path) in enumerate(nodes)),
}
