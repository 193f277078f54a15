"""Small tables with nulls, empty and long texts, ties, repeats and clashing names; plain versions of shared rules."""

import zlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return (text or "").encode().lower().split()


def crc(x, m):
    return zlib.crc32(str(x).encode()) % m


def documents(spark, texts, extra=False):
    """doc_id counts from 0; a pair (doc_id, text) gives another."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, None if i is None or i % 5 == 0 else "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if extra:  # names that an operator might use itself
        for name in ("root", "node", "id", "u", "v", "rank", "label", "tokens", "key", "s1", "score", "held_out", "kind"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def rows(df, *names):
    return sorted((tuple(r[n] for n in (names or df.columns)) for r in df.collect()), key=str)
