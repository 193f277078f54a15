"""Every operator against a plain version, over nulls, empty and long texts, ties, repeats, clashing names, empty tables."""

import base64
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corvane.llm import decontaminate, language_model, packing, secret_scan, sstable, topk, toxicity, url_filter, warc
from corvane.llm.common import shared_dir
from corvane.llm.tokens import Encoder
from tests.llm.helpers import crc, documents, rows, words

ODD = [None, "", "   \n", "x", "two  blanks", " lead", "trail ", "tab\tand\nline\n\nlines", "Zoë's naïve café, 12½ — <|endoftext|>", "漢字 かな \U0001f600", "a\x1cb \x01c", "don't 's ~ ~~ İΣΑΣ", "w " * 5000, "long" * 3000]


def plain_ids(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids


# secrets


def der(tag, content):
    n = len(content)
    head = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + head + content


RSA = der(0x30, der(2, b"\0") + der(2, b"\x01" * 64) + b"".join(der(2, b"\x03" * 33) for _ in range(7)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, bytes.fromhex("2b6570"))) + der(4, der(4, b"k" * 32)))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 51, b"q" * 136))
JWT = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), b'{"sub":"1"}', b"s" * 32))


def plain_base(text):
    out = []
    for kind, pattern, group, least in (("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[1])))


def test_secrets(spark):
    lines = base64.encodebytes(RSA).decode().strip()
    texts = [*ODD, "token = abc", "Token='abcdef' PASSWORD:hunter22 ſecret=abcdefg api_key=AKIA" + "A1" * 9, "AKIA" + "Z" * 15, "f" * 23 + " " + "f" * 24, f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----", f"é {base64.b64encode(PKCS8).decode()} {base64.b64encode(SSH).decode()} {JWT}", PKCS8.hex(), "M" + "A" * 60]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(documents(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        kinds = Counter(k for _, k, _ in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {x for x in joined.split(",") if x} <= set(got[i].spans.split(","))
    n = len(ODD)
    assert [re.findall(r"jwt|der|openssh", got[n + k].spans) for k in range(8)] == [[], [], [], [], ["der"], ["der", "openssh", "jwt"], ["der"], []]
    assert not secret_scan.is_private_der(RSA[:-1]) and not secret_scan.is_private_der(RSA + b"\0") and not secret_scan.is_openssh(SSH[:-1])
    assert secret_scan.scan_secrets(documents(spark, [])).count() == 0
    red = secret_scan.redact_secrets(documents(spark, texts, extra=True))
    assert red.columns == documents(spark, [], extra=True).columns
    for r in red.collect():
        assert (r.text is None) == (texts[r.doc_id] is None) and not plain_base(r.text) and (r.text is None or r.n_chars == len(r.text))


def test_secrets_wherever_they_begin(spark):
    url = base64.urlsafe_b64encode(RSA[:-1] + b"\xff").decode()
    keys = {"der": base64.b64encode(RSA).decode(), "openssh": base64.b64encode(SSH).decode()}
    cases = []
    for kind, key in keys.items():
        lines = [key[a : a + 64] for a in range(0, len(key), 64)]
        bare = [x.rstrip("=") for x in lines]
        for before, body, after in (
            ("-----BEGIN KEY-----\\n", "\\n".join(lines), "\\n-----END KEY-----\\n"),
            ('{"k": "KEY-----\\r\\n', "\\r\\n".join(lines), '\\r\\n-----END"}'),
            ("\\\\n", "\\\\n".join(lines), "\\\\n"),
            ("key/", key, " x"),
            ("word", key, ""),
            ("see MIIabc/MAIN", key, ","),
            ("", "\n".join(bare), "\nand so on"),
            ("é ", "\r\n".join(bare), "\r\nshort\r\nlines of text"),
            ("", key.replace("/", "\\/"), '"'),
        ):
            cases.append((before, body, after, kind))
    for kind, data in (("der", RSA), ("der", PKCS8), ("openssh", SSH)):
        cases += [("0x", data.hex(), " ", kind), ("0X", data.hex().upper(), "", kind), ("abc", data.hex().upper(), "zz", kind)]
    cases.append(("u=", url, "&", "der"))
    cases += [("", base64.b64encode(RSA[:-1]).decode(), "", None), ("key/", base64.b64encode(RSA[:200]).decode(), "", None), ("0x", SSH[:-1].hex(), "", None), ("", "MII" * 3000, "", None), ("", "M" * 3000, "", None)]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(documents(spark, [a + b + c for a, b, c, _ in cases])).collect()}
    for i, (a, b, _, kind) in enumerate(cases):
        found = [x for x in got[i].spans.split(",") if x.startswith(("der", "openssh"))]
        assert found == ([f"{kind}:{len(a)}:{len(a + b)}"] if kind else []), (i, cases[i])
        assert got[i].n_confirmed == len(found)


# language model


def test_language_model(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["der", "die", "und"] if k % 2 else ["the", "and", "of"]) + rng.choice(["", "", "x", f"{rng.randrange(900)}"]) for _ in range(rng.randrange(60))) for k in range(400)] + ODD
    docs = documents(spark, texts, extra=True)
    got = {r.doc_id: r for r in language_model.score_texts(docs).collect()}
    c = Counter(w for i, t in enumerate(texts) if crc(i, 7) != 2 for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = [*words(t), None]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (crc(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    held = [got[i] for i in got if got[i].held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert rows(language_model.score_texts(docs.limit(0))) == []
    assert rows(language_model.score_texts(documents(spark, [(2, "a b")]).where("crc32(cast(doc_id as string)) % 7 != 2")), "doc_id", "n_tokens")[:1] in ([(2, 3)], [])


def test_language_model_rare_words_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(language_model, "COMMON", 5)
    texts = [f"a b c d e f word{i % 50} z{i}" for i in range(120)]
    c = Counter(w for i, t in enumerate(texts) if crc(i, 7) != 2 for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for r in language_model.score_texts(documents(spark, texts)).collect():
        w = [*words(texts[r.doc_id]), None]
        assert r.n_known == sum(c[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    m = language_model.Model.start(np.full(language_model.CLASSES, 1 / language_model.CLASSES))
    p = [m.log10(np.array([1, 2, 3, 4, k]), np.array([4]))[0] for k in range(language_model.CLASSES)]
    assert sum(10**x for x in p) == pytest.approx(1, abs=1e-4)


def test_language_model_words_outside_the_commonest(spark):
    """Words of one tail class are told apart by context, though none has a class of its own."""
    rng = random.Random(5)
    filler = [f"f{k}" for k in range(260)]
    a, b = [f"a{k:02}zzz" for k in range(40)], [f"b{k:02}zzz" for k in range(40)]
    texts = [" ".join([*rng.choices(filler, k=200), *(f"left left left {rng.choice(a)} right right right {rng.choice(b)}" for _ in range(20))]) for _ in range(600)]
    tries = [f"{x} {x} {x} {w}" for w in (a[0], b[0]) for x in ("left", "right")]
    got = {r.doc_id: r.score for r in language_model.score_texts(documents(spark, texts + tries)).collect()}
    la, ra, lb, rb = (got[len(texts) + k] for k in range(4))
    assert (la - ra) - (lb - rb) > 0.2  # by class and count alone, it is 0


def test_language_model_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = []
    for n in (1, 8, 64):
        got = {r.doc_id: r for r in language_model.score_texts(docs.repartition(n)).collect()}
        found.append({i: r.score for i, r in got.items()})
        out = [r for r in got.values() if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
    for other in found[1:]:
        assert all(x == pytest.approx(found[0][i], rel=1e-3) for i, x in other.items())


def test_language_model_table_finds_words():
    rng = np.random.default_rng(8)
    h = np.unique(np.r_[rng.integers(0, 2**64, 3000, np.uint64), rng.integers(0, 90, 40, np.uint64), np.uint64(2**64 - 1)])
    t = language_model.Table(h[::2], np.ones(len(h[::2]), np.int64), np.zeros(len(h[::2]), np.int64))
    at, there = t.find(h)
    assert there.tolist() == np.isin(h, h[::2]).tolist() and (t.h[at[there]] == h[there]).all()


def test_language_model_places():
    """Before a text's first words stand marks, and predictions add up the vectors of the words before."""
    row, places, begin = language_model.sequence(np.array([5, 6, 7]), np.array([0, 2, 2, 3]))
    o, e = language_model.CLASSES, language_model.END
    assert row.tolist() == [o, o, o, o, 5, 6, e, o, o, o, o, e, o, o, o, o, 7, e] and places.tolist() == [4, 5, 6, 11, 16, 17] and begin.tolist() == [0, 3, 4, 6]
    rng = np.random.default_rng(3)
    m = language_model.Model.start(np.full(language_model.CLASSES, 1 / language_model.CLASSES))
    m.c[:] = rng.normal(size=m.c.shape)
    v = rng.normal(size=(len(row), language_model.SIZE)).astype(np.float32)
    plain = [sum(v[p - 1 - k] * m.c[k] for k in range(language_model.CONTEXT)) for p in range(language_model.CONTEXT, len(row))]
    assert np.allclose(m.predict(v), plain, atol=1e-5)


def test_language_model_sums_of_shards():
    """A task with several shards gives the changes of each, and averages weigh them by tokens."""
    table = language_model.Table(np.arange(3).astype(np.uint64), np.array([5, 4, 3]), np.zeros(3, np.int64))
    share = np.full(language_model.CLASSES, 1 / language_model.CLASSES)
    start = language_model.Model.start(share, table, np.ones(language_model.TAILS))
    squares = np.full(start.dense, 1e-6, np.float32)
    rows = pa.RecordBatch.from_arrays([pa.array([0, 0, 4, 4, 4]), pa.array([np.array(x, "<i4").tobytes() for x in ([0, 1, 2], [], [1, 1], [2], [0] * 9)], pa.binary())], ["shard", "ids"])
    parts = [list(language_model._fit(iter(x), start.flat, squares, table, share)) for x in ([rows], [rows.slice(0, 2)], [rows.slice(2)])]
    assert [b.column(1)[0].as_py() for b in parts[0]] == [0, 4] and [b.column(2)[0].as_py() for b in parts[0]] == [5, 15]
    assert parts[0] == parts[1] + parts[2]
    both = sorted((r for b in parts[0] for r in b.to_pylist()), key=lambda r: (r["chunk"], r["shard"]))
    averaged = pa.Table.from_batches(language_model._averaged(iter([pa.RecordBatch.from_pylist(both, parts[0][0].schema)]))).to_pylist()
    assert [r["chunk"] for r in averaged] == list(range(language_model.CHUNKS))
    one, two = (np.frombuffer(b.column(3)[0].as_py(), np.float16).astype(float) for b in parts[0])
    weight = 5.0 * (one != 0) + 15.0 * (two != 0)
    assert np.allclose(np.frombuffer(averaged[0]["p"], np.float16), (5 * one + 15 * two) / np.maximum(weight, 1), atol=1e-3)


def test_language_model_steps_add_up():
    rng = np.random.default_rng(6)
    n = 900
    table = language_model.Table(rng.permutation(n).astype(np.uint64), rng.integers(1, 50, n), rng.integers(0, language_model.TAILS - 1, n))
    m = language_model.Model.start(np.full(language_model.CLASSES, 1 / language_model.CLASSES), table, np.ones(language_model.TAILS))
    m.flat[:] = rng.normal(0, 0.3, len(m.flat))
    ids = np.delete(np.arange(language_model.CLASSES + 1 + table.words), language_model.CLASSES)
    p = [m.log10(np.array([1, language_model.CLASSES + 7, 300, language_model.CLASSES, i]), np.array([4]), table)[0] for i in ids]
    assert table.words == n - language_model.OWN and sum(10**x for x in p) == pytest.approx(1, abs=1e-4)


def test_language_model_sums_of_exponentials():
    """Rows of a block are shifted only where one is out of range, whatever the bounds of all parameters say."""
    rng = np.random.default_rng(9)
    for shift in (0, 70, 300, -300):
        z = (rng.normal(0, 3, (50, 40)) + shift).astype(np.float32)
        plain = np.log(np.exp(z.astype(float) - shift).sum(axis=1)) + shift
        assert np.allclose(language_model._log_sums(z, np.ones(40, np.float32)), plain, atol=1e-3)


def test_language_model_scatter_repeats_rows():
    rng = np.random.default_rng(10)
    for n in (0, 3, 5 * language_model.BATCH):
        rows, values = rng.integers(0, 7, n), rng.normal(size=(n, language_model.SIZE)).astype(np.float32)
        out, plain = np.zeros((7, language_model.SIZE), np.float32), np.zeros((7, language_model.SIZE))
        language_model._scatter(out, rows, values)
        np.add.at(plain, rows, values)
        assert np.allclose(out, plain, atol=1e-2)


# decontamination


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [" ".join(word() for _ in range(40)) for _ in range(6)]
    noise = lambda n: " ".join(word() for _ in range(n))
    w = items[2].split()
    parts = [w[20:], w[10:20], w[:10]]
    texts = [f"{noise(50)} {items[0].upper()}, {noise(50)}", noise(400), f"{noise(9)} {' '.join(' '.join(p) + ' ' + noise(3) for p in parts)}", " ".join(items[3].split()[:20]), items[4] + " " + items[5], *ODD, items[0]]
    b = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, "too short"), (92, "")], "item_id bigint, text string")
    got = decontaminate.contaminated(documents(spark, texts, extra=True), b)
    assert rows(got, "doc_id", "item_id") == [(0, 0), (2, 2), (4, 4), (4, 5), (len(texts) - 1, 0)] or set(rows(got, "doc_id", "item_id")) == {(0, 0), (2, 2), (4, 4), (4, 5), (len(texts) - 1, 0)}
    for r in got.collect():  # tiles are common runs that don't overlap
        d, i = decontaminate.words_of(texts[r.doc_id]), decontaminate.words_of(items[r.item_id])
        assert all(d[t.doc_start : t.doc_start + t.length] == i[t.item_start : t.item_start + t.length] for t in r.tiles)
        assert len({t.item_start + k for t in r.tiles for k in range(t.length)}) == r.matched == sum(t.length for t in r.tiles)
    left = decontaminate.without_contaminated(documents(spark, texts, extra=True), b)
    assert left.count() == len(texts) - 4 and left.columns == documents(spark, [], extra=True).columns
    assert decontaminate.contaminated(documents(spark, texts), b.limit(0)).count() == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontaminate, "INDEXED", 50)
        assert set(rows(decontaminate.contaminated(documents(spark, texts), b), "doc_id", "item_id")) == {(0, 0), (2, 2), (4, 4), (4, 5), (len(texts) - 1, 0)}


def test_tiling_takes_the_longest_first():
    a, b = np.array([1, 2, 3, 4, 9, 1, 2, 3, 4, 5, 6]), np.array([1, 2, 3, 4, 5, 6, 8])
    assert decontaminate.tile(a, b, 3) == [(5, 0, 6)]
    assert decontaminate.tile(np.array([7, 7, 7, 7, 7, 7, 7, 7]), np.array([7, 7, 7, 7, 7]), 4) == [(0, 0, 5)]


# top-k


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 24)]) for i in range(-40, 400)]
    v += [(1000, v[5][1]), (1001, v[5][1]), (1100, None), (1101, [None] * 24), (1102, [float("nan")] * 24), (1103, [float("inf")] * 24), (1200, [1.0, 2.0]), (None, v[3][1]), (500, v[5][1]), (500, v[6][1])]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>").selectExpr("*", "'x' as id", "'y' as v", "1 as score")
    ready = [(i, [math.floor(1024 * x) for x in e]) for i, e in v if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for i, q in sorted({i: q for i, q in reversed(ready)}.items()):
        if i % 100 == 0:
            q = min(x for j, x in ready if j == i)
            best = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in ready if j != i and len(e) == len(q))[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert rows(topk.top_k(df, df.where("vec_id % 100 = 0"))) == sorted(want, key=str)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [1e15, 1.0]), (2, [1e15, 2.0]), (3, [-1e15, 1.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(big, big.where("vec_id = 1")).orderBy("rank").collect()] == [2, 3]
    with pytest.MonkeyPatch.context() as m:  # several blocks of queries
        m.setattr(topk, "QUERIES", 3)
        assert rows(topk.top_k(df, df.where("vec_id % 100 = 0"))) == sorted(want, key=str)


# toxicity


def test_toxicity(spark):
    rng = random.Random(2)
    good = [f"w{k}" * 2 for k in range(60)]
    good = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    texts, labels = [], []
    for k in range(500):
        s = [" ".join(rng.choices(good, k=10)) for _ in range(rng.randrange(1, 6))]
        bad = k % 4 == 0
        if bad:
            s[rng.randrange(len(s))] += " " + rng.choice(["moron", "scumbag", "scummy"])
        texts.append(". ".join(s))
        labels.append((k, int(bad)))
    texts += ODD
    docs = documents(spark, texts, extra=True)
    lab = spark.createDataFrame([*labels, (1, None), (2, 7), (None, 1), (0, 1)], "doc_id bigint, toxic int").selectExpr("*", "'z' as text")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, lab).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [k for k, _ in labels if got[k].held_out]
    assert {k for k in got if got[k].held_out} == {k for k in got if crc(k, 5) == 0}
    assert sum(got[k].predicted == labels[k][1] for k in held) / len(held) > 0.95
    found = [texts[k][o.start : o.end] for k, y in labels if y and got[k].predicted for o in got[k].offending]
    assert found and sum("moron" in x or "scum" in x for x in found) / len(found) > 0.9
    assert toxicity.without_toxic(docs, lab).count() == sum(not r.predicted for r in got.values())
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs, lab.limit(0)).collect())
    assert toxicity.score_toxicity(docs.limit(0), lab).count() == 0


def test_keys_in_hex_and_mounted_files():
    h, b = RSA.hex(), base64.b64encode(RSA).decode()
    pairs = [h[i : i + 2] for i in range(0, len(h), 2)]
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(b[i : i + 64] for i in range(0, len(b), 64)) + "\n-----END RSA PRIVATE KEY-----\n"
    listing = ":\n    ".join(":".join(pairs[i : i + 15]) for i in range(0, len(pairs), 15))
    for text, kind in (("0x" + h, "der"), (":".join(pairs), "der"), (listing, "der"), (" ".join(pairs), "der"), (h.upper(), "der"), (base64.b64encode(pem.encode()).decode(), "pem"), (base64.encodebytes(pem.encode()).decode(), "pem")):
        (start, found, end), = secret_scan.confirmed_spans(f"key {text} next")
        assert found == kind and start == 4 + 2 * text.startswith("0x") and len(text.rstrip()) - 8 <= end - 4 <= len(text)
    assert secret_scan.confirmed_spans(base64.b64encode(pem.replace("M", "N", 1).encode()).decode()) == []


def test_secrets_in_a_megabyte_take_seconds():
    for part in ("MIIEabcd_/", "30:82:", "LS0tLS1CRUdJTiBSU0EgUFJJVkFURSBLRVktLS0tLQ", "M" + "A" * 999 + "_/", "token=", "ey.ey."):
        began = time.time()
        secret_scan.confirmed_spans(part * (1_000_000 // len(part)))
        secret_scan.base_spans(part * (1_000_000 // len(part)))
        assert time.time() - began < 30


# tokens, packing, shards


def test_encoder_equals_the_library():
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(["a", "Bc", " ", " ", "\n", "'s", "é", "1", ".", "\t", "\u00a0", "漢", "x|y", "~"]) for _ in range(rng.randrange(14))) for _ in range(1500)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(public_tokenizers.path(name))
        assert e.mode != "whole"
        whole = e._whole(texts)
        assert e.encode(texts) == whole
        assert [x for t in texts for x in e.encode([t])] == whole


@pytest.mark.parametrize("part", ["30:82:ff:ff:02:01:00:", "MIL//wIBAD\n", ":".join(f"{b:02x}" for b in b"openssh-key-v1\0") + ":", "3082ffff020100", "LS0tLS1CRUdJTi", "3082ffff0201000482000730820fff020100", "b3BlbnNzaC1rZXktdjEAAAAABG5vbmU"])
def test_hostile_megabytes_take_seconds(part):
    began = time.time()
    secret_scan.confirmed_spans(part * (1_000_000 // len(part)))
    assert time.time() - began < 15


def test_keys_are_found_at_every_phase():
    rng = random.Random(4)
    for key, kind in ((RSA, "der"), (PKCS8, "der"), (SSH, "openssh")):
        for text in (base64.b64encode(key).decode(), base64.encodebytes(key).decode().strip(), base64.urlsafe_b64encode(key).decode().rstrip("="), key.hex(), ":".join(f"{b:02X}" for b in key)):
            for before in ("", "x", "key/", "ab\n", "MIIB\n", "30:82:"):
                for after in ("", " end", "\nmore", "!" * rng.randrange(4)):
                    found = secret_scan.confirmed_spans(before + text + after)
                    assert (len(before), kind, len(before) + len(text)) in found, (before, text[:20], after, found)


def test_table_of_frequent_words_at_any_count(spark):
    def chosen(counts, most):
        df = spark.createDataFrame([(mixed(i), c) for i, c in enumerate(counts)], "h bigint, c bigint")
        return sorted(r.c for r in df.where(language_model.most_frequent(df, most)).collect())

    def mixed(i):
        return int.from_bytes(hashlib.sha256(b"%d" % i).digest()[:8], "big", signed=True)

    assert chosen([5, 4, 4, 3, 1], 3) == [4, 4, 5] and chosen([5, 4, 4, 3], 2) == [5] and chosen([7, 7], 9) == [7, 7]
    large = [(1 << 20) + 4096 * k for k in range(300)] + [1 << 40] * 3 + [9] * 50
    assert len(chosen(large, 100)) > 90 and chosen(large, 100)[-3:] == [1 << 40] * 3 and min(chosen(large, 100)) > 1 << 20
    assert 90 <= len(chosen([(1 << 20) + 1] * 300, 100)) <= 100 and chosen([], 5) == []


def test_marks_in_every_letter_case():
    rng = random.Random(8)
    ends = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|", "|ENDOFTEXT|>", "<|", "<|STARTOFTEXT|>", "\u0130", "\u212a"]
    texts = ["a <|ENDOFTEXT|> b"] + ["".join(rng.choice([*ends, " ", "a", "Zo\u00eb", "\n", ".", "1", "x "]) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, path = Encoder(public_tokenizers.path(name)), public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
        assert e.encode(texts) == want


def plain_tiles(a, b, least):
    """The longest run of free equal words, again and again."""
    free_a, free_b, out = [x >= 0 for x in a], [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for t in range(len(b)):
                k = 0
                while p + k < len(a) and t + k < len(b) and free_a[p + k] and free_b[t + k] and a[p + k] == b[t + k]:
                    k += 1
                best = min(best, (-k, p, t))
        k, p, t = -best[0], *best[1:]
        if k < least:
            return sorted(out)
        free_a[p : p + k] = free_b[t : t + k] = [False] * k
        out.append((p, t, k))


def test_tiles_are_the_longest_runs(monkeypatch):
    rng = np.random.default_rng(11)
    for few in (0, 20_000):
        monkeypatch.setattr(decontaminate, "_FEW", few)
        for words_, n in ((1, 20), (2, 40), (3, 60), (30, 60)):
            for _ in range(6):
                a, b = rng.integers(-1 if words_ > 2 else 0, words_, n), rng.integers(0, words_, n // 2)
                a[5:15] = b[-10:]
                assert decontaminate.tile(a, b) == plain_tiles(a.tolist(), b.tolist(), decontaminate.SEED)
    began = time.time()
    assert sum(k for *_, k in decontaminate.tile(np.zeros(20_000, np.int64), np.zeros(2_000, np.int64))) == 2000
    assert time.time() - began < 5


def test_short_items_are_found_as_wholes(spark):
    items = spark.createDataFrame([(1, "Ab, cd"), (2, "x"), (3, ""), (4, None), (5, "one two three"), (5, "one two three")], "item_id bigint, text string")
    docs = documents(spark, ["ab cd", "ab x cd", "one two", "zero ONE two-three four one two three", None, "", "x", "x"], extra=True)
    got = rows(decontaminate.contaminated(docs, items), "doc_id", "item_id", "coverage", "matched")
    assert got == sorted([(0, 1, 1.0, 2), (1, 2, 1.0, 1), (3, 5, 1.0, 3), (3, 5, 1.0, 3), (6, 2, 1.0, 1), (7, 2, 1.0, 1)], key=str)
    left = decontaminate.without_contaminated(docs, items)
    assert rows(left, "doc_id") == [(2,), (4,), (5,)] and left.columns == docs.columns
    assert decontaminate.without_contaminated(docs.limit(0), items).count() == 0


def test_padding_does_not_grow_with_partitions(spark):
    rng = random.Random(16)
    texts = [" ".join("".join(rng.choices("abcdef", k=rng.randrange(1, 9))) for _ in range(rng.randrange(400))) for _ in range(1000)]
    for n in (1, 200):
        got = packing.pack_documents(documents(spark, texts).repartition(n), public_tokenizers.path("word_bpe_49k.json")).collect()
        assert sum(r.length for r in got) > 0.98 * 2048 * len({r.sequence_id for r in got})
        assert all(0 <= r.offset and r.offset + r.length <= 2048 for r in got)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    texts = [*ODD, *(" ".join("".join(rng.choices("abcdef", k=rng.randrange(1, 9))) for _ in range(rng.randrange(300))) for _ in range(400))]
    got = packing.pack_documents(documents(spark, texts, extra=True).repartition(2), path).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*plain_ids(path, t), 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in got) > 0.95 * 2048 * len(by_seq)
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_differencing():
    rng = random.Random(7)
    for _ in range(50):
        sizes = [rng.randrange(1, 500) for _ in range(rng.randrange(1, 60))]
        k = rng.randrange(1, 12)
        out = packing.differencing(sizes, k)
        assert sorted(x for w in out for x in w) == list(range(len(sizes))) and len(out) <= k
        assert all(sum(sizes[x] for x in w) <= 500 for w in packing.pack(sizes, 500))
    assert sorted(sum([8, 7, 6, 5, 4][x] for x in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.differencing([], 3) == []


def test_shards(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, *(f"text {i} " * (i % 50) for i in range(300)), (-5, "negative"), (None, "nameless"), (7, "again"), (7, "again")]
    docs = documents(spark, texts, extra=True)
    pairs = sorted(((i, t or "") for i, t in ((t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(texts))), key=lambda p: (p[0] is not None, p[0] or 0, p[1].encode()))
    want, at = [], 0
    for i, t in pairs:
        ids = [*plain_ids(path, t), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(sstable.store_tokens(docs, path)) == sorted(want, key=str)
    manifest = sstable.write_shards(docs, shared_dir(spark), path, shards=3)
    for i in (0, 7, -5, None, 310):
        assert sorted(len(x) for x in sstable.lookup(manifest, i)) == sorted(n for j, _, n, _ in want if j == i)
    assert sstable.lookup(manifest, 10**9) == []
    assert sstable.store_tokens(docs.limit(0), path).count() == 0


# WARC


def test_warc(spark):
    big = "é" * 200_000
    pages = [(1, "http://a.b/c?d#e", "<p>x</p>"), (2, "no scheme", "<p>x</p>"), (0, "http://é.b/ \r\nX: y", big), (5, None, None), (4, "http://a/", ""), (None, "http://n/", "<p>x</p>"), (-3, "u", big), (9, "z", "a\r\n\r\nWARC/1.1\r\n"), (2, "no scheme", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'x' as digest", "'y' as least", "'k' as key", "'c' as capture")
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        least = min((j for j, _, x in pages if (x or "") == (h or "") and j is not None), default=None)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == least else "revisit", None if i == least else least))
    assert rows(warc.archive_pages(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    folder = shared_dir(spark)
    c = warc.read_captures(spark, [m.path for m in warc.write_archives(df, folder)])
    assert c.count() == len(pages) and c.where("request is null or metadata is null").count() == 0
    assert {bytes(r.response.body) for r in c.collect() if r.response.kind == "response"} == {(h or "").encode() for _, _, h in pages}
    assert warc.archive_pages(df.limit(0)).count() == 0
    for p in (0, 5, -7, 2**62, -(2**63), None):
        assert warc.page_of(warc.record_id(2, p, 9, 77)) == p


def test_warc_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    pages = [(i, f"http://h/{i}", "same" if i % 2 else f"page {i // 4}") for i in range(40)]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    first = {}
    for i, _, h in pages:
        first.setdefault(h, i)
    assert rows(got, "page_id", "refers_to") == sorted(((i, None if first[h] == i else first[h]) for i, _, h in pages), key=str)


def test_warc_revisits_name_records_that_are_there(spark, monkeypatch):
    pages = [(i % 50, f"http://h/{i}", "same" if i % 2 else f"page {i // 6}") for i in range(1, 90)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)
    for hot in (3, 1000):
        monkeypatch.setattr(warc, "HOT", hot)
        c = warc.read_captures(spark, [m.path for m in warc.write_archives(df, shared_dir(spark))]).collect()
        digests = {r.response.record: r.response.payload_digest for r in c if r.response.kind == "response"}
        revisits = [r.response for r in c if r.response.kind == "revisit"]
        assert len(c) == len(pages) and len(revisits) > 40
        assert all(digests.get(r.refers_to) == r.payload_digest for r in revisits)


# URLs


def test_toxicity_is_fitted_outside_the_driver(spark):
    import tracemalloc

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(500)]
    docs = documents(spark, [" ".join(rng.choices(words, k=5000)) + " moron" * (k % 2) for k in range(100)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id bigint, toxic int")
    tracemalloc.start()
    theta = toxicity.train(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(theta) == 2**18 + 1 and theta[toxicity.features("moron")[0]] > 0
    assert most < 12 << 20  # the model comes in a few copies of 2 MB; the words of the sample took more


def test_toxicity_scores_equal_a_plain_noisy_or(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(80)]
    texts = [". ".join(" ".join(rng.choices(words, k=rng.randrange(1, 50))) for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    texts = [t + (" moron scum" if k % 3 == 0 else "") for k, t in enumerate(texts)] + ["moron " * 9000, "", "!!", None, "a. b. c", "Moron\nSCUM " + "x " * 100]
    docs = documents(spark, texts, extra=True)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id bigint, toxic int")
    theta = toxicity.train(docs, labels)

    def plain(text):
        """Every sentence, joined to 8 words and cut to 40, with the sum of its distinct words' hashed beginnings."""
        groups, held = [], []
        for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
            held += re.findall(r"[^\W\d_]+", sentence)
            if len(held) >= 8:
                n = -(-len(held) // 40)
                groups += [held[k * len(held) // n : (k + 1) * len(held) // n] for k in range(n)]
                held = []
        clean = 1.0
        for g in groups + [held] * bool(held):
            z = theta[-1] + sum(theta[zlib.crc32(f.encode()) % 2**18] for w in set(g) for f in {"=" + w, *(w[:n] for n in range(3, 8) if n <= len(w))})
            clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    for r in toxicity.score_toxicity(docs, labels).collect():
        want = plain(texts[r.doc_id])
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id, 5) == 0)
    none = toxicity.score_toxicity(docs.where("doc_id < 0"), labels)
    assert none.count() == 0 and toxicity.without_toxic(docs.where("doc_id < 0"), labels).count() == 0
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {k for k, t in enumerate(texts) if plain(t) < 0.5} and len(kept) > 100


def test_urls_of_an_empty_table_and_repeats(spark):
    urls = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id bigint, url string")
    got = url_filter.judge_urls(urls).collect()
    assert len(got) == 3 and got[0] == got[1] and url_filter.judge_urls(urls.where("page_id > 5")).count() == 0


def test_urls(spark):
    urls = ["http://www.example.com/en/1", "http://example.com/en/", "https://x.example.com/en/a?b#c", "http://EXAMPLE.com/fr/", "http://a.net/es/1", "http://net/fr/x", "http://a.com", "http://a.com?x=/en/", "notcom/x", None, "", "://com/", "http://xexample.com/en/1", "http://a.b://c/d", "http://spam-farm.example.org/en/1", "http://library.example.org/en/5", "x" * 50_000 + "://h/p", "http://É.com/é\nx"]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'x' as host", "'r' as rule")).collect()}

    def plain(u):
        if u is None or "://" not in u:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]

    w = url_filter.train(url_filter.labelled_urls())
    for i, u in enumerate(urls):
        h, p = plain(u)
        fits = [(len(x + y), x + y, a) for a, x, y in url_filter.RULES if (h == x or h.endswith("." + x)) and p.startswith(y)]
        rule = max(fits)[1:] if fits else (None, "block" if url_filter.probability(w, h, p) >= 0.5 else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (h, p, *rule)
    table = url_filter.labelled_urls()
    assert len({h for h, *_ in table}) > 0.95 * len(table)  # folds by row are folds by host
    wrong = {0: 0, 1: 0}
    for fold in range(5):
        hosts = {h for i, (h, *_) in enumerate(table) if i % 5 == fold}
        w = url_filter.train([x for x in table if x[0] not in hosts])
        for h, p, y in table:
            wrong[y] += h in hosts and (url_filter.probability(w, h, p) >= 0.5) != y
    assert wrong[0] <= 4 and wrong[1] <= 14  # of 80 each
    w = url_filter.train(table)
    for h, p in (("wikipedia.org", "/a/1.html"), ("nytimes.com", ""), ("m.ththes.example.org", "/de/2145"), ("mycompany.com", "/about"), ("library.example.org", "/en/5")):
        assert url_filter.probability(w, h, p) < 0.3
    assert url_filter.probability(w, "best-poker-room.example.net", "/x") > 0.5
