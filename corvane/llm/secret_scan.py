"""Secrets in texts: patterns, and structures confirmed by decoding.

Base patterns find assigned secrets (`assign`), access keys (`access`) and long hex strings (`hex`). The method adds
what decodes into a known structure: signed tokens whose first part is a JSON header with an algorithm (`jwt`), and
base64 or hex whose bytes are a private key: DER with nested lengths that fit exactly (`der`), or the binary format of
OpenSSH with its length-prefixed fields (`openssh`). A key may begin anywhere, also within a longer run of letters, and
run over several lines, broken by line ends or by escaped ones as in JSON; its own lengths say where it ends. Bytes in hex
may stand apart by colons or blanks. A PEM file that is itself in base64, as mounted secrets are, counts as `pem`, if a key
is confirmed in it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import strings

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "pem")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
#: A run of 20 or 24 characters is found just where the open-ended pattern finds a run that long.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Alphabets of encoded keys; what may stand between two pieces: a line end, real or escaped, or the backslash of "\/".
_BASE64, _URL_BASE64, _ANY_HEX = (re.compile(f"[{x}]+") for x in ("A-Za-z0-9+/", "A-Za-z0-9_-", "0-9a-fA-F"))
_BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*|\\+(?=/)")
#: The same in hex, where a colon or a blank may also stand between two bytes.
_HEX_BREAK = re.compile(r":?[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*|[: ]")
#: Where keys may begin: DER with the byte 0x30 and a length, so in base64 with M and A to I; OpenSSH with its magic.
_STARTS = (re.compile(r"M(?=[A-I][A-Za-z0-9+/_-]{6})"), re.compile("b3BlbnNz"), re.compile("30(?=[: ]?[0-8][0-9a-fA-F](?:[: ]?[0-9a-fA-F]{2}){2})"), re.compile("6[fF][: ]?70[: ]?65[: ]?6[eE][: ]?73[: ]?73"), re.compile("LS0tLS1CRUdJTi"))
#: A PEM file, by its first and last lines.
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:[^-]|-(?!----BEGIN))+?-----END [A-Z0-9 ]+-----")
#: Object identifiers of private-key algorithms (RSA, EC, Ed25519, Ed448, X25519, X448, DSA, DH).
_KEY_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b6571", "2b656e", "2b656f", "2a8648ce380401", "2a864886f70d010301")}
#: Fixed value: object identifier of password-based encryption 2.
_PBES2 = bytes.fromhex("2a864886f70d01050d")
_OPENSSH = b"openssh-key-v1\0"
_LENGTH = rb"(?:[\0-\x7f]|\x81.|\x82..)"
#: How every key in DER begins: a version, or the name of the encryption. The longest such beginning has 19 bytes.
_HEAD = re.compile(rb"\x30" + _LENGTH + rb"(?:\x02\x01[\0\1]|\x30" + _LENGTH + rb"\x06\x09" + re.escape(_PBES2) + rb")", re.DOTALL)
#: The most bytes of a key, DER with a length of two bytes, and the most elements of one level (keys have ten at most).
_MOST, ELEMENTS = 4 + 0xFFFF, 16


def _fields(read: Callable[[int, int], bytes], at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill the bytes from `at` to `end` exactly, as (tag, begin, end of the content); None if a length doesn't fit, or of more than ELEMENTS.

    Only tags and lengths are read, and the first length that doesn't fit ends it.
    """
    out = []
    while at < end:
        head = read(at, min(6, end - at))
        if len(head) < 2 or len(out) == ELEMENTS:
            return None
        n, at = head[1], at + 2
        if n & 128:
            size = n & 127
            if not 1 <= size <= 4 or len(head) < 2 + size:
                return None
            n = int.from_bytes(head[2 : 2 + size], "big")
            at += size
            if n < 128 or (size > 1 and n >> (8 * (size - 1)) == 0):
                return None
        if at + n > end:
            return None
        out.append((head[0], at, at + n))
        at += n
    return out


def _private_der(read: Callable[[int, int], bytes], total: int) -> bool:
    """is_private_der() of `total` bytes, of which only the parts that decide it are read."""
    top = _fields(read, 0, total)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    f = _fields(read, *top[0][1:])
    if not f:
        return False
    tags, sizes = [t for t, _, _ in f], [b - a for _, a, b in f]

    def small(k: int) -> bytes:
        return read(f[k][1], sizes[k]) if sizes[k] <= 16 else b""

    def algorithm(k: int) -> bytes:
        inner = _fields(read, *f[k][1:])
        if not inner or inner[0][0] != 0x06 or inner[0][2] - inner[0][1] > 16:
            return b""
        return read(inner[0][1], inner[0][2] - inner[0][1])

    if tags[:2] == [0x02, 0x30] and len(f) >= 3 and tags[2] == 0x04 and small(0) in (b"\0", b"\1"):
        return algorithm(1) in _KEY_OIDS
    if len(f) >= 9 and all(t == 0x02 for t in tags[:9]) and small(0) in (b"\0", b"\1"):
        return sizes[1] >= 32 and sizes[2] >= 1
    if tags[:2] == [0x02, 0x04] and small(0) == b"\1" and 16 <= sizes[1] <= 80:
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    return tags == [0x30, 0x04] and sizes[1] >= 16 and algorithm(0) == _PBES2


def is_private_der(data: bytes) -> bool:
    """Whether the bytes are a private key in DER: PKCS#1, PKCS#8, encrypted PKCS#8 or SEC 1; every nested length must fit."""
    return _private_der(lambda at, n: data[at : at + n], len(data))


def _openssh_end(read: Callable[[int, int], bytes], total: int) -> int | None:
    """Where the private-key file of OpenSSH at the beginning of the bytes ends: magic, cipher, kdf and options, key count, public and private parts."""
    if read(0, len(_OPENSSH)) != _OPENSSH:
        return None
    at, parts = len(_OPENSSH), []
    for k in range(5):
        if k == 3:  # the number of keys stands between the kdf options and the public key
            if read(at, 4) != b"\0\0\0\1":
                return None
            at += 4
        if at + 4 > total:
            return None
        n = int.from_bytes(read(at, 4), "big")
        at += 4
        if at + n > total:
            return None
        parts.append((at, n))
        at += n
    cipher, private = parts[0], parts[4]
    named = 0 < cipher[1] <= 64 and read(*cipher).isascii()
    return at if named and private[1] >= 8 and private[1] % 8 == 0 else None


def is_openssh(data: bytes) -> bool:
    """Whether the bytes are a private-key file of OpenSSH and nothing more."""
    return _openssh_end(lambda at, n: data[at : at + n], len(data)) == len(data)


def is_signed_header(part: str) -> bool:
    """Whether base64url text is a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


class _Run:
    """The characters of an alphabet from some place of a text on, what breaks lines left out; each run of a text is put together once."""

    def __init__(self, text: str, alphabet: re.Pattern[str]):
        self.text, self.alphabet, self.hex = text, alphabet, alphabet is _ANY_HEX
        self.begin = self.end = 0

    def cover(self, at: int) -> None:
        """Goes to the run that holds a place, unless that is this one."""
        if self.begin <= at < self.end:
            return
        breaks = _HEX_BREAK if self.hex else _BREAK
        self.begin, out, self.starts, self.offsets, n = at, [], [], [], 0
        while m := self.alphabet.match(self.text, at):
            out.append(m[0])
            self.starts.append(at)
            self.offsets.append(n)
            n, self.end = n + len(m[0]), m.end()
            if not (b := breaks.match(self.text, self.end)):
                break
            at = b.end()
        self.chars = "".join(out)
        if not out:
            self.starts, self.offsets, self.end = [self.begin], [0], self.begin

    def offset(self, at: int) -> int:
        """The number of characters before a place of the text."""
        k = bisect_right(self.starts, at) - 1
        return self.offsets[k] + at - self.starts[k]

    def place(self, offset: int) -> int:
        """The place in the text behind so many characters, of which there is one at least."""
        k = bisect_left(self.offsets, offset) - 1
        return self.starts[k] + offset - self.offsets[k]

    def size(self, start: int) -> int:
        """The bytes that are encoded from a character on."""
        return (len(self.chars) - start) // 2 if self.hex else (len(self.chars) - start) * 3 // 4

    def read(self, start: int, at: int, n: int) -> bytes:
        """Up to n bytes from byte `at` of what is encoded from a character on."""
        if self.hex:
            s = self.chars[start + 2 * at : start + 2 * (at + n)]
            return bytes.fromhex(s[: len(s) // 2 * 2])
        group, skip = divmod(at, 3)
        s = self.chars[start + 4 * group : start + 4 * group + -(-4 * (skip + n) // 3)]
        s = s[:-1] if len(s) % 4 == 1 else s
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4))[skip : skip + n]

    def stop(self, start: int, n: int) -> int:
        """Where the last character of n bytes, or its padding, ends in the text."""
        if self.hex:
            return self.place(start + 2 * n)
        chars = -(-4 * n // 3)
        end, pad = self.place(start + chars), -chars % 4
        while pad and self.text[end : end + 1] == "=":
            pad, end = pad - 1, end + 1
        return end


def _key_at(run: _Run, at: int) -> tuple[str, int] | None:
    """Kind and end of the private key that is encoded from a place on."""
    run.cover(at)
    start = run.offset(at)
    total = min(run.size(start), _MOST)

    def read(k: int, n: int) -> bytes:
        return run.read(start, k, n)

    head = read(0, 24)
    if head.startswith(b"-----BEGIN "):
        n = inner = 0
        while not inner and n < 2 * _MOST:  # a longer part only while no second file begins in it
            n = 4 * n or 2048
            pem = read(0, n).decode("latin-1")
            inner = _PEM.match(pem)
            if len(pem) < n or "-----BEGIN" in pem[10:]:
                break
        if inner and any(k in ("der", "openssh") for _, k, _ in confirmed_spans(inner[0])):
            return "pem", run.stop(start, inner.end())
        return None
    if head.startswith(_OPENSSH):
        n = _openssh_end(read, total)
        return ("openssh", run.stop(start, n)) if n else None
    if not _HEAD.match(head):
        return None
    size = head[1] & 127 if head[1] & 128 else 0
    n = 2 + size + (int.from_bytes(head[2 : 2 + size], "big") if size else head[1])
    return ("der", run.stop(start, n)) if n <= total and _private_der(read, n) else None


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what decodes into a known structure."""
    out = []
    if "ey" in text or "ew" in text:
        out += [(m.start(), "jwt", m.end()) for m in _JWT.finditer(text) if is_signed_header(m[1])]
    for k, start in enumerate(_STARTS):
        runs, at = [_Run(text, x) for x in ((_ANY_HEX,) if k in (2, 3) else (_BASE64, _URL_BASE64))], 0
        while m := start.search(text, at):
            at = m.start() + 1
            for run in runs:
                if found := _key_at(run, m.start()):
                    out.append((m.start(), *found))
                    at = found[1]
                    break
    return out


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


_SCAN = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            base = base_spans(text)
            more = confirmed_spans(text)
            kinds = [k for _, k, _ in base]
            out.append((doc, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
        columns = list(zip(*out, strict=True)) or [()] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _SCAN.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed), one row for each row of docs (doc_id, text, ...).

    Null and empty texts have no spans: counts 0, spans '', and the digest of ''. Repeated rows give repeated results, a
    null doc_id stays null, other columns are ignored, and an empty table gives an empty result. Texts are scanned
    whole, in time in proportion to their length. Nothing is shuffled.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _SCAN)


def redacted(text: str, mark: str = "[{kind}]") -> str:
    """The text with every span replaced by a mark; spans that overlap are replaced as one, named by the first."""
    spans = sorted(base_spans(text) + confirmed_spans(text), key=lambda x: (x[0], -x[2]))
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], mark.format(kind=kind.upper())]
        at = end
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the same columns and rows; secrets in text are replaced by a mark of their kind, and n_chars, if there, is counted anew for changed texts.

    Null and empty texts stay as they are, repeated rows change alike, texts of any length are searched whole, an empty
    table stays empty, and columns other than text and n_chars may have any names.
    """
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(names.index("text")).to_pylist()
            new = [t if t is None else redacted(t) for t in old]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([n if a is b or a == b else len(b) for n, a, b in zip(columns[at].to_pylist(), old, new, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
