"""Language identification with hyperdimensional profiles.

Every letter has a random vector of SIZE signs, drawn from its code point. Three symbols in a row (letters in lower case,
and one boundary for anything else between words) are bound into one vector: the product of the first, permuted twice,
the second, permuted once, and the third; the permutation is a rotation, so order counts. A text's vector is the bundle,
the sum over its stretches, each as often as it occurs. A language's prototype is the bundle of its texts' directions,
from which the mean of all prototypes is taken, so that what languages share doesn't count. A text is of the language
with the greatest cosine.

Texts' vectors are whole numbers, and directions are rounded to whole numbers before they are added, so prototypes don't
depend on the order of rows or partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bucket, slices

#: Signs of a vector, symbols that are bound, bytes and number of texts that are bundled together, parts in which tasks' sums meet.
SIZE, ORDER, SLICE, ROWS, PARTS = 1024, 3, 1 << 17, 256, 16
#: Length of a text's direction in a prototype.
UNIT = 1 << 20
#: Vectors of letters and of bound stretches that a task remembers (1 KB each).
LETTERS, REMEMBERED = 20_000, 20_000
SEED = 20_240_501
UNKNOWN = "und"


def letter_vector(code: int) -> np.ndarray:
    """The signs of a code point; 0 stands for the boundary of words."""
    return np.random.default_rng([SEED, code]).integers(0, 2, SIZE, dtype=np.int8) * np.int8(2) - np.int8(1)


def symbols(text: str) -> np.ndarray:
    """Code points of the letters in lower case, with one 0 in place of all between words, one before and one behind; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    low = points < 128
    kept = (points >= 97) & (points <= 122)
    if not low.all():
        others, where = np.unique(points[~low], return_inverse=True)
        kept[~low] = np.array([chr(c).isalpha() for c in others])[where]
    if not kept.any():
        return np.zeros(0, np.int64)
    out = np.concatenate(([0], np.where(kept, points, 0), [0]))
    stays = np.ones(len(out), bool)
    stays[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[stays]


def stretches(text: str) -> np.ndarray:
    """A number for each ORDER symbols in a row: the code points, 21 bits each."""
    s = symbols(text)
    return (s[:-2] << 42) | (s[1:-1] << 21) | s[2:] if len(s) else s


class Bundler:
    """Vectors of texts. Vectors of letters and stretches are kept up to a bound and drawn again beyond it."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.keys = np.zeros(0, np.int64)
        self.places = np.zeros(0, np.int64)
        self.vectors = np.empty((REMEMBERED, SIZE), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            self.letters[code] = letter_vector(code)
        return self.letters[code]

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """The bound vectors of stretches, a row each."""
        out = np.ones((len(keys), SIZE), np.int8)
        for place in range(ORDER):
            codes, where = np.unique((keys >> (21 * (ORDER - 1 - place))) & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), ORDER - 1 - place) for c in codes])[where]
        return out

    def look(self, keys: np.ndarray) -> np.ndarray:
        """`bound`, out of memory where possible; keys ascend."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if known.all():
            return self.vectors[self.places[at]].astype(np.float32)
        out = np.empty((len(keys), SIZE), np.int8)
        out[known] = self.vectors[self.places[at[known]]]
        out[~known] = self.bound(new := keys[~known])
        filled, held = len(self.keys), min(len(new), REMEMBERED - len(self.keys))
        if held:
            self.vectors[filled : filled + held] = out[~known][:held]
            order = np.argsort(both := np.concatenate((self.keys, new[:held])), kind="stable")
            self.keys, self.places = both[order], np.concatenate((self.places, np.arange(filled, filled + held)))[order]
        return out.astype(np.float32)

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The vectors of texts, a row each; zeros without letters. Sums are of whole numbers and exact."""
        if len(texts) > ROWS:
            return np.concatenate([self.bundle(texts[a : a + ROWS]) for a in range(0, len(texts), ROWS)])
        out = np.zeros((len(texts), SIZE), np.float64)
        keys = [stretches(t) for t in texts]
        every = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        for a in range(0, len(every), 4096):
            part = every[a : a + 4096]
            counts = np.zeros((len(texts), len(part)), np.float32)
            for k, own in enumerate(keys):
                inside = own[(own >= part[0]) & (own <= part[-1])] if len(every) > 4096 else own
                if len(inside):
                    counts[k] = np.bincount(np.searchsorted(part, inside), minlength=len(part))
            vectors = self.look(part)
            # float32 sums of whole numbers are exact below 2^24, so long texts are summed in float64
            wide = counts.sum(axis=1) >= 1 << 24
            out[~wide] += counts[~wide] @ vectors
            for k in np.flatnonzero(wide):
                out[k] += counts[k].astype(np.float64) @ vectors.astype(np.float64)
        return out


def directions(vectors: np.ndarray) -> np.ndarray:
    """Rows of length UNIT, rounded to whole numbers; zeros stay."""
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.rint(UNIT * vectors / np.where(norm, norm, 1)).astype(np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each language: (lang, vector)."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = np.frombuffer(v, "<i8")
            sums[lang] = sums[lang] + v if lang in sums else v
    yield _rows(sums)


def _rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["lang", "vector"])


def train(docs: DataFrame, folds: int = 4, held_out: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, rows of length 1 (or zeros), from all documents with a lang outside the held-out fold.

    Each task adds up its texts; PARTS tasks add up those sums, the driver PARTS sums of 8 KB for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(), {}
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                langs = b.column(0).to_pylist()
                d = directions(bundler.bundle(b.column(1).to_pylist()))
                for lang in set(langs):
                    own = d[[k for k, x in enumerate(langs) if x == lang]].sum(axis=0)
                    sums[lang] = sums[lang] + own if lang in sums else own
        yield _rows(sums)

    shown = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket("doc_id", folds) != held_out))
    each = shown.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, vector binary")
    sums: dict[str, np.ndarray] = {}
    for r in each.repartition(PARTS).mapInArrow(_added, "lang string, vector binary").collect():
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(r.vector, "<i8")
    langs = sorted(k for k, v in sums.items() if v.any())
    if not langs:
        return [], np.zeros((0, SIZE), np.float32)
    p = np.stack([sums[k].astype(np.float64) for k in langs])
    p /= np.sqrt((p * p).sum(axis=1, keepdims=True))
    if len(langs) > 1:
        p -= p.mean(axis=0)
        norm = np.sqrt((p * p).sum(axis=1, keepdims=True))
        p /= np.where(norm > 1e-9, norm, 1)
    return langs, p


_OUT = "doc_id bigint, held_out boolean, lang_pred string, score double"


def predict_language(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs (doc_id, text, lang, ...).

    Learned from texts with a lang outside the held-out fold of crc32(doc_id), all of them; a text counts once however
    long it is. score is the cosine with the prototype of lang_pred, 0 where that is negative. A text that is null, empty
    or without letters is `und` with score 0, so is any text where nothing could be learned. Equal cosines go to the
    language that sorts first. Repeated rows are learned as often as they occur and get equal results; a null doc_id is
    in no fold but learned from; texts are read whole at any length; an empty table gives an empty one; other columns
    are ignored. Prototypes, 8 KB a language, go out with the tasks.
    """
    langs, prototypes = train(docs, folds, held_out)
    model = docs.sparkSession.sparkContext.broadcast((langs, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = model.value
        bundler = Bundler()
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                v = bundler.bundle([t or "" for t in b.column(2).to_pylist()])
                norm = np.sqrt((v * v).sum(axis=1))
                if names:
                    cosine = (v @ p.T) / np.where(norm, norm, 1)[:, None]
                    top = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(v)), top], 0, 1)
                    pred = [names[k] if n else UNKNOWN for k, n in zip(top, norm, strict=True)]
                else:
                    score, pred = np.zeros(len(v)), [UNKNOWN] * len(v)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [f.split()[0] for f in _OUT.split(", ")])

    held = F.col("doc_id").isNotNull() & (bucket("doc_id", folds) == held_out)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, _OUT)

