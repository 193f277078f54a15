"""Toxicity by multiple-instance learning: sentences are scored, labels are known for documents only.

A sentence's logit is a bias plus the weights of its words; a word's weight is the sum of the weights of its features:
the word and its beginnings of three to seven letters, hashed. A document is toxic unless all its sentences are clean
(noisy-or): P = 1 - prod(1 - sigmoid(z_s)). Weights are fitted to document labels alone, by gradient steps scaled by
sums of squared gradients; the sentences' own probabilities then show where a document offends.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bucket, strings

BITS = 18
#: Labelled documents that are fitted to, at most about this many of each label; chosen by a hash of doc_id.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
#: Words of one instance: longer sentences count as several, shorter ones go with the next.
LONGEST, SHORTEST = 40, 8
#: Words whose weights a task remembers.
REMEMBERED = 400_000
_END = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def instances(low: str) -> Iterator[list[str]]:
    """The words of each instance: sentences in a row until they have SHORTEST words, and parts of LONGEST words of long ones."""
    held: list[str] = []
    for part in _END.split(low):
        held += _WORD.findall(part)
        if len(held) >= SHORTEST:
            if len(held) <= LONGEST:
                yield held
            else:
                n = -(-len(held) // LONGEST)
                for k in range(n):
                    yield held[k * len(held) // n : (k + 1) * len(held) // n]
            held = []
    if held:
        yield held


def features(word: str) -> list[int]:
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in {"=" + word, *(word[:n] for n in range(3, 8) if len(word) >= n)}]


def _sums(at: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[of] by `at`, n of them, as bincount gives them; a quarter of a million at a time, so that no array of their length is made."""
    out = np.zeros(n)
    for a in range(0, len(at), 1 << 18):
        np.add.at(out, at[a : a + (1 << 18)], values[of[a : a + (1 << 18)]])
    return out


def fit(labelled: Iterable[tuple[str, int]], rounds: int = 120, rate: float = 0.4, l2: float = 2e-4, least: int = 3, weight: float = 4.0) -> np.ndarray:
    """Weights of the features, and the bias last. Features in fewer than `least` documents keep weight 0; a toxic document counts `weight` times. Texts are read once and one at a time; four bytes for each word and its place are kept."""
    number: dict[str, int] = {}
    word, sent, doc, f, f_word, held_by = (array("i") for _ in range(6))
    labels, n_sent = [], 0
    for d, (t, label) in enumerate(labelled):
        labels.append(label)
        own: set[int] = set()
        for words in instances(_lower(t)):
            for w in set(words):
                k = number.setdefault(w, len(number))
                if not f_word or f_word[-1] < k:
                    x = features(w)
                    f.extend(x)
                    f_word.extend([k] * len(x))
                    held_by.append(0)
                own.add(k)
                word.append(k)
                sent.append(n_sent)
            doc.append(d)
            n_sent += 1
        for k in own:
            held_by[k] += 1
    n_words = len(number)
    del number
    theta = np.zeros((1 << BITS) + 1)
    theta[-1] = -5.0
    if not n_sent or not any(labels) or all(labels):
        theta[-1] = 3.0 if n_sent and all(labels) else -9.0
        return theta
    word, sent, doc, f, f_word, held_by = (np.frombuffer(x, np.int32) for x in (word, sent, doc, f, f_word, held_by))
    df = _sums(f, held_by, f_word, 1 << BITS)
    keep = df[f] >= least
    f, f_word = f[keep], f_word[keep]
    y = np.array(labels)[doc].astype(bool)
    squares = np.full(len(theta), 1e-4)
    for _ in range(rounds):
        z = _sums(sent, _sums(f_word, theta, f, n_words), word, n_sent) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.bincount(doc, np.logaddexp(0, z), len(labels))[doc]
        clean = np.exp(-total)
        g = np.where(y, -weight * p * clean / np.maximum(1 - clean, 1e-9), p)
        step = np.zeros(len(theta))
        step[:-1] = _sums(f, _sums(word, g, sent, n_words), f_word, 1 << BITS)
        step[-1] = g.sum()
        step = step / len(labels)
        step[:-1] += l2 * theta[:-1]
        squares += step * step * 1e4
        theta -= rate * step * 1e2 / np.sqrt(squares)
    return theta


class Scorer:
    def __init__(self, theta: np.ndarray):
        self.theta, self.bias, self.known = theta, float(theta[-1]), {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            w = float(sum(self.theta[f] for f in features(word)))
            if len(self.known) < REMEMBERED:
                self.known[word] = w
        return w

    def logits(self, text: str) -> list[float]:
        weight = self.weight
        return [self.bias + sum(map(weight, set(words))) for words in instances(_lower(text))]

    def sentences(self, text: str, least: float) -> list[tuple[int, int, float]]:
        """(start, end, logit) of the instances from `least` on."""
        low, at, out = _lower(text), 0, []
        spans = [m.span() for m in _WORD.finditer(low)]
        for words in instances(low):
            z = self.bias + sum(map(self.weight, set(words)))
            if z >= least:
                out.append((spans[at][0], spans[at + len(words) - 1][1], z))
            at += len(words)
        return out


def noisy_or(logits: list[float]) -> float:
    return float(-np.expm1(-np.logaddexp(0, np.array(logits)).sum())) if logits else 0.0


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> np.ndarray:
    """Fits to labelled documents outside the held-out fold, a bounded sample of each label; one task gets those texts, the driver the weights only."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(bucket("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {t: min(1.0, most / max(1, counts.get(t, 0))) for t, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(((F.col("toxic") == 1) & (draw < share[1])) | ((F.col("toxic") == 0) & (draw < share[0])))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # about MAX_TOXIC + MAX_CLEAN rows of two numbers, so texts needn't be shuffled to meet them
    small = F.broadcast(chosen.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = fit((t.as_py() or "", y.as_py()) for b in batches for t, y in zip(b.column(0), b.column(1), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([theta.tobytes()], pa.binary())], ["theta"])

    rows = d.join(small, "doc_id").repartition(1).sortWithinPartitions("doc_id", "text", "y")
    got = rows.select("text", "y").mapInArrow(run, "theta binary").first()
    return fit([]) if got is None else np.frombuffer(got.theta)


_OUT = "doc_id bigint, score double, predicted int, offending array<struct<start: bigint, end: bigint, score: double>>"


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending), one row for each row of docs (doc_id, text, ...).

    labels (doc_id, toxic, ...): rows outside the held-out fold of crc32(doc_id) are learned from; a doc_id with several
    labels is toxic if one says so; null or other labels are ignored. offending lists the sentences whose own
    probability reaches the threshold. Null, empty and wordless texts score 0. Without labels of both kinds every
    document gets the prior. Repeated rows get equal results, a null doc_id is not held out, other columns are ignored.
    Texts are scored whole however long, sentence by sentence; empty tables give empty results. A score of just the
    threshold counts as toxic. The model, two megabytes whatever the input, goes out with the tasks.
    """
    theta = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(theta.value)
        cut = np.log(threshold / (1 - threshold))
        for b in batches:
            scores, bad = [], []
            for t in strings(b.column(1)):
                z = scorer.logits(t)
                scores.append(noisy_or(z))
                bad.append([{"start": s, "end": e, "score": float(1 / (1 + np.exp(-z)))} for s, e, z in scorer.sentences(t, cut)] if z and max(z) >= cut else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(bad, kind)], ["doc_id", "score", "predicted", "offending"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = d.mapInArrow(run, _OUT)
    return out.select("doc_id", (F.col("doc_id").isNotNull() & (bucket("doc_id", folds) == held_out)).alias("held_out"), "score", "predicted", "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, the same columns, without the rows that score `threshold` or more.

    Rows are judged one by one: repeated ones go or stay together, whatever their doc_id, which may be null. Null, empty
    and wordless texts score 0 and stay; texts of any length are scored whole; other columns may have any names; an empty
    table stays empty; without labels of both kinds nothing is rejected but where all known labels are toxic.
    """
    theta = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(theta.value)
        for b in batches:
            yield b.filter(pa.array([noisy_or(scorer.logits(t)) < threshold for t in strings(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
