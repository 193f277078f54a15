"""Token ids of documents in sorted-string-table shards.

A shard file holds, in ascending order of keys:

    data blocks    entries (shared: varint, rest: varint, value: varint, key bytes after the shared prefix, value), about
                   64 KB; the key of a block's first entry is whole; a crc32 of the block follows it
    index block    for each data block: its last key, its place and its length
    Bloom filter   10 bits a key, 7 probes
    footer         40 bytes: places and lengths of index and filter, number of entries and of ids, format, magic

A key is the document's identifier, 8 bytes big-endian with the sign bit turned (null: none, so it comes first); its
value is the token ids, two or four bytes each, little-endian. A lookup reads the footer, asks the filter, finds the
block by binary search in the index, and reads that block alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corvane.llm.common import file_system, partitions, shared_dir, slices, strings
from corvane.llm.tokens import encoder

MAGIC, FORMAT = b"CVSST\x01", 1
_FOOTER = struct.Struct("<QIQIIQH6s")  # sizes checked in footer()
_BLOCK = 64 * 1024
_PROBES, _BITS = 7, 10


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Places of each key's bits: one row for each key."""
    a = np.array([zlib.crc32(k) for k in keys], np.uint64)
    b = np.array([zlib.adler32(k[::-1] + k) | 1 for k in keys], np.uint64) * np.uint64(0x9E3779B1)
    return (a[:, None] + b[:, None] * np.arange(1, _PROBES + 1, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Writes entries in ascending order of keys; equal keys keep their order."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.block, self.first = bytearray(), True
        self.last, self.index, self.keys = b"", [], []
        self.ids = 0

    def add(self, key: bytes, value: bytes, ids: int) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if not self.first:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.first = key, False
        self.keys.append(key)
        self.ids += ids
        if len(self.block) >= _BLOCK:
            self._close()

    def _write(self, data: bytes) -> tuple[int, int]:
        place = self.at, len(data)
        self.out.write(data)
        self.at += len(data)
        return place

    def _close(self) -> None:
        if self.block:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, *self._write(bytes(self.block))))
            self.block, self.first = bytearray(), True

    def close(self) -> tuple[int, int]:
        self._close()
        index = self._write(b"".join(_varint(len(k)) + k + struct.pack("<QI", a, n) for k, a, n in self.index))
        bits = max(64, -(-len(self.keys) * _BITS // 8) * 8)
        bloom = np.zeros(bits, bool)
        for at in range(0, len(self.keys), 100_000):
            bloom[_probes(self.keys[at : at + 100_000], bits).astype(np.int64).ravel()] = True
        bloom = self._write(np.packbits(bloom).tobytes())
        self._write(_FOOTER.pack(*index, *bloom, len(self.keys), self.ids, FORMAT, MAGIC))
        return len(self.keys), self.ids


class ShardReader:
    """Reads a shard: entries() in order, get(doc_id) by filter and binary search."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index, index_n, bloom, bloom_n, self.count, self.ids, form, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or form != FORMAT:
            raise ValueError(f"{uri} is no shard of this format")
        self.index, raw, at = [], self._at(index, index_n), 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key = raw[at : at + n]
            self.index.append((key, *struct.unpack_from("<QI", raw, at + n)))
            at += n + 12
        self.bloom = self._at(bloom, bloom_n)

    def _at(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _block(self, at: int, n: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._at(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        at, key, end = 0, b"", n - 4
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, n in self.index:
            yield from self._block(at, n)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of all entries with this identifier."""
        key = key_of(doc_id)
        for p in _probes([key], len(self.bloom) * 8)[0]:
            if not self.bloom[int(p) // 8] >> (7 - int(p) % 8) & 1:
                return []
        found = []
        for k in range(bisect_left([x[0] for x in self.index], key), len(self.index)):
            hits = [v for x, v in self._block(*self.index[k][1:]) if x == key]
            found += hits
            if self.index[k][0] > key:
                break
        return found


_MANIFEST = "shard int, path string, documents bigint, ids bigint, least bigint, most bigint"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, shards: int | None = None, width: int = 2) -> list:
    """Encodes docs (doc_id, text, ...) and writes shards in ascending order of doc_id; their manifest, in that order.

    Texts are dealt out by ranges of doc_id and sorted there (by text where ids repeat), then encoded and written as
    they come: a task holds a batch of texts. A file gets its name only when it is whole; a repeated task replaces it
    with the same bytes. The driver gets a row for each shard.
    """
    spark = docs.sparkSession
    n = shards or partitions(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sort = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    dtype = {2: "<u2", 4: "<u4"}[width]
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        fs, path = file_system(f"{folder}/shard-{shard:06d}.sst")
        part = f"{path}.{uuid.uuid4().hex}"
        writer, least, most = None, None, None
        stream = None
        for whole in batches:
            for b in slices(whole, "text"):
                if stream is None:
                    stream = fs.open_output_stream(part)
                    writer = ShardWriter(stream)
                for doc, ids in zip(b.column(0).to_pylist(), enc.encode(strings(b.column(1))), strict=True):
                    x = np.frombuffer(ids + last, "<u4")
                    if width == 2 and x.max() > 65535:
                        raise ValueError("ids need width=4")
                    writer.add(key_of(doc), x.astype(dtype).tobytes(), len(x))
                    least = doc if least is None else least
                    most = doc
        if writer is not None:
            count, ids = writer.close()
            stream.close()
            fs.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((shard, pa.int32()), (f"{folder}/shard-{shard:06d}.sst", pa.string()), (count, pa.int64()), (ids, pa.int64()), (least, pa.int64()), (most, pa.int64()))], [x.split()[0] for x in _MANIFEST.split(", ")])

    done = texts.repartitionByRange(n, sort[0], F.xxhash64("text")).sortWithinPartitions(*sort).mapInArrow(run, _MANIFEST).collect()
    return sorted(done, key=lambda r: r.shard)


_READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_shards(spark: SparkSession, manifest: list, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, read back from the files, a task for each shard or some."""
    dtype = {2: "<u2", 4: "<u4"}[width]
    rows, before = [], 0
    for m in manifest:
        rows.append((m.path, before))
        before += m.ids
    if not rows:
        return spark.createDataFrame([], _READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = []
                for key, value in ShardReader(path).entries():
                    ids = np.frombuffer(value, dtype)
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return spark.createDataFrame(rows, "path string, start bigint").mapInArrow(run, _READ)


def lookup(manifest: list, doc_id: int | None, width: int = 2) -> list[np.ndarray]:
    """The token ids of a document: the shards whose range may hold it, each asked by filter and binary search."""
    found = []
    for m in manifest:
        if doc_id is None or m.least is None or (m.most is not None and m.least <= doc_id <= m.most):
            found += [np.frombuffer(v, {2: "<u2", 4: "<u4"}[width]).astype(np.uint32) for v in ShardReader(m.path).get(doc_id)]
    return found


def store_tokens(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Writes the documents' token ids as shards in the shared folder, reads them back: (doc_id, start, n_tokens, ids_crc32).

    A document's ids are those of its text (null: none) and then `end`; start counts the ids of all documents before it
    in ascending order of doc_id, null first; rows that share a doc_id are documents of their own, in one order of
    their texts or of their hashes. Texts of any length are encoded whole. Other columns are ignored; an empty table
    writes no shard and gives an empty result.
    """
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, shared_dir(spark), tokenizer, end))
