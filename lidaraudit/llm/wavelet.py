"""Token ids in files of wavelet matrices.

Documents are dealt to ranges of ascending doc_id, encoded (one id 0 after each) and written
as shards of about SHARD_TOKENS ids. A shard is one value of a binary column of a Parquet
file, compressed by the file's codec, so writing survives lost executors and any store that
Spark reaches will do. A shard holds its documents' ids and lengths and a wavelet matrix of
its tokens: for each bit of an id, highest first, a plane with that bit of all tokens, after
which tokens are parted stably into those with 0 and those with 1. Counts of ones before each
block of 512 bits answer rank; with it a token is read (`access`), counted (`count`,
`rank`) or found (`select`) without unpacking the shard, and `tokens` unpacks it whole.

Layout, little-endian: "WVM1", bits u8, documents u32, tokens u64; doc_id i64 each; null flag
u8 each; length u32 each; then per plane: zeros u64, ones before each block u32, bits packed.

Defined cases: a null text is an empty one; an empty text is the single id 0; null doc_ids
come first; rows that share doc_id are separate documents, in the order of their text's
hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lidaraudit.llm.common import mapped, read_documents, written
from lidaraudit.llm.encoding import default_vocabulary, encoder, ids_crc32

SHARD_TOKENS = 1 << 20
BLOCK = 512
END_ID = 0
HEAD = struct.Struct("<4sBIQ")


class WaveletMatrix:
    def __init__(self, bits: int, size: int, planes: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.bits, self.size, self.planes = bits, size, planes  # of a plane: zeros, ones before each block, bits

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits, planes, now = max(1, int(ids.max(initial=0)).bit_length()), [], ids
        for level in range(bits - 1, -1, -1):
            plane = (now & ids.dtype.type(1 << level)) != 0
            packed = np.packbits(plane, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(packed).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
            low = np.flatnonzero(~plane)  # taking by places is faster than by a mask
            planes.append((len(low), np.concatenate([[0], np.cumsum(ones)]).astype("<u4"), packed))
            now = now[np.concatenate([low, np.flatnonzero(plane)])]
        return cls(bits, len(ids), planes)

    def tokens(self) -> np.ndarray:
        """All tokens: from the last plane up, each part goes back to the places of its bits."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.size, kind)
        for level, (zeros, _, packed) in enumerate(reversed(self.planes)):
            plane = np.unpackbits(packed, count=self.size, bitorder="little").view(bool)
            up = np.empty(self.size, kind)
            up[np.flatnonzero(~plane)] = now[:zeros]
            up[np.flatnonzero(plane)] = now[zeros:] | kind(1 << level)
            now = up
        return now

    def _ones(self, level: int, i: int) -> int:
        _, before, packed = self.planes[level]
        a = i // BLOCK
        rest = packed[a * (BLOCK // 8) : i // 8]
        tail = int(packed[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(before[a]) + int(np.bitwise_count(rest).sum()) + tail.bit_count()

    def access(self, i: int) -> int:
        value = 0
        for level, (zeros, _, packed) in enumerate(self.planes):
            bit, ones = packed[i // 8] >> (i % 8) & 1, self._ones(level, i)
            i = zeros + ones if bit else i - ones
            value = value * 2 + int(bit)
        return value

    def _span(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of token before place i stand after the last plane."""
        a, b = 0, i
        for level, (zeros, _, _) in enumerate(self.planes):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (zeros + x, zeros + y) if token >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before place i."""
        a, b = self._span(token, i) if token >> self.bits == 0 else (0, 0)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, k: int) -> int:
        """The place of occurrence k (from 0) of token."""
        a, b = self._span(token, self.size) if token >> self.bits == 0 else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            zeros, before, _ = self.planes[level]
            bit, want = i >= zeros, i - zeros if i >= zeros else i
            low, high = 0, self.size  # the last place with want such bits before it
            while low < high:
                middle = (low + high + 1) // 2
                ones = self._ones(level, middle)
                low, high = (middle, high) if (ones if bit else middle - ones) <= want else (low, middle - 1)
            i = low
        return i


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    m = WaveletMatrix.build(ids)
    parts = [HEAD.pack(b"WVM1", m.bits, len(doc_ids), m.size), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), lengths.astype("<u4").tobytes()]
    for zeros, before, packed in m.planes:
        parts += [struct.pack("<Q", zeros), before.tobytes(), packed.tobytes()]
    return b"".join(parts)


def from_bytes(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, lengths, matrix."""
    magic, bits, docs, size = HEAD.unpack_from(blob)
    if magic != b"WVM1":
        raise ValueError("not a shard of token ids")
    at = HEAD.size
    doc_ids, null = np.frombuffer(blob, "<i8", docs, at).tolist(), np.frombuffer(blob, np.uint8, docs, at + 8 * docs).tolist()
    lengths = np.frombuffer(blob, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    blocks, planes = -(-size // BLOCK), []
    for _ in range(bits):
        (zeros,) = struct.unpack_from("<Q", blob, at)
        before = np.frombuffer(blob, "<u4", blocks + 1, at + 8)
        at += 8 + 4 * (blocks + 1)
        planes.append((zeros, before, np.frombuffer(blob, np.uint8, blocks * (BLOCK // 8), at)))
        at += blocks * (BLOCK // 8)
    return [None if x else d for d, x in zip(doc_ids, null, strict=True)], lengths, WaveletMatrix(bits, size, planes)


def _shards(vocabulary: str, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, start = encoder(vocabulary), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            nonlocal start, doc_ids, lengths, ids
            n, all_ids = np.concatenate(lengths), np.concatenate(ids)
            row = pa.RecordBatch.from_pydict({"part": [part], "part_start": [start], "n_tokens": [len(all_ids)], "shard": [to_bytes(doc_ids, n, all_ids)]})
            start, doc_ids, lengths, ids = start + len(all_ids), [], [], []
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = batch.slice(at, 1000)
                got, n = e.encode(own["text"])
                ids.append(np.insert(got, np.cumsum(n), END_ID))
                lengths.append(n + 1)
                doc_ids += own["doc_id"].to_pylist()
                if sum(map(len, ids)) >= shard_tokens:
                    yield shard()
        if doc_ids:
            yield shard()

    return write


def write_shards(docs: DataFrame, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS, path: str | None = None) -> DataFrame:
    """The written shards: part (range of doc_id), part_start (ids of the part before the shard), n_tokens, shard.

    They are a Parquet folder at path, which must be new, or one in spark.checkpoint.dir.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = ordered.transform(mapped, _shards(vocabulary or default_vocabulary(), shard_tokens), "part long, part_start long, n_tokens long, shard binary")
    if path is None:
        return written(shards, "shards")
    shards.write.parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, blob in zip(batch["part"].to_pylist(), batch["part_start"].to_pylist(), batch["shard"], strict=True):
            doc_ids, lengths, matrix = from_bytes(blob.as_buffer())
            tokens, ends = matrix.tokens().astype("<u4"), np.cumsum(lengths)
            crc = [ids_crc32(tokens[a:b]) for a, b in zip(ends - lengths, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(crc), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document, read from the shards: doc_id, start, n_tokens, ids_crc32."""
    docs = shards.select("part", "part_start", "shard").transform(mapped, _documents, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # as many rows as ranges
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(offsets, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op9_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read_documents(spark, sf_dir)))


QUERIES = {"op9_wavelet_matrix": op9_wavelet_matrix}
ORACLE: dict[str, str] = {}
