"""What the text operators share: reading, working folders, word hashing over Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are hashed at a time; a longer text is hashed alone.
CHUNK_BYTES = 1 << 20
#: `[^\x20\x09-\x0D]+` of the contracts: these bytes end a word.
SPACES = bytes([32, *range(9, 14)])


#: Bytes of rows that go to a Python worker at a time; long texts would fill hundreds of MB by count alone.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, on the JVM's side as well as in the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, as in tests on local[*], a temporary folder is set.
    On a cluster without the setting this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lidaraudit-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that this worker has freed to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
        trim.malloc_trim(0)


def mapped(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInArrow(work, schema), whose tasks give memory back when they end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def grouped(work):
    """work for applyInPandas or applyInArrow, which gives memory back after each group."""

    @functools.wraps(work)  # Spark reads the annotations
    def whole(key, rows):
        try:
            return work(key, rows)
        finally:
            give_back()

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of a buffer at once.

    A word's hash is the sum of table[byte] * base**(place in the word), which a running
    sum over the buffer gives for every word; a power of the inverse base moves it to place 0.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, spaces: bytes = SPACES) -> None:
        values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        values[65:91] = values[97:123]  # A-Z count as a-z
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[list(spaces)] = True
        self.room(CHUNK_BYTES)

    def room(self, n: int) -> None:
        step = np.full(n + 1, self.BASE, np.uint64)
        back = np.full(n + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        self.power, self.inverse = np.cumprod(step), np.cumprod(back)

    def words(self, data: np.ndarray, ends: np.ndarray, stem: int | None = None) -> tuple[np.ndarray, ...]:
        """Hashes of all words, how many words each text has, and hashes of the first `stem` bytes of each word.

        data: the bytes of the texts, one after the other; ends: where each text ends.
        """
        if len(data) >= len(self.power):
            self.room(len(data))
        if not len(data):
            none = np.zeros(0, np.uint64)
            return (none, np.zeros(len(ends), np.int64), none)[: 2 + (stem is not None)]
        inside = ~self.space[data]
        cut = np.zeros(len(data) + 1, bool)  # a text begins here
        cut[0] = True
        cut[ends] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:-1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=total[1:])
        upto = np.searchsorted(starts, ends)
        counts = np.diff(upto, prepend=0)
        hashes = mix64((total[stops] - total[starts]) * self.inverse[starts])
        if stem is None:
            return hashes, counts
        return hashes, counts, mix64((total[np.minimum(stops, starts + stem)] - total[starts]) * self.inverse[starts])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 borders of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    borders = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of at most limit bytes (or one longer text): first, past last, bytes, ends."""
    data, borders = text_buffer(column)
    a, n = 0, len(borders) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(borders, borders[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[borders[a] : borders[b]], borders[a + 1 : b + 1] - borders[a]
        a = b


def runs(ends: np.ndarray) -> np.ndarray:
    """Index of the text for each of its items, given how many items each has."""
    return np.repeat(np.arange(len(ends)), ends)
