"""Best-fit packing of documents into sequences, with certified bin counts and repacking.

Documents are encoded (one id 0 after each) and only those longer than a sequence are cut:
into whole sequences, the first piece taking what is left over. Whole sequences need no
packing. The other pieces are dealt to groups of about GROUP_PIECES by a hash, and each group
is packed by best-fit decreasing. Dual feasible functions give a lower bound of a group's
bins: a function f with sum f(x) <= 1 for all pieces x that fit one bin turns sizes into a
bound, the sum of f over all pieces. A group that meets its bound is certified: no other packing of it has
fewer bins, so it is closed but for its emptiest bin. Of a group that doesn't, all bins with a gap of more
than GAP tokens stay open. Open bins of several groups meet in new groups, exchange their documents and are packed
again; a new packing is kept when it has fewer bins than came in. Rounds end when the bins of all are as few as the bound
of all pieces together says, when one group holds all that is open, or when a round saves nothing.

Defined cases: a null text is an empty one; an empty text is the single id 0; rows that share
doc_id are separate documents; equal sizes go by doc_id, piece, start and checksum, so
reruns agree; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.llm.common import mapped, read_documents, written
from lidaraudit.llm.encoding import default_vocabulary, encoder, ids_crc32

CAPACITY = 2048
GROUP_PIECES = 8192
#: A bin with a gap of more tokens is repacked.
GAP = 16
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
PACKED = PIECES + ", sequence_id long, offset long, bin_bound long, group_bins long, open boolean"


def _cut(vocabulary: str, capacity: int):
    """A function for mapInArrow: documents to pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, uid = encoder(vocabulary), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = batch.slice(at, 500)
                ids, counts = e.encode(own["text"])
                rows: list[tuple] = []
                upto = 0
                for doc_id, n in zip(own["doc_id"].to_pylist(), counts.tolist(), strict=True):
                    doc = np.append(ids[upto : upto + n], np.uint16(END_ID)).astype("<u4")
                    upto += n
                    a, b, k = 0, (n + 1) % capacity or capacity, 0
                    while a <= n:
                        rows.append((doc_id, k, a, b - a, ids_crc32(doc[a:b]), uid))
                        a, b, k, uid = b, b + capacity, k + 1, uid + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 4], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return cut


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, the largest bound of two families of dual feasible functions."""
    return _bound(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def lower_bound_of(numbers: dict[int, int], capacity: int) -> int:
    """The same, given how many pieces there are of each size."""
    have = np.zeros(capacity + 1, np.int64)
    have[list(numbers)] = list(numbers.values())
    return _bound(have, capacity)


def _bound(have: np.ndarray, capacity: int) -> int:
    if not have.any():
        return 0
    x = np.arange(capacity + 1)
    best = -(-int((have * x).sum()) // capacity)
    # Sizes under e count nothing, those over capacity - e a whole bin.
    mass, number = np.concatenate([[0], np.cumsum(have * x)]), np.concatenate([[0], np.cumsum(have)])
    e = np.arange(1, capacity // 2 + 1)
    total = (number[-1] - number[capacity - e + 1]) * capacity + mass[capacity - e + 1] - mass[e]
    best = max(best, -(-int(total.max()) // capacity))
    # (k + 1) x / capacity rounded down, over k, unless it is whole.
    for k in range(1, 33):
        steps, rest = np.divmod((k + 1) * x, capacity)
        value = np.where(rest == 0, k * x, steps * capacity)
        best = max(best, -(-int((have * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For pieces in descending order: each one's bin and offset; and the room left in each bin."""
    of_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r is set when a bin has room r
    bins, offsets, rooms = [], [], []
    for n in sizes:
        if fit := there >> n:
            r = n + (fit & -fit).bit_length() - 1
            b = of_room[r].pop()
            if not of_room[r]:
                there &= ~(1 << r)
        else:
            r, b = capacity, len(rooms)
            rooms.append(capacity)
        bins.append(b)
        offsets.append(capacity - r)
        rooms[b] = r - n
        if rooms[b]:
            of_room[rooms[b]].append(b)
            there |= 1 << rooms[b]
    return bins, offsets, rooms


def _pack(capacity: int, turn: int):
    """A function for applyInPandas: one group of pieces to their places."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32", "uid"], ascending=[False, *[True] * 5], ignore_index=True)
        sizes = rows["length"].to_numpy()
        bins, offsets, rooms = best_fit_decreasing(sizes.tolist(), capacity)
        bound = lower_bound(sizes, capacity)
        had = rows["sequence_id"].nunique() if turn else len(rows) + 1
        certified = min(len(rooms), had) == bound
        if len(rooms) < had:
            rows["sequence_id"] = ((turn << 56) + (int(key[0]) << 32) + np.array(bins, np.int64)) * 2 + 1
            rows["offset"] = offsets
            room = np.array(rooms)[bins]
        else:
            room = capacity - rows.groupby("sequence_id")["length"].transform("sum").to_numpy()
        rows["open"] = room > GAP
        if certified and room.max() > GAP:
            rows["open"] = rows["sequence_id"] == rows["sequence_id"].iloc[int(room.argmax())]
        rows["bin_bound"], rows["group_bins"] = bound, min(len(rooms), had)
        return rows.drop(columns="group")

    return pack


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, bin_bound, group_bins."""
    cut = docs.select("doc_id", "text").transform(mapped, _cut(vocabulary or default_vocabulary(), capacity), PIECES)
    pieces = written(cut, "pieces")
    whole = pieces.where(F.col("length") == capacity).select(
        *pieces.columns, (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(1).cast("long").alias("bin_bound"), F.lit(1).cast("long").alias("group_bins"))
    sizes = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row per length, at most capacity
    bins, bound = sizes.get(capacity, 0), lower_bound_of(sizes, capacity)
    done, left = [whole], pieces.where(F.col("length") < capacity).select(
        *pieces.columns, F.lit(None).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("uid").alias("moves_with"))
    n, before, turn = sum(sizes.values()) - bins, None, 0
    while n:
        groups = -(-n // GROUP_PIECES)
        dealt = left.withColumn("group", F.pmod(F.xxhash64("moves_with", F.lit(turn)), F.lit(groups))).drop("moves_with")
        packed = written(dealt.groupBy("group").applyInPandas(_pack(capacity, turn), PACKED), "packed")
        first = F.col("offset") == 0  # one piece of each bin
        after, still, n = packed.agg(F.count_if(first), F.count_if(first & F.col("open")), F.count_if("open")).first()
        if bins + after <= bound or groups == 1 or after == before:
            done.append(packed.select(*whole.columns))
            break
        done.append(packed.where("not open").select(*whole.columns))
        left = packed.where("open").select(*pieces.columns, "sequence_id", "offset", F.col("sequence_id").alias("moves_with"))
        bins, before, turn = bins + after - still, still, turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("uid")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLE: dict[str, str] = {}
