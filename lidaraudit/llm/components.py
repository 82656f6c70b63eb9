"""Connected components of a graph given by its edges, for graphs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidaraudit.llm.common import mapped, written


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a-b and the least node of the component of each."""
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: batch by batch, each with the stars before it."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = roots(np.concatenate([a, batch["a"].to_numpy()]), np.concatenate([b, batch["b"].to_numpy()]))
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame, most_rounds: int = 40, shrink: bool = True) -> DataFrame:
    """node, component (its least node) for the nodes of edges a-b (longs).

    Rounds of large and small stars (Kiveris et al. 2014): each node's larger neighbours are
    linked to its least one, then its smaller ones to its least one, until nothing changes.
    Tasks first shrink their edges to stars, and the stars of a node meet once, so rounds move about one row per
    node however many edges there were; where edges are forests already, as those of tiles are, this is left
    out, and with it a second Python worker per task.
    """
    own = edges.select("a", "b").where("a <> b")
    if shrink:
        stars = own.transform(mapped, _forest, "a long, b long")
        # A node has a root in each task that knew it, at most as many as tasks: it keeps the least, to which the others are linked.
        roots_of = stars.groupBy("b").agg(F.collect_set("a").alias("roots")).withColumn("least", F.array_min("roots"))
        each = F.transform("roots", lambda r: F.struct(F.col("least").alias("a"), F.when(r == F.col("least"), F.col("b")).otherwise(r).alias("b")))
        own = roots_of.select(F.explode(each).alias("e")).select("e.*").distinct()
    now = written(own, "stars")
    seen = None
    for _ in range(most_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join is one of two shuffles, which Spark splits where a node has very many edges.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = written(small, "stars")
        state = tuple(now.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first())
        if state == seen or state[0] == state[2] and not now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").head(1):
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
