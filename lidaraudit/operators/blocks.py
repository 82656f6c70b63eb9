"""HDBSCAN of frames whose distances no task could hold: Spark deals their points out in blocks.

Each pass sends points to the blocks within reach of them and works on a block at a time (see
spanning for what makes that exact): core distances, then each block's own tree, then edges between what is still apart. The
reach doubles from pass to pass, and only blocks that have open points are dealt out again. A frame's own task
holds its edges, a few for each point, and never its distances.

Each frame begins with its own reach, the longest at which no block has more than block_points points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C
from lidaraudit.functions.storage import stored
from lidaraudit.operators import hierarchy, spanning
from lidaraudit.operators.cloud import FRAME

#: Halvings of a frame's extent that are tried.
LEVELS = 24
EDGE = "scene_id string, frame_index int, a long, b long, length double"
#: kind 0: an edge of the forest; 1: point a lies in part b.
FOREST = "kind int, " + EDGE


def with_reach(points: DataFrame, block_points: int) -> DataFrame:
    """points with the bounds of their frame (ox, oy, oz, extent) and its reach."""
    bounds = points.groupBy(*FRAME).agg(*[f(a).alias(f"{p}{a}") for a in C.AXES for f, p in ((F.min, "o"), (F.max, "m"))])
    size = [F.col(f"m{a}") - F.col(f"o{a}") for a in C.AXES]
    widest = F.greatest(*size)
    bounds = bounds.select(*FRAME, *[f"o{a}" for a in C.AXES], F.sqrt(sum((s * s for s in size), F.lit(0.0))).alias("extent"), F.when(widest > 0, widest).otherwise(1.0).alias("widest"))
    levels = points.join(bounds, FRAME).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    cell = [F.floor((F.col(a) - F.col(f"o{a}")) / (F.col("widest") / F.pow(F.lit(2.0), "level"))).alias(f"c{a}") for a in C.AXES]
    most = levels.groupBy(*FRAME, "level", *cell).count().groupBy(*FRAME, "level").agg(F.max("count").alias("most"))
    level = most.groupBy(*FRAME).agg(F.coalesce(F.min(F.when(F.col("most") <= block_points, F.col("level"))), F.lit(LEVELS)).alias("level"))
    reach = F.col("widest") / F.pow(F.lit(2.0), "level") / spanning.SIDES_PER_REACH
    return points.join(bounds.join(level, FRAME).withColumn("reach", reach).drop("widest", "level"), FRAME)


def dealt(points: DataFrame, work, schema: str) -> DataFrame:
    """work(rows) of each block that has asked points: its own rows and those within reach (own tells which)."""
    side = F.col("reach") * spanning.SIDES_PER_REACH
    cell = lambda v, a: F.floor((v - F.col(f"o{a}")) / side)
    room = F.col("reach") * 1.000001
    rows = points.withColumns({f"h{a}": cell(F.col(a), a) for a in C.AXES})
    wanted = rows.where("asked").select(*FRAME, *[F.col(f"h{a}").alias(f"c{a}") for a in C.AXES]).distinct()
    for a in C.AXES:
        rows = rows.withColumn(f"c{a}", F.explode(F.sequence(cell(F.col(a) - room, a), cell(F.col(a) + room, a))))
    own = (F.col("hx") == F.col("cx")) & (F.col("hy") == F.col("cy")) & (F.col("hz") == F.col("cz"))
    block = [*FRAME, *[f"c{a}" for a in C.AXES]]
    rows = rows.withColumn("asked", F.col("asked") & own).join(wanted, block, "left_semi")
    return rows.groupBy(*block).applyInPandas(lambda part: work(part.sort_values("point_idx", ignore_index=True)), schema)


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows[list(C.AXES)].to_numpy(float), rows["point_idx"].to_numpy(np.int64), np.flatnonzero(rows["asked"].to_numpy(bool))


def _frame(rows: pd.DataFrame, **columns) -> pd.DataFrame:
    found = pd.DataFrame(columns)
    found.insert(0, "frame_index", rows["frame_index"].iloc[0])
    found.insert(0, "scene_id", rows["scene_id"].iloc[0])
    return found


def with_core(points: DataFrame, k: int) -> DataFrame:
    """points (with_reach) with core, their distance to the k-th nearest; all frames have k points at least."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        places, ids, asked = _arrays(rows)
        far = spanning.kth_nearest(places[asked], places, k)
        reach, extent = rows["reach"].iloc[0], rows["extent"].iloc[0]
        done = far <= (np.inf if reach > extent else reach)
        return _frame(rows, point_idx=ids[asked[done]], core=far[done])

    open_ = points.withColumn("core", F.lit(None).cast("double"))
    while True:
        found = dealt(open_.withColumn("asked", F.col("core").isNull()), work, "scene_id string, frame_index int, point_idx long, core double")
        open_ = stored(open_.drop("core").join(found.unionByName(open_.where("core is not null").select(*FRAME, "point_idx", "core")), [*FRAME, "point_idx"], "left").withColumn("reach", F.col("reach") * 2), "core")
        if open_.where("core is null").isEmpty():
            return open_


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """The spanning forest of a frame's edges, and the part of each of its points."""
    nodes, number = np.unique(np.concatenate([rows["a"], rows["b"]]), return_inverse=True)
    a, b = number.reshape(2, -1)
    kept, part = spanning.kruskal(a, b, rows["length"].to_numpy(float), len(nodes))
    edges = _frame(rows, kind=0, a=nodes[a[kept]], b=nodes[b[kept]], length=rows["length"].to_numpy(float)[kept])
    return pd.concat([edges, _frame(rows, kind=1, a=nodes, b=nodes[part], length=0.0)])[["kind", "scene_id", "frame_index", "a", "b", "length"]]


def _prim(rows: pd.DataFrame) -> pd.DataFrame:
    places, ids, _ = _arrays(rows)
    low, high, length = spanning.prim(places, rows["core"].to_numpy(float), ids)
    near = length <= rows["reach"].iloc[0]
    return _frame(rows, a=low[near], b=high[near], length=length[near])


def _between(rows: pd.DataFrame) -> pd.DataFrame:
    places, ids, asked = _arrays(rows)
    low, high, length = spanning.between_parts(asked, places, rows["core"].to_numpy(float), rows["part"].to_numpy(np.int64), ids, rows["reach"].iloc[0])
    return _frame(rows, a=low, b=high, length=length)


def trees(points: DataFrame, k: int, block_points: int = spanning.BLOCK_POINTS) -> DataFrame:
    """EDGE rows: the spanning tree of each frame of points (scene_id, frame_index, point_idx, x, y, z)."""
    placed = stored(with_reach(points, block_points), "reach")
    cored = with_core(placed, k).select(*FRAME, "point_idx", "core")
    placed = stored(placed.join(cored, [*FRAME, "point_idx"]), "points")
    edges = dealt(placed.withColumn("asked", F.lit(True)), _prim, EDGE)
    while True:
        forest = stored(edges.groupBy(*FRAME).applyInPandas(_forest, FOREST), "forest")
        edges = forest.where("kind = 0").drop("kind")
        parts = forest.where("kind = 1").select(*FRAME, F.col("a").alias("point_idx"), F.col("b").alias("part"))
        placed = placed.drop("part").join(parts, [*FRAME, "point_idx"], "left").withColumn("part", F.coalesce("part", "point_idx"))
        sizes = placed.groupBy(*FRAME, "part").count().groupBy(*FRAME).agg(F.max_by("part", F.struct("count", -F.col("part"))).alias("largest"))
        placed = stored(placed.withColumn("reach", F.col("reach") * 2).join(sizes, FRAME).withColumn("asked", F.col("part") != F.col("largest")).drop("largest"), "parts")
        if placed.where("asked").isEmpty():
            return edges
        edges = edges.unionByName(dealt(placed, _between, EDGE))


def hdbscan(points: DataFrame, min_cluster_size: int, min_samples: int, selection: str, block_points: int = spanning.BLOCK_POINTS) -> DataFrame:
    """scene_id, frame_index, point_idx, label, confidence of frames that have min_samples points and two at least."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, number = np.unique(np.concatenate([rows["a"], rows["b"]]), return_inverse=True)
        a, b = number.reshape(2, -1)
        length = rows["length"].to_numpy(float)
        order = np.lexsort((b, a, length))
        label, sure = hierarchy.labels(a[order], b[order], length[order], min_cluster_size, selection)
        return _frame(rows, point_idx=nodes, label=label, confidence=sure)

    return trees(points, min_samples, block_points).groupBy(*FRAME).applyInPandas(work, "scene_id string, frame_index int, point_idx long, label int, confidence double")
