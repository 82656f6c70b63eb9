"""Points of a frame: those outside all boxes, filters, voxels and shapes.

The order is fixed: box removal, ego box, range, voxels, then height of the voxels' means.
Points with a coordinate that isn't a number are dropped first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C

FRAME = ["scene_id", "frame_index"]
CELL = 16.0
#: x, y, z bounds of the recording vehicle itself.
EGO = ((-2.0, 2.8), (-1.2, 1.2), (-1.0, 2.5))


def numeric(points: DataFrame) -> DataFrame:
    return points.where(" and ".join(f"{a} is not null and not isnan({a})" for a in "xyz"))


def oriented(boxes: DataFrame) -> DataFrame:
    """Boxes whose nine numbers are all there, with the rows of their rotation."""
    whole = boxes.dropna(subset=[f"{p}_{a}" for p in ("position", "rotation", "scale") for a in C.AXES])
    r = C.rotation(F.col("rotation_x"), F.col("rotation_y"), F.col("rotation_z"))
    return whole.withColumns({f"r{i}{j}": r[i][j] for i in range(3) for j in range(3)})


def outside_boxes(points: DataFrame, boxes: DataFrame, margin: float = 0.05, cell: float = CELL) -> DataFrame:
    """Points that are in no box of their frame, faces included, sides widened by margin.

    Boxes are listed under all grid cells that they may reach, so the anti join is on frame and
    cell, and the exact test is left for the few boxes of a cell.
    """
    half = {a: F.col(f"scale_{a}") / 2 * (1 + margin) for a in C.AXES}
    reach = F.sqrt(sum((h * h for h in half.values()), F.lit(0.0)))
    cells = lambda a: F.sequence(F.floor((F.col(f"position_{a}") - reach) / cell), F.floor((F.col(f"position_{a}") + reach) / cell))
    b = oriented(boxes).select(
        *FRAME, *[F.col(f"position_{a}").alias(f"c{a}") for a in C.AXES], *[h.alias(f"h{a}") for a, h in half.items()],
        *[f"r{i}{j}" for i in range(3) for j in range(3)], cells("x").alias("gxs"), cells("y").alias("gys"))
    b = b.withColumn("gx", F.explode("gxs")).withColumn("gy", F.explode("gys")).drop("gxs", "gys")
    p = numeric(points).withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    off = [F.col(a) - F.col(f"c{a}") for a in C.AXES]
    local = [sum((F.col(f"r{i}{j}") * off[i] for i in range(3)), F.lit(0.0)) for j in range(3)]
    inside = (F.abs(local[0]) <= F.col("hx")) & (F.abs(local[1]) <= F.col("hy")) & (F.abs(local[2]) <= F.col("hz"))
    same = [p[c] == b[c] for c in (*FRAME, "gx", "gy")]
    return p.join(b, [*same, inside], "left_anti").drop("gx", "gy")


def outside_ego(points: DataFrame, bounds: tuple = EGO) -> DataFrame:
    inside = F.lit(True)
    for a, (low, high) in zip(C.AXES, bounds, strict=True):
        inside = inside & F.col(a).between(low, high)
    return points.where(~inside)


def within_range(points: DataFrame, most: float | None = 100.0) -> DataFrame:
    return points if most is None or most <= 0 else points.where(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) <= most)


def voxels(points: DataFrame, side: float = 0.2) -> DataFrame:
    """Means of the points of each cube; cubes are counted from the origin downwards as well."""
    keys = [F.floor(F.col(a) / side).alias(f"v{a}") for a in C.AXES]
    return points.groupBy(*FRAME, *keys).agg(F.count("x").alias("points"), *[F.avg(a).alias(a) for a in C.AXES])


def above_ground(means: DataFrame, low: float = 0.3, high: float | None = None) -> DataFrame:
    return means.where((F.col("z") > low) & (F.lit(True) if high is None else F.col("z") < high))


def residual(points: DataFrame, boxes: DataFrame, margin: float = 0.05, most: float | None = 100.0, side: float = 0.2, low: float = 0.3) -> DataFrame:
    """What clustering works on."""
    return above_ground(voxels(within_range(outside_ego(outside_boxes(points, boxes, margin)), most), side), low)


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Of a symmetric 3 x 3 matrix, largest first, in closed form."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off
    p = F.sqrt(p2 / 6)
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    r = F.greatest(F.least(F.try_divide(det, 2 * p * p * p), F.lit(1.0)), F.lit(-1.0))
    phi = F.acos(F.coalesce(r, F.lit(1.0))) / 3
    one, three = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return [one, 3 * q - one - three, three]


def shapes(points: DataFrame, by: list[str], sample: bool = False) -> DataFrame:
    """Bounds, volume and how flat each group is: 0 like a line or a plane, 1 like a ball.

    Groups of fewer than three points, or without any spread, have 0 for both ratios.
    """
    cov = F.covar_samp if sample else F.covar_pop
    pairs = {"xx": ("x", "x"), "yy": ("y", "y"), "zz": ("z", "z"), "xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z")}
    g = points.groupBy(*by).agg(
        F.count("x").alias("points"), *[F.min(a).alias(f"min_{a}") for a in C.AXES], *[F.max(a).alias(f"max_{a}") for a in C.AXES],
        *[F.avg(a).alias(f"mean_{a}") for a in C.AXES], *[cov(*p).alias(k) for k, p in pairs.items()])
    g = g.withColumns(dict(zip(("l1", "l2", "l3"), eigenvalues(*[F.col(k) for k in pairs]), strict=True)))
    spread = (F.col("points") >= 3) & (F.col("l1") > 1e-12)
    flat = 1 - F.greatest((F.col("l1") - F.col("l2")) / F.col("l1"), (F.col("l2") - F.col("l3")) / F.col("l1"))
    extent = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in C.AXES]
    return g.withColumns({
        "volume": extent[0] * extent[1] * extent[2],
        "flatness": F.when(spread, flat).otherwise(0.0),
        "thickness": F.when(spread, F.col("l3") / F.col("l1")).otherwise(0.0),
    }).drop(*pairs, "l1", "l2", "l3")
