"""Boxes and points in camera pictures: edge points, pinhole projection, regions and their quality."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C
from lidaraudit.operators.cloud import FRAME, oriented

EDGE_SAMPLES = 9
MIN_DEPTH, MIN_VISIBLE, PADDING = 0.1, 3, 8
#: least area, width, height; largest share of the picture; least visible points; margin; sides at the edge.
CLUSTER_QUALITY = {"area": 400, "width": 48, "height": 32, "ratio": 0.5, "visible": 8, "margin": 2, "sides": 1}
BOX_QUALITY = {"area": 2500, "width": 64, "height": 48, "ratio": 0.65, "visible": 12, "margin": 2, "sides": 2}


def edge_table(samples: int = EDGE_SAMPLES) -> list[tuple[float, float, float]]:
    """Points on the twelve edges of a cube from -0.5 to 0.5, corners once for each edge that they end."""
    steps, out = np.linspace(-0.5, 0.5, max(2, samples)).tolist(), []
    for axis in range(3):
        for u, v in itertools.product((-0.5, 0.5), repeat=2):
            for s in steps:
                p = [u, v]
                p.insert(axis, s)
                out.append(tuple(p))
    return out


def box_edge_points(boxes: DataFrame, samples: int = EDGE_SAMPLES) -> DataFrame:
    """A row for each edge point of each box with all nine numbers: candidate_id, x, y, z."""
    unit = F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in zip(p, C.AXES, strict=True)]) for p in edge_table(samples)])
    rows = oriented(boxes).select("*", F.posexplode(unit).alias("edge_point", "u"))
    local = [F.col(f"u.{a}") * F.col(f"scale_{a}") for a in C.AXES]
    world = [sum((F.col(f"r{i}{j}") * local[j] for j in range(3)), F.lit(0.0)) + F.col(f"position_{a}") for i, a in enumerate(C.AXES)]
    return rows.select(*FRAME, F.col("bbox_index").cast("string").alias("candidate_id"), "edge_point", *[w.alias(a) for w, a in zip(world, C.AXES, strict=True)])


def usable_cameras(cameras: DataFrame) -> DataFrame:
    """One camera for each place: one with an extrinsic matrix first, then by number at the end of the name, then by name."""
    order = Window.partitionBy("place").orderBy(F.col("extrinsic").isNull(), C.numeric_suffix(F.col("camera_id")), "camera_id")
    return cameras.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def with_inverse(cameras: DataFrame) -> DataFrame:
    """Cameras with the three rows that take a point of the scene to the camera; those without, or with a singular matrix, go.

    The matrix is [R t; 0 0 0 1], so the inverse is R's, by its cofactors, and -R's inverse times t.
    """
    m = lambda i, j: F.get("extrinsic", F.lit(4 * i + j))
    minor = lambda i, j: m(*ij(i + 1, j + 1)) * m(*ij(i + 2, j + 2)) - m(*ij(i + 1, j + 2)) * m(*ij(i + 2, j + 1))
    ij = lambda i, j: (i % 3, j % 3)
    det = sum((m(0, j) * minor(0, j) for j in range(3)), F.lit(0.0))
    inverse = [[F.try_divide(minor(j, i), F.col("det")) for j in range(3)] for i in range(3)]
    rows = [x for r in inverse for x in (*r, -sum((r[k] * m(k, 3) for k in range(3)), F.lit(0.0)))]
    whole = cameras.where("extrinsic is not null and fx is not null and width is not null").withColumn("det", det)
    kept = [c for c in ("scene_id", "frame_index") if c in cameras.columns]
    return whole.where(F.abs("det") > 1e-12).select(*kept, "camera_id", "width", "height", "fx", "fy", "cx", "cy", F.array(*rows).alias("to_camera"))


#: Rows of a table of cameras that may be broadcast; a longer one is joined by a shuffle.
BROADCAST_CAMERAS = 20_000


def seen_by(candidates: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each candidate with each camera of its scene (and frame, if cameras have one): by equality, cameras gathered to one list.

    Cameras without a scene belong to every scene.
    """
    by = [c for c in FRAME if c in cameras.columns]
    fields = F.struct("camera_id", "width", "height", "fx", "fy", "cx", "cy", "to_camera")
    if by:
        lists = cameras.groupBy(*by).agg(F.sort_array(F.collect_list(fields)).alias("cams"))
        lists = F.broadcast(lists) if cameras.count() <= BROADCAST_CAMERAS else lists
        return candidates.join(lists, by).withColumn("cam", F.explode("cams")).drop("cams")
    one = cameras.agg(F.sort_array(F.collect_list(fields)).alias("cams"))  # one row
    return candidates.join(F.broadcast(one), F.lit(True)).withColumn("cam", F.explode("cams")).drop("cams")


def _pixels(points: np.ndarray, owner: np.ndarray, camera: dict[str, np.ndarray], n: int, min_depth: float) -> list[np.ndarray]:
    """Of the points of n pairs of candidate and camera, in order of pairs: how many are in the picture, and their bounds."""
    many = np.bincount(owner, minlength=n)
    each = lambda x: np.repeat(x, many)
    m = camera["to_camera"]
    xyz = [np.ascontiguousarray(points[:, k]) for k in range(3)]
    row = lambda i: each(m[:, 4 * i]) * xyz[0] + each(m[:, 4 * i + 1]) * xyz[1] + each(m[:, 4 * i + 2]) * xyz[2] + each(m[:, 4 * i + 3])
    depth = row(2)
    front = depth > min_depth
    depth[~front] = 1.0
    u = each(camera["fx"]) * row(0) / depth + each(camera["cx"])
    v = each(camera["fy"]) * row(1) / depth + each(camera["cy"])
    inside = front & (u >= 0) & (u < each(camera["width"])) & (v >= 0) & (v < each(camera["height"]))
    out = [np.bincount(owner[inside], minlength=n)]
    starts, some = (np.cumsum(many) - many)[many > 0], many > 0
    for value in (u, v):
        for bound, best in ((np.inf, np.minimum), (-np.inf, np.maximum)):
            whole = np.full(n, bound)
            whole[some] = best.reduceat(np.where(inside, value, bound), starts) if len(starts) else bound
            out.append(whole)
    return out


SPANS = "visible_points long, min_u double, max_u double, min_v double, max_v double"


def _spans(fields: list[str], points_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], min_depth: float):
    """A function for mapInArrow: to each row of a candidate and a camera (struct cam) what is seen of its points."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cam = batch.num_rows, batch["cam"]
            if not n:
                continue
            camera = {c: cam.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("width", "height", "fx", "fy", "cx", "cy")}
            camera["to_camera"] = cam.field("to_camera").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, 12)
            points, owner = points_of(batch)
            seen = _pixels(points, owner, camera, n, min_depth)
            ids = [cam.field(c) for c in ("camera_id", "width", "height")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in fields), *ids, pa.array(np.bincount(owner, minlength=n)), *map(pa.array, seen)], [*fields, "camera_id", "width", "height", "total_points", *(x.split()[0] for x in SPANS.split(", "))])

    return work


def _edge_points_of(samples: int):
    """Edge points of the boxes of a batch (columns position, scale and r, arrays of 3, 3 and 9)."""
    unit = np.array(edge_table(samples))

    def points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = batch.num_rows
        array = lambda c, k: batch[c].flatten().to_numpy(zero_copy_only=False).reshape(n, *k)
        local = unit[None] * array("scale", (3,))[:, None]
        world = np.einsum("nij,nkj->nki", array("r", (3, 3)), local) + array("position", (3,))[:, None]
        return world.reshape(-1, 3), np.repeat(np.arange(n), len(unit))

    return points


def _own_points_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The points of a batch of candidates (column members, an array of arrays of 3)."""
    members = batch["members"]
    n = pc.fill_null(pc.list_value_length(members), 0).to_numpy(zero_copy_only=False)
    return members.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3), np.repeat(np.arange(batch.num_rows), n)


def box_spans(boxes: DataFrame, cameras: DataFrame, samples: int = EDGE_SAMPLES, min_depth: float = MIN_DEPTH) -> DataFrame:
    """scene_id, frame_index, candidate_id, camera_id, width, height, total_points and what is seen of each box's edge points: a row per box and camera."""
    b = oriented(boxes).select(
        *FRAME, F.col("bbox_index").cast("string").alias("candidate_id"), F.array(*[f"position_{a}" for a in C.AXES]).alias("position"),
        F.array(*[f"scale_{a}" for a in C.AXES]).alias("scale"), F.array(*[f"r{i}{j}" for i in range(3) for j in range(3)]).alias("r"))
    return _mapped(seen_by(b, cameras), _edge_points_of(samples), min_depth)


def cluster_spans(clusters: DataFrame, cameras: DataFrame, min_depth: float = MIN_DEPTH) -> DataFrame:
    """The same for candidates that carry their points: scene_id, frame_index, candidate_id, members (array of arrays x, y, z)."""
    return _mapped(seen_by(clusters.select(*FRAME, "candidate_id", "members"), cameras), _own_points_of, min_depth)


def _mapped(pairs: DataFrame, points_of: Callable, min_depth: float) -> DataFrame:
    fields = [*FRAME, "candidate_id"]
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in fields)
    return pairs.mapInArrow(_spans(fields, points_of, min_depth), f"{kinds}, camera_id string, width int, height int, total_points long, {SPANS}")


def regions(spans: DataFrame, min_visible: int = MIN_VISIBLE, padding: int = PADDING) -> DataFrame:
    """The rectangle of each candidate in each camera, from the pixels inside the picture; candidates seen too little go.

    With columns image_width and image_height the pictures are of another size than the camera was
    calibrated for, and rectangles are scaled to them; tests and paddings are those of the picture.
    """
    scaled = "image_width" in spans.columns
    wide, high = (F.col("image_width"), F.col("image_height")) if scaled else (F.col("width"), F.col("height"))
    across = {"u": wide / F.col("width") if scaled else F.lit(1.0), "v": high / F.col("height") if scaled else F.lit(1.0)}
    seen = spans.where(F.col("visible_points") >= max(1, min_visible))
    raw = {"x1": F.floor(F.col("min_u") * across["u"]) - padding, "y1": F.floor(F.col("min_v") * across["v"]) - padding, "x2": F.ceil(F.col("max_u") * across["u"]) + padding, "y2": F.ceil(F.col("max_v") * across["v"]) + padding}
    held = {k: F.greatest(F.lit(0), F.least((wide if k[0] == "x" else high) - 1, v)).cast("int") for k, v in raw.items()}
    clipped = F.lit(False)
    for k in raw:
        clipped = clipped | (held[k] != raw[k])
    out = seen.withColumns(held | {"clipped": clipped}).where("x2 > x1 and y2 > y1")
    return out.select(*FRAME, "candidate_id", "camera_id", "x1", "y1", "x2", "y2", "visible_points", "total_points", "clipped", wide.cast("int").alias("width"), high.cast("int").alias("height"))


def place_of_asset(name: Column) -> Column:
    """The place that a picture's name stands for: without its beginning `cam_`."""
    return F.regexp_replace(F.lower(name), "^cam_", "")


def cameras_of_images(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """scene_id, frame_index, path, image_width, image_height and the camera of each picture's place; the first picture of a place by path.

    images: scene_id, frame_index, asset_name, path, width, height. The table of cameras is a calibration, broadcast if short.
    """
    own = images.withColumn("place", place_of_asset(F.col("asset_name"))).withColumns({"image_width": F.col("width"), "image_height": F.col("height")}).drop("width", "height")
    first = own.withColumn("n", F.row_number().over(Window.partitionBy(*FRAME, "place").orderBy("path"))).where("n = 1").drop("n")
    usable = usable_cameras(cameras)
    return first.join(F.broadcast(usable) if cameras.count() <= BROADCAST_CAMERAS else usable, "place")


def views_of_images(spans: DataFrame, matched: DataFrame) -> DataFrame:
    """spans (of all cameras) for which there is a picture, with its path and size; others are dropped."""
    return spans.join(matched.select(*FRAME, "camera_id", "path", "image_width", "image_height"), [*FRAME, "camera_id"])


def quality_of(kind: str, configs: dict[str, dict] | None = None, generic: dict | None = None) -> dict:
    """The limits for a kind of candidate, those of all kinds where it has none of its own."""
    own = ({"residual_cluster": CLUSTER_QUALITY, "existing_bbox": BOX_QUALITY} if configs is None else configs).get(kind)
    return own or generic or CLUSTER_QUALITY


def quality(config: dict = BOX_QUALITY) -> dict[str, Column]:
    """roi_area, border_sides, reasons (in a fixed order, joined by commas) and good, for the columns of regions()."""
    w, h = F.greatest(F.lit(0), F.col("x2") - F.col("x1")), F.greatest(F.lit(0), F.col("y2") - F.col("y1"))
    margin = max(0, config["margin"])
    sides = sum((t.cast("int") for t in (F.col("x1") <= margin, F.col("y1") <= margin, F.col("x2") >= F.col("width") - 1 - margin, F.col("y2") >= F.col("height") - 1 - margin)), F.lit(0))
    tests = [
        (w * h < config["area"], "roi_area_too_small"), (w < config["width"], "roi_width_too_small"), (h < config["height"], "roi_height_too_small"),
        (w * h / F.greatest(F.lit(1), F.col("width") * F.col("height")) > config["ratio"], "roi_area_too_large"),
        (F.col("visible_points") < config["visible"], "visible_points_too_few"), (sides > config["sides"], "roi_at_image_edge"),
    ]
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))
    return {"roi_area": w * h, "border_sides": sides, "reasons": F.array_join(reasons, ","), "good": F.size(reasons) == 0}


def crop_bounds(expand: float = 0.25) -> dict[str, Column]:
    """The rectangle widened on each side by a share of it, rounded half to even, within the picture."""
    mx = F.bround(F.greatest(F.lit(1), F.col("x2") - F.col("x1")) * F.lit(max(0.0, expand))).cast("int")
    my = F.bround(F.greatest(F.lit(1), F.col("y2") - F.col("y1")) * F.lit(max(0.0, expand))).cast("int")
    return {
        "crop_x1": F.greatest(F.lit(0), F.col("x1") - mx), "crop_y1": F.greatest(F.lit(0), F.col("y1") - my),
        "crop_x2": F.least(F.col("width"), F.col("x2") + mx), "crop_y2": F.least(F.col("height"), F.col("y2") + my),
    }


def views(found: DataFrame, config: dict = BOX_QUALITY) -> DataFrame:
    """Each candidate with its views in order of camera, and what ranks it: good views, their points, largest region."""
    judged = found.withColumns(quality(config))
    good = lambda c: F.when(F.col("good"), c)
    return judged.groupBy(*FRAME, "candidate_id").agg(
        F.count_if("good").alias("good_views"), F.coalesce(F.sum(good(F.col("visible_points"))), F.lit(0)).alias("good_points"),
        F.coalesce(F.max(good(F.col("roi_area"))), F.lit(0)).alias("largest"), F.sum("visible_points").alias("all_points"),
        F.sort_array(F.collect_list(F.struct("camera_id", "x1", "y1", "x2", "y2"))).alias("views"))


def best_observation(candidates: DataFrame) -> DataFrame:
    """Of each object the frame in which it is seen best; earlier frames win ties. candidates: views() with track_id."""
    order = Window.partitionBy("scene_id", F.coalesce(F.nullif("track_id", F.lit("")), "candidate_id")).orderBy(
        *[F.desc(c) for c in ("good_views", "good_points", "largest", "all_points")], "frame_index", "candidate_id")
    return candidates.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
