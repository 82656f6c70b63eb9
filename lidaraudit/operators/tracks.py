"""Rules over the history of one object: each row next to what came before it.

All rules share one window (scene and object, in order of frame and row). A rule is a short array
of entries worked out on a row, so any number of rules is one pass: one exchange by object, one
sort, one explode of the arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C

POSITION_JUMP, ROTATION_JUMP, SIZE_CHANGE = 25.0, 1.0, 0.3
BROKEN_GAP = 3

FINDING = ("scene_id", "frame_index", "track_id", "bbox_index", "label", "rule_id", "severity", "part", "value")


def entry(rule: str, test: Column, value: Column | None = None, part: int = 0) -> Column:
    """What a rule says of a row, null where test isn't met; part orders findings of one box, value is what was measured."""
    measured = F.lit(None) if value is None else value
    return F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(part).alias("part"), measured.cast("double").alias("value")))


def findings(rows: DataFrame, entries: list[Column]) -> DataFrame:
    """The entries that hold, in the common shape."""
    each = rows.withColumn("entry", F.explode(F.array_compact(F.array(*entries))))
    return each.select(
        "scene_id", "frame_index", F.col("target_key").alias("track_id"), F.col("bbox_index").cast("string").alias("bbox_index"),
        F.col("label_of").alias("label"), "entry.rule_id", F.lit("Warning").alias("severity"), "entry.part", "entry.value")


def keyed(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"target_key": C.target_key(boxes), "label_of": C.label()})


def frames_without_boxes(boxes: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.select("scene_id", "frame_index").join(boxes.select("scene_id", "frame_index").distinct(), ["scene_id", "frame_index"], "left_anti")


def empty_frames_before(boxes: DataFrame, expected: DataFrame) -> DataFrame:
    """scene_id, frame_index, empties: for each frame with boxes, how many expected frames before it have none.

    Two frames of an object enclose an empty frame if their numbers differ. The window holds a row per frame of a scene.
    """
    both = boxes.select("scene_id", "frame_index", F.lit(0).alias("empty")).unionByName(expected.select("scene_id", "frame_index", F.lit(1).alias("empty")))
    frames = both.groupBy("scene_id", "frame_index").agg(F.min("empty").alias("empty"))
    upto = F.sum("empty").over(Window.partitionBy("scene_id").orderBy("frame_index"))
    return frames.withColumn("empties", upto).where("empty = 0").drop("empty")


def history(boxes: DataFrame, expected: DataFrame | None = None, gap: int = BROKEN_GAP) -> DataFrame:
    """Each box with the one before it, and with the last position, rotation and size that weren't missing.

    With expected frames, those of them without any box are known: `breaks` counts how often the
    object has been missing for at most gap frames, none of which was empty; `broken` tells whether it has just been.
    """
    order = Window.partitionBy("scene_id", "target_key").orderBy("frame_index", "bbox_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda value: F.last(F.when(value.isNotNull(), F.struct(F.col("frame_index").alias("frame"), value.alias("value"))), True).over(before)
    rows = keyed(boxes).withColumns({"position": C.vector("position"), "scale": C.vector("scale")})
    rows = rows.withColumn("empties", F.lit(0).cast("long")) if expected is None else rows.join(empty_frames_before(boxes, expected), ["scene_id", "frame_index"])
    rows = rows.withColumns({
        "previous": F.lag(F.struct("frame_index", F.col("label_of").alias("label"), "empties")).over(order),
        "last_position": last(F.col("position")),
        "last_rotation": last(F.col("rotation_z")),
        "last_scale": last(F.col("scale")),
    })
    missing = F.col("frame_index") - F.col("previous.frame_index") - 1
    broken = F.coalesce(missing.between(1, gap) & (F.col("empties") == F.col("previous.empties")), F.lit(False))
    rows = rows.withColumn("broken", broken)
    return rows.withColumn("breaks", F.sum(F.col("broken").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _next_frame(column: str) -> Column:
    return F.col("frame_index") - F.col(f"{column}.frame") == 1


def label_entries() -> list[Column]:
    """The label differs from the one before, however many frames lie between."""
    return [entry("LabelConsistency", F.col("previous").isNotNull() & (F.col("label_of") != F.col("previous.label")))]


def position_entries(limit: float = POSITION_JUMP) -> list[Column]:
    moved = C.distance(F.col("last_position.value"), F.col("position"))
    return [entry("PositionJump", _next_frame("last_position") & C.above(moved, limit), moved)]


def rotation_entries(limit: float = ROTATION_JUMP) -> list[Column]:
    turned = C.angle_between(F.col("rotation_z"), F.col("last_rotation.value"))
    return [entry("RotationJump", _next_frame("last_rotation") & C.above(turned, limit), turned)]


def size_change_entries(limit: float = SIZE_CHANGE) -> list[Column]:
    """A side differs by more than a share of what it was; sides that were 0 are left out."""
    change = lambda a: F.try_divide(F.abs(F.col(f"scale.{a}") - F.col(f"last_scale.value.{a}")), F.abs(F.col(f"last_scale.value.{a}")))
    return [entry("SizeConsistency", _next_frame("last_scale") & C.above(change(a), limit), change(a), i) for i, a in enumerate(C.AXES)]


def broken_entries() -> list[Column]:
    """The object is back after a short absence; value: which time it is. Rows: history() with expected frames."""
    return [entry("BrokenTrack", F.col("broken"), F.col("breaks"))]


ENTRIES: dict[str, Callable[[], list[Column]]] = {
    "label_consistency": label_entries, "position_jump": position_entries, "rotation_jump": rotation_entries,
    "size_consistency": size_change_entries, "broken_track": broken_entries,
}


def label_consistency(rows: DataFrame) -> DataFrame:
    return findings(rows, label_entries())


def position_jump(rows: DataFrame, limit: float = POSITION_JUMP) -> DataFrame:
    return findings(rows, position_entries(limit))


def rotation_jump(rows: DataFrame, limit: float = ROTATION_JUMP) -> DataFrame:
    return findings(rows, rotation_entries(limit))


def size_consistency(rows: DataFrame, limit: float = SIZE_CHANGE) -> DataFrame:
    return findings(rows, size_change_entries(limit))


def broken_track(rows: DataFrame) -> DataFrame:
    return findings(rows, broken_entries())


def persistent(found: DataFrame) -> DataFrame:
    """Findings of one rule and object in frames that follow one another become one, with the first one's values.

    A finding counts once, or as often as its occurrence_count says if it has one.
    """
    count = F.col("occurrence_count") if "occurrence_count" in found.columns else F.lit(1)
    key = Window.partitionBy("scene_id", "track_id", "rule_id").orderBy("frame_index", F.col("bbox_index").try_cast("bigint"), "part")
    starts = (F.col("frame_index") - F.lag("frame_index").over(key) > 1).cast("int")
    islands = found.withColumn("starts", F.coalesce(starts, F.lit(0))).withColumn("island", F.sum("starts").over(key))
    order = F.struct("frame_index", F.col("bbox_index").try_cast("bigint"), "part")
    first = lambda c: F.min_by(c, order).alias(c)
    return islands.groupBy("scene_id", "track_id", "rule_id", "island").agg(
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.sum(count).alias("occurrence_count"),
        *[first(c) for c in ("bbox_index", "label", "severity", "value")],
    ).drop("island").withColumn("frame_index", F.col("first_frame"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
