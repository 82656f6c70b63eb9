"""Rules over whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C
from lidaraudit.operators.tracks import frames_without_boxes


def _of_frames(frames: DataFrame, rule: str) -> DataFrame:
    empty = F.lit("")
    return frames.select(
        "scene_id", "frame_index", empty.alias("track_id"), empty.alias("bbox_index"), empty.alias("label"), F.lit(rule).alias("rule_id"),
        F.lit("Warning").alias("severity"), F.lit(0).alias("part"), F.lit(None).cast("double").alias("value"))


def empty_frame(boxes: DataFrame, expected: DataFrame | None) -> DataFrame:
    """Frames that were expected and have no box; without expected frames, or with an empty list of them, there are none to miss."""
    if expected is None:
        expected = boxes.select("scene_id", "frame_index").distinct()
    return _of_frames(frames_without_boxes(boxes, expected), "EmptyFrame")


def empty_frame_readable(boxes: DataFrame, expected: DataFrame) -> DataFrame:
    """Frames that failed to be read can't be told to be empty."""
    return empty_frame(boxes, expected.where("read_ok"))


def failed_frames(expected: DataFrame) -> DataFrame:
    """scene_id, frame_index, reason: one row for each frame whose boxes couldn't be read, with the first reason (column seq, else by name)."""
    reason = F.col("reason") if "reason" in expected.columns else F.lit(None).cast("string")
    order = F.col("seq") if "seq" in expected.columns else reason
    return expected.where("not read_ok").groupBy("scene_id", "frame_index").agg(F.min_by(reason, order).alias("reason"))


def missing_bbox(expected: DataFrame) -> DataFrame:
    """One finding for each frame whose boxes couldn't be read, whatever the number of reasons."""
    return _of_frames(failed_frames(expected), "MissingBBox")


def ordinals(boxes: DataFrame, order: str = "bbox_index") -> DataFrame:
    """Boxes with bbox_index as their place in the frame, from 0, in the given order."""
    place = F.row_number().over(Window.partitionBy("scene_id", "frame_index").orderBy(order)) - 1
    return boxes.withColumn("bbox_index", place.cast("long"))


def inspected(expected: DataFrame, skip_first: bool = True) -> DataFrame:
    first = expected.groupBy("scene_id").agg(F.min("frame_index").alias("first"))
    return expected.join(first, "scene_id").where(F.col("frame_index") > F.col("first") if skip_first else F.lit(True)).drop("first")


def sampled(frames: DataFrame, start: int, every: int) -> DataFrame:
    return frames.where(C.is_sampled(F.col("frame_index"), start, every))
