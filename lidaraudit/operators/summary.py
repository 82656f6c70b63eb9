"""Totals over findings and raw fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id").agg(F.count("rule_id").alias("findings"), F.count_if(F.col("severity") == "Warning").alias("warnings"))


def rule_summary(found: DataFrame, boxes: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per scene: frames, boxes, warnings, frames and objects with findings, failed frames."""
    frames = expected.groupBy("scene_id").agg(F.count("frame_index").alias("total_frames"), F.count_if(~F.col("read_ok")).alias("missing_bbox_count"))
    counted = boxes.groupBy("scene_id").agg(F.count("bbox_index").alias("total_bbox"))
    issues = found.groupBy("scene_id").agg(
        F.count_if(F.col("severity") == "Warning").alias("total_warnings"),
        F.countDistinct("frame_index").alias("frames_with_issues"),
        F.countDistinct(F.when(F.col("track_id") != "", F.col("track_id"))).alias("tracks_with_issues"))
    return frames.join(counted, "scene_id", "left").join(issues, "scene_id", "left").na.fill(0)


def summary_document(found: DataFrame, boxes: DataFrame, expected: DataFrame) -> DataFrame:
    """The summary of each scene as JSON text, with sorted lists of frames and objects; rules with most findings first, ties by name."""
    lists = found.groupBy("scene_id").agg(
        F.sort_array(F.collect_set("frame_index")).alias("frames_with_issues"),
        F.sort_array(F.collect_set(F.nullif("track_id", F.lit("")))).alias("tracks_with_issues"))
    rules = found.groupBy("scene_id", "rule_id").count().groupBy("scene_id").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("order"), "rule_id", "count"))), lambda x: F.struct(x["rule_id"], x["count"]))).alias("warnings_by_rule"))
    missing = expected.where("not read_ok").groupBy("scene_id").agg(F.sort_array(F.collect_set("frame_index")).alias("missing_bbox_frames"))
    totals = rule_summary(found, boxes, expected).drop("frames_with_issues", "tracks_with_issues")
    whole = totals.join(lists, "scene_id", "left").join(rules, "scene_id", "left").join(missing, "scene_id", "left")
    return whole.select("scene_id", F.to_json(F.struct(*[c for c in whole.columns])).alias("document"))


def fill_rates(boxes: DataFrame, fields: list[str]) -> DataFrame:
    """How many rows have each field, in one pass; blank text counts as missing, 0 and false don't."""
    counts = [F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in fields]
    wide = boxes.agg(F.count(F.lit(1)).alias("rows"), *counts)
    return wide.select("rows", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))).alias("field", "filled")).select("field", "filled", "rows", (F.col("filled") == 0).alias("always_empty"))


def key_usage(boxes: DataFrame) -> DataFrame:
    """Which field names objects, and how often."""
    return boxes.select(C.key_field().alias("field")).groupBy("field").agg(F.count("field").alias("boxes"))
