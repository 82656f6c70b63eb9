"""Readers and writers of the tables that an inspection takes and gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidaraudit.functions.columns import filled, key_field, key_value, number

#: The columns of the files, in order.
BOXES = (
    "scene_id", "frame_index", "bbox_index", "track_id", "target_id", "uuid", "object_id", "label", "className", "name",
    "position_x", "position_y", "position_z", "rotation_x", "rotation_y", "rotation_z", "scale_x", "scale_y", "scale_z", "visible",
    "class_id", "mark_id", "is_hide", "is_selected", "point_count", "start_index", "resolved_target_field", "resolved_target_key",
)
REPORT = (
    "scene_id", "frame_index", "first_frame", "last_frame", "occurrence_count", "track_id", "bbox_index", "label", "rule_id", "severity", "message", "evidence",
    "cluster_id", "cluster_center", "cluster_size", "cameras", "rois", "possible_category", "ai_confidence", "ai_reason", "context_paths", "crop_paths",
)
CAPTURES = (
    "scene_id", "frame_index", "screenshot_path", "navigation_status", "ready_status", "pcd_count", "jpg_count", "warning", "ai_status",
    "issue_type", "description", "confidence", "reviewer_note",
)
ASSETS = ("scene_id", "frame_index", "pcd_url", "jpg_url_1", "jpg_url_2", "jpg_url_3", "jpg_url_4", "jpg_url_5", "pcd_count", "jpg_count", "status", "warning")
NUMBERS = tuple(f"{p}_{a}" for p in ("position", "rotation", "scale") for a in "xyz")
FLAGS, COUNTS = ("visible", "is_hide", "is_selected"), ("point_count", "start_index")


def _csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """All columns as text, without the mark that may stand before the header."""
    names = spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(c.lstrip("\ufeff"), T.StringType()) for c in names])
    return spark.read.schema(schema).csv(path, header=True, multiLine=multiline, escape='"')


def read_boxes(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Boxes from CSV files in which all is text: empty fields are empty texts, numbers that can't be read are null.

    frame_index has to be a whole number; anything else is an error. Columns that a file lacks are empty.
    row_seq orders rows of a file as they stand in it. Files are split unless multiline says that fields hold line ends.
    """
    raw = _csv(spark, path, multiline)
    have = set(raw.columns)
    field = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    kinds = {"frame_index": field("frame_index").cast("int"), "bbox_index": field("bbox_index").cast("long")}
    kinds |= {c: number(field(c)) for c in NUMBERS} | {c: F.lower(F.trim(field(c))).try_cast("boolean") for c in FLAGS} | {c: number(field(c)).try_cast("int") for c in COUNTS}
    return raw.select(*[kinds.get(c, F.coalesce(field(c), F.lit(""))).alias(c) for c in BOXES], F.monotonically_increasing_id().alias("row_seq"))


def write_boxes(boxes: DataFrame, path: str) -> None:
    """Boxes as CSV with a header; the field that names the object, and its value, are worked out where no key is stored."""
    have = set(boxes.columns)
    stored = filled("resolved_target_key").isNotNull() if "resolved_target_key" in have else F.lit(False)
    kept = {c: F.when(stored, F.col(c)) if c in have else F.lit(None) for c in ("resolved_target_field", "resolved_target_key")}
    resolved = {"resolved_target_field": F.coalesce(kept["resolved_target_field"], F.when(~stored, key_field())), "resolved_target_key": F.coalesce(kept["resolved_target_key"], key_value())}
    boxes.select(*[resolved.get(c, F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in BOXES]).write.mode("overwrite").csv(path, header=True, escape="\"")


def report_rows(found: DataFrame) -> DataFrame:
    """Findings with all columns of the report as text; those they lack are empty, and a single frame is its own first and last."""
    have = set(found.columns)
    single = {"first_frame": F.col("frame_index"), "last_frame": F.col("frame_index"), "occurrence_count": F.lit(1)}
    return found.select(*[F.coalesce((F.col(c) if c in have else single.get(c, F.lit(""))).cast("string"), F.lit("")).alias(c) for c in REPORT])


def write_report(found: DataFrame, path: str, order: bool = True) -> None:
    """The report as CSV with a header, also without findings; columns of a fixed order, rows by frame, object and rule."""
    rows = report_rows(found)
    rows = rows.orderBy("scene_id", F.col("frame_index").cast("int"), "track_id", "rule_id") if order else rows
    rows.write.mode("overwrite").csv(path, header=True, escape="\"")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture reports: frame and counts as whole numbers, null where they aren't, all else as text."""
    raw = _csv(spark, path, False)
    whole = {"frame_index", "pcd_count", "jpg_count"}
    field = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    return raw.select(*[number(field(c)).try_cast("int").alias(c) if c in whole else F.coalesce(field(c), F.lit("")).alias(c) for c in CAPTURES])


def capture_rows(frames: DataFrame) -> DataFrame:
    """Frames with all columns of the capture report; what hasn't been looked at yet is pending."""
    have = set(frames.columns)
    fresh = {"ai_status": F.lit("pending"), "pcd_count": F.lit(0), "jpg_count": F.lit(0)}
    return frames.select(*[(F.col(c) if c in have else fresh.get(c, F.lit(""))).alias(c) for c in CAPTURES])


def write_captures(frames: DataFrame, path: str) -> None:
    capture_rows(frames).write.mode("overwrite").csv(path, header=True, escape="\"")


def mapping_report(rates: DataFrame, usage: DataFrame) -> DataFrame:
    """One row, text: how often each field is filled (rates: fill_rates), which never is, what names objects (usage: key_usage), most often first.

    Both tables have a row per field, so they fit one task.
    """
    line = F.format_string("%s: %d / %d", "field", "filled", "rows")
    fields = rates.agg(
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("filled"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("always_empty"), F.col("field")))), ", ").alias("empty"))
    keys = usage.agg(
        F.array_join(F.sort_array(F.collect_list(F.format_string("%s: %d", "field", "boxes"))), "\n").alias("used"),
        F.max_by("field", F.struct("boxes", F.col("field"))).alias("main"))
    parts = F.concat_ws("\n", F.lit("Filled fields"), "filled", F.concat(F.lit("Always empty: "), F.coalesce(F.nullif("empty", F.lit("")), F.lit("none"))), F.lit("Objects are named by"), "used", F.concat(F.lit("Mostly by: "), F.coalesce("main", F.lit("none"))))
    return fields.join(keys, F.lit(True)).select(parts.alias("text"))


def download_metadata(assets: DataFrame) -> DataFrame:
    """scene_id, frame_index, metadata: a JSON text for each frame of what was to be downloaded (url, kind, ok, error)."""
    one = F.struct("url", "kind", "ok", "error")
    return assets.groupBy("scene_id", "frame_index").agg(F.sort_array(F.collect_list(one)).alias("files"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed")).select(
        "scene_id", "frame_index", F.to_json(F.struct("scene_id", "frame_index", "ok", "failed", "files")).alias("metadata"))


def write_summary(documents: DataFrame, path: str) -> None:
    """One line of JSON for each scene."""
    documents.select("document").write.mode("overwrite").text(path)


def write_assets(slots: DataFrame, path: str) -> None:
    slots.select(*ASSETS).write.mode("overwrite").csv(path, header=True, escape="\"")


#: What a manifest may hold besides views: the model's answer, the cache's, and the decision.
SECTIONS = ("vision", "vision_cache", "vision_decision")


def write_manifest(views: DataFrame, path: str) -> None:
    """Each candidate's views, and those of SECTIONS that it has as columns, as JSON in folders by scene and frame."""
    own = [c for c in SECTIONS if c in views.columns]
    rows = views.select("scene_id", "frame_index", F.to_json(F.struct("candidate_id", "views", *own)).alias("manifest"))
    rows.write.mode("overwrite").partitionBy("scene_id", "frame_index").text(path)
