"""The canonical tables, derived from the generic ones; in Spark, and as SQL for the comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START_US = 1_704_067_200_000_000
HOUR_US = 3_600_000_000
FRAMES = 720

#: Fixed values of the tests: class, order, reference length, width, height (null: none), tolerance.
DIMENSIONS = [
    ("click", 0, 3.0, 1.0, 2.0, 0.5),
    ("view_low", 1, 2.0, 1.0, 2.0, 0.5),
    ("view_high", 2, 6.0, 2.0, 3.0, 0.5),
    ("purchase", 3, None, None, None, 0.5),
    ("refund", 4, 2.0, 2.0, 2.0, 0.5),
]
#: camera, order, place, device, whether it has an extrinsic matrix, shift of its place, turn about z.
CAMERAS = [
    ("cam_front_1", 0, "front", "a", True, 0.0, 0.0),
    ("cam_front_2", 1, "front", "b", True, 0.5, 0.1),
    ("cam_left_1", 2, "left", "c", True, 1.0, 1.5707963267948966),
    ("cam_right_1", 3, "right", "d", False, -1.0, -1.5707963267948966),
    ("cam_back_1", 4, "back", "e", True, -0.5, 3.141592653589793),
]
WIDTH, HEIGHT, FOCUS = 1920, 1080, 1000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a box in a frame."""
    e = table(spark, sf_dir, "events").select(
        "*", F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    turn = F.col("event_id") * F.lit(0.7)
    every = lambda n: F.col("event_id") % n == 0
    return e.select(
        (F.col("user_id") % 5).cast("string").alias("scene_id"),
        (F.floor((F.col("us") - START_US) / F.lit(float(HOUR_US))).cast("int") + 1).alias("frame_index"),
        F.col("event_id").alias("bbox_index"),
        F.when(every(17), "").otherwise(F.col("user_id").cast("string")).alias("track_id"),
        F.lit("").alias("target_id"),
        F.when(every(34), "").otherwise(F.concat(F.lit("u"), "event_id")).alias("uuid"),
        F.lit("").alias("object_id"),
        F.col("event_type").alias("label"),
        F.when(every(29), "").otherwise(F.col("event_type")).alias("className"),
        F.when(~every(23), F.col("value") / 5).alias("position_x"),
        F.col("k").alias("position_y"),
        ((F.col("event_id") % 7) * F.lit(0.1)).alias("position_z"),
        F.lit(0.0).alias("rotation_x"), F.lit(0.0).alias("rotation_y"),
        (turn - F.floor((turn + math.pi) / (2 * math.pi)) * (2 * math.pi)).alias("rotation_z"),
        (1 + F.col("value") / 20).alias("scale_x"),
        (F.lit(0.05) + F.col("k") / 40).alias("scale_y"),
        (1 + (F.col("event_id") % 13) * F.lit(0.25)).alias("scale_z"),
    )


BOXES_SQL = f"""
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, epoch_us(ts) AS us FROM events),
boxes AS (
  SELECT CAST(user_id % 5 AS VARCHAR) AS scene_id,
    CAST(floor((us - {START_US}) / CAST({HOUR_US} AS DOUBLE)) AS INTEGER) + 1 AS frame_index,
    event_id AS bbox_index,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS track_id, '' AS target_id,
    CASE WHEN event_id % 34 = 0 THEN '' ELSE 'u' || event_id END AS uuid, '' AS object_id,
    event_type AS label, CASE WHEN event_id % 29 = 0 THEN '' ELSE event_type END AS className,
    CASE WHEN event_id % 23 <> 0 THEN value / 5 END AS position_x, k AS position_y,
    (event_id % 7) * CAST(0.1 AS DOUBLE) AS position_z, 0e0 AS rotation_x, 0e0 AS rotation_y,
    event_id * 0.7e0 - floor((event_id * 0.7e0 + {math.pi!r}e0) / {2 * math.pi!r}e0) * {2 * math.pi!r}e0 AS rotation_z,
    1 + value / 20 AS scale_x, 0.05e0 + k / 40 AS scale_y, 1 + (event_id % 13) * 0.25e0 AS scale_z
  FROM ev),
keyed AS (
  SELECT *, coalesce(nullif(className, ''), nullif(label, ''), '') AS label_of,
    coalesce(nullif(track_id, ''), nullif(target_id, ''), nullif(uuid, ''), nullif(object_id, ''), CAST(bbox_index AS VARCHAR)) AS target_key
  FROM boxes)"""


def expected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all frames that should have been read; each fiftieth failed."""
    scenes = boxes(spark, sf_dir).select("scene_id").distinct()
    return scenes.select("scene_id", F.explode(F.sequence(F.lit(1), F.lit(FRAMES))).alias("frame_index")).withColumn("read_ok", F.col("frame_index") % 50 != 0)


FRAMES_SQL = f"""
expected AS (
  SELECT scene_id, CAST(f AS INTEGER) AS frame_index, f % 50 <> 0 AS read_ok
  FROM (SELECT DISTINCT scene_id FROM boxes), range(1, {FRAMES + 1}) t(f))"""


def dimensions(spark: SparkSession) -> DataFrame:
    """reference sizes of a class and its variants."""
    return spark.createDataFrame(DIMENSIONS, "class_name string, class_order int, ref_length double, ref_width double, ref_height double, tolerance double")


def _value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else (repr(x) if "e" in repr(x) else f"{x!r}e0") if isinstance(x, float) else str(x)


def values_sql(rows: list[tuple], name: str, columns: str) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(_value(x) for x in r) + ')' for r in rows)}) t({columns}))"


DIMENSIONS_SQL = values_sql(DIMENSIONS, "dims", "class_name, class_order, ref_length, ref_width, ref_height, tolerance")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points of a frame."""
    p = table(spark, sf_dir, "lineitem")
    return p.select(
        (F.col("l_suppkey") % 5).cast("string").alias("scene_id"), (F.col("l_orderkey") % 20 + 1).cast("int").alias("frame_index"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_idx"),
        (F.col("l_extendedprice") / 1000 - 5).cast("double").alias("x"), (F.col("l_quantity") * 2 - 10).cast("double").alias("y"),
        ((F.col("l_tax") + F.col("l_discount")) * 20 - F.lit(0.5)).cast("double").alias("z"))


POINTS_SQL = """
points AS (
  SELECT CAST(l_suppkey % 5 AS VARCHAR) AS scene_id, CAST(l_orderkey % 20 + 1 AS INTEGER) AS frame_index,
    l_orderkey * 10 + l_linenumber AS point_idx, CAST(l_extendedprice / 1000 - 5 AS DOUBLE) AS x,
    CAST(l_quantity * 2 - 10 AS DOUBLE) AS y, CAST((l_tax + l_discount) * 20 - 0.5e0 AS DOUBLE) AS z
  FROM lineitem)"""


def dense_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 for clustering: three coordinates of the vectors, a frame for each label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.lit("0").alias("scene_id"), (F.col("label") + 1).cast("int").alias("frame_index"), F.col("vec_id").alias("point_idx"),
        *[(F.element_at("embedding", i + 1).cast("double") * 100).alias(a) for i, a in enumerate("xyz")])


DENSE_SQL = """
dense AS (
  SELECT '0' AS scene_id, CAST(label + 1 AS INTEGER) AS frame_index, vec_id AS point_idx,
    CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z
  FROM embeddings)"""


def cameras(spark: SparkSession) -> DataFrame:
    """cameras with the twelve numbers that take a point of the scene to camera coordinates."""
    rows = []
    for name, order, place, device, placed, shift, turn in CAMERAS:
        rows.append((name, order, place, device, WIDTH, HEIGHT, FOCUS, FOCUS, WIDTH / 2, HEIGHT / 2, [float(v) for v in to_world(shift, turn)] if placed else None))
    return spark.createDataFrame(rows, "camera_id string, camera_order int, place string, device string, width int, height int, fx double, fy double, cx double, cy double, extrinsic array<double>")


def to_world(shift: float, turn: float) -> list[float]:
    """A camera's 4 x 4 matrix, row by row: it looks along x, turned about z, at (shift, 0, 1.5)."""
    c, s = math.cos(turn), math.sin(turn)
    return [s, 0.0, c, shift, -c, 0.0, s, 0.0, 0.0, -1.0, 0.0, 1.5, 0.0, 0.0, 0.0, 1.0]
