"""Queries on what recurs over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.functions.storage import stored
from lidaraudit.operators import decisions, temporal
from lidaraudit.operators.tracks import keyed
from lidaraudit.sources import fixtures as X


def _candidates(s: SparkSession, d: str) -> DataFrame:
    b = keyed(X.boxes(s, d)).where("position_x is not null and scale_x is not null")
    return b.select(
        "scene_id", "frame_index", F.col("bbox_index").cast("string").alias("candidate_id"), F.col("position_x").alias("x"), F.col("position_y").alias("y"), F.col("position_z").alias("z"),
        F.col("scale_x").alias("size_x"), F.col("scale_y").alias("size_y"), F.col("scale_z").alias("size_z"), *[F.lit(0.0).alias(f"f{k}") for k in (1, 2, 3)], F.col("bbox_index").alias("points"), "target_key")


def _landmarks(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d).select("scene_id", "frame_index", F.col("target_key").alias("track_id"), "x", "y", "z")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Objects seen in a frame and in the next one, one row of each kind."""
    one = _landmarks(s, d).groupBy("scene_id", "frame_index", "track_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    a = one.select("scene_id", "track_id", "frame_index", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = one.select("scene_id", "track_id", (F.col("frame_index") - 1).alias("frame_index"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(b, ["scene_id", "track_id", "frame_index"])


def _fits(s: SparkSession, d: str) -> DataFrame:
    return temporal.rigid_fits(_pairs(s, d), ["scene_id"]).select("scene_id", "pairs", *[F.round(c, 5).alias(c) for c in ("angle", "shift_x", "shift_y")])


def _sample(s: SparkSession, d: str) -> DataFrame:
    near = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    tests = {"near": near <= 30, "far": near >= 60, "large": F.greatest("size_x", "size_y", "size_z") >= 8, "thin": F.least("size_x", "size_y", "size_z") <= 0.1}
    return decisions.diverse_sample(_candidates(s, d), tests, 40).select("scene_id", "candidate_id", "group_no", "turn")


#: A drive past users that stand still: how far the car turns and drives in a day, how users are placed, how far a moving thing goes.
TURN, DRIVE, SIDE_DRIVE, APART, ROW, STEP = 0.05, 1.5, 0.5, 10.0, 40, 0.32
DAY_US = 24 * X.HOUR_US


def _seen(s: SparkSession, d: str) -> DataFrame:
    """a frame for each day of a scene; what a user does that day is one observation for each kind of event, in the car's coordinates."""
    e = X.table(s, d, "events").select((F.col("user_id") % 5).cast("string").alias("scene_id"), "user_id", "event_type", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - X.START_US) / F.lit(float(DAY_US))).cast("int").alias("day"))
    one = e.groupBy("scene_id", "user_id", "event_type", "day").agg(F.count("*").alias("points"))
    u, day = F.col("user_id"), F.col("day")
    kind = F.col("event_type")
    x = (u % ROW) * F.lit(APART) + F.when(kind == "error", 3.0).when(kind == "signup", 5.0 + STEP * day).otherwise(0.0)
    y = F.floor(u / ROW) * F.lit(APART) + F.when(kind == "error", 2.0).when(kind == "signup", 7.0).otherwise(0.0)
    c, t = F.cos(TURN * day), F.sin(TURN * day)
    px, py = x - DRIVE * day, y - SIDE_DRIVE * day
    return one.select("scene_id", (day + 1).alias("frame_index"), "user_id", "event_type", "points", (c * px + t * py).alias("x"), (c * py - t * px).alias("y"), (u % 3).cast("double").alias("z"))


def _drive(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (errors stand still, signups move) and landmarks (users that click or view)."""
    seen = _seen(s, d)
    size = {f"size_{a}": F.lit(v) for a, v in zip("xyz", (2.0, 1.0, 1.5), strict=True)} | {f"f{k}": F.lit(0.1 * k) for k in (1, 2, 3)}
    found = seen.where("event_type in ('error', 'signup')").withColumn("candidate_id", F.concat("event_type", F.lit("/"), "user_id")).withColumns(size)
    marks = seen.where("event_type in ('click', 'view')").withColumn("track_id", F.col("user_id").cast("string"))
    return found.drop("user_id", "event_type"), marks.select("scene_id", "frame_index", "track_id", "x", "y", "z")


def _moving_groups(s: SparkSession, d: str) -> DataFrame:
    out = temporal.stationary_clusters(*_drive(s, d))
    return out.select("scene_id", "frame_index", "candidate_id", "registered", F.col("group").isNotNull().alias("grouped"), "represents", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce(F.array_join(F.col("observed_frames").cast("array<string>"), ","), F.lit("")).alias("observed_frames"))


def _statistics(found: DataFrame, marks: DataFrame) -> DataFrame:
    ways = stored(temporal.registered_frames(marks), "ways")
    return temporal.dedup_statistics(stored(temporal.stationary_clusters(found, marks, ways=ways), "matched"), marks, ways)


def _moving_statistics(s: SparkSession, d: str) -> DataFrame:
    return _statistics(*_drive(s, d))


QUERIES = {
    "rigid_fits": _fits,
    "registered_frames": lambda s, d: temporal.registered_frames(_drive(s, d)[1]).select("scene_id", "frame_index", *[F.round(F.round(c, 4) + 0.0, 4).alias(c) for c in ("angle", "shift_x", "shift_y", "shift_z")]),
    "moving_groups": _moving_groups,
    "moving_statistics": _moving_statistics,
    "diverse_sample": _sample,
    "stationary_clusters": lambda s, d: temporal.stationary_clusters(_candidates(s, d).drop("target_key"), _landmarks(s, d)),
    "dedup_statistics": lambda s, d: _statistics(_candidates(s, d).drop("target_key"), _landmarks(s, d)),
    "spatial_groups": lambda s, d: temporal.spatial_groups(_candidates(s, d), 1.0),
}
BASE = f"""WITH {X.BOXES_SQL},
c AS (SELECT scene_id, frame_index, CAST(bbox_index AS VARCHAR) AS candidate_id, target_key, position_x AS x, position_y AS y, scale_x, scale_y, scale_z FROM keyed WHERE position_x IS NOT NULL AND position_y IS NOT NULL)"""
MOVING = f"""WITH RECURSIVE obs AS (
  SELECT CAST(user_id % 5 AS VARCHAR) AS scene_id, user_id, event_type, CAST(floor((epoch_us(ts) - {X.START_US}) / CAST({DAY_US} AS DOUBLE)) AS INTEGER) + 1 AS frame_index, count(*) AS points FROM events GROUP BY ALL),
marks AS (SELECT DISTINCT scene_id, frame_index, user_id FROM obs WHERE event_type IN ('click', 'view')),
things AS (SELECT scene_id, frame_index, event_type || '/' || user_id AS candidate_id, event_type = 'error' AS still, points FROM obs WHERE event_type IN ('error', 'signup')),
shared AS (SELECT a.scene_id, a.frame_index AS f, b.frame_index AS g FROM marks a JOIN marks b ON a.scene_id = b.scene_id AND a.user_id = b.user_id AND a.frame_index <> b.frame_index GROUP BY ALL HAVING count(*) >= 6),
way AS (
  SELECT scene_id, min(frame_index) AS frame_index FROM marks GROUP BY scene_id
  UNION SELECT s.scene_id, s.f FROM shared s JOIN way w ON w.scene_id = s.scene_id AND w.frame_index = s.g),
placed AS (SELECT t.*, w.frame_index IS NOT NULL AS registered FROM things t LEFT JOIN way w ON w.scene_id = t.scene_id AND w.frame_index = t.frame_index),
counted AS (SELECT *, count(*) FILTER (registered AND still) OVER (PARTITION BY scene_id, candidate_id) AS n FROM placed),
grouped AS (
  SELECT *, still AND registered AND n >= 3 AS grouped, row_number() OVER (PARTITION BY scene_id, candidate_id, still AND registered AND n >= 3 ORDER BY points DESC, frame_index) AS place FROM counted)"""
ORACLE = {
    "registered_frames": MOVING + f""", first AS (SELECT scene_id, min(frame_index) - 1 AS d0 FROM marks GROUP BY scene_id),
ways AS (SELECT w.scene_id, w.frame_index, w.frame_index - 1 - d0 AS n, d0 FROM way w JOIN first f ON f.scene_id = w.scene_id)
SELECT scene_id, frame_index, round({TURN}e0 * n, 4) AS angle, round(cos({TURN}e0 * d0) * {DRIVE}e0 * n + sin({TURN}e0 * d0) * {SIDE_DRIVE}e0 * n, 4) + 0e0 AS shift_x,
  round(cos({TURN}e0 * d0) * {SIDE_DRIVE}e0 * n - sin({TURN}e0 * d0) * {DRIVE}e0 * n, 4) + 0e0 AS shift_y, 0e0 AS shift_z FROM ways""",
    "moving_groups": MOVING + """
SELECT g.scene_id, g.frame_index, g.candidate_id, g.registered, g.grouped, NOT g.grouped OR g.place = 1 AS represents, CASE WHEN g.grouped THEN g.n ELSE 0 END AS observations,
  CASE WHEN g.grouped AND g.place = 1 THEN (SELECT string_agg(h.frame_index::VARCHAR, ',' ORDER BY h.frame_index) FROM grouped h WHERE h.grouped AND h.scene_id = g.scene_id AND h.candidate_id = g.candidate_id) ELSE '' END AS observed_frames
FROM grouped g""",
    "moving_statistics": MOVING + """, frames AS (SELECT scene_id, frame_index FROM things UNION SELECT scene_id, frame_index FROM marks),
f AS (SELECT f.scene_id, count(w.frame_index) AS registered_frames, count(*) - count(w.frame_index) AS unregistered_frames FROM frames f LEFT JOIN way w ON w.scene_id = f.scene_id AND w.frame_index = f.frame_index GROUP BY f.scene_id),
g AS (SELECT scene_id, count(*) AS raw_candidates, count(*) FILTER (NOT grouped OR place = 1) AS candidates, count(*) FILTER (grouped AND place = 1) AS duplicate_groups, count(*) FILTER (grouped) AS duplicate_observations FROM grouped GROUP BY scene_id)
SELECT g.*, registered_frames, unregistered_frames, duplicate_observations - duplicate_groups AS saved_calls FROM g JOIN f ON f.scene_id = g.scene_id""",
    "rigid_fits": BASE + """,
one AS (SELECT scene_id, frame_index, target_key, min(x) AS x, min(y) AS y FROM c GROUP BY ALL),
p AS (SELECT a.scene_id, a.x AS ax, a.y AS ay, b.x AS u, b.y AS v FROM one a JOIN one b ON a.scene_id = b.scene_id AND a.target_key = b.target_key AND b.frame_index = a.frame_index + 1),
m AS (SELECT scene_id, count(*) AS pairs, avg(ax) AS mx, avg(ay) AS my, avg(u) AS nx, avg(v) AS ny FROM p GROUP BY scene_id),
t AS (SELECT p.scene_id, atan2(sum((ax - mx) * (v - ny) - (ay - my) * (u - nx)), sum((ax - mx) * (u - nx) + (ay - my) * (v - ny))) AS angle FROM p JOIN m ON p.scene_id = m.scene_id GROUP BY p.scene_id)
SELECT m.scene_id, pairs, round(angle, 5) AS angle, round(nx - cos(angle) * mx + sin(angle) * my, 5) AS shift_x, round(ny - sin(angle) * mx - cos(angle) * my, 5) AS shift_y FROM m JOIN t ON m.scene_id = t.scene_id""",
}
