"""Queries over arrivals as a whole table: claims by stamp and by window, readiness. The streams have replay tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.operators import claims
from lidaraudit.plans.review import ASSETS, asset_events
from lidaraudit.operators.assets import classified
from lidaraudit.sources import fixtures as X
from lidaraudit.streaming.claims import NAMES

#: A frame for each hour in which a scene has events: it begins with the hour and claims 50 minutes later.
CLAIM_US = 50 * 60 * 1_000_000
QUIET_MS, TIMEOUT_MS, SETTLE_MS = 6 * 60_000, 2 * X.HOUR_US // 1000, 3000
PCDS, JPGS = 1, 2


def arrival_events(spark: SparkSession, d: str) -> DataFrame:
    """F8 as events of streaming.claims."""
    own = classified(asset_events(spark, d)).select("scene_id", F.unix_micros(F.col("arrival_ts").cast("timestamp")).alias("ts"), "kind", "group_key", "url")
    hours = own.select("scene_id", F.floor((F.col("ts") - X.START_US) / F.lit(float(X.HOUR_US))).cast("int").alias("h")).distinct()
    begin = F.lit(X.START_US) + F.col("h").cast("long") * F.lit(X.HOUR_US)
    none = F.lit(None).cast("string")
    marks = lambda action, ts: hours.select("scene_id", ts.alias("ts"), F.lit(action).alias("action"), (F.col("h") + 1).alias("frame_index"), none.alias("kind"), none.alias("group_key"), none.alias("url"))
    files = own.select("scene_id", "ts", F.lit("asset").alias("action"), F.lit(None).cast("int").alias("frame_index"), "kind", "group_key", "url")
    return files.unionByName(marks("start", begin)).unionByName(marks("claim", begin + CLAIM_US)).select(*NAMES)


def _told(claimed: DataFrame) -> DataFrame:
    """frame_index 0: no frame claims it."""
    return claimed.select("scene_id", "url", "arrival_ts", "kind", F.coalesce("frame_index", F.lit(0)).alias("frame_index"), "how")


QUERIES = {
    "claimed_assets": lambda s, d: _told(claims.claimed_by_stamp(arrival_events(s, d))),
    "window_assets": lambda s, d: _told(claims.claimed_by_window(arrival_events(s, d))),
    "claimed_frames": lambda s, d: claims.frame_counts(claims.claimed_by_stamp(e := arrival_events(s, d)), e),
    "ready_frames": lambda s, d: claims.ready_frames(arrival_events(s, d), PCDS, JPGS, QUIET_MS, TIMEOUT_MS, SETTLE_MS),
}

EVENTS_SQL = ASSETS.replace("WITH items", "WITH RECURSIVE items", 1) + f""", files AS (
  SELECT scene_id, url, epoch_us(arrival_ts) AS arrival_ts, kind, group_key, CAST(group_key AS DOUBLE) AS stamp FROM addressed),
hours AS (SELECT DISTINCT scene_id, h FROM items),
marks AS (
  SELECT scene_id, h + 1 AS frame_index, {X.START_US} + h * {X.HOUR_US}::BIGINT AS start_ts, {X.START_US} + h * {X.HOUR_US}::BIGINT + {CLAIM_US} AS claim_ts,
    row_number() OVER (PARTITION BY scene_id ORDER BY h) AS n FROM hours)"""
CLAIMS_SQL = EVENTS_SQL + """, scenes AS (
  SELECT scene_id, list({d: stamp, t: arrival_ts}) FILTER (kind = 'pcd' AND stamp IS NOT NULL) AS free FROM files GROUP BY scene_id),
steps AS (
  SELECT scene_id, 0::BIGINT AS n, NULL::BIGINT AS claim_ts, NULL::INTEGER AS frame_index, NULL::DOUBLE AS stamp, coalesce(free, []) AS free FROM scenes
  UNION ALL
  SELECT scene_id, n, claim_ts, frame_index, stamp, list_filter(free, lambda x: NOT (x.t <= claim_ts AND x.d IS NOT DISTINCT FROM stamp))
  FROM (
    SELECT s.scene_id, m.n, m.claim_ts, m.frame_index, s.free, list_min(list_transform(list_filter(s.free, lambda x: x.t <= m.claim_ts), lambda x: x.d)) AS stamp
    FROM steps s JOIN marks m ON m.scene_id = s.scene_id AND m.n = s.n + 1)),
told AS (
  SELECT f.scene_id, f.url, f.arrival_ts, f.kind, arg_min(s.frame_index, s.claim_ts) AS frame_index,
    CASE WHEN count(s.claim_ts) = 0 THEN 'swept' WHEN arg_min(s.stamp IS NULL, s.claim_ts) THEN 'rest' ELSE 'claimed' END AS how
  FROM files f LEFT JOIN steps s ON s.scene_id = f.scene_id AND s.n > 0 AND s.claim_ts >= f.arrival_ts AND (s.stamp IS NULL OR s.stamp = f.stamp) GROUP BY ALL)"""
ORACLE = {
    "claimed_assets": CLAIMS_SQL + " SELECT * REPLACE (coalesce(frame_index, 0) AS frame_index) FROM told",
    "claimed_frames": CLAIMS_SQL + """ SELECT m.scene_id, m.frame_index, count(*) FILTER (t.kind = 'pcd') AS pcd_count, count(*) FILTER (t.kind = 'jpg') AS jpg_count
FROM marks m LEFT JOIN told t ON t.scene_id = m.scene_id AND t.frame_index = m.frame_index GROUP BY ALL""",
    "window_assets": EVENTS_SQL + """, met AS (
  SELECT f.scene_id, f.url, f.arrival_ts, f.kind, min(m.claim_ts) FILTER (m.claim_ts >= f.arrival_ts) AS c, min(m.start_ts) FILTER (m.start_ts >= f.arrival_ts) AS s, arg_min(m.frame_index, m.claim_ts) FILTER (m.claim_ts >= f.arrival_ts) AS frame
  FROM files f LEFT JOIN marks m ON m.scene_id = f.scene_id GROUP BY ALL)
SELECT scene_id, url, arrival_ts, kind, CASE WHEN c <= coalesce(s, c) THEN frame ELSE 0 END AS frame_index, CASE WHEN c <= coalesce(s, c) THEN 'claimed' ELSE 'swept' END AS how FROM met""",
    "ready_frames": EVENTS_SQL + f""", near AS (
  SELECT m.scene_id, m.frame_index, m.start_ts, f.arrival_ts, f.kind FROM marks m JOIN files f ON f.scene_id = m.scene_id AND f.arrival_ts > m.start_ts - {QUIET_MS * 1000} AND f.arrival_ts < m.start_ts + {TIMEOUT_MS * 1000}
  UNION ALL SELECT scene_id, frame_index, start_ts, NULL, NULL FROM marks),
counted AS (
  SELECT DISTINCT scene_id, frame_index, start_ts, arrival_ts,
    count(*) FILTER (kind = 'pcd' AND arrival_ts > start_ts) OVER w AS pcd, count(*) FILTER (kind = 'jpg' AND arrival_ts > start_ts) OVER w AS jpg
  FROM near WINDOW w AS (PARTITION BY scene_id, frame_index ORDER BY arrival_ts NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
steps AS (
  SELECT *, greatest(start_ts, coalesce(arrival_ts + {QUIET_MS * 1000}, start_ts)) AS calm, lead(arrival_ts) OVER (PARTITION BY scene_id, frame_index ORDER BY arrival_ts NULLS FIRST) AS following FROM counted),
judged AS (SELECT *, pcd >= {PCDS} AND jpg >= {JPGS} AND (following IS NULL OR calm < following) AND calm < start_ts + {TIMEOUT_MS * 1000} AS good FROM steps)
SELECT scene_id, frame_index, CASE WHEN bool_or(good) THEN 'ok' ELSE 'timeout' END AS ready_status,
  CASE WHEN bool_or(good) THEN arg_min(pcd, calm) FILTER (good) ELSE max(pcd) END AS pcd_count, CASE WHEN bool_or(good) THEN arg_min(jpg, calm) FILTER (good) ELSE max(jpg) END AS jpg_count,
  CASE WHEN bool_or(good) THEN (min(calm) FILTER (good) - any_value(start_ts)) // 1000 + {SETTLE_MS} ELSE {TIMEOUT_MS} END AS elapsed_ms
FROM judged GROUP BY scene_id, frame_index""",
}
