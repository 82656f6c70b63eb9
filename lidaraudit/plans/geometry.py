"""Queries on points, clusters and projections, each with its SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.functions.storage import stored
from lidaraudit.operators import cloud, cluster, inspection, projection
from lidaraudit.operators.tracks import keyed
from lidaraudit.sources import fixtures as X

SIDE, EPS, LEAST = 5.0, 10.0, 5
BOX_GROWTH = 3.0


def _boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes three times as large, so that points of the test tables fall into some."""
    return X.boxes(s, d).withColumns({f"scale_{a}": F.col(f"scale_{a}") * BOX_GROWTH for a in "xyz"})


def _outside(s: SparkSession, d: str) -> DataFrame:
    return cloud.outside_boxes(X.points(s, d), _boxes(s, d), 0.05)


def _rounded(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _means(s: SparkSession, d: str) -> DataFrame:
    return cloud.voxels(cloud.within_range(cloud.outside_ego(_outside(s, d)), 100.0), SIDE)


def _labels(s: SparkSession, d: str) -> DataFrame:
    return cluster.dbscan(X.dense_points(s, d), EPS, LEAST)


def _fragments(s: SparkSession, d: str) -> DataFrame:
    return cluster.fragments(X.dense_points(s, d), _labels(s, d))


MERGE = {"most": 6.0, "max_z_gap": 4.0, "min_overlap": 0.5}
WEAK_POINTS = 10
GATES = {"min_points": 6, "max_aspect": 4.0, "max_volume": 3000.0, "min_flatness": 0.2, "low_height": 5.0}


def _gates(s: SparkSession, d: str) -> DataFrame:
    points, labels = X.dense_points(s, d), _labels(s, d)
    found = cluster.fragments(points, labels)
    groups = cluster.merged_fragments(found, cluster.fragment_gaps(found, **MERGE))
    return cluster.candidates(points, labels, groups, **GATES).select("scene_id", "frame_index", "cluster_id", "points", "fragments", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


def _regions(s: SparkSession, d: str) -> DataFrame:
    return projection.regions(projection.box_spans(X.boxes(s, d), projection.with_inverse(projection.usable_cameras(X.cameras(s)))))


def _best(s: SparkSession, d: str) -> DataFrame:
    owner = keyed(X.boxes(s, d)).select("scene_id", "frame_index", F.col("bbox_index").cast("string").alias("candidate_id"), F.col("target_key").alias("track_id"))
    return projection.best_observation(projection.views(_regions(s, d)).join(owner, ["scene_id", "frame_index", "candidate_id"]))


INSIDE = f"""EXISTS (SELECT 1 FROM boxes b WHERE b.scene_id = p.scene_id AND b.frame_index = p.frame_index
  AND position_x IS NOT NULL AND position_y IS NOT NULL AND scale_x IS NOT NULL AND scale_y IS NOT NULL
  AND abs(cos(rotation_z) * (p.x - position_x) + sin(rotation_z) * (p.y - position_y)) <= scale_x * {BOX_GROWTH}e0 / 2 * 1.05e0
  AND abs(cos(rotation_z) * (p.y - position_y) - sin(rotation_z) * (p.x - position_x)) <= scale_y * {BOX_GROWTH}e0 / 2 * 1.05e0
  AND abs(p.z - position_z) <= scale_z * {BOX_GROWTH}e0 / 2 * 1.05e0)"""
OUTSIDE = f"WITH {X.BOXES_SQL}, {X.POINTS_SQL}, outside AS (SELECT * FROM points p WHERE NOT {INSIDE})"
MEANS = f"""{OUTSIDE}, kept AS (
  SELECT * FROM outside WHERE NOT (x BETWEEN -2 AND 2.8e0 AND y BETWEEN -1.2e0 AND 1.2e0 AND z BETWEEN -1 AND 2.5e0) AND sqrt(x * x + y * y) <= 100),
means AS (
  SELECT scene_id, frame_index, CAST(floor(x / {SIDE}) AS BIGINT) AS vx, CAST(floor(y / {SIDE}) AS BIGINT) AS vy, CAST(floor(z / {SIDE}) AS BIGINT) AS vz,
    count(*) AS points, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM kept GROUP BY ALL)"""


def shape_sql(source: str, by: str) -> str:
    """Bounds and closed-form eigenvalues in SQL."""
    return f"""
sums AS (
  SELECT {by}, count(*) AS points, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z,
    covar_pop(x, x) AS a, covar_pop(y, y) AS b, covar_pop(z, z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f
  FROM {source} GROUP BY {by}),
ps AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - q)**2 + (b - q)**2 + (c - q)**2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM sums),
dets AS (SELECT *, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) AS det FROM ps),
angles AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(least(det / (2 * p**3), 1), -1)) / 3 ELSE 0 END AS phi FROM dets),
ls AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3, 3 * q - l1 - l3 AS l2 FROM angles),
shapes AS (
  SELECT *, (max_x - min_x) * (max_y - min_y) * (max_z - min_z) AS volume,
    CASE WHEN points >= 3 AND l1 > 1e-12 THEN 1 - greatest((l1 - l2) / l1, (l2 - l3) / l1) ELSE 0 END AS flatness,
    CASE WHEN points >= 3 AND l1 > 1e-12 THEN l3 / l1 ELSE 0 END AS thickness
  FROM ls)"""


DBSCAN = f"""WITH RECURSIVE {X.DENSE_SQL},
pairs AS (
  SELECT p.frame_index, p.point_idx AS a, q.point_idx AS b FROM dense p JOIN dense q ON p.frame_index = q.frame_index
  WHERE (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 <= {EPS * EPS}),
cores AS (SELECT frame_index, a AS core FROM pairs GROUP BY ALL HAVING count(*) >= {LEAST}),
edges AS (SELECT * FROM pairs WHERE a IN (SELECT core FROM cores) AND b IN (SELECT core FROM cores)),
reach AS (SELECT frame_index, a, b FROM edges UNION SELECT r.frame_index, r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT frame_index, a AS core, min(b) AS root FROM reach GROUP BY ALL),
numbers AS (SELECT frame_index, core, dense_rank() OVER (PARTITION BY frame_index ORDER BY root) - 1 AS label FROM roots),
labels AS (
  SELECT d.scene_id, d.frame_index, d.point_idx, d.x, d.y, d.z,
    CAST(coalesce((SELECT min(label) FROM pairs JOIN numbers ON b = core WHERE a = d.point_idx), -1) AS INTEGER) AS label,
    d.point_idx IN (SELECT core FROM cores) AS core
  FROM dense d)"""
FRAGMENTS = f"{DBSCAN}, inside AS (SELECT * FROM labels WHERE label >= 0), {shape_sql('inside', 'scene_id, frame_index, label')}"
GAPS = f"""{FRAGMENTS}, gaps AS (
  SELECT a.scene_id, a.frame_index, CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b,
    sqrt(greatest(0, a.min_x - b.max_x, b.min_x - a.max_x)**2 + greatest(0, a.min_y - b.max_y, b.min_y - a.max_y)**2) AS gap
  FROM shapes a JOIN shapes b ON a.frame_index = b.frame_index AND a.label < b.label
  WHERE gap <= {MERGE['most']} AND (greatest(0, a.min_z - b.max_z, b.min_z - a.max_z) <= {MERGE['max_z_gap']}
    OR (least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x) >= {MERGE['min_overlap']} AND least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y) >= {MERGE['min_overlap']})))"""
GROUPS = f"""{GAPS}, twoway AS (SELECT frame_index, a, b FROM gaps UNION SELECT frame_index, b, a FROM gaps),
tied AS (SELECT frame_index, a, b FROM twoway UNION SELECT t.frame_index, t.a, e.b FROM tied t JOIN twoway e ON t.frame_index = e.frame_index AND t.b = e.a),
groups AS (
  SELECT s.scene_id, s.frame_index, CAST(s.label AS BIGINT) AS label, least(CAST(s.label AS BIGINT), coalesce(min(t.b), s.label)) AS "group"
  FROM shapes s LEFT JOIN tied t ON t.frame_index = s.frame_index AND t.a = s.label GROUP BY s.scene_id, s.frame_index, s.label)"""
GATE = GROUPS + """,
members AS (SELECT l.scene_id, l.frame_index, x, y, z, "group" FROM labels l JOIN groups g ON g.frame_index = l.frame_index AND g.label = l.label),
""" + shape_sql("members", 'scene_id, frame_index, "group"').replace("sums AS", "sums2 AS").replace("FROM sums)", "FROM sums2)").replace("ps AS", "ps2 AS", 1).replace("FROM ps)", "FROM ps2)").replace("dets AS", "dets2 AS").replace("FROM dets)", "FROM dets2)").replace("angles AS", "angles2 AS").replace("FROM angles)", "FROM angles2)").replace("ls AS (SELECT *, q + 2", "ls2 AS (SELECT *, q + 2").replace("FROM ls)", "FROM ls2)").replace("shapes AS", "whole AS")
GATE += f"""
SELECT w.scene_id, w.frame_index, 'cluster_' || w."group" || CASE WHEN n > 1 THEN '_m' || n ELSE '' END AS cluster_id, points, n AS fragments,
  CASE WHEN points < {GATES['min_points']} THEN 'point_count' WHEN min_z > 15 THEN 'base_height'
    WHEN greatest(max_x - min_x, max_y - min_y, max_z - min_z) > 30 THEN 'extent' WHEN max_z - min_z < 0.3e0 THEN 'vertical_extent'
    WHEN greatest(max_x - min_x, max_y - min_y) / greatest(least(max_x - min_x, max_y - min_y), 1e-6) > {GATES['max_aspect']} THEN 'horizontal_aspect_ratio'
    WHEN max_z - min_z <= {GATES['low_height']} AND (max_x - min_x) * (max_y - min_y) > 12 THEN 'low_height_horizontal_area'
    WHEN volume < 0.001e0 THEN 'volume_low' WHEN volume > {GATES['max_volume']} THEN 'volume_high' WHEN flatness < {GATES['min_flatness']}e0 THEN 'flatness' ELSE '' END AS reject_reason
FROM whole w JOIN (SELECT frame_index, "group", count(*) AS n FROM groups GROUP BY ALL) c ON c.frame_index = w.frame_index AND c."group" = w."group" """

EDGE_SQL = f"""
steps AS (SELECT i, -0.5e0 + i * {1 / (projection.EDGE_SAMPLES - 1)!r}e0 AS s FROM range(0, {projection.EDGE_SAMPLES}) t(i)),
corners AS (SELECT * FROM (VALUES (0, -0.5e0), (1, 0.5e0)) t(k, c)),
unit AS (
  SELECT u.k * 18 + v.k * 9 + i AS edge_point, s AS ux, u.c AS uy, v.c AS uz FROM steps, corners u, corners v UNION ALL
  SELECT 36 + u.k * 18 + v.k * 9 + i, u.c, s, v.c FROM steps, corners u, corners v UNION ALL
  SELECT 72 + u.k * 18 + v.k * 9 + i, u.c, v.c, s FROM steps, corners u, corners v),
edge_points AS (
  SELECT scene_id, frame_index, CAST(bbox_index AS VARCHAR) AS candidate_id, edge_point,
    cos(rotation_z) * (ux * scale_x) + -sin(rotation_z) * (uy * scale_y) + position_x AS x,
    sin(rotation_z) * (ux * scale_x) + cos(rotation_z) * (uy * scale_y) + position_y AS y, uz * scale_z + position_z AS z
  FROM boxes, unit WHERE position_x IS NOT NULL AND position_y IS NOT NULL AND scale_x IS NOT NULL AND scale_y IS NOT NULL)"""
PLACED = [(name, shift, math.cos(turn), math.sin(turn)) for name, _, place, _, placed, shift, turn in X.CAMERAS if placed and name != "cam_front_2"]
CAMERA_SQL = X.values_sql(PLACED, "cams", "camera_id, shift, c, s")
REGION_SQL = f"""WITH {X.BOXES_SQL}, {EDGE_SQL}, {CAMERA_SQL},
seen AS (
  SELECT scene_id, frame_index, candidate_id, camera_id, c * (x - shift) + s * y AS depth, s * (x - shift) - c * y AS cx, 1.5e0 - z AS cy
  FROM edge_points, cams WHERE c * (x - shift) + s * y > 0.1e0),
pixels AS (SELECT *, {X.FOCUS} * cx / depth + {X.WIDTH / 2} AS u, {X.FOCUS} * cy / depth + {X.HEIGHT / 2} AS v FROM seen),
spans AS (
  SELECT scene_id, frame_index, candidate_id, camera_id, count(*) AS visible_points, floor(min(u)) - 8 AS a, floor(min(v)) - 8 AS b, ceil(max(u)) + 8 AS c, ceil(max(v)) + 8 AS d
  FROM pixels WHERE u >= 0 AND u < {X.WIDTH} AND v >= 0 AND v < {X.HEIGHT} GROUP BY ALL HAVING count(*) >= 3),
held AS (
  SELECT scene_id, frame_index, candidate_id, camera_id, visible_points, 108::BIGINT AS total_points,
    CAST(greatest(0, least({X.WIDTH - 1}, a)) AS INTEGER) AS x1, CAST(greatest(0, least({X.HEIGHT - 1}, b)) AS INTEGER) AS y1,
    CAST(greatest(0, least({X.WIDTH - 1}, c)) AS INTEGER) AS x2, CAST(greatest(0, least({X.HEIGHT - 1}, d)) AS INTEGER) AS y2,
    a < 0 OR b < 0 OR c > {X.WIDTH - 1} OR d > {X.HEIGHT - 1} OR a > {X.WIDTH - 1} OR b > {X.HEIGHT - 1} OR c < 0 OR d < 0 AS clipped
  FROM spans),
regions AS (SELECT *, CAST({X.WIDTH} AS INTEGER) AS width, CAST({X.HEIGHT} AS INTEGER) AS height FROM held WHERE x2 > x1 AND y2 > y1)"""
JUDGED = REGION_SQL + """, tests AS (
  SELECT *, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS roi_area,
    CAST(x1 <= 2 AS INTEGER) + CAST(y1 <= 2 AS INTEGER) + CAST(x2 >= width - 3 AS INTEGER) + CAST(y2 >= height - 3 AS INTEGER) AS border_sides FROM regions),
judged AS (
  SELECT *, concat_ws(',', CASE WHEN roi_area < 2500 THEN 'roi_area_too_small' END, CASE WHEN w < 64 THEN 'roi_width_too_small' END,
    CASE WHEN h < 48 THEN 'roi_height_too_small' END, CASE WHEN roi_area / (width * height) > 0.65e0 THEN 'roi_area_too_large' END,
    CASE WHEN visible_points < 12 THEN 'visible_points_too_few' END, CASE WHEN border_sides > 2 THEN 'roi_at_image_edge' END) AS reasons FROM tests)"""
OWNED = JUDGED + f""", ranked AS (
  SELECT scene_id, frame_index, candidate_id, count(*) FILTER (reasons = '') AS good_views, coalesce(sum(visible_points) FILTER (reasons = ''), 0) AS good_points,
    coalesce(max(roi_area) FILTER (reasons = ''), 0) AS largest, sum(visible_points) AS all_points FROM judged GROUP BY ALL),
best AS (
  SELECT r.*, k.target_key AS track_id, row_number() OVER (PARTITION BY r.scene_id, k.target_key ORDER BY good_views DESC, good_points DESC, largest DESC, all_points DESC, r.frame_index, candidate_id) AS n
  FROM ranked r JOIN keyed k ON CAST(k.bbox_index AS VARCHAR) = candidate_id)
SELECT scene_id, track_id, frame_index, candidate_id, good_views, CAST(good_points AS BIGINT) AS good_points, CAST(all_points AS BIGINT) AS all_points FROM best WHERE n = 1"""

WEAK = f"""{GROUPS}, marked AS (
  SELECT s.frame_index, g."group", CAST(s.label AS BIGINT) AS label, min_x, min_y, max_x, max_y, points < {WEAK_POINTS} OR flatness < 0.25e0 AS weak FROM shapes s JOIN groups g ON g.frame_index = s.frame_index AND g.label = s.label),
firm AS (
  SELECT a.frame_index, a.label AS a, b.label AS b FROM marked a JOIN marked b ON a.frame_index = b.frame_index AND a."group" = b."group" AND a.label <> b.label
  WHERE sqrt(greatest(0, a.min_x - b.max_x, b.min_x - a.max_x)**2 + greatest(0, a.min_y - b.max_y, b.min_y - a.max_y)**2) <= {MERGE['most']}
    AND (NOT (a.weak OR b.weak) OR (least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x) >= 0.05e0 AND least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y) >= 0.05e0))),
held AS (SELECT frame_index, a, b FROM firm UNION SELECT h.frame_index, h.a, f.b FROM held h JOIN firm f ON h.frame_index = f.frame_index AND h.b = f.a),
parts AS (SELECT m.frame_index, m."group", least(m.label, coalesce(min(h.b), m.label)) AS root FROM marked m LEFT JOIN held h ON h.frame_index = m.frame_index AND h.a = m.label GROUP BY m.frame_index, m."group", m.label)
SELECT '0' AS scene_id, frame_index, "group" FROM parts GROUP BY frame_index, "group" HAVING count(DISTINCT root) > 1"""


def _weak(s: SparkSession, d: str) -> DataFrame:
    found = _fragments(s, d).withColumn("label", F.col("label").cast("long"))
    return cluster.weak_groups(found, cluster.merged_fragments(found, cluster.fragment_gaps(found, **MERGE)), MERGE["most"], min_points=WEAK_POINTS)


def _detected(s: SparkSession, d: str) -> DataFrame:
    """Candidates of the production method on voxels of the test points."""
    return cluster.detect_clusters(X.points(s, d), _boxes(s, d), {"side": SIDE}, {"method": "hdbscan", "min_cluster_size": 6, "min_samples": 3}, merge={"most": 1.0}, weak={"min_points": 6, "min_flatness": 0.05}, min_points=6, max_low_area=None, max_volume=1e9, max_extent=200.0)


def _pictures(s: SparkSession, d: str) -> DataFrame:
    """pictures of half the calibrated size for frames with boxes: three places, the left one only in odd frames, none in every third frame."""
    frames = X.boxes(s, d).select("scene_id", "frame_index").distinct().where("frame_index % 3 <> 0")
    name = F.explode(F.array(F.lit("CAM_front"), F.lit("cam_back"), F.when(F.col("frame_index") % 2 == 1, F.lit("cam_LEFT"))))
    named = frames.withColumn("asset_name", name).where("asset_name is not null")
    path = F.concat(F.lit("scene_"), "scene_id", F.lit("/frame_"), "frame_index", F.lit("/"), "asset_name", F.lit(".jpg"))
    return named.select("scene_id", "frame_index", "asset_name", path.alias("path"), F.lit(X.WIDTH // 2).alias("width"), F.lit(X.HEIGHT // 2).alias("height"))


def _box_views(s: SparkSession, d: str) -> DataFrame:
    found = inspection.candidates(s.createDataFrame([], "scene_id string, frame_index int, cluster_id string, members array<array<double>>"), X.boxes(s, d), _pictures(s, d), X.cameras(s))
    v = found.select("scene_id", "frame_index", "candidate_id", F.explode("views").alias("v")).select("scene_id", "frame_index", "candidate_id", "v.*")
    return v.select("scene_id", "frame_index", "candidate_id", "camera_id", "path", "x1", "y1", "x2", "y2", "visible_points", "reasons")


def _frame_projection(s: SparkSession, d: str) -> DataFrame:
    """All frames with boxes or points: clusters and boxes in pictures."""
    points, boxes, pictures = X.points(s, d), _boxes(s, d), _pictures(s, d)
    clusters = inspection.clusters_with_points(points, boxes, {"side": SIDE}, {"method": "hdbscan", "min_cluster_size": 6, "min_samples": 3}, merge={"most": 1.0}, min_points=6, max_low_area=None, max_volume=1e9, max_extent=1e9)
    found = stored(inspection.candidates(clusters, boxes, pictures, X.cameras(s)), "candidates")
    frames = boxes.select("scene_id", "frame_index").unionByName(points.select("scene_id", "frame_index"))
    return inspection.frame_results(frames, clusters, boxes, points, pictures, found)


def _chains(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """F4 as chains: each user's events are a block of points, four blocks of a scene follow one another a short gap apart."""
    e = X.table(s, d, "events").select("event_id", (F.col("user_id") % 5).cast("string").alias("scene_id"), F.lit(1).alias("frame_index"), F.floor(F.col("user_id") / 5).alias("label"))
    digit = lambda k: (F.floor(F.col("event_id") / 10**k) % 10) * F.lit(0.1)
    x = F.col("label") * F.lit(1.1) + F.floor(F.col("label") / 4) * F.lit(5.0) + digit(0)
    points = e.select("scene_id", "frame_index", F.col("event_id").alias("point_idx"), x.alias("x"), digit(1).alias("y"), digit(2).alias("z"))
    return points, e.select("scene_id", "frame_index", F.col("event_id").alias("point_idx"), "label")


def _weak_chains(s: SparkSession, d: str) -> DataFrame:
    points, labels = _chains(s, d)
    found = cluster.fragments(points, labels)
    few = found.agg(F.percentile("points", 0.3)).first()[0] or 0  # what counts as few grows with the tables
    groups = cluster.merged_fragments(found, cluster.fragment_gaps(found, CHAIN_GAP))
    return cluster.weak_groups(found, groups, CHAIN_GAP, min_points=int(few), min_flatness=0.0)


CHAIN_GAP = 0.35
QUERIES = {
    "weak_chains": _weak_chains,
    "picture_cameras": lambda s, d: projection.cameras_of_images(_pictures(s, d), X.cameras(s)).select("scene_id", "frame_index", "path", "camera_id"),
    "box_views": _box_views,
    "frame_projection": _frame_projection,
    "weak_groups": _weak,
    "hdbscan_labels": lambda s, d: cluster.hdbscan(X.dense_points(s, d), 6, 3, "eom"),
    "detect_clusters": _detected,
    "possible_missing_annotation": lambda s, d: cluster.possible_missing(_detected(s, d), 5.0),
    "residual_points": lambda s, d: _outside(s, d).select("scene_id", "frame_index", "point_idx"),
    "voxel_means": lambda s, d: _rounded(_means(s, d), "x", "y", "z", digits=8),
    "above_ground_means": lambda s, d: cloud.above_ground(_means(s, d), 0.3).groupBy("scene_id", "frame_index").agg(F.count("x").alias("voxels"), F.sum("points").alias("points")),
    "frame_shapes": lambda s, d: _rounded(cloud.shapes(X.points(s, d), ["scene_id", "frame_index"]), "volume", "flatness", "thickness", digits=4).select("scene_id", "frame_index", "points", "volume", "flatness", "thickness"),
    "dbscan_labels": _labels,
    "fragment_shapes": lambda s, d: _rounded(_fragments(s, d), "volume", "flatness", "thickness", digits=4).select("frame_index", "label", "points", "volume", "flatness", "thickness"),
    "fragment_gaps": lambda s, d: _rounded(cluster.fragment_gaps(_fragments(s, d), **MERGE), "gap"),
    "merged_fragments": lambda s, d: cluster.merged_fragments(f := _fragments(s, d), cluster.fragment_gaps(f, **MERGE)),
    "cluster_gates": _gates,
    "box_edge_points": lambda s, d: _rounded(projection.box_edge_points(X.boxes(s, d)), "x", "y", "z").groupBy("scene_id", "frame_index").agg(F.count("x").alias("points"), *[F.round(F.sum(a), 2).alias(a) for a in "xyz"]),
    "camera_match": lambda s, d: projection.usable_cameras(X.cameras(s)).select("place", "camera_id"),
    "box_regions": _regions,
    "region_quality": lambda s, d: _regions(s, d).withColumns(projection.quality()).select("scene_id", "frame_index", "candidate_id", "camera_id", "roi_area", "border_sides", "reasons", "good"),
    "crop_bounds": lambda s, d: _regions(s, d).withColumns(projection.crop_bounds()).select("candidate_id", "camera_id", "crop_x1", "crop_y1", "crop_x2", "crop_y2"),
    "best_view_of_track": lambda s, d: _best(s, d).select("scene_id", "track_id", "frame_index", "candidate_id", "good_views", "good_points", "all_points"),
}
PICTURES_SQL = """pictures AS (
  SELECT scene_id, frame_index, 'scene_' || scene_id || '/frame_' || frame_index || '/' || name || '.jpg' AS path, camera_id
  FROM (SELECT DISTINCT scene_id, frame_index FROM boxes WHERE frame_index % 3 <> 0), (VALUES ('CAM_front', 'cam_front_1'), ('cam_back', 'cam_back_1'), ('cam_LEFT', 'cam_left_1')) t(name, camera_id)
  WHERE name <> 'cam_LEFT' OR frame_index % 2 = 1)"""
HALF_SQL = JUDGED.replace("GROUP BY ALL HAVING", "GROUP BY ALL HAVING", 1)
for _c, _x in (("min(u)", "floor"), ("min(v)", "floor"), ("max(u)", "ceil"), ("max(v)", "ceil")):
    HALF_SQL = HALF_SQL.replace(f"{_x}({_c})", f"{_x}({_c} * 0.5e0)")
HALF_SQL = HALF_SQL.replace(str(X.WIDTH - 1), str(X.WIDTH // 2 - 1)).replace(str(X.HEIGHT - 1), str(X.HEIGHT // 2 - 1)).replace(f"CAST({X.WIDTH} AS INTEGER)", f"CAST({X.WIDTH // 2} AS INTEGER)").replace(f"CAST({X.HEIGHT} AS INTEGER)", f"CAST({X.HEIGHT // 2} AS INTEGER)")
CHAINS_SQL = f"""WITH RECURSIVE pts AS (
  SELECT CAST(user_id % 5 AS VARCHAR) AS scene_id, user_id // 5 AS label, (user_id // 5) * 1.1e0 + ((user_id // 5) // 4) * 5e0 + (event_id % 10) * 0.1e0 AS x, ((event_id // 10) % 10) * 0.1e0 AS y, ((event_id // 100) % 10) * 0.1e0 AS z FROM events),
f AS (SELECT scene_id, label, count(*) AS points, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM pts GROUP BY ALL),
few AS (SELECT CAST(floor(quantile_cont(points, 0.3)) AS BIGINT) AS least FROM f),
near AS (
  SELECT a.scene_id, a.label AS a, b.label AS b, NOT (a.points < least OR b.points < least) OR (least(a.bx, b.bx) - greatest(a.ax, b.ax) >= 0.05e0 AND least(a.by_, b.by_) - greatest(a.ay, b.ay) >= 0.05e0) AS firm
  FROM f a JOIN f b ON a.scene_id = b.scene_id AND a.label <> b.label, few
  WHERE sqrt(greatest(0, a.ax - b.bx, b.ax - a.bx)**2 + greatest(0, a.ay - b.by_, b.ay - a.by_)**2) <= {CHAIN_GAP}e0 AND greatest(0, a.az - b.bz, b.az - a.bz) <= 1),
tied AS (SELECT scene_id, a, b FROM near UNION SELECT t.scene_id, t.a, n.b FROM tied t JOIN near n ON n.scene_id = t.scene_id AND n.a = t.b),
held AS (SELECT scene_id, a, b FROM near WHERE firm UNION SELECT t.scene_id, t.a, n.b FROM held t JOIN near n ON n.scene_id = t.scene_id AND n.a = t.b AND n.firm),
grouped AS (SELECT f.scene_id, f.label, least(f.label, coalesce(min(t.b), f.label)) AS g FROM f LEFT JOIN tied t ON t.scene_id = f.scene_id AND t.a = f.label GROUP BY f.scene_id, f.label),
parts AS (SELECT g.scene_id, g.g, least(g.label, coalesce(min(h.b), g.label)) AS root FROM grouped g LEFT JOIN held h ON h.scene_id = g.scene_id AND h.a = g.label GROUP BY g.scene_id, g.g, g.label)
SELECT scene_id, 1::INTEGER AS frame_index, g AS "group" FROM parts GROUP BY scene_id, g HAVING count(DISTINCT root) > 1"""
ORACLE = {
    "weak_chains": CHAINS_SQL,
    "picture_cameras": f"WITH {X.BOXES_SQL}, {PICTURES_SQL} SELECT scene_id, frame_index, path, camera_id FROM pictures",
    "box_views": f"{HALF_SQL}, {PICTURES_SQL} SELECT j.scene_id, j.frame_index, j.candidate_id, j.camera_id, path, x1, y1, x2, y2, visible_points, reasons FROM judged j JOIN pictures p ON p.scene_id = j.scene_id AND p.frame_index = j.frame_index AND p.camera_id = j.camera_id",
    "weak_groups": WEAK,
    "residual_points": f"{OUTSIDE} SELECT scene_id, frame_index, point_idx FROM outside",
    "voxel_means": f"{MEANS} SELECT scene_id, frame_index, vx, vy, vz, points, round(x, 8) AS x, round(y, 8) AS y, round(z, 8) AS z FROM means",
    "above_ground_means": f"{MEANS} SELECT scene_id, frame_index, count(*) AS voxels, CAST(sum(points) AS BIGINT) AS points FROM means WHERE z > 0.3e0 GROUP BY ALL",
    "frame_shapes": f"WITH {X.POINTS_SQL}, {shape_sql('points', 'scene_id, frame_index')} SELECT scene_id, frame_index, points, round(volume, 4) AS volume, round(flatness, 4) AS flatness, round(thickness, 4) AS thickness FROM shapes",
    "dbscan_labels": f"{DBSCAN} SELECT scene_id, frame_index, point_idx, label, core FROM labels",
    "fragment_shapes": f"{FRAGMENTS} SELECT frame_index, label, points, round(volume, 4) AS volume, round(flatness, 4) AS flatness, round(thickness, 4) AS thickness FROM shapes",
    "fragment_gaps": f"{GAPS} SELECT scene_id, frame_index, a, b, round(gap, 5) AS gap FROM gaps",
    "merged_fragments": f"{GROUPS} SELECT * FROM groups",
    "cluster_gates": GATE,
    "box_edge_points": f"WITH {X.BOXES_SQL}, {EDGE_SQL} SELECT scene_id, frame_index, count(*) AS points, round(sum(round(x, 5)), 2) AS x, round(sum(round(y, 5)), 2) AS y, round(sum(round(z, 5)), 2) AS z FROM edge_points GROUP BY ALL",
    "camera_match": "SELECT * FROM (VALUES ('front', 'cam_front_1'), ('left', 'cam_left_1'), ('right', 'cam_right_1'), ('back', 'cam_back_1')) t(place, camera_id)",
    "box_regions": f"{REGION_SQL} SELECT * FROM regions",
    "region_quality": f"{JUDGED} SELECT scene_id, frame_index, candidate_id, camera_id, roi_area, border_sides, reasons, reasons = '' AS good FROM judged",
    "crop_bounds": f"""{REGION_SQL} SELECT candidate_id, camera_id, greatest(0, x1 - mx) AS crop_x1, greatest(0, y1 - my) AS crop_y1, least(width, x2 + mx) AS crop_x2, least(height, y2 + my) AS crop_y2
FROM (SELECT *, CAST(round_even((x2 - x1) * 0.25e0, 0) AS INTEGER) AS mx, CAST(round_even((y2 - y1) * 0.25e0, 0) AS INTEGER) AS my FROM regions)""",
    "best_view_of_track": OWNED,
}
