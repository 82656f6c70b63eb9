"""Queries of the rules, each with its SQL."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C
from lidaraudit.operators import frames, sizes, summary, tracks
from lidaraudit.sources import fixtures as X

ROUND = 6


def _shown(found: DataFrame) -> DataFrame:
    return tracks.persistent(found).withColumn("value", F.round("value", ROUND))


#: Rules by name, which are those of the findings; callers pick some.
RULES = ("label_consistency", "position_jump", "rotation_jump", "size_consistency", "broken_track", "empty_frame", "size_outlier", "dimension_mismatch")


def box_rules(boxes: DataFrame, expected: DataFrame, dimensions: DataFrame, enabled: tuple[str, ...] = RULES) -> DataFrame:
    """Unmerged findings of the enabled rules that judge boxes: one pass, with one window if a rule looks back.

    Rules that aren't known are named in a warning and skipped; a rule that is named twice runs once.
    """
    if unknown := [r for r in enabled if r not in RULES]:
        warnings.warn(f"unknown rules are skipped: {', '.join(unknown)}", stacklevel=2)
    back = [r for r in tracks.ENTRIES if r in enabled]
    rows = tracks.history(boxes, expected if "broken_track" in back else None) if back else sizes.sized(boxes)
    entries = [e for r in back for e in tracks.ENTRIES[r]()]
    if "size_outlier" in enabled:
        entries += sizes.outlier_entries()
    if "dimension_mismatch" in enabled:
        rows = sizes.with_references(rows, dimensions)
        entries += sizes.mismatch_entries()
    return tracks.findings(rows, entries or [tracks.entry("", F.lit(False))])


def _rule(spark: SparkSession, d: str, name: str) -> DataFrame:
    boxes, expected = X.boxes(spark, d), X.expected_frames(spark, d)
    return frames.empty_frame(boxes, expected) if name == "empty_frame" else box_rules(boxes, expected, X.dimensions(spark), (name,))


def run_rules(spark: SparkSession, d: str, enabled: tuple[str, ...] = RULES, split_failed: bool = True) -> DataFrame:
    """Merged findings of the enabled rules, then a finding for each failed frame, as the whole inspection gives them."""
    boxes, expected = X.boxes(spark, d), X.expected_frames(spark, d)
    found = box_rules(boxes, expected, X.dimensions(spark), enabled)
    if "empty_frame" in enabled:
        found = found.unionByName(frames.empty_frame_readable(boxes, expected) if split_failed else frames.empty_frame(boxes, expected))
    merged = tracks.persistent(found)
    failed = frames.missing_bbox(expected)
    one = failed.select("*", F.col("frame_index").alias("first_frame"), F.col("frame_index").alias("last_frame"), F.lit(1).cast("long").alias("occurrence_count")).drop("part")
    return merged.unionByName(one).withColumn("value", F.round("value", ROUND))


def _broken_by_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """The broken tracks of boxes whose bbox_index repeats from frame to frame."""
    boxes = frames.ordinals(X.boxes(spark, d).withColumn("event_id", F.col("bbox_index")), "event_id")
    return tracks.broken_track(tracks.history(boxes, X.expected_frames(spark, d))).select("scene_id", "track_id", "frame_index", "bbox_index", "value")


COLUMNS = "scene_id, frame_index, target_key AS track_id, CAST(bbox_index AS VARCHAR) AS bbox_index, label_of AS label"
SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY scene_id, target_key ORDER BY frame_index, bbox_index) AS rn FROM keyed)"


def _found(rule: str, body: str, value: str, part: str = "0", columns: str = COLUMNS) -> str:
    return f"SELECT {columns}, '{rule}' AS rule_id, 'Warning' AS severity, {part} AS part, CAST({value} AS DOUBLE) AS value FROM ({body})"


def _numbered(name: str, where: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY scene_id, target_key ORDER BY frame_index, bbox_index) AS rn FROM keyed WHERE {where})"


PAIR = "a JOIN {0} b ON a.scene_id = b.scene_id AND a.target_key = b.target_key AND b.rn = a.rn + 1"
PLACED = _numbered("placed", "position_x IS NOT NULL AND position_y IS NOT NULL AND position_z IS NOT NULL")
TURNED = _numbered("turned", "rotation_z IS NOT NULL")
SIZED = _numbered("sized", "scale_x IS NOT NULL AND scale_y IS NOT NULL AND scale_z IS NOT NULL")
BASE = f"{X.BOXES_SQL}, {X.FRAMES_SQL}, {SEQ}, {PLACED}, {TURNED}, {SIZED}, {X.DIMENSIONS_SQL}"
AXES = " UNION ALL ".join(f"SELECT b.*, {i} AS axis, abs(b.scale_{a} - a.scale_{a}) / nullif(abs(a.scale_{a}), 0) AS change FROM sized {PAIR.format('sized')} AND b.frame_index = a.frame_index + 1" for i, a in enumerate("xyz"))
SIDES = " UNION ALL ".join(f"SELECT *, {i} AS axis, scale_{a} AS side FROM sized" for i, a in enumerate("xyz"))
FRAME_COLUMNS = "scene_id, frame_index, '' AS track_id, '' AS bbox_index, '' AS label"
EMPTY = "SELECT e.* FROM expected e WHERE {0} NOT EXISTS (SELECT 1 FROM boxes b WHERE b.scene_id = e.scene_id AND b.frame_index = e.frame_index)"
MISMATCH = """
  SELECT k.scene_id, k.frame_index, k.target_key, k.bbox_index, k.label_of,
    bool_or(abs(scale_x - ref_length) <= 1e300 AND scale_x BETWEEN ref_length * (1 - tolerance) AND ref_length * (1 + tolerance)
      AND scale_y BETWEEN ref_width * (1 - tolerance) AND ref_width * (1 + tolerance)
      AND scale_z BETWEEN ref_height * (1 - tolerance) AND ref_height * (1 + tolerance)) AS passes,
    min(greatest(abs(scale_x - ref_length) / ref_length, abs(scale_y - ref_width) / ref_width, abs(scale_z - ref_height) / ref_height)) AS deviation
  FROM sized k JOIN dims ON (class_name = k.label_of OR starts_with(class_name, k.label_of || '_')) AND ref_length IS NOT NULL
  WHERE k.label_of <> '' GROUP BY ALL"""
FOUND = {
    "label_consistency": _found("LabelConsistency", f"SELECT b.* FROM seq {PAIR.format('seq')} WHERE a.label_of <> b.label_of", "NULL"),
    "position_jump": _found("PositionJump", f"SELECT b.*, sqrt((a.position_x - b.position_x)**2 + (a.position_y - b.position_y)**2 + (a.position_z - b.position_z)**2) AS v FROM placed {PAIR.format('placed')} WHERE b.frame_index = a.frame_index + 1 AND v > 25", "v"),
    "rotation_jump": _found("RotationJump", f"SELECT b.*, least(abs(a.rotation_z - b.rotation_z), 2 * pi() - abs(a.rotation_z - b.rotation_z)) AS v FROM turned {PAIR.format('turned')} WHERE b.frame_index = a.frame_index + 1 AND v > 1", "v"),
    "size_consistency": _found("SizeConsistency", f"SELECT * FROM ({AXES}) WHERE change > 0.3e0", "change", "axis"),
    "broken_track": _found("BrokenTrack", f"""
      SELECT *, row_number() OVER (PARTITION BY scene_id, target_key ORDER BY frame_index, bbox_index) AS n FROM (
        SELECT b.* FROM seq {PAIR.format('seq')} AND b.frame_index - a.frame_index - 1 BETWEEN 1 AND 3
        WHERE NOT EXISTS (SELECT 1 FROM ({EMPTY.format('')}) z WHERE z.scene_id = b.scene_id AND z.frame_index > a.frame_index AND z.frame_index < b.frame_index))""", "n"),
    "empty_frame": _found("EmptyFrame", EMPTY.format(""), "NULL", columns=FRAME_COLUMNS),
    "size_outlier": _found("SizeOutlier", f"SELECT * FROM ({SIDES}) WHERE side < 0.1e0 OR side > 30", "side", "axis"),
    "dimension_mismatch": _found("DimensionMismatch", f"SELECT * FROM ({MISMATCH}) WHERE NOT passes", "deviation"),
}
FOUND_READABLE = _found("EmptyFrame", EMPTY.format("e.read_ok AND"), "NULL", columns=FRAME_COLUMNS)


def _persistent(found: str) -> str:
    """Another way to islands: frames that follow one another keep their distance to their rank."""
    order = "ORDER BY frame_index, TRY_CAST(bbox_index AS BIGINT), part"
    return f"""WITH {BASE}, found AS ({found}),
islands AS (SELECT *, frame_index - dense_rank() OVER (PARTITION BY scene_id, track_id, rule_id ORDER BY frame_index) AS island FROM found),
merged AS (
  SELECT scene_id, track_id, rule_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS occurrence_count,
    first(bbox_index {order}) AS bbox_index, first(label {order}) AS label, first(severity {order}) AS severity,
    round(first(value {order}), {ROUND}) AS value, min(frame_index) AS frame_index
  FROM islands GROUP BY scene_id, track_id, rule_id, island)"""


ALL_FOUND = " UNION ALL ".join(FOUND_READABLE if r == "empty_frame" else FOUND[r] for r in RULES)
ALL_SQL = _persistent(ALL_FOUND) + """,
report AS (
  SELECT scene_id, frame_index, first_frame, last_frame, occurrence_count, track_id, bbox_index, label, rule_id, severity, value FROM merged
  UNION ALL SELECT scene_id, frame_index, frame_index, frame_index, 1, '', '', '', 'MissingBBox', 'Warning', NULL FROM expected WHERE NOT read_ok)"""

FIELDS = ["track_id", "target_id", "uuid", "object_id", "label", "className", "position_x", "rotation_z", "scale_x"]


def _typed(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, " 1.5 ").when(F.col("event_id") % 5 == 1, "").when(F.col("event_id") % 5 == 2, "abc").when(F.col("event_id") % 5 == 3, F.col("value").cast("string")).otherwise(F.lit(None))
    return X.table(spark, d, "events").select("event_id", C.number(raw).alias("number"))


#: Fixed values of the tests: tolerance of length, width and height of each class of the dictionary (null: none).
SIDE_TOLERANCES = {"click": (0.5, 0.25, 0.75), "view_low": (0.75, 0.5, 0.5), "view_high": (0.25, 0.5, 0.75), "purchase": (0.5, 0.5, 0.5), "refund": (0.5, None, 0.5)}


def _by_side(spark: SparkSession) -> DataFrame:
    rows = [(name, order, *refs, *SIDE_TOLERANCES[name]) for name, order, *refs, _ in X.DIMENSIONS]
    return spark.createDataFrame(rows, "class_name string, class_order int, ref_length double, ref_width double, ref_height double, tol_length double, tol_width double, tol_height double")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with a stored key: some have one, some none; they are told by it or by their number."""
    n = F.col("bbox_index")
    return X.boxes(spark, d).withColumn("resolved_target_key", F.when(n % 11 == 0, "").when(n % 13 != 0, F.concat(F.lit("K"), F.col("track_id"), F.lit("/"), n % 2)))


QUERIES = {name: (lambda s, d, n=name: _shown(_rule(s, d, n))) for name in RULES} | {
    "dimension_mismatch_by_side": lambda s, d: _shown(box_rules(X.boxes(s, d), X.expected_frames(s, d), _by_side(s), ("dimension_mismatch",))),
    "stored_target_key": lambda s, d: tracks.keyed(_stored(s, d)).select("bbox_index", "target_key"),
    "stored_key_findings": lambda s, d: _shown(box_rules(_stored(s, d), X.expected_frames(s, d), X.dimensions(s), ("label_consistency", "size_consistency"))),
    "empty_frame_readable": lambda s, d: _shown(frames.empty_frame_readable(X.boxes(s, d), X.expected_frames(s, d))),
    "broken_track_ordinals": _broken_by_ordinals,
    "best_variant": lambda s, d: sizes.best_variant(sizes.with_references(sizes.sized(X.boxes(s, d)), X.dimensions(s))).where("variant is not null").select("bbox_index", "variant"),
    "missing_bbox": lambda s, d: frames.missing_bbox(X.expected_frames(s, d)).select("scene_id", "frame_index", "rule_id"),
    "all_findings": run_rules,
    "findings_by_rule": lambda s, d: summary.by_rule(run_rules(s, d)),
    "rule_summary": lambda s, d: summary.rule_summary(run_rules(s, d), X.boxes(s, d), X.expected_frames(s, d)),
    "top_tracks": lambda s, d: run_rules(s, d).where("track_id <> ''").groupBy("scene_id", "track_id").agg(F.sum("occurrence_count").alias("hits")).orderBy(F.desc("hits"), "scene_id", "track_id").limit(20),
    "resolve_target_key": lambda s, d: X.boxes(s, d).select("bbox_index", C.key_field().alias("field"), C.key_value().alias("target_key"), C.label().alias("label")),
    "safe_number": _typed,
    "complete_geometry": lambda s, d: X.boxes(s, d).dropna(subset=[f"{p}_{a}" for p in ("position", "rotation", "scale") for a in "xyz"]).groupBy("scene_id").agg(F.count("bbox_index").alias("boxes")),
    "inspection_frames": lambda s, d: frames.inspected(X.expected_frames(s, d)).groupBy("scene_id").agg(F.count("frame_index").alias("frames"), F.min("frame_index").alias("first")),
    "sampled_frames": lambda s, d: frames.sampled(frames.inspected(X.expected_frames(s, d)), 2, 10).select("scene_id", "frame_index"),
    "field_fill_rates": lambda s, d: summary.fill_rates(X.boxes(s, d), FIELDS),
    "key_usage": lambda s, d: summary.key_usage(X.boxes(s, d)),
    "reference_sizes": lambda s, d: sizes.reference_sizes(X.boxes(s, d)).select("class_name", "objects", *[F.round(f"ref_{x}", ROUND).alias(f"ref_{x}") for x, _ in sizes.SIDES]),
}
def _sided(sql: str) -> str:
    """The same with a dictionary that has a tolerance for each side."""
    rows = [(name, order, *refs, *SIDE_TOLERANCES[name]) for name, order, *refs, _ in X.DIMENSIONS if None not in SIDE_TOLERANCES[name]]
    sql = sql.replace(X.DIMENSIONS_SQL, X.values_sql(rows, "dims", "class_name, class_order, ref_length, ref_width, ref_height, tol_length, tol_width, tol_height"))
    for side, _ in sizes.SIDES:
        for sign in "-+":
            sql = sql.replace(f"ref_{side} * (1 {sign} tolerance)", f"ref_{side} * (1 {sign} tol_{side})")
    return sql


KEYS_SQL = "coalesce(nullif(track_id, ''), nullif(target_id, ''), nullif(uuid, ''), nullif(object_id, ''), CAST(bbox_index AS VARCHAR)) AS target_key"
STORED_SQL = "CASE WHEN bbox_index % 11 <> 0 AND bbox_index % 13 <> 0 THEN 'K' || track_id || '/' || bbox_index % 2 ELSE 'bbox_index:' || bbox_index END AS target_key"


def _with_stored_keys(sql: str) -> str:
    assert KEYS_SQL in sql
    return sql.replace(KEYS_SQL, STORED_SQL)


ORACLE = {name: _persistent(FOUND[name]) + " SELECT * FROM merged" for name in RULES} | {
    "dimension_mismatch_by_side": _sided(_persistent(FOUND["dimension_mismatch"]) + " SELECT * FROM merged"),
    "stored_target_key": _with_stored_keys(f"WITH {X.BOXES_SQL} SELECT bbox_index, target_key FROM keyed"),
    "stored_key_findings": _with_stored_keys(_persistent(FOUND["label_consistency"] + " UNION ALL " + FOUND["size_consistency"]) + " SELECT * FROM merged"),
    "empty_frame_readable": _persistent(FOUND_READABLE) + " SELECT * FROM merged",
    "broken_track_ordinals": f"""WITH {X.BOXES_SQL.replace('keyed AS', 'keyed0 AS')},
keyed AS (SELECT * EXCLUDE (target_key, bbox_index), row_number() OVER (PARTITION BY scene_id, frame_index ORDER BY bbox_index) - 1 AS bbox_index,
  coalesce(nullif(track_id, ''), nullif(uuid, ''), CAST(row_number() OVER (PARTITION BY scene_id, frame_index ORDER BY bbox_index) - 1 AS VARCHAR)) AS target_key FROM keyed0),
{X.FRAMES_SQL}, {SEQ}, broken AS ({FOUND['broken_track']})
SELECT scene_id, track_id, frame_index, bbox_index, value FROM broken""",
    "best_variant": f"""WITH {BASE}, judged AS (
  SELECT k.bbox_index, class_name AS variant, class_order, class_name = k.label_of AS exact,
    scale_x BETWEEN ref_length * (1 - tolerance) AND ref_length * (1 + tolerance) AND scale_y BETWEEN ref_width * (1 - tolerance) AND ref_width * (1 + tolerance)
      AND scale_z BETWEEN ref_height * (1 - tolerance) AND ref_height * (1 + tolerance) AS passes,
    greatest(abs(scale_x - ref_length) / ref_length, abs(scale_y - ref_width) / ref_width, abs(scale_z - ref_height) / ref_height) AS deviation
  FROM sized k JOIN dims ON (class_name = k.label_of OR starts_with(class_name, k.label_of || '_')) AND ref_length IS NOT NULL)
SELECT bbox_index, variant FROM (SELECT *, row_number() OVER (PARTITION BY bbox_index ORDER BY passes DESC, CASE WHEN passes THEN 0 ELSE deviation END, exact DESC, class_order) AS n FROM judged) WHERE n = 1""",
    "missing_bbox": f"WITH {BASE} SELECT scene_id, frame_index, 'MissingBBox' AS rule_id FROM expected WHERE NOT read_ok",
    "all_findings": ALL_SQL + " SELECT * FROM report",
    "findings_by_rule": ALL_SQL + " SELECT rule_id, count(*) AS findings, count(*) FILTER (severity = 'Warning') AS warnings FROM report GROUP BY rule_id",
    "rule_summary": ALL_SQL + """
SELECT e.scene_id, count(*) AS total_frames, count(*) FILTER (NOT read_ok) AS missing_bbox_count,
  (SELECT count(*) FROM boxes b WHERE b.scene_id = e.scene_id) AS total_bbox,
  (SELECT count(*) FROM report r WHERE r.scene_id = e.scene_id AND severity = 'Warning') AS total_warnings,
  (SELECT count(DISTINCT frame_index) FROM report r WHERE r.scene_id = e.scene_id) AS frames_with_issues,
  (SELECT count(DISTINCT nullif(track_id, '')) FROM report r WHERE r.scene_id = e.scene_id) AS tracks_with_issues
FROM expected e GROUP BY e.scene_id""",
    "top_tracks": ALL_SQL + " SELECT scene_id, track_id, CAST(sum(occurrence_count) AS BIGINT) AS hits FROM report WHERE track_id <> '' GROUP BY ALL ORDER BY hits DESC, scene_id, track_id LIMIT 20",
    "resolve_target_key": f"""WITH {X.BOXES_SQL} SELECT bbox_index, target_key, label_of AS label,
  CASE WHEN track_id <> '' THEN 'track_id' WHEN uuid <> '' THEN 'uuid' ELSE 'bbox_index' END AS field FROM keyed""",
    "safe_number": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1.5e0 WHEN 3 THEN value END AS number FROM events",
    "complete_geometry": f"WITH {BASE} SELECT scene_id, count(*) AS boxes FROM boxes WHERE position_x IS NOT NULL AND position_y IS NOT NULL AND scale_x IS NOT NULL AND scale_y IS NOT NULL GROUP BY scene_id",
    "inspection_frames": f"WITH {BASE} SELECT scene_id, count(*) AS frames, min(frame_index) AS first FROM expected WHERE frame_index > 1 GROUP BY scene_id",
    "sampled_frames": f"WITH {BASE} SELECT scene_id, frame_index FROM expected WHERE frame_index >= 2 AND (frame_index - 2) % 10 = 0",
    "field_fill_rates": f"WITH {BASE} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (trim(CAST({f} AS VARCHAR)) <> '') AS filled, count(*) AS rows, count(*) FILTER (trim(CAST({f} AS VARCHAR)) <> '') = 0 AS always_empty FROM boxes" for f in FIELDS),
    "key_usage": f"""WITH {BASE} SELECT CASE WHEN track_id <> '' THEN 'track_id' WHEN uuid <> '' THEN 'uuid' ELSE 'bbox_index' END AS field, count(*) AS boxes FROM boxes GROUP BY 1""",
    "reference_sizes": f"""WITH {BASE}, one AS (
  SELECT label_of, scene_id, target_key, median(scale_x) AS l, median(scale_y) AS w, median(scale_z) AS h FROM sized WHERE label_of <> '' GROUP BY ALL)
SELECT label_of AS class_name, count(*) AS objects, round(median(l), {ROUND}) AS ref_length, round(median(w), {ROUND}) AS ref_width, round(median(h), {ROUND}) AS ref_height FROM one GROUP BY 1""",
}
