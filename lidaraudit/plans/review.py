"""Queries on model answers and arriving files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.operators import assets, calls, decisions, verdicts
from lidaraudit.operators.tracks import keyed
from lidaraudit.plans import rules
from lidaraudit.sources import fixtures as X
from lidaraudit.sources import tables

ALLOWED = ["view", "click", "purchase", "signup"]
ALIASES = {"error": "purchase", "signup": "sign up"}


def answers(spark: SparkSession, d: str) -> DataFrame:
    """a JSON answer for each box, some in a fence, some malformed."""
    e = keyed(X.boxes(spark, d)).withColumn("n", F.col("bbox_index"))
    n = F.col("n")
    suggested = F.when(n % 4 == 0, F.col("label_of")).when(n % 4 == 1, "view").when(n % 4 == 2, "unknown").otherwise("tree")
    null_at_five = lambda c: F.when(n % 5 == 0, "null").otherwise(F.when(c, "true").otherwise("false"))
    confidence = F.when(n % 50 == 9, '"0.9"').when(n % 50 == 13, "true").when(n % 50 == 14, "1.2").otherwise((n % 101 / 100.0).cast("string"))
    fields = F.concat(
        F.lit('{"candidate_id": "'), F.when(n % 50 == 12, "other").otherwise(F.concat(F.lit("b"), n)), F.lit('", "cluster_id": "'),
        F.when(n % 50 == 12, "other").when(n % 3 == 0, "").otherwise(F.concat(F.lit("b"), n)),
        F.lit('", "label_match": '), null_at_five(n % 2 == 0), F.lit(', "bbox_match": '), null_at_five(n % 3 != 0),
        F.lit(', "contains_real_object": '), F.when(n % 50 == 16, '"yes"').when(n % 7 == 0, "false").otherwise("true"),
        F.lit(', "missing_annotation_suspected": '), F.when(n % 11 == 0, "false").otherwise("true"),
        F.lit(', "suggested_category": "'), suggested, F.lit('", "possible_category": "'), suggested,
        F.lit('", "confidence": '), confidence, F.lit(', "reason": "'), F.when(n % 50 == 11, "  ").otherwise("seen"), F.lit('"}'))
    text = F.when(n % 50 == 7, "not json").when(n % 50 == 15, "[1, 2]").when(n % 50 == 8, F.concat(F.lit("```json\n"), fields, F.lit("\n```"))).otherwise(fields)
    return e.select("scene_id", "frame_index", F.concat(F.lit("b"), n).alias("candidate_id"), F.col("target_key").alias("track_id"), F.col("label_of").alias("label"),
                    F.col("scale_x").alias("size_x"), F.col("scale_y").alias("size_y"), F.col("scale_z").alias("size_z"), text.alias("response"))


BASE = f"""WITH {X.BOXES_SQL}, {X.DIMENSIONS_SQL},
raw AS (
  SELECT scene_id, frame_index, 'b' || bbox_index AS candidate_id, target_key AS track_id, label_of AS label, scale_x AS size_x, scale_y AS size_y, scale_z AS size_z, bbox_index AS n,
    CASE n % 4 WHEN 0 THEN label_of WHEN 1 THEN 'view' WHEN 2 THEN 'unknown' ELSE 'tree' END AS category,
    CASE WHEN n % 5 <> 0 THEN n % 2 = 0 END AS lm, CASE WHEN n % 5 <> 0 THEN n % 3 <> 0 END AS bm,
    n % 7 <> 0 AS object, n % 11 <> 0 AS suspected, CAST(n % 101 AS DOUBLE) / 100 AS conf
  FROM keyed),
tested AS (
  SELECT *, category IN ('view', 'click', 'purchase', 'signup') AS scope,
    CASE WHEN n % 50 = 7 THEN 'invalid_json' WHEN n % 50 = 15 THEN 'response_json_must_be_object' END AS e1,
    category NOT IN ('view', 'click', 'purchase', 'signup', 'unknown', 'out_of_scope') AS odd,
    CASE WHEN n % 50 IN (9, 13) THEN 'confidence_must_be_number' WHEN n % 50 = 14 THEN 'confidence_out_of_range' WHEN n % 50 = 11 THEN 'reason_must_be_non_empty_string' END AS e3
  FROM raw),
wrong AS (SELECT *, coalesce(e1, CASE WHEN odd THEN 'invalid_suggested_category' END, e3, CASE WHEN n % 50 = 12 THEN 'candidate_id_mismatch' END) AS error FROM tested),
missing AS (SELECT *, coalesce(e1, CASE WHEN n % 50 = 16 THEN 'contains_real_object_must_be_boolean' END, CASE WHEN odd THEN 'invalid_possible_category' END, e3, CASE WHEN n % 50 = 12 THEN 'cluster_id_mismatch' END) AS error FROM tested),
named AS (
  SELECT *, CASE category WHEN 'error' THEN 'purchase' WHEN 'signup' THEN 'sign up' ELSE category END AS sug,
    CASE label WHEN 'error' THEN 'purchase' WHEN 'signup' THEN 'sign up' ELSE label END AS cur
  FROM wrong WHERE error IS NULL),
votes AS (
  SELECT *, CASE WHEN conf < 0.9e0 THEN 'confidence_below_report_threshold' WHEN lm IS NULL AND bm IS NULL THEN 'model_returned_unknown'
    WHEN lm = false AND sug = cur THEN 'model_response_internally_inconsistent' WHEN bm = false THEN 'bbox_mismatch_vote'
    WHEN lm = false AND (NOT scope OR sug = 'unknown') THEN 'label_mismatch_without_valid_suggestion' WHEN lm = false THEN 'label_mismatch_vote' ELSE 'annotation_consistent' END AS vote_reason
  FROM named),
ruled AS (
  SELECT *, CASE vote_reason WHEN 'bbox_mismatch_vote' THEN 'VisionBBoxMismatch' WHEN 'label_mismatch_vote' THEN 'VisionLabelMismatch' END AS vote_rule,
    CASE vote_reason WHEN 'bbox_mismatch_vote' THEN '' WHEN 'label_mismatch_vote' THEN sug END AS vote_category FROM votes),
cats AS (SELECT * FROM (VALUES ('view', 'view_low'), ('view', 'view_high'), ('click', 'click'), ('purchase', 'purchase')) t(name, key)),
gated AS (
  SELECT m.*, CASE WHEN size_x IS NULL OR size_y IS NULL OR size_z IS NULL THEN 'missing_measured_size' WHEN category NOT IN (SELECT name FROM cats) THEN 'unknown_vision_category'
    WHEN NOT EXISTS (SELECT 1 FROM cats JOIN dims ON class_name = key WHERE name = category AND ref_length > 0) THEN 'no_fixed_reference'
    WHEN EXISTS (SELECT 1 FROM cats JOIN dims ON class_name = key WHERE name = category AND ref_length > 0
      AND greatest(size_x, size_y) / greatest(ref_length, ref_width) BETWEEN 0.1e0 AND 2 AND least(size_x, size_y) / least(ref_length, ref_width) BETWEEN 0.1e0 AND 2
      AND size_z / ref_height BETWEEN 0.1e0 AND 2) THEN 'within_reference_multiplier' ELSE 'category_size_mismatch' END AS gate_reason
  FROM missing m),
outcomes AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN NOT scope THEN 'out_of_scope' WHEN NOT object THEN 'background' WHEN NOT suspected THEN 'not_suspected'
    WHEN conf < 0.92e0 THEN 'low_confidence' WHEN gate_reason NOT IN ('no_fixed_reference', 'within_reference_multiplier') THEN 'size_rejected' ELSE 'accepted' END AS outcome FROM gated)"""
COUNTED = """, counted AS (
  SELECT scene_id, track_id, vote_rule, vote_category, count(*) AS n, arg_max(candidate_id, (conf, -frame_index)) AS candidate_id FROM ruled WHERE vote_rule IS NOT NULL GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY scene_id, track_id ORDER BY n DESC, vote_rule DESC, vote_category DESC) AS place FROM counted)
SELECT w.scene_id, w.track_id, vote_rule, vote_category, w.n, o.observations, round(w.n / o.observations, 6) AS share
FROM won w JOIN (SELECT scene_id, track_id, count(*) AS observations FROM ruled GROUP BY ALL) o ON o.scene_id = w.scene_id AND o.track_id = w.track_id
WHERE place = 1 AND w.n >= 2 AND w.n / o.observations >= 0.05e0"""


def _votes(s: SparkSession, d: str) -> DataFrame:
    return decisions.wrong_votes(decisions.parse_wrong(answers(s, d), ALLOWED), ALIASES)


def _untracked(s: SparkSession, d: str) -> DataFrame:
    """Votes, those of every third box on an object that no track names, of another third on one whose track is empty."""
    n = F.substring("candidate_id", 2, 20).cast("long") % 3
    return _votes(s, d).withColumn("track_id", F.when(n == 0, "").when(n == 2, F.col("track_id")))


def _categories(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("view", ["view_low", "view_high"]), ("click", ["click"]), ("purchase", ["purchase"])], "name string, dimension_keys array<string>")


def _gated(s: SparkSession, d: str) -> DataFrame:
    parsed = decisions.parse_missing(answers(s, d), ALLOWED)
    gated = decisions.size_gate(parsed, _categories(s), X.dimensions(s))
    return decisions.missing_outcome(gated)


def asset_events(spark: SparkSession, d: str) -> DataFrame:
    """F8: purchases are point clouds, other events pictures of one of five cameras; a stamp for each hour."""
    e = X.table(spark, d, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - X.START_US) / F.lit(float(X.HOUR_US))).cast("int")
    stamp = F.concat(hour.cast("string"), F.lit(".25"))
    url = F.when(F.col("event_type") == "purchase", F.concat(F.lit("http://host/lidar/"), stamp, F.lit(".pcd"))).otherwise(
        F.concat(F.lit("http://host/camera/CAM"), F.col("user_id") % 5, F.lit("/"), stamp, F.lit(".jpg?e="), "event_id"))
    return e.select((F.col("user_id") % 5).cast("string").alias("scene_id"), F.col("ts").alias("arrival_ts"), url.alias("url"))


ASSETS = f"""WITH items AS (
  SELECT CAST(user_id % 5 AS VARCHAR) AS scene_id, ts AS arrival_ts, CASE WHEN event_type = 'purchase' THEN 'pcd' ELSE 'jpg' END AS kind, event_id,
    CAST(floor((epoch_us(ts) - {X.START_US}) / CAST({X.HOUR_US} AS DOUBLE)) AS INTEGER) AS h, user_id % 5 AS cam FROM events),
addressed AS (SELECT *, CASE kind WHEN 'pcd' THEN 'http://host/lidar/' || h || '.25.pcd' ELSE 'http://host/camera/CAM' || cam || '/' || h || '.25.jpg?e=' || event_id END AS url, h || '.25' AS group_key FROM items),
grouped AS (
  SELECT scene_id, group_key, h, count(*) FILTER (kind = 'pcd') AS pcd_count, count(*) FILTER (kind = 'jpg') AS jpg_count, min(arrival_ts) FILTER (kind = 'pcd') AS pcd_ts FROM addressed GROUP BY ALL),
claimed AS (SELECT *, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY h) AS INTEGER) AS frame_index FROM grouped WHERE pcd_count > 0)"""


def _assets(s: SparkSession, d: str) -> DataFrame:
    return assets.classified(asset_events(s, d))


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Made-up calls: every other box a cluster, every fourth from the cache, some tried more than once."""
    n = F.col("n")
    told = answers(s, d).withColumn("n", F.substring("candidate_id", 2, 20).cast("long"))
    return told.select(
        "scene_id", F.when(n % 2 == 0, "existing_bbox").otherwise("residual_cluster").alias("candidate_type"),
        F.when(n % 10 == 3, "error").when(n % 10 == 7, "skipped").otherwise("verified").alias("status"), (n % 4 == 0).alias("cache_hit"),
        F.when(n % 10 == 7, 0).otherwise(1 + n % 3).alias("attempts"), (n % 7 / 2).alias("seconds"), F.lit(1.5).alias("cached_seconds"))


def prepared_answer(request: dict) -> str:
    """Stands for a model: the answer is a column of the request; some fail always, some once."""
    n = request["n"]
    if n % 10 == 3 or (n % 7 == 1 and request["attempt"] == 1):
        raise ConnectionError("down")
    return request["prepared"]


def _review(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """A whole review: every other box, the others as clusters; every fourth has been answered before."""
    n = F.col("n")
    told = answers(s, d).withColumnRenamed("response", "prepared").withColumn("n", F.substring("candidate_id", 2, 20).cast("long"))
    candidates = told.withColumns({
        "candidate_type": F.when(n % 2 == 0, calls.BOX).otherwise(calls.CLUSTER), "quality": F.when(n % 31 == 30, None).when(n % 9 == 5, "low").otherwise("good"),
        "key": decisions.cache_key(F.lit("model").alias("model"), F.col("candidate_id"), F.col("label"))})
    cache = candidates.where(n % 4 == 0).select("key", "candidate_type", F.col("prepared").alias("response"), F.lit(1.5).alias("seconds"))
    return calls.review(candidates, prepared_answer, ALLOWED, ALIASES, _categories(s), X.dimensions(s), cache, delay_seconds=0.0)


def _vision_run(s: SparkSession, d: str) -> DataFrame:
    found = _review(s, d)
    out = verdicts.review_counters(found["calls"], found["outcomes"], found["votes"], low_quality=found["low_quality"], selected=found["candidates"])
    return out.select("scene_id", *RUN_COUNTERS)


def _sections(s: SparkSession, d: str) -> DataFrame:
    told = _review(s, d)["sections"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return told.select("scene_id", "frame_index", "candidate_id", text("vision.status").alias("status"), text("vision.error").alias("error"), F.coalesce("vision.attempts", F.lit(0)).alias("attempts"), text("vision_cache.hit").alias("hit"), text("vision_decision.accepted").alias("accepted"), text("vision_decision.reason").alias("reason"))


def _counters(s: SparkSession, d: str) -> DataFrame:
    out = verdicts.review_counters(_calls(s, d), _gated(s, d), _votes(s, d), mode="track_consensus", min_votes=2, min_share=0.05)
    return out.select("scene_id", *COUNTERS)


COUNTERS = (
    "total_test_clusters", "total_wrong_annotation_candidates", "api_failures", "api_skipped", "vision_cache_hits", "missing_cache_hits", "wrong_cache_hits", "missing_api_requests", "wrong_api_requests",
    "api_attempts", "api_retries", "api_elapsed_seconds", "estimated_cache_saved_seconds", "uncertain", "ai_out_of_scope", "ai_real_objects", "ai_background_or_noise", "category_size_rejected",
    "wrong_inconsistent_rejected", "wrong_unknown", "wrong_consensus_rejected", "wrong_label_mismatches", "wrong_bbox_mismatches", "wrong_report_findings", "report_findings", "api_requests")


RUN_COUNTERS = (
    "total_test_clusters", "total_wrong_annotation_candidates", "api_failures", "api_skipped", "vision_cache_hits", "missing_cache_hits", "wrong_cache_hits", "missing_api_requests", "wrong_api_requests",
    "api_attempts", "api_retries", "estimated_cache_saved_seconds", "uncertain", "ai_out_of_scope", "ai_real_objects", "ai_background_or_noise", "category_size_rejected", "wrong_inconsistent_rejected",
    "wrong_unknown", "wrong_label_mismatches", "wrong_bbox_mismatches", "wrong_report_findings", "report_findings", "api_requests", "projection_low_quality", "input_failures")


def _slots(s: SparkSession, d: str) -> DataFrame:
    a = _assets(s, d)
    return assets.slots(a, assets.groups(a))


def _late(s: SparkSession, d: str) -> DataFrame:
    a = _assets(s, d)
    return assets.late(a, assets.groups(a)).select("scene_id", "frame_index", "url")


def _full_report(s: SparkSession, d: str) -> DataFrame:
    """Rules, then failed frames, then what the model found, as the report has them: nothing is merged or sorted again."""
    judged = verdicts.with_messages(rules.run_rules(s, d))
    return tables.report_rows(judged).unionByName(tables.report_rows(verdicts.vision_findings(_votes(s, d), _gated(s, d)))).select(
        "scene_id", F.col("frame_index").cast("int").alias("frame_index"), "track_id", "bbox_index", "label", "rule_id", F.col("occurrence_count").cast("long").alias("occurrence_count"))


QUERIES = {
    "parse_wrong_answer": lambda s, d: decisions.parse_wrong(answers(s, d), ALLOWED).select("candidate_id", F.coalesce("error", F.lit("")).alias("error"), "label_match", "bbox_match", "suggested_category", "confidence", "in_scope"),
    "parse_missing_answer": lambda s, d: decisions.parse_missing(answers(s, d), ALLOWED).select("candidate_id", F.coalesce("error", F.lit("")).alias("error"), "contains_real_object", "missing_annotation_suspected", "possible_category", "confidence"),
    "wrong_votes": lambda s, d: _votes(s, d).select("candidate_id", "vote_reason", F.coalesce("vote_rule", F.lit("")).alias("vote_rule"), F.coalesce("vote_category", F.lit("")).alias("vote_category")),
    "wrong_consensus": lambda s, d: decisions.consensus(_votes(s, d), 2, 0.05).drop("candidate_id", "candidate_frame", "object_key").withColumn("share", F.round("share", 6)),
    "untracked_consensus": lambda s, d: decisions.consensus(_untracked(s, d), 1, 0.05).select("scene_id", "object_key", "vote_rule", "vote_category", "n", "observations", F.round("share", 6).alias("share")),
    "untracked_findings": lambda s, d: verdicts.wrong_findings(_untracked(s, d), "track_consensus", 1, 0.05).select("scene_id", F.coalesce("track_id", F.lit("")).alias("track_id"), "frame_index", "bbox_index", "rule_id", "ai_confidence"),
    "category_size_gate": lambda s, d: _gated(s, d).where("error is null").select("candidate_id", "gate_reason"),
    "missing_outcomes": lambda s, d: _gated(s, d).select("candidate_id", "outcome"),
    "vision_findings": lambda s, d: verdicts.vision_findings(_votes(s, d), _gated(s, d)).select("scene_id", "frame_index", "track_id", "bbox_index", "label", "rule_id", "message", "possible_category", "ai_confidence", "occurrence_count"),
    "consensus_findings": lambda s, d: verdicts.wrong_findings(_votes(s, d), "track_consensus", 2, 0.05).select("scene_id", "track_id", "frame_index", "bbox_index", "rule_id", "ai_confidence"),
    "review_counters": _counters,
    "vision_run": _vision_run,
    "review_sections": _sections,
    "full_report": _full_report,
    "review_statistics": lambda s, d: _gated(s, d).groupBy("scene_id").pivot("outcome", ["error", "out_of_scope", "background", "not_suspected", "low_confidence", "size_rejected", "accepted"]).count().na.fill(0),
    "cache_keys": lambda s, d: answers(s, d).select("candidate_id", decisions.cache_key(F.lit("model").alias("model"), F.col("candidate_id"), F.col("label")).alias("key")),
    "asset_groups": lambda s, d: assets.with_status(assets.groups(_assets(s, d))).select("scene_id", "frame_index", "group_key", "pcd_count", "jpg_count", "status", "warning"),
    "asset_slots": _slots,
    "late_assets": _late,
    "quiet_periods": lambda s, d: assets.quiet_periods(_assets(s, d)).groupBy("scene_id").agg(F.count("assets").alias("periods"), F.max("assets").alias("longest"), F.sum("assets").alias("assets")),
}
FOUND_SQL = BASE + """, told AS (
  SELECT scene_id, frame_index, track_id, candidate_id AS bbox_index, label, vote_rule AS rule_id, category AS possible_category, conf,
    CASE vote_rule WHEN 'VisionBBoxMismatch' THEN 'AI-confirmed BBox does not cover the labelled target' ELSE 'AI-confirmed annotation label mismatch' END AS message FROM ruled WHERE vote_rule IS NOT NULL
  UNION ALL SELECT scene_id, frame_index, 'vision_cluster_' || frame_index || '_' || candidate_id, candidate_id, category, 'PossibleMissingAnnotation', category, conf, 'AI-confirmed possible missing annotation' FROM outcomes WHERE outcome = 'accepted')"""
CALLS_SQL = """, calls AS (
  SELECT scene_id, n % 2 = 0 AS box, CASE n % 10 WHEN 3 THEN 'error' WHEN 7 THEN 'skipped' ELSE 'verified' END AS status, n % 4 = 0 AS hit, CASE n % 10 WHEN 7 THEN 0 ELSE 1 + n % 3 END AS attempts, (n % 7) / 2e0 AS seconds FROM raw),
asked AS (SELECT *, NOT hit AND attempts > 0 AS asked FROM calls),
c AS (
  SELECT scene_id, count(*) FILTER (NOT box) AS total_test_clusters, count(*) FILTER (box) AS total_wrong_annotation_candidates, count(*) FILTER (status = 'error') AS api_failures, count(*) FILTER (status = 'skipped') AS api_skipped,
    count(*) FILTER (hit) AS vision_cache_hits, count(*) FILTER (hit AND NOT box) AS missing_cache_hits, count(*) FILTER (hit AND box) AS wrong_cache_hits, count(*) FILTER (asked AND NOT box) AS missing_api_requests, count(*) FILTER (asked AND box) AS wrong_api_requests,
    CAST(coalesce(sum(attempts) FILTER (asked), 0) AS BIGINT) AS api_attempts, CAST(coalesce(sum(attempts - 1) FILTER (asked), 0) AS BIGINT) AS api_retries, coalesce(sum(seconds) FILTER (asked), 0) AS api_elapsed_seconds, 1.5e0 * count(*) FILTER (hit) AS estimated_cache_saved_seconds
  FROM asked GROUP BY scene_id),
unsure AS (SELECT *, error IS NULL AND (category = 'unknown' OR conf < 0.92e0) AS vague FROM outcomes),
m AS (
  SELECT scene_id, count(*) FILTER (vague) AS uncertain, count(*) FILTER (error IS NULL AND NOT vague AND NOT scope) AS ai_out_of_scope, count(*) FILTER (error IS NULL AND NOT vague AND scope AND object) AS ai_real_objects,
    count(*) FILTER (error IS NULL AND NOT vague AND (NOT scope OR NOT object)) AS ai_background_or_noise, count(*) FILTER (outcome = 'size_rejected') AS category_size_rejected, count(*) FILTER (outcome = 'accepted') AS accepted
  FROM unsure GROUP BY scene_id),
per AS (SELECT scene_id, track_id, count(*) AS observations, count(vote_rule) AS voted, count(*) FILTER (vote_reason = 'model_response_internally_inconsistent') AS odd FROM ruled GROUP BY ALL),
counted AS (SELECT scene_id, track_id, vote_rule, vote_category, count(*) AS n FROM ruled WHERE vote_rule IS NOT NULL GROUP BY ALL),
won AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY scene_id, track_id ORDER BY n DESC, vote_rule DESC, vote_category DESC) = 1),
per2 AS (SELECT p.*, CASE WHEN w.n >= 2 AND w.n / p.observations >= 0.05e0 THEN w.vote_rule END AS rule FROM per p LEFT JOIN won w ON w.scene_id = p.scene_id AND w.track_id = p.track_id),
w AS (
  SELECT scene_id, CAST(sum(odd) AS BIGINT) AS wrong_inconsistent_rejected, count(*) FILTER (rule IS NULL AND voted = 0) AS wrong_unknown, count(*) FILTER (rule IS NULL AND voted > 0) AS wrong_consensus_rejected,
    count(*) FILTER (rule = 'VisionLabelMismatch') AS wrong_label_mismatches, count(*) FILTER (rule = 'VisionBBoxMismatch') AS wrong_bbox_mismatches, count(rule) AS wrong_report_findings
  FROM per2 GROUP BY scene_id)
SELECT c.*, m.* EXCLUDE (scene_id, accepted), w.* EXCLUDE (scene_id), accepted + wrong_report_findings AS report_findings, missing_api_requests + wrong_api_requests AS api_requests
FROM c JOIN m ON m.scene_id = c.scene_id JOIN w ON w.scene_id = c.scene_id"""
UNTRACKED = BASE.replace("target_key AS track_id,", "CASE bbox_index % 3 WHEN 0 THEN '' WHEN 2 THEN target_key END AS track_id,") + """,
objects AS (SELECT *, coalesce(nullif(track_id, ''), candidate_id) AS object_key FROM ruled),
counted AS (
  SELECT scene_id, object_key, vote_rule, vote_category, count(*) AS n, arg_max(candidate_id, (conf, -frame_index)) AS candidate_id FROM objects WHERE vote_rule IS NOT NULL GROUP BY ALL),
won AS (
  SELECT c.*, o.observations, c.n / o.observations AS share, row_number() OVER (PARTITION BY c.scene_id, c.object_key ORDER BY c.n DESC, vote_rule DESC, vote_category DESC) AS place
  FROM counted c JOIN (SELECT scene_id, object_key, count(*) AS observations FROM objects GROUP BY ALL) o ON o.scene_id = c.scene_id AND o.object_key = c.object_key),
sure AS (SELECT * FROM won WHERE place = 1 AND share >= 0.05e0)"""
RUN = BASE + f""",
asked AS (
  SELECT w.n, w.scene_id, w.frame_index, w.candidate_id, w.n % 2 = 0 AS box, CASE WHEN w.n % 31 = 30 THEN NULL WHEN w.n % 9 = 5 THEN 'low' ELSE 'good' END AS quality,
    CASE WHEN w.n % 2 = 0 THEN w.error ELSE m.error END AS bad FROM wrong w JOIN missing m ON m.n = w.n),
calls AS (
  SELECT *, hit IS NOT TRUE AND attempts > 0 AS asking FROM (
    SELECT *, n % 4 = 0 AND bad IS NULL AS hit, CASE WHEN n % 4 = 0 AND bad IS NULL THEN NULL WHEN n % 10 = 3 THEN 'down' ELSE bad END AS error,
      CASE WHEN n % 4 = 0 AND bad IS NULL THEN 0 WHEN n % 10 = 3 OR bad IS NOT NULL THEN 3 WHEN n % 7 = 1 THEN 2 ELSE 1 END AS attempts FROM asked WHERE quality = 'good')),
seen AS (SELECT r.*, c.box FROM ruled r JOIN calls c ON c.n = r.n WHERE c.box AND c.error IS NULL),
ends AS (SELECT o.* FROM outcomes o JOIN calls c ON c.n = o.n WHERE NOT c.box AND c.error IS NULL)"""
FULL = "scene_id, frame_index, track_id, bbox_index, label, rule_id, occurrence_count"
ORACLE = {
    "vision_findings": FOUND_SQL + " SELECT * EXCLUDE (conf), printf('%.4f', conf) AS ai_confidence, 1::BIGINT AS occurrence_count FROM told",
    "consensus_findings": BASE + COUNTED.replace("SELECT w.scene_id, w.track_id, vote_rule, vote_category, w.n, o.observations, round(w.n / o.observations, 6) AS share", "SELECT w.scene_id, w.track_id, r.frame_index, r.candidate_id AS bbox_index, w.vote_rule AS rule_id, printf('%.4f', r.conf) AS ai_confidence").replace("WHERE place = 1", "JOIN ruled r ON r.candidate_id = w.candidate_id WHERE place = 1"),
    "review_counters": BASE + CALLS_SQL,
    "vision_run": RUN + """,
c AS (
  SELECT scene_id, count(*) FILTER (error IS NOT NULL) AS api_failures, 0::BIGINT AS api_skipped,
    count(*) FILTER (hit) AS vision_cache_hits, count(*) FILTER (hit AND NOT box) AS missing_cache_hits, count(*) FILTER (hit AND box) AS wrong_cache_hits,
    count(*) FILTER (asking AND NOT box) AS missing_api_requests, count(*) FILTER (asking AND box) AS wrong_api_requests, CAST(sum(attempts) AS BIGINT) AS api_attempts,
    CAST(sum(attempts - 1) FILTER (asking) AS BIGINT) AS api_retries, 1.5e0 * count(*) FILTER (hit) AS estimated_cache_saved_seconds FROM calls GROUP BY scene_id),
vague AS (SELECT *, category = 'unknown' OR conf < 0.92e0 AS unsure FROM ends),
m AS (
  SELECT scene_id, count(*) FILTER (unsure) AS uncertain, count(*) FILTER (NOT unsure AND NOT scope) AS ai_out_of_scope, count(*) FILTER (NOT unsure AND scope AND object) AS ai_real_objects,
    count(*) FILTER (NOT unsure AND (NOT scope OR NOT object)) AS ai_background_or_noise, count(*) FILTER (outcome = 'size_rejected') AS category_size_rejected, count(*) FILTER (outcome = 'accepted') AS accepted
  FROM vague GROUP BY scene_id),
w AS (
  SELECT scene_id, count(*) FILTER (vote_reason = 'model_response_internally_inconsistent') AS wrong_inconsistent_rejected,
    count(*) FILTER (vote_reason IN ('confidence_below_report_threshold', 'model_returned_unknown', 'label_mismatch_without_valid_suggestion')) AS wrong_unknown,
    count(*) FILTER (vote_rule = 'VisionLabelMismatch') AS wrong_label_mismatches, count(*) FILTER (vote_rule = 'VisionBBoxMismatch') AS wrong_bbox_mismatches, count(vote_rule) AS wrong_report_findings
  FROM seen GROUP BY scene_id),
q AS (SELECT scene_id, count(*) FILTER (NOT box) AS total_test_clusters, count(*) FILTER (box) AS total_wrong_annotation_candidates, count(*) FILTER (quality = 'low') AS projection_low_quality, count(*) FILTER (quality IS NULL) AS input_failures FROM asked GROUP BY scene_id)
SELECT c.*, m.* EXCLUDE (scene_id, accepted), w.* EXCLUDE (scene_id), accepted + wrong_report_findings AS report_findings, missing_api_requests + wrong_api_requests AS api_requests, q.* EXCLUDE (scene_id)
FROM c JOIN m ON m.scene_id = c.scene_id JOIN w ON w.scene_id = c.scene_id JOIN q ON q.scene_id = c.scene_id""",
    "review_sections": RUN + """
SELECT a.scene_id, a.frame_index, a.candidate_id,
  CASE WHEN a.quality IS NULL THEN '' WHEN a.quality <> 'good' THEN 'skipped' WHEN c.error IS NULL THEN 'verified' ELSE 'error' END AS status,
  CASE WHEN a.quality <> 'good' THEN 'projection_low_quality' ELSE coalesce(c.error, '') END AS error, coalesce(c.attempts, 0) AS attempts, coalesce(CAST(c.hit AS VARCHAR), '') AS hit,
  CASE WHEN s.n IS NOT NULL THEN CAST(s.vote_rule IS NOT NULL AS VARCHAR) WHEN e.outcome IN ('low_confidence', 'size_rejected', 'accepted') THEN CAST(e.outcome = 'accepted' AS VARCHAR) ELSE '' END AS accepted,
  CASE WHEN s.n IS NOT NULL THEN s.vote_reason WHEN e.outcome = 'low_confidence' THEN 'confidence_below_report_threshold' WHEN e.outcome = 'size_rejected' THEN e.gate_reason WHEN e.outcome = 'accepted' THEN 'accepted' ELSE '' END AS reason
FROM asked a LEFT JOIN calls c ON c.n = a.n LEFT JOIN seen s ON s.n = a.n LEFT JOIN ends e ON e.n = a.n""",
    "untracked_consensus": UNTRACKED + " SELECT scene_id, object_key, vote_rule, vote_category, n, observations, round(share, 6) AS share FROM sure",
    "untracked_findings": UNTRACKED + " SELECT r.scene_id, coalesce(r.track_id, '') AS track_id, r.frame_index, r.candidate_id AS bbox_index, s.vote_rule AS rule_id, printf('%.4f', r.conf) AS ai_confidence FROM sure s JOIN ruled r ON r.candidate_id = s.candidate_id",
    "full_report": f"SELECT {FULL} FROM ({rules.ALL_SQL} SELECT {FULL} FROM report) UNION ALL SELECT {FULL} FROM ({FOUND_SQL} SELECT *, 1 AS occurrence_count FROM told)",
    "parse_wrong_answer": BASE + " SELECT candidate_id, coalesce(error, '') AS error, CASE WHEN error IS NULL THEN lm END AS label_match, CASE WHEN error IS NULL THEN bm END AS bbox_match, CASE WHEN error IS NULL THEN category END AS suggested_category, CASE WHEN error IS NULL THEN conf END AS confidence, CASE WHEN error IS NULL THEN scope END AS in_scope FROM wrong",
    "parse_missing_answer": BASE + " SELECT candidate_id, coalesce(error, '') AS error, CASE WHEN error IS NULL THEN object END AS contains_real_object, CASE WHEN error IS NULL THEN suspected AND scope END AS missing_annotation_suspected, CASE WHEN error IS NULL THEN category END AS possible_category, CASE WHEN error IS NULL THEN conf END AS confidence FROM missing",
    "wrong_votes": BASE + " SELECT candidate_id, vote_reason, coalesce(vote_rule, '') AS vote_rule, coalesce(vote_category, '') AS vote_category FROM ruled",
    "wrong_consensus": BASE + COUNTED,
    "category_size_gate": BASE + " SELECT candidate_id, gate_reason FROM gated WHERE error IS NULL",
    "missing_outcomes": BASE + " SELECT candidate_id, outcome FROM outcomes",
    "review_statistics": BASE + " SELECT scene_id, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("error", "out_of_scope", "background", "not_suspected", "low_confidence", "size_rejected", "accepted")) + " FROM outcomes GROUP BY scene_id",
    "cache_keys": BASE + """ SELECT candidate_id, sha256('{"model":"model","candidate_id":"' || candidate_id || '","label":"' || label || '"}') AS key FROM raw""",
    "asset_groups": ASSETS + """ SELECT scene_id, frame_index, group_key, pcd_count, jpg_count, CASE WHEN pcd_count = 1 AND jpg_count = 5 THEN 'ok' ELSE 'warning' END AS status,
  concat_ws('; ', CASE WHEN pcd_count <> 1 THEN 'pcd ' || pcd_count || '/1' END, CASE WHEN jpg_count <> 5 THEN 'jpg ' || jpg_count || '/5' END) AS warning FROM claimed""",
    "asset_slots": ASSETS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY scene_id, group_key, kind ORDER BY arrival_ts, url) AS n FROM addressed)
SELECT c.scene_id, c.group_key, c.frame_index, c.pcd_count, c.jpg_count, CASE WHEN pcd_count = 1 AND jpg_count = 5 THEN 'ok' ELSE 'warning' END AS status,
  concat_ws('; ', CASE WHEN pcd_count <> 1 THEN 'pcd ' || pcd_count || '/1' END, CASE WHEN jpg_count <> 5 THEN 'jpg ' || jpg_count || '/5' END) AS warning,
  string_agg(url, ';' ORDER BY arrival_ts, url) FILTER (kind = 'pcd') AS pcd_url, """ + ", ".join(f"min(url) FILTER (kind = 'jpg' AND n = {k}) AS jpg_url_{k}" for k in range(1, 6)) + " FROM claimed c JOIN numbered n ON n.scene_id = c.scene_id AND n.group_key = c.group_key GROUP BY ALL",
    "late_assets": ASSETS + " SELECT a.scene_id, frame_index, url FROM addressed a JOIN claimed c ON a.scene_id = c.scene_id AND a.group_key = c.group_key WHERE kind = 'jpg' AND arrival_ts > pcd_ts + INTERVAL 30 MINUTE",
    "quiet_periods": ASSETS + """, steps AS (SELECT *, coalesce(arrival_ts - lag(arrival_ts) OVER (PARTITION BY scene_id ORDER BY arrival_ts) >= INTERVAL 10 MINUTE, true) AS starts FROM addressed),
numbered AS (SELECT scene_id, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY scene_id ORDER BY arrival_ts) AS k FROM steps),
periods AS (SELECT scene_id, k, count(*) AS assets FROM numbered GROUP BY ALL)
SELECT scene_id, count(*) AS periods, max(assets) AS longest, CAST(sum(assets) AS BIGINT) AS assets FROM periods GROUP BY scene_id""",
}
