"""Findings and counters of a review by a model: from votes and outcomes to rows of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidaraudit.operators import decisions
from lidaraudit.operators.tracks import union

#: Texts of the findings.
MESSAGES = {
    "VisionBBoxMismatch": "AI-confirmed BBox does not cover the labelled target", "VisionLabelMismatch": "AI-confirmed annotation label mismatch",
    "PossibleMissingAnnotation": "AI-confirmed possible missing annotation",
}
#: Reasons for which an answer counts as unknown when answers are judged one by one.
UNKNOWN_REASONS = ("confidence_below_report_threshold", "model_returned_unknown", "label_mismatch_without_valid_suggestion")
FINDING = (
    "scene_id", "frame_index", "first_frame", "last_frame", "occurrence_count", "track_id", "bbox_index", "label", "rule_id", "severity", "message", "evidence",
    "cluster_id", "cluster_size", "possible_category", "ai_confidence", "ai_reason")


def _size() -> Column:
    return F.to_json(F.array("size_x", "size_y", "size_z"))


def _shaped(rows: DataFrame, **columns: Column) -> DataFrame:
    own = {"severity": F.lit("Warning"), "first_frame": F.col("frame_index"), "last_frame": F.col("frame_index"), "occurrence_count": F.lit(1).cast("long")}
    own |= {"ai_confidence": F.format_string("%.4f", "confidence"), "ai_reason": F.col("reason"), "cluster_size": _size()} | columns
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in FINDING])


def wrong_findings(votes: DataFrame, mode: str = "per_frame", min_votes: int = decisions.MIN_VOTES, min_share: float = decisions.MIN_SHARE) -> DataFrame:
    """Findings on boxes that the model calls wrong: each vote one, or one for each object whose answers agree, told by the surest of them.

    votes: wrong_votes() with scene_id, frame_index, candidate_id, track_id, label and sizes.
    """
    if mode not in ("per_frame", "track_consensus"):
        raise ValueError(f"mode has to be per_frame or track_consensus, not {mode}")
    told = votes.where("vote_rule is not null")
    if mode == "track_consensus":
        won = decisions.consensus(votes, min_votes, min_share).select("scene_id", "candidate_id", F.col("candidate_frame").alias("frame_index"))
        told = told.join(won, ["scene_id", "candidate_id", "frame_index"], "left_semi")
    texts = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    evidence = F.format_string("current_label=%s, size=%s, label_match=%s, bbox_match=%s", "label", _size(), F.col("label_match").cast("string"), F.col("bbox_match").cast("string"))
    return _shaped(told, bbox_index=F.col("candidate_id"), rule_id=F.col("vote_rule"), message=texts[F.col("vote_rule")], evidence=evidence, cluster_id=F.lit(""), possible_category=F.col("suggested_category"))


def missing_findings(outcomes: DataFrame) -> DataFrame:
    """Findings on accepted missing boxes; with frames (those in which a stationary candidate was seen) these give first, last and number."""
    kept = outcomes.where("outcome = 'accepted'")
    seen = F.col("frames") if "frames" in outcomes.columns else F.array("frame_index")
    evidence = F.format_string("estimated_size=%s, observed_frames=%s", _size(), F.array_join(seen.cast("array<string>"), ","))
    return _shaped(
        kept, first_frame=F.array_min(seen), last_frame=F.array_max(seen), occurrence_count=F.size(seen).cast("long"), track_id=F.format_string("vision_cluster_%d_%s", "frame_index", "candidate_id"),
        bbox_index=F.col("candidate_id"), label=F.col("possible_category"), rule_id=F.lit("PossibleMissingAnnotation"), message=F.lit(MESSAGES["PossibleMissingAnnotation"]), evidence=evidence, cluster_id=F.col("candidate_id"))


def vision_findings(votes: DataFrame, outcomes: DataFrame, mode: str = "per_frame", **consensus) -> DataFrame:
    return union([missing_findings(outcomes), wrong_findings(votes, mode, **consensus)])


def call_counters(calls: DataFrame) -> list[Column]:
    """Counters of calls: candidate_type (residual_cluster or existing_bbox), status (verified, error, skipped), cache_hit, attempts, seconds, cached_seconds."""
    box, hit = F.col("candidate_type") == "existing_bbox", F.coalesce(F.col("cache_hit"), F.lit(False))
    asked = ~hit & (F.col("attempts") > 0)
    of = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0))
    counts = {
        "total_test_clusters": ~box, "total_wrong_annotation_candidates": box, "api_failures": F.col("status") == "error", "api_skipped": F.col("status") == "skipped",
        "vision_cache_hits": hit, "missing_cache_hits": hit & ~box, "wrong_cache_hits": hit & box, "missing_api_requests": asked & ~box, "wrong_api_requests": asked & box,
    }
    sums = {
        "api_attempts": of(asked, F.col("attempts")), "api_retries": of(asked, F.col("attempts") - 1), "api_elapsed_seconds": of(asked, F.col("seconds")).cast("double"),
        "estimated_cache_saved_seconds": of(hit, F.col("cached_seconds")).cast("double"),
    }
    return [*[F.count_if(t).alias(c) for c, t in counts.items()], *[v.alias(c) for c, v in sums.items()]]


def missing_counters(least: float = decisions.MISSING_CONFIDENCE) -> list[Column]:
    """Counters over parsed and gated answers on missing boxes; an answer may count as uncertain and still be refused later on."""
    ok = F.col("error").isNull()
    unsure = ok & ((F.col("possible_category") == decisions.UNKNOWN) | (F.col("confidence") < least))
    outside = ok & ~unsure & ~F.col("in_scope")
    real = ok & ~unsure & F.col("in_scope") & F.col("contains_real_object")
    named = {
        "uncertain": unsure, "ai_out_of_scope": outside, "ai_real_objects": real, "ai_background_or_noise": outside | (ok & ~unsure & F.col("in_scope") & ~F.col("contains_real_object")),
        "category_size_rejected": F.col("outcome") == "size_rejected", "missing_report_findings": F.col("outcome") == "accepted",
    }
    return [F.count_if(t).alias(c) for c, t in named.items()]


def wrong_counters(votes: DataFrame, mode: str = "per_frame", min_votes: int = decisions.MIN_VOTES, min_share: float = decisions.MIN_SHARE) -> DataFrame:
    """One row per scene: what became of the answers on boxes, counted by answer or by object as mode says."""
    inconsistent = F.count_if(F.col("vote_reason") == "model_response_internally_inconsistent").alias("wrong_inconsistent_rejected")
    by_rule = lambda c: [F.count_if(F.col(c) == "VisionLabelMismatch").alias("wrong_label_mismatches"), F.count_if(F.col(c) == "VisionBBoxMismatch").alias("wrong_bbox_mismatches"), F.count(c).alias("wrong_report_findings")]
    if mode == "per_frame":
        return votes.groupBy("scene_id").agg(inconsistent, F.count_if(F.col("vote_reason").isin(*UNKNOWN_REASONS)).alias("wrong_unknown"), F.lit(0).cast("long").alias("wrong_consensus_rejected"), *by_rule("vote_rule"))
    track = ["scene_id", "object_key"]
    objects = votes.withColumn("object_key", decisions.object_of()).groupBy(*track).agg(F.count("vote_rule").alias("voted"), F.count_if(F.col("vote_reason") == "model_response_internally_inconsistent").alias("odd"))
    won = decisions.consensus(votes, min_votes, min_share).select(*track, "vote_rule")
    return objects.join(won, track, "left").groupBy("scene_id").agg(
        F.sum("odd").alias("wrong_inconsistent_rejected"), F.count_if(F.col("vote_rule").isNull() & (F.col("voted") == 0)).alias("wrong_unknown"),
        F.count_if(F.col("vote_rule").isNull() & (F.col("voted") > 0)).alias("wrong_consensus_rejected"), *by_rule("vote_rule"))


def review_counters(calls: DataFrame, outcomes: DataFrame, votes: DataFrame, matched: DataFrame | None = None, low_quality: DataFrame | None = None, mode: str = "per_frame", workers: int = 2, wall_seconds: float = 0.0, selected: DataFrame | None = None, **consensus) -> DataFrame:
    """One row per scene with all counters of a review.

    calls, outcomes, votes as above; matched: dedup_statistics; low_quality: scene_id, projection_low_quality, input_failures;
    selected: all candidates, if some were never asked about. What isn't given counts 0.
    """
    out = calls.groupBy("scene_id").agg(*call_counters(calls))
    out = out.join(outcomes.groupBy("scene_id").agg(*missing_counters()), "scene_id", "left").join(wrong_counters(votes, mode, **consensus), "scene_id", "left")
    if selected is not None:
        box = F.col("candidate_type") == "existing_bbox"
        totals = selected.groupBy("scene_id").agg(F.count_if(~box).alias("total_test_clusters"), F.count_if(box).alias("total_wrong_annotation_candidates"))
        out = totals.join(out.drop("total_test_clusters", "total_wrong_annotation_candidates"), "scene_id", "left")
    names = {
        "raw_candidates": "raw_cluster_candidates", "duplicate_groups": "temporal_dedup_groups", "duplicate_observations": "temporal_dedup_observations",
        "saved_calls": "temporal_dedup_saved_calls", "registered_frames": "temporal_registered_frames", "unregistered_frames": "temporal_unregistered_frames",
    }
    if matched is not None:
        out = out.join(matched.select("scene_id", *[F.col(a).alias(b) for a, b in names.items() if a in matched.columns]), "scene_id", "left")
    if low_quality is not None:
        out = out.join(low_quality, "scene_id", "left")
    missing = [c for c in (*names.values(), "projection_low_quality", "input_failures") if c not in out.columns]
    out = out.withColumns({c: F.lit(0).cast("long") for c in missing}).na.fill(0)
    requests = F.col("missing_api_requests") + F.col("wrong_api_requests")
    return out.withColumns({
        "api_requests": requests, "report_findings": F.col("missing_report_findings") + F.col("wrong_report_findings"),
        "average_api_seconds": F.coalesce(F.try_divide(F.col("api_elapsed_seconds"), requests), F.lit(0.0)),
        "vision_workers": F.lit(max(1, workers)), "request_phase_wall_seconds": F.lit(wall_seconds), "vision_wall_seconds": F.lit(wall_seconds),
        "estimated_parallel_saved_seconds": F.when(requests > 1, F.greatest(F.lit(0.0), F.col("api_elapsed_seconds") - wall_seconds)).otherwise(0.0),
    })


#: What is said of a rule's finding, of its value.
RULE_TEXTS = {
    "LabelConsistency": "the label differs from the one before", "PositionJump": "moved by %.2f m within a frame", "RotationJump": "turned by %.2f rad within a frame",
    "SizeConsistency": "a side changed by %.2f of its length", "BrokenTrack": "missing for a short time, the %.0f. time", "EmptyFrame": "a frame without boxes",
    "SizeOutlier": "a side of %.2f m", "DimensionMismatch": "no reference size is near: off by %.2f", "MissingBBox": "the boxes of the frame couldn't be read",
}


def with_messages(found: DataFrame) -> DataFrame:
    """Findings of the rules with message and evidence."""
    text = F.when(F.lit(False), "")
    for rule, words in RULE_TEXTS.items():
        text = text.when(F.col("rule_id") == rule, F.format_string(words, F.coalesce("value", F.lit(0.0))) if "%" in words else F.lit(words))
    return found.withColumns({"message": F.coalesce(text, F.lit("")), "evidence": F.concat_ws(", ", F.concat(F.lit("value="), F.col("value").cast("string")), F.concat(F.lit("frames="), F.col("first_frame").cast("string"), F.lit("-"), F.col("last_frame").cast("string")))})
