"""From a model's answers to findings: strict parsing, votes, consensus, size gate and acceptance."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRONG_CONFIDENCE, MISSING_CONFIDENCE = 0.9, 0.92
MIN_VOTES, MIN_SHARE = 2, 0.67
MIN_RATIO, MAX_RATIO = 0.10, 2.0
OUT_OF_SCOPE, UNKNOWN = "out_of_scope", "unknown"


def unfenced(raw: Column) -> Column:
    """The text inside a code fence, if it stands in one."""
    text = F.trim(raw)
    inside = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n", ""), r"\n[ \t]*```[ \t]*$", "")
    return F.when(text.startswith("```"), F.trim(inside)).otherwise(text)


class Answer:
    """Typed reads of one JSON answer; `bad` holds a test and its error name, in the order of the tests."""

    def __init__(self, json: Column) -> None:
        self.json = json
        self.bad: list[tuple[Column, str]] = [
            (self.json.isNull(), "invalid_json"),
            (~F.schema_of_variant(self.json).startswith("OBJECT"), "response_json_must_be_object"),
        ]

    def _kind(self, name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(self.json, f"$.{name}", "variant")), F.lit("VOID"))

    def flag(self, name: str, may_be_null: bool) -> Column:
        kinds = ["BOOLEAN", "VOID"] if may_be_null else ["BOOLEAN"]
        self.bad.append((~self._kind(name).isin(kinds), f"{name}_must_be_boolean" + "_or_null" * may_be_null))
        return F.try_variant_get(self.json, f"$.{name}", "boolean")

    def category(self, name: str, allowed: list[str]) -> Column:
        value = F.when(self._kind(name) == "STRING", F.try_variant_get(self.json, f"$.{name}", "string"))
        self.bad.append((~F.coalesce(value.isin([*allowed, OUT_OF_SCOPE, UNKNOWN]), F.lit(False)), f"invalid_{name}"))
        return value

    def confidence(self) -> Column:
        value = F.try_variant_get(self.json, "$.confidence", "double")
        self.bad.append((~self._kind("confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "confidence_must_be_number"))
        self.bad.append((~value.between(0.0, 1.0), "confidence_out_of_range"))
        return value

    def reason(self) -> Column:
        value = F.when(self._kind("reason") == "STRING", F.trim(F.try_variant_get(self.json, "$.reason", "string")))
        self.bad.append((F.coalesce(value, F.lit("")) == "", "reason_must_be_non_empty_string"))
        return value

    def identity(self, name: str, expected: Column) -> None:
        given = F.coalesce(F.try_variant_get(self.json, f"$.{name}", "string"), F.lit(""))
        self.bad.append(((given != "") & (given != expected), f"{name}_mismatch"))

    def error(self) -> Column:
        found = F.when(*(self.bad[0][0], F.lit(self.bad[0][1])))
        for test, name in self.bad[1:]:
            found = found.when(test, F.lit(name))
        return found


def parse_wrong(answers: DataFrame, allowed: list[str]) -> DataFrame:
    """candidate_id and response to label_match, bbox_match, suggested_category, confidence, reason, in_scope, error."""

    def fields(a: Answer) -> dict[str, Column]:
        values = {"label_match": a.flag("label_match", True), "bbox_match": a.flag("bbox_match", True)}
        values |= {"suggested_category": a.category("suggested_category", allowed), "confidence": a.confidence(), "reason": a.reason()}
        a.identity("candidate_id", F.col("candidate_id"))
        return values

    return _parsed(answers, fields, "suggested_category", allowed)


def parse_missing(answers: DataFrame, allowed: list[str]) -> DataFrame:
    """candidate_id and response to the verdict on a missing box; out of scope, none is suspected."""

    def fields(a: Answer) -> dict[str, Column]:
        values = {"contains_real_object": a.flag("contains_real_object", False), "missing_annotation_suspected": a.flag("missing_annotation_suspected", False)}
        values |= {"possible_category": a.category("possible_category", allowed), "confidence": a.confidence(), "reason": a.reason()}
        a.identity("cluster_id", F.col("candidate_id"))
        return values

    out = _parsed(answers, fields, "possible_category", allowed)
    return out.withColumn("missing_annotation_suspected", F.col("missing_annotation_suspected") & F.col("in_scope"))


def _parsed(answers: DataFrame, fields: Callable[[Answer], dict[str, Column]], category: str, allowed: list[str]) -> DataFrame:
    """The text is parsed and tested once: a lambda keeps the optimiser from repeating that for each field, and a test that
    always holds, of a number that it can't know, from moving a filter on a field below the parsing.
    """
    text = F.when(F.monotonically_increasing_id() >= 0, unfenced(F.col("response")))

    def build(json: Column) -> Column:
        a = Answer(json)
        values = fields(a)
        return F.struct(a.error().alias("error"), *[v.alias(k) for k, v in values.items()])

    out = answers.withColumn("answer", F.element_at(F.transform(F.array(F.try_parse_json(text)), build), 1))
    names = out.schema["answer"].dataType.names
    ok = F.col("answer.error").isNull()
    values = [F.when(ok, F.col(f"answer.{n}")).alias(n) for n in names if n != "error"]
    return out.select(*answers.columns, F.col("answer.error").alias("error"), *values, F.when(ok, F.col(f"answer.{category}").isin(allowed)).alias("in_scope"))


def normal(label: Column, aliases: dict[str, str]) -> Column:
    """The category that a label stands for."""
    value = F.trim(F.coalesce(label, F.lit("")))
    if not aliases:
        return value
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def wrong_votes(parsed: DataFrame, aliases: dict[str, str], least: float = WRONG_CONFIDENCE) -> DataFrame:
    """vote_rule, vote_category (null: no vote) and vote_reason of each parsed answer with column label."""
    current, suggested = normal(F.col("label"), aliases), normal(F.col("suggested_category"), aliases)
    off = F.col("label_match") == F.lit(False)
    reason = (
        F.when(F.col("confidence") < least, "confidence_below_report_threshold")
        .when(F.col("label_match").isNull() & F.col("bbox_match").isNull(), "model_returned_unknown")
        .when(off & (suggested != "") & (suggested == current), "model_response_internally_inconsistent")
        .when(F.col("bbox_match") == F.lit(False), "bbox_mismatch_vote")
        .when(off & (~F.col("in_scope") | suggested.isin("", UNKNOWN, OUT_OF_SCOPE)), "label_mismatch_without_valid_suggestion")
        .when(off, "label_mismatch_vote").otherwise("annotation_consistent"))
    rule = lambda r: F.when(r == "bbox_mismatch_vote", "VisionBBoxMismatch").when(r == "label_mismatch_vote", "VisionLabelMismatch")
    category = lambda r: F.when(r == "bbox_mismatch_vote", "").when(r == "label_mismatch_vote", suggested)
    vote = F.element_at(F.transform(F.array(reason), lambda r: F.struct(r.alias("reason"), rule(r).alias("rule"), category(r).alias("category"))), 1)
    judged = parsed.where("error is null").withColumn("vote", vote)
    return judged.select(*parsed.columns, *[F.col(f"vote.{c}").alias(f"vote_{c}") for c in ("reason", "rule", "category")])


def object_of() -> Column:
    """What an answer's object is told by over frames: its track, or where it has none the candidate itself."""
    return F.coalesce(F.nullif(F.col("track_id"), F.lit("")), F.col("candidate_id"))


def consensus(votes: DataFrame, min_votes: int = MIN_VOTES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row for each object (see object_of) whose answers agree often enough, with its surest answer; ties go to the greater rule and category."""
    track = ["scene_id", "object_key"]
    votes = votes.withColumn("object_key", object_of())
    # Answers without a vote fall out by their count: a filter on the rule would be pushed down and repeat the parsing.
    counted = votes.groupBy(*track, "vote_rule", "vote_category").agg(
        F.count("vote_rule").alias("n"), F.max_by(F.struct("candidate_id", "frame_index", "track_id"), F.struct(F.col("confidence"), -F.col("frame_index"))).alias("best")).where("n > 0")
    won = counted.groupBy(*track).agg(F.max(F.struct("n", "vote_rule", "vote_category", F.col("best.candidate_id").alias("candidate_id"), F.col("best.frame_index").alias("candidate_frame"), F.col("best.track_id").alias("track_id"))).alias("w"))
    all_votes = votes.groupBy(*track).agg(F.count("candidate_id").alias("observations"))
    joined = won.join(all_votes, track).select(*track, "w.*", "observations").withColumn("share", F.col("n") / F.col("observations"))
    return joined.where((F.col("n") >= min_votes) & (F.col("share") >= min_share))


def size_gate(candidates: DataFrame, categories: DataFrame, dimensions: DataFrame, low: float = MIN_RATIO, high: float = MAX_RATIO) -> DataFrame:
    """candidates (possible_category, size_x, size_y, size_z) with gate_accepts and gate_reason.

    categories: name, dimension_keys; both dictionaries are short lists kept with the code and are broadcast.
    Sides in plan are compared in order of length; one variant that fits is enough.
    """
    refs = categories.select("name", F.explode("dimension_keys").alias("key")).join(dimensions, F.col("key") == F.col("class_name"), "left")
    usable = (F.col("ref_length") > 0) & (F.col("ref_width") > 0) & (F.col("ref_height") > 0)
    r = F.when(usable, F.struct(F.greatest("ref_length", "ref_width").alias("a"), F.least("ref_length", "ref_width").alias("b"), F.col("ref_height").alias("c")))
    known = refs.groupBy("name").agg(F.collect_list(r).alias("refs"))
    joined = candidates.join(F.broadcast(known), candidates.possible_category == known.name, "left")
    within = lambda v, ref: (v / ref).between(low, high)
    fits = F.exists("refs", lambda x: within(F.greatest("size_x", "size_y"), x["a"]) & within(F.least("size_x", "size_y"), x["b"]) & within(F.col("size_z"), x["c"]))
    missing = F.col("size_x").isNull() | F.col("size_y").isNull() | F.col("size_z").isNull()
    reason = F.when(missing, "missing_measured_size").when(F.col("refs").isNull(), "unknown_vision_category").when(F.size("refs") == 0, "no_fixed_reference").when(fits, "within_reference_multiplier").otherwise("category_size_mismatch")
    return joined.withColumn("gate_reason", reason).withColumn("gate_accepts", F.col("gate_reason").isin("no_fixed_reference", "within_reference_multiplier")).drop("name", "refs")


def public_metadata(metadata: Column) -> Column:
    """The entries that a model is shown: names that begin with `_` are for the library alone."""
    return F.map_filter(metadata, lambda k, v: ~k.startswith("_"))


def answer_status(parsed: DataFrame) -> DataFrame:
    """verified or error for each parsed answer; skipped where no answer was asked for (response is null)."""
    return parsed.withColumn("status", F.when(F.col("response").isNull(), "skipped").when(F.col("error").isNull(), "verified").otherwise("error"))


def missing_outcome(gated: DataFrame, least: float = MISSING_CONFIDENCE) -> DataFrame:
    """outcome of each parsed answer on a missing box: the first test that it fails, or accepted."""
    outcome = (
        F.when(F.col("error").isNotNull(), "error").when(~F.col("in_scope"), "out_of_scope").when(~F.col("contains_real_object"), "background")
        .when(~F.col("missing_annotation_suspected"), "not_suspected").when(F.col("confidence") < least, "low_confidence")
        .when(~F.col("gate_accepts"), "size_rejected").otherwise("accepted"))
    return gated.withColumn("outcome", outcome)


def cache_key(*parts: Column) -> Column:
    """SHA-256 over all that an answer depends on."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def request_keys(requests: DataFrame, pictures: DataFrame, **settings: str) -> DataFrame:
    """requests (scene_id, frame_index, candidate_id, metadata as text) with the key of their answer.

    It covers the settings (model, provider, address, hashes of the prompt and of the categories, aliases), the metadata, and names
    and contents of all pictures: scene_id, frame_index, candidate_id, name, content.
    """
    own = ["scene_id", "frame_index", "candidate_id"]
    seen = pictures.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("name", F.sha2("content", 256).alias("sha256")))).alias("pictures"))
    fixed = [F.lit(v).alias(k) for k, v in sorted(settings.items())]
    joined = requests.join(seen, own, "left").withColumn("key", cache_key(*fixed, F.col("metadata"), F.coalesce("pictures", F.array()).alias("pictures")))
    return joined.drop("pictures")


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the stored answer of the same key, if it was verified; hit tells which need no call."""
    newest = cache.where("status = 'verified'").groupBy("key").agg(F.max_by("response", "stored_at").alias("cached_response"))
    return requests.join(newest, "key", "left").withColumn("hit", F.col("cached_response").isNotNull())


def diverse_sample(candidates: DataFrame, groups: dict[str, Column], limit: int) -> DataFrame:
    """At most limit candidates of a scene, taken in turn from overlapping groups, each candidate once: with group_no and turn, from 1.

    In each round every group, in order, gives its next candidate (by frame and id) that hasn't been taken yet. A group
    passes over at most limit candidates that others took, so its first 2 * limit are all that matters: they
    are one task's work for each scene. Without a limit, or where there are no more candidates, all are taken, in order.
    """
    ordered = candidates.withColumn("place", F.row_number().over(Window.partitionBy("scene_id").orderBy("frame_index", "candidate_id")))
    if limit <= 0:
        return ordered.withColumns({"group_no": F.lit(None).cast("int"), "turn": F.col("place")}).drop("place")
    ordered = ordered.withColumn("many", F.count("place").over(Window.partitionBy("scene_id")))
    member = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in enumerate(groups.values())]))
    listed = ordered.where(F.col("many") > limit).select("scene_id", "place", F.explode(member).alias("group_no"))
    rank = F.row_number().over(Window.partitionBy("scene_id", "group_no").orderBy("place"))
    short = listed.withColumn("rank", rank).where(F.col("rank") <= 2 * limit).drop("rank")
    turns = short.groupBy("scene_id").applyInPandas(lambda rows: in_turn(rows, limit), "scene_id string, place int, group_no int, turn int")
    few = ordered.where(F.col("many") <= limit).select("scene_id", "place", F.lit(None).cast("int").alias("group_no"), F.col("place").alias("turn"))
    return ordered.drop("many").join(turns.unionByName(few), ["scene_id", "place"]).drop("place")


def in_turn(rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Round robin over the groups of one scene: place, group_no to group_no, turn of those taken."""
    queues = {g: iter(sorted(own["place"])) for g, own in sorted(rows.groupby("group_no"))}
    taken: dict[int, int] = {}
    while queues and len(taken) < limit:
        for g in list(queues):
            place = next((p for p in queues[g] if p not in taken), None)
            if place is None:
                del queues[g]
            elif len(taken) < limit:
                taken[place] = g
    return pd.DataFrame({"scene_id": rows["scene_id"].iloc[0], "place": list(taken), "group_no": list(taken.values()), "turn": range(1, len(taken) + 1)})
