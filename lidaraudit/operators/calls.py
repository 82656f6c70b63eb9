"""A review by an injected function: cache, calls with retries as rows, verdicts, counters and manifest sections.

The function takes a request (a dict of the columns of a row, and `attempt`) and returns the text of an answer; what it raises is
told in a column. A round asks all open requests, in batches in the tasks, and is written before its answers are
parsed, so no later use asks again; the next round asks those whose call or answer was bad. A task that is run twice asks
twice: the key of a request makes that harmless, as each key is stored once (see sources.cache).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidaraudit.functions.storage import stored
from lidaraudit.operators import decisions

RETRIES, DELAY_SECONDS = 2, 1.0
BOX, CLUSTER = "existing_bbox", "residual_cluster"


def asked(requests: DataFrame, provider: Callable[[dict], str], attempt: int, delay_seconds: float = 0.0) -> DataFrame:
    """requests with response, call_error (null: none) and call_seconds."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, errors, seconds = [], [], []
            for row in part.to_dict("records"):
                if delay_seconds:
                    time.sleep(delay_seconds)
                began, text, error = time.perf_counter(), None, None
                try:
                    text = provider(row | {"attempt": attempt})
                    if not isinstance(text, str) or not text.strip():
                        text, error = None, "empty_answer"
                except Exception as e:  # noqa: BLE001  the job goes on whatever the function does
                    error = str(e) or type(e).__name__
                texts.append(text)
                errors.append(error)
                seconds.append(time.perf_counter() - began)
            yield part.assign(response=texts, call_error=errors, call_seconds=seconds)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(work, f"{kinds}, response string, call_error string, call_seconds double")


def answered(requests: DataFrame, provider: Callable[[dict], str], parse: Callable[[DataFrame], DataFrame], retries: int = RETRIES, delay_seconds: float = DELAY_SECONDS) -> DataFrame:
    """requests with what parse finds in the last answer, error, status (verified or error), attempts and seconds of all attempts."""
    columns, open_, done = requests.columns, requests.withColumn("seconds", F.lit(0.0)), None
    for attempt in range(1, retries + 2):
        got = stored(asked(open_, provider, attempt, delay_seconds if attempt > 1 else 0.0), "calls").withColumn("seconds", F.col("seconds") + F.col("call_seconds"))
        judged = parse(got).withColumn("error", F.coalesce("call_error", "error")).drop("call_error", "call_seconds").withColumn("attempts", F.lit(attempt))
        bad = F.col("error").isNotNull()
        last = attempt > retries
        ended = judged if last else judged.where(~bad)
        done = ended if done is None else done.unionByName(ended)
        if not last:
            open_ = stored(judged.where(bad).select(*columns, "seconds"), "calls-open")
            if open_.isEmpty():
                break
    return done.withColumn("status", F.when(F.col("error").isNull(), "verified").otherwise("error"))


def verified(requests: DataFrame, provider: Callable[[dict], str], parse: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None, retries: int = RETRIES, delay_seconds: float = DELAY_SECONDS) -> DataFrame:
    """requests (with key and candidate_type) answered from the cache or by the function: cache_hit, attempts, seconds, cached_seconds, status, error and what parse finds.

    cache: ANSWER of sources.cache, of which an answer counts if it is of the same type and can still be parsed.
    """
    columns = requests.columns
    if cache is None:
        fresh, hits = requests, None
    else:
        known = cache.select("key", "candidate_type", F.col("response"), F.col("seconds").alias("cached_seconds"))
        hits = stored(parse(requests.join(known, ["key", "candidate_type"])), "cached").where("error is null")
        fresh = requests.join(hits.select("key").distinct(), "key", "left_anti")
    out = answered(fresh.select(*columns), provider, parse, retries, delay_seconds).withColumns({"cache_hit": F.lit(False), "cached_seconds": F.lit(0.0)})
    if hits is None:
        return out
    return out.unionByName(hits.withColumns({"cache_hit": F.lit(True), "attempts": F.lit(0), "seconds": F.lit(0.0), "status": F.lit("verified")}))


def to_ask(candidates: DataFrame, enabled: bool = True, wrong_enabled: bool = True) -> DataFrame:
    """candidates (candidate_type, quality; null: none of its pictures could be made) with skip: why no answer is asked for, or null."""
    skip = F.when(F.col("quality").isNull(), "input_failed").when(F.col("quality") != "good", "projection_low_quality")
    skip = skip.when(F.lit(not enabled), "ai_vision_disabled").when(F.lit(not wrong_enabled) & (F.col("candidate_type") == BOX), "wrong_annotation_disabled")
    return candidates.withColumn("skip", skip)


def low_quality(candidates: DataFrame) -> DataFrame:
    """Counters of candidates that were never asked about: scene_id, projection_low_quality, input_failures."""
    return candidates.groupBy("scene_id").agg(F.count_if(F.col("skip") == "projection_low_quality").alias("projection_low_quality"), F.count_if(F.col("skip") == "input_failed").alias("input_failures"))


def sections(candidates: DataFrame, calls: DataFrame, decided: DataFrame) -> DataFrame:
    """scene_id, frame_index, candidate_type, candidate_id with the sections of the manifest: vision, vision_cache, vision_decision (null where there is nothing to tell).

    candidates: to_ask(); calls: verified() of all types, as far as columns go; decided: the same key with accepted and reason.
    """
    key = ["scene_id", "frame_index", "candidate_type", "candidate_id"]
    told = calls.select(*key, F.struct("status", F.coalesce("error", F.lit("")).alias("error"), "attempts").alias("vision"), F.struct(F.col("cache_hit").alias("hit"), "key").alias("vision_cache"))
    skipped = F.when(F.col("skip") == "projection_low_quality", "skipped").otherwise("disabled")
    own = candidates.join(told, key, "left").join(decided.select(*key, F.struct("accepted", "reason").alias("vision_decision")), key, "left")
    return own.select(*key, F.coalesce("vision", F.when(F.col("skip") != "input_failed", F.struct(skipped.alias("status"), F.col("skip").alias("error"), F.lit(0).alias("attempts")))).alias("vision"), "vision_cache", "vision_decision")


def decided(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """accepted and reason of each judged answer: votes on boxes, and outcomes of clusters that are told of as missing."""
    key = ["scene_id", "frame_index", "candidate_type", "candidate_id"]
    reasons = {"low_confidence": "confidence_below_report_threshold", "accepted": "accepted"}
    reason = F.when(F.col("outcome") == "size_rejected", F.col("gate_reason"))
    for outcome, words in reasons.items():
        reason = reason.when(F.col("outcome") == outcome, words)
    boxes = votes.select(*key, F.col("vote_rule").isNotNull().alias("accepted"), F.col("vote_reason").alias("reason"))
    return boxes.unionByName(outcomes.where(F.col("outcome").isin("size_rejected", *reasons)).select(*key, (F.col("outcome") == "accepted").alias("accepted"), reason.alias("reason")))


def review(candidates: DataFrame, provider: Callable[[dict], str], allowed: list[str], aliases: dict[str, str], categories: DataFrame, dimensions: DataFrame, cache: DataFrame | None = None, retries: int = RETRIES, delay_seconds: float = DELAY_SECONDS) -> dict[str, DataFrame]:
    """The whole review: tables `candidates`, `calls`, `votes`, `outcomes`, `low_quality`, `sections`.

    candidates: scene_id, frame_index, candidate_type, candidate_id, track_id, label, size_x, size_y, size_z, quality, key and
    whatever the function wants to see. Votes and outcomes are written once; all that follows reads them.
    """
    all_ = to_ask(candidates)
    ask = all_.where("skip is null").drop("skip", "quality")
    wrong = verified(ask.where(F.col("candidate_type") == BOX), provider, lambda a: decisions.parse_wrong(a, allowed), cache, retries, delay_seconds)
    missing = verified(ask.where(F.col("candidate_type") == CLUSTER), provider, lambda a: decisions.parse_missing(a, allowed), cache, retries, delay_seconds)
    wrong, missing = stored(wrong, "wrong"), stored(missing, "missing")
    votes = decisions.wrong_votes(wrong, aliases)
    outcomes = decisions.missing_outcome(decisions.size_gate(missing, categories, dimensions))
    shared = ["scene_id", "frame_index", "candidate_type", "candidate_id", "key", "response", "status", "error", "attempts", "seconds", "cache_hit", "cached_seconds"]
    calls = wrong.select(*shared).unionByName(missing.select(*shared))
    return {"candidates": all_, "calls": calls, "votes": votes, "outcomes": outcomes, "low_quality": low_quality(all_), "sections": sections(all_, calls, decided(votes, outcomes))}
