"""Calls through an injected function, and the cache that several runs write at once."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from lidaraudit.operators import calls, decisions
from lidaraudit.sources import cache, tables

ALLOWED = ["car", "van"]
GOOD = '{"label_match": false, "bbox_match": true, "suggested_category": "van", "confidence": 0.95, "reason": "seen"}'


def flaky(request):
    """By the candidate's name: good, down always, down once, odd text once, empty always."""
    kind = request["candidate_id"][0]
    if kind == "d" or (kind == "o" and request["attempt"] == 1):
        raise TimeoutError(f"no answer to {request['candidate_id']}")
    return "" if kind == "e" else "what?" if kind == "t" and request["attempt"] < 3 else GOOD


def requests(spark, names):
    rows = [("s", 1, calls.BOX, n, "t1", "car", f"{n:0>2}", "good") for n in names]
    return spark.createDataFrame(rows, "scene_id string, frame_index int, candidate_type string, candidate_id string, track_id string, label string, key string, quality string")


def parse(answers):
    return decisions.parse_wrong(answers, ALLOWED)


def test_calls_are_retried_and_never_fail_the_job(spark):
    got = {r["candidate_id"]: r for r in calls.verified(requests(spark, ["g", "d", "o", "t", "e"]), flaky, parse, delay_seconds=0.0).collect()}
    assert {k: (r["status"], r["attempts"], r["error"]) for k, r in got.items()} == {
        "g": ("verified", 1, None), "o": ("verified", 2, None), "t": ("verified", 3, None), "e": ("error", 3, "empty_answer"), "d": ("error", 3, "no answer to d")}
    assert got["g"]["suggested_category"] == "van" and got["d"]["suggested_category"] is None and all(r["seconds"] >= 0 for r in got.values())
    assert calls.verified(requests(spark, ["g"]).limit(0), flaky, parse).count() == 0
    once = calls.verified(requests(spark, ["o"]), flaky, parse, retries=0).first()
    assert (once["status"], once["attempts"]) == ("error", 1)


def test_answers_of_the_cache_are_not_asked_again(spark, tmp_path):
    path, names = f"file://{tmp_path}/cache", ["g", "d", "o"]
    first = calls.verified(requests(spark, names), flaky, parse, cache.read(spark, path), delay_seconds=0.0)
    cache.save(first.withColumn("stored_at", F.current_timestamp()), path)
    assert sorted(r["key"] for r in cache.read(spark, path).collect()) == ["0g", "0o"]

    def never(request):
        raise AssertionError("asked")

    again = {r["candidate_id"]: r for r in calls.verified(requests(spark, names), never, parse, cache.read(spark, path), delay_seconds=0.0).collect()}
    assert {k: (r["status"], r["cache_hit"], r["attempts"]) for k, r in again.items()} == {"g": ("verified", True, 0), "o": ("verified", True, 0), "d": ("error", False, 3)}
    # An answer of another type, or one that can't be parsed any more, is asked for anew.
    other = cache.read(spark, path).withColumn("candidate_type", F.lit(calls.CLUSTER))
    broken = cache.read(spark, path).withColumn("response", F.lit("{}"))
    for known in (other, broken):
        assert {r["cache_hit"] for r in calls.verified(requests(spark, names), flaky, parse, known, delay_seconds=0.0).collect()} == {False}


def test_review_writes_its_manifest(spark, tmp_path):
    candidates = requests(spark, ["g", "d", "low", "none"]).withColumn("quality", F.when(F.col("candidate_id") == "low", "low").when(F.col("candidate_id") != "none", "good")).withColumns({f"size_{a}": F.lit(1.0) for a in "xyz"})
    categories = spark.createDataFrame([("car", ["car"])], "name string, dimension_keys array<string>")
    sizes = spark.createDataFrame([("car", 4.0, 2.0, 1.5)], "class_name string, ref_length double, ref_width double, ref_height double")
    found = calls.review(candidates, flaky, ALLOWED, {}, categories, sizes, delay_seconds=0.0)
    told = {r["candidate_id"]: r for r in found["sections"].collect()}
    assert {k: r["vision"] and (r["vision"]["status"], r["vision"]["error"]) for k, r in told.items()} == {"g": ("verified", ""), "d": ("error", "no answer to d"), "low": ("skipped", "projection_low_quality"), "none": None}
    assert told["g"]["vision_decision"].asDict() == {"accepted": True, "reason": "label_mismatch_vote"} and told["g"]["vision_cache"]["hit"] is False and told["d"]["vision_decision"] is None
    assert found["low_quality"].first().asDict() == {"scene_id": "s", "projection_low_quality": 1, "input_failures": 1}
    tables.write_manifest(found["sections"].withColumn("views", F.array(F.lit("a.jpg"))), str(tmp_path / "m"))
    assert sum('"vision_decision"' in p.read_text() for p in (tmp_path / "m").rglob("*.txt")) >= 1


def answers(spark, rows):
    return spark.createDataFrame([(k, "x", v, 1.0, status) for k, v, status in rows], "key string, candidate_type string, response string, seconds double, status string").withColumn("stored_at", F.current_timestamp())


def test_two_writers_store_each_key_once(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    keys = [f"{i:x}{j}" for i in range(16) for j in range(3)]
    errors = []

    def run(name, own):
        try:
            cache.save(answers(spark, [(k, name, "verified") for k in own]), path)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(n, own)) for n, own in (("one", keys[:40]), ("two", keys[8:]), ("three", keys))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    got = cache.read(spark, path).collect()
    assert sorted(r["key"] for r in got) == sorted(keys)
    cache.save(answers(spark, [(keys[0], "later", "verified"), ("zz", "new", "verified"), ("ff", "no", "error"), ("fe", "1", "verified"), ("fe", "2", "verified")]), path)
    stored = {r["key"]: r["response"] for r in cache.read(spark, path).collect()}
    assert stored[keys[0]] != "later" and stored["fe"] == "2" and "ff" not in stored and stored["zz"] == "new" and len(stored) == len(keys) + 2


def test_a_killed_writer_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    cache.save(answers(spark, [("a1", "1", "verified")]), path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(cache, "_range", killed)
        with pytest.raises(KeyboardInterrupt):
            cache.save(answers(spark, [("a2", "1", "verified"), ("b1", "1", "verified")]), path)
    assert os.listdir(tmp_path / "cache" / "preparing") and [r["key"] for r in cache.read(spark, path).collect()] == ["a1"]
    # One that lost the race for a number takes the next, without what the other stored.
    folder = cache.Folder(spark, path)
    r = next(r for r in cache.RANGES if folder.parts(f"committed/{r}"))
    answers(spark, [("a1", "mine", "verified"), ("a3", "mine", "verified")]).select(*cache.NAMES).write.parquet(f"{path}/preparing/x/range={r}")
    assert cache._range(folder, cache.read(spark, path), r, 0, f"preparing/x/range={r}", 3) == 2
    assert sorted((r["key"], r["response"]) for r in cache.read(spark, path).collect()) == [("a1", "1"), ("a3", "mine")]
