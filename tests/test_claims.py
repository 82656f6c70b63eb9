"""Claims and readiness: streams against a plain replay, over shuffled arrivals and restarts; whole tables against the same."""

import random

import pytest
from pyspark.sql import functions as F

from lidaraudit.operators import claims as whole
from lidaraudit.streaming import claims as stream

SECOND = 1_000_000


def plain_claims(events, by):
    """Events of one scene in order: who claims what."""
    items, out, begin = [], [], 0
    for ts, action, frame, kind, stamp, url in stream.ordered(events):
        if action == "asset":
            items.append([url, kind, stamp, False])
        elif action == "start":
            begin = len(items)
        elif action in ("claim", "end"):
            how, free = "swept" if action == "end" else "claimed", [x for x in items if not x[3]]
            if action == "claim" and by == "window":
                free = [x for x in items[begin:] if not x[3]]
            elif action == "claim":
                stamps = sorted({x[2] for x in free if x[1] == "pcd" and x[2]}, key=float)
                how = "claimed" if stamps else "rest"
                free = [x for x in free if x[2] == stamps[0]] if stamps else free
            for x in free:
                x[3] = True
                out.append((frame if action == "claim" else None, x[0], how))
    return sorted(out, key=str)


def scene_events(name, seed, frames=14):
    """A scene whose files come early, late or never, with files that have no stamp."""
    rng, rows = random.Random(seed), []
    for f in range(1, frames + 1):
        begin = f * 100
        rows += [(begin * SECOND, "start", f, None, None, None), ((begin + 70) * SECOND, "claim", f, None, None, None)]
        stamp = f"{1000 + f}.5" if f != 9 else "998.25"  # one is older than those before it
        files = [("pcd", f"/lidar/{stamp}.pcd")] * (f % 5 != 0) + [("jpg", f"/cam{k}/{stamp}.jpg") for k in range(rng.randrange(3, 7))]
        for k, (kind, url) in enumerate(files):
            rows.append((int((begin + rng.uniform(-130, 90)) * SECOND), "asset", None, kind, stamp, f"{name}{url}?{k}"))
        rows.append((int((begin + rng.uniform(0, 60)) * SECOND), "asset", None, "jpg", None, f"{name}/plain/{f}.jpg"))
    rows.append(((frames + 1) * 100 * SECOND, "end", None, None, None, None))
    return rows


SCENES = {f"s{k}": scene_events(f"s{k}", k) for k in range(3)}


def shuffled(by_seconds, seed=1):
    """All events, each at most by_seconds out of order, and a last tick for each scene."""
    rng = random.Random(seed)
    rows = [(s, *e) for s, own in SCENES.items() for e in own]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, by_seconds * SECOND))
    return rows + [(s, 10_000 * SECOND, "tick", None, None, None, None) for s in SCENES]


def run(spark, folder, rows, make, mode="append", stops=(0.4,)):
    """Feeds rows file by file, in order; the query is stopped and started anew at each of stops."""
    stream.with_state_store(spark)
    feed, out = str(folder / "in"), str(folder / "out")
    cuts = [0, *(int(x * len(rows)) for x in stops), len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for k in range(a, b, max(1, (b - a) // 3 + 1)):
            spark.createDataFrame(rows[k : min(b, k + max(1, (b - a) // 3 + 1))], stream.EVENT).coalesce(1).write.mode("append").parquet(feed)
            events = spark.readStream.schema(stream.EVENT).option("maxFilesPerTrigger", 1).parquet(feed)
            if k == a:
                query = make(events, out, str(folder / "checkpoint"))
            query.processAllAvailable()
        query.stop()
    return out


def written_to(found, out, checkpoint):
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()


@pytest.mark.parametrize("by", ["stamp", "window"])
def test_stream_of_claims_is_a_plain_replay(spark, tmp_path, by):
    rows = shuffled(40)
    out = run(spark, tmp_path, rows, lambda e, o, c: written_to(stream.claims(e, 45, by), o, c))
    got = spark.read.parquet(out).collect()
    for s, own in SCENES.items():
        mine = [r for r in got if r["scene_id"] == s and r["url"] is not None]
        assert sorted(((r["frame_index"], r["url"], r["how"]) for r in mine), key=str) == plain_claims(own, by)
        assert not any(r["delayed"] for r in mine)
        # A frame without files is told of, too.
        assert {e[2] for e in own if e[1] == "claim"} == {r["frame_index"] for r in got if r["scene_id"] == s and r["frame_index"] is not None}


def test_late_assets_go_to_the_next_mark_or_aside(spark, tmp_path):
    rows = shuffled(0)
    late = [r for r in rows[: len(rows) // 2] if r[2] == "asset"][::9]
    rows = [r for r in rows if r not in late]
    rows = rows[: len(rows) * 2 // 3] + late + rows[len(rows) * 2 // 3 :] + [("s0", 5 * SECOND, "asset", None, "jpg", "1.5", "too late")]
    out = run(spark, tmp_path, rows, lambda e, o, c: stream.to_two_sinks(stream.claims(e, 1), o, c).start(), stops=(1 - 0.5 / len(rows),))  # the last row comes when the scenes have ended
    assets, aside = spark.read.parquet(f"{out}/assets").where("url is not null"), spark.read.parquet(f"{out}/late")
    assert [r["url"] for r in aside.collect()] == ["too late"]
    assert sorted(r["url"] for r in assets.collect()) == sorted(r[6] for r in rows if r[2] == "asset" and r[6] != "too late")
    delayed = {r["url"]: r for r in assets.where("delayed").collect()}
    assert delayed and set(delayed) <= {r[6] for r in late}
    for r in delayed.values():  # claimed when it had come, not before
        assert r["claim_ts"] > r["arrival_ts"]


def test_two_sinks_own_a_folder_a_batch(spark, tmp_path):
    """A batch that is run again replaces its rows."""
    found = spark.createDataFrame([("s", 1, 5, "1.5", "jpg", "a", 3, "claimed", False), ("s", None, None, None, "jpg", "b", 3, "late", False)], stream.OUTCOME)

    class Stream:
        def foreachBatch(self, f):  # noqa: N802
            self.store = f
            return self

        def option(self, *_):
            return self

    class Found:
        writeStream = Stream()  # noqa: N815

    store = stream.to_two_sinks(Found(), str(tmp_path), "c").store
    for number in (0, 0, 1):
        store(found, number)
    assert spark.read.parquet(f"{tmp_path}/assets").count() == 2 and spark.read.parquet(f"{tmp_path}/late").count() == 2


def table(spark):
    return spark.createDataFrame([(s, *e) for s, own in SCENES.items() for e in own], stream.EVENT).repartition(3)


@pytest.mark.parametrize("by", ["stamp", "window"])
def test_table_of_claims_is_a_plain_replay(spark, by):
    got = (whole.claimed_by_stamp if by == "stamp" else whole.claimed_by_window)(table(spark)).collect()
    for s, own in SCENES.items():
        assert sorted(((r["frame_index"], r["url"], r["how"]) for r in got if r["scene_id"] == s), key=str) == plain_claims(own, by)


NEEDS = {"usual": stream.Needs(1, 3, 8000, 60_000, 3000), "pictures": stream.Needs(None, 2, 5000, 30_000, 0), "nothing": stream.Needs(None, None, 8000, 60_000, 500)}


def polled(start, arrivals, needs, step=SECOND // 20):
    """Looks at the counters again and again, as a waiting program does; its answer is at most a step too late."""
    t = start
    while t < start + needs.timeout_ms * 1000:
        since = [k for a, k in arrivals if start < a <= t]
        last = max((a for a, _ in arrivals if a <= t), default=None)
        if (needs.pcds is None or since.count("pcd") >= needs.pcds) and (needs.jpgs is None or since.count("jpg") >= needs.jpgs) and (last is None or t - last >= needs.quiet_ms * 1000):
            return "ok", since.count("pcd"), since.count("jpg")
        t += step
    since = [k for a, k in arrivals if start < a < start + needs.timeout_ms * 1000]
    return "timeout", since.count("pcd"), since.count("jpg")


@pytest.mark.parametrize("name", sorted(NEEDS))
def test_readiness_against_polling(spark, tmp_path, name):
    needs, want = NEEDS[name], {}
    for s, own in SCENES.items():
        arrivals = sorted((e[0] // 50_000 * 50_000, e[3]) for e in own if e[1] == "asset")
        for e in own:
            if e[1] == "start":
                got = stream.readiness(e[0], arrivals, needs)
                assert got[:3] == polled(e[0], arrivals, needs)
                want[s, e[2]] = got[:4]
    rounded = table(spark).withColumn("ts", F.when(F.col("action") == "asset", F.expr("ts div 50000 * 50000")).otherwise(F.col("ts")))
    got = whole.ready_frames(rounded, needs.pcds, needs.jpgs, needs.quiet_ms, needs.timeout_ms, needs.settle_ms).collect()
    assert {(r["scene_id"], r["frame_index"]): tuple(r[2:6]) for r in got} == want


def test_nothing_came_yet():
    """An empty scene is quiet: ready at once if no files are asked for, else it waits to the end."""
    assert stream.readiness(7, [], stream.Needs(None, None, 800, 60_000, 3000)) == ("ok", 0, 0, 3000, "")
    status, pcds, jpgs, ms, reason = stream.readiness(7, [], stream.Needs())
    assert (status, pcds, jpgs, ms) == ("timeout", 0, 0, 60_000) and "idle_ms=inf" in reason
    assert stream.readiness(7, [], stream.Needs(), upto=59_000_000) is None
    assert stream.readiness(0, [(100, "pcd")], stream.Needs(1, None), upto=700_000) is None  # not quiet for long enough yet


def test_stream_of_readiness(spark, tmp_path):
    needs = NEEDS["usual"]
    out = run(spark, tmp_path, shuffled(20), lambda e, o, c: written_to(stream.ready_frames(e, needs, "25 seconds"), o, c))
    got = {(r["scene_id"], r["frame_index"]): (r["ready_status"], r["pcd_count"], r["jpg_count"], r["elapsed_ms"], r["reason"]) for r in spark.read.parquet(out).collect()}
    want = {(s, e[2]): stream.readiness(e[0], sorted((x[0], x[3]) for x in own if x[1] == "asset"), needs) for s, own in SCENES.items() for e in own if e[1] == "start"}
    assert got == want and {x[0] for x in got.values()} == {"ok", "timeout"}
