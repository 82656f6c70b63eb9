"""Claims and readiness of frames over a whole table of events: what the streams of streaming.claims give when all has come.

Events have the columns of streaming.claims.EVENT.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidaraudit.operators.assets import JPGS

CLAIM = "scene_id string, claim_ts long, frame_index int, stamp double, takes_all boolean"


def claim_order(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What each claim of a scene takes; rows: its claims and its clouds that have a stamp, nothing else."""
    rows = rows.assign(rank=(rows["action"] == "claim").astype(int)).sort_values(["ts", "rank", "frame_index"], kind="stable")
    free, out = {}, []
    for ts, action, frame, stamp in rows[["ts", "action", "frame_index", "stamp"]].itertuples(index=False):
        if action == "asset":
            free[stamp] = ts
        else:
            first = min(free, default=None)
            out.append((key[0], ts, frame, first, first is None))
            free.pop(first, None)
    return pd.DataFrame(out, columns=["scene_id", "claim_ts", "frame_index", "stamp", "takes_all"]).astype({"frame_index": "Int32"})


def claimed_by_stamp(events: DataFrame) -> DataFrame:
    """Each asset with the frame that claims it: scene_id, url, arrival_ts, kind, group_key, frame_index, how.

    Only claims and clouds, a few for each frame, are ordered scene by scene. All assets then meet the first claim of
    their stamp at or after them, and the first that takes all, whichever comes first; what has neither is swept.
    """
    stamp = F.col("group_key").cast("double")
    deciding = events.where("action = 'claim' or action = 'asset' and kind = 'pcd' and group_key is not null")
    taken = deciding.select("scene_id", "ts", "action", "frame_index", stamp.alias("stamp")).groupBy("scene_id").applyInPandas(claim_order, CLAIM)
    assets = events.where("action = 'asset'").select("scene_id", F.col("ts").alias("arrival_ts"), "kind", "group_key", "url", stamp.alias("stamp"))
    by_stamp = taken.where("not takes_all").groupBy("scene_id", "stamp").agg(F.array_sort(F.collect_list(F.struct("claim_ts", "frame_index"))).alias("own"))
    by_scene = taken.where("takes_all").groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("claim_ts", "frame_index"))).alias("all"))
    # A stamp is claimed again only when another cloud of it comes, so `own` has one entry as a rule.
    next_of = lambda c: F.try_element_at(F.filter(c, lambda x: x["claim_ts"] >= F.col("arrival_ts")), F.lit(1))
    found = assets.join(by_stamp, ["scene_id", "stamp"], "left").join(by_scene, "scene_id", "left")
    found = found.withColumns({"one": next_of("own"), "whole": next_of("all")})
    first = F.when(F.col("whole").isNull() | (F.col("one.claim_ts") <= F.col("whole.claim_ts")), F.struct("one.*", F.lit("claimed").alias("how"))).otherwise(F.struct("whole.*", F.lit("rest").alias("how")))
    found = found.withColumn("first", F.when(F.col("one").isNotNull() | F.col("whole").isNotNull(), first))
    return found.select("scene_id", "url", "arrival_ts", "kind", "group_key", F.col("first.frame_index").alias("frame_index"), F.coalesce("first.how", F.lit("swept")).alias("how"))


def claimed_by_window(events: DataFrame) -> DataFrame:
    """Each asset with the frame whose window has it: the first claim after it, if no frame began in between; else it is swept."""
    rank = F.when(F.col("action") == "asset", 0).when(F.col("action") == "claim", 1).otherwise(2)
    back = Window.partitionBy("scene_id").orderBy(F.col("ts").desc(), rank.desc(), F.coalesce("frame_index", F.lit(0)).desc())
    mark = F.when(F.col("action") != "asset", F.struct("action", "frame_index"))
    following = F.last(mark, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = events.where("action in ('asset', 'claim', 'start')").withColumn("mark", following).where("action = 'asset'")
    mine = F.col("mark.action") == "claim"
    return found.select("scene_id", "url", F.col("ts").alias("arrival_ts"), "kind", "group_key", F.when(mine, F.col("mark.frame_index")).alias("frame_index"), F.when(mine, "claimed").otherwise("swept").alias("how"))


def frame_counts(claimed: DataFrame, events: DataFrame) -> DataFrame:
    """Of each claim: how many clouds and pictures it took."""
    own = claimed.where("frame_index is not null").groupBy("scene_id", "frame_index").agg(F.count_if(F.col("kind") == "pcd").alias("pcd_count"), F.count_if(F.col("kind") == "jpg").alias("jpg_count"))
    frames = events.where("action = 'claim'").select("scene_id", "frame_index").distinct()
    return frames.join(own, ["scene_id", "frame_index"], "left").fillna(0, ["pcd_count", "jpg_count"])


def ready_frames(events: DataFrame, pcds: int | None = 1, jpgs: int | None = JPGS, quiet_ms: int = 800, timeout_ms: int = 60_000, settle_ms: int = 3000) -> DataFrame:
    """scene_id, frame_index, ready_status, pcd_count, jpg_count, elapsed_ms of each start.

    Starts meet the arrivals of their time in buckets as long as the timeout, so no scene's events are all in one task.
    """
    quiet, timeout = quiet_ms * 1000, timeout_ms * 1000
    bucket = lambda c: F.floor(c / F.lit(timeout)).cast("long")
    arrivals = events.where("action = 'asset' and kind in ('pcd', 'jpg')").select("scene_id", F.col("ts").alias("arrival"), "kind", bucket(F.col("ts")).alias("bucket"))
    starts = events.where("action = 'start'").select("scene_id", "frame_index", F.col("ts").alias("start"))
    near = starts.select("*", F.explode(F.sequence(bucket(F.col("start") - quiet), bucket(F.col("start") + timeout))).alias("bucket"))
    # Of what came before, only the last that could break the quiet counts: no longer ago than the quiet time.
    inside = (F.col("arrival") > F.col("start") - quiet) & (F.col("arrival") < F.col("start") + timeout)
    met = near.join(arrivals, ["scene_id", "bucket"]).where(inside).select("scene_id", "frame_index", "start", "arrival", "kind")
    own = ["scene_id", "frame_index", "start"]
    steps = starts.select(*own, F.lit(None).cast("long").alias("arrival"), F.lit(None).cast("string").alias("kind")).unionByName(met)
    so_far = Window.partitionBy(*own).orderBy(F.col("arrival").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = steps.withColumns({k: F.count_if((F.col("kind") == k) & (F.col("arrival") > F.col("start"))).over(so_far) for k in ("pcd", "jpg")})
    counted = counted.dropDuplicates([*own, "arrival"]).withColumn("following", F.lead("arrival").over(Window.partitionBy(*own).orderBy(F.col("arrival").asc_nulls_first())))
    enough = F.lit(True)
    for name, n in (("pcd", pcds), ("jpg", jpgs)):
        enough = enough if n is None else enough & (F.col(name) >= n)
    calm = F.greatest("start", F.coalesce(F.col("arrival") + quiet, "start"))
    good = enough & (calm < F.coalesce("following", F.lit(1 << 62))) & (calm < F.col("start") + timeout)
    told = counted.groupBy(*own).agg(
        F.min(F.when(good, F.struct(calm.alias("calm"), "pcd", "jpg"))).alias("ok"), F.max("pcd").alias("pcd"), F.max("jpg").alias("jpg"))
    ok = F.col("ok").isNotNull()
    return told.select(
        "scene_id", "frame_index", F.when(ok, "ok").otherwise("timeout").alias("ready_status"), F.when(ok, F.col("ok.pcd")).otherwise(F.col("pcd")).alias("pcd_count"),
        F.when(ok, F.col("ok.jpg")).otherwise(F.col("jpg")).alias("jpg_count"), F.when(ok, F.expr("(ok.calm - start) div 1000") + settle_ms).otherwise(timeout_ms).cast("long").alias("elapsed_ms"))
