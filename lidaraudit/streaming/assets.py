"""Arriving files as a stream: groups by time stamp, and quiet periods, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidaraudit.operators.assets import JPGS, classified


def arrivals(events: DataFrame, late_by: str = "1 hour") -> DataFrame:
    """A stream of scene_id, arrival_ts, url with kind and stamp; what comes later than late_by is dropped."""
    return classified(events).withWatermark("arrival_ts", late_by)


def grouped(assets: DataFrame, settle: str = "1 hour") -> DataFrame:
    """Counts of each scene and stamp, given out when nothing of it has come for as long as settle, and no more can come.

    A session per stamp, so a group isn't cut at the hour; its state goes when the watermark has passed it. A stamp
    without a cloud is unclaimed, and so is what comes after its group was given out.
    """
    counted = assets.groupBy("scene_id", "group_key", F.session_window("arrival_ts", settle).alias("w")).agg(
        F.count_if(F.col("kind") == "pcd").alias("pcd_count"), F.count_if(F.col("kind") == "jpg").alias("jpg_count"))
    whole = (F.col("pcd_count") == 1) & (F.col("jpg_count") == JPGS)
    return counted.select("scene_id", "group_key", "pcd_count", "jpg_count", F.when(F.col("pcd_count") == 0, "unclaimed").when(whole, "ok").otherwise("warning").alias("status"))


def quiet(assets: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """A row for each run of arrivals, given out when it has been quiet for gap."""
    return assets.groupBy("scene_id", F.session_window("arrival_ts", gap).alias("w")).agg(F.count("url").alias("assets")).select("scene_id", F.col("w.start").alias("first_ts"), "assets")
