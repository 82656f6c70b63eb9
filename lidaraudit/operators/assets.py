"""Arriving files of a frame: kinds, groups by time stamp, claims, slots and quiet periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C

PCD, JPG = r"(?i)\.pcd(\?|$)", r"(?i)\.jpe?g(\?|$)"
STAMP = r"/(\d+\.\d+)\.(?:pcd|jpe?g)"
JPGS = 5


def classified(events: DataFrame) -> DataFrame:
    """Events of addresses (scene_id, arrival_ts, url) with kind and group_key; other files are dropped."""
    kind = F.when(F.col("url").rlike(PCD), "pcd").when(F.col("url").rlike(JPG), "jpg")
    stamp = F.nullif(F.regexp_extract("url", STAMP, 1), F.lit(""))
    return events.withColumns({"kind": kind, "group_key": stamp}).where("kind is not null")


def groups(assets: DataFrame) -> DataFrame:
    """One row per scene and time stamp that has a point cloud, numbered in order of the stamp: the frame that claims it."""
    found = assets.where("group_key is not null").groupBy("scene_id", "group_key").agg(
        F.count_if(F.col("kind") == "pcd").alias("pcd_count"), F.count_if(F.col("kind") == "jpg").alias("jpg_count"),
        F.min(F.when(F.col("kind") == "pcd", F.col("arrival_ts"))).alias("pcd_ts"), F.max("arrival_ts").alias("last_ts"))
    with_cloud = found.where("pcd_count > 0")
    frame = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.col("group_key").cast("double")))
    return with_cloud.withColumn("frame_index", frame)


def with_status(found: DataFrame, pcds: int = 1, jpgs: int = JPGS) -> DataFrame:
    warning = F.concat_ws(
        "; ", F.when(F.col("pcd_count") != pcds, F.format_string("pcd %d/%d", "pcd_count", F.lit(pcds))),
        F.when(F.col("jpg_count") != jpgs, F.format_string("jpg %d/%d", "jpg_count", F.lit(jpgs))))
    return found.withColumn("warning", warning).withColumn("status", F.when(F.col("warning") == "", "ok").otherwise("warning"))


def slots(assets: DataFrame, found: DataFrame, jpgs: int = JPGS) -> DataFrame:
    """The addresses of each frame's clouds, joined by `;` so that none is lost, and of its first pictures, in order of arrival and address; with counts and status."""
    clouds = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "pcd", F.struct("arrival_ts", "url")))), lambda x: x["url"])
    order = Window.partitionBy("scene_id", "group_key", "kind").orderBy("arrival_ts", "url")
    numbered = assets.withColumn("n", F.row_number().over(order)).where((F.col("kind") == "pcd") | (F.col("n") <= jpgs))
    pick = lambda k: F.max(F.when((F.col("kind") == "jpg") & (F.col("n") == k), F.col("url")))
    wide = numbered.groupBy("scene_id", "group_key").agg(F.array_join(clouds, ";").alias("pcd_url"), *[pick(k).alias(f"jpg_url_{k}") for k in range(1, jpgs + 1)])
    told = with_status(found, jpgs=jpgs).select("scene_id", "group_key", "frame_index", "pcd_count", "jpg_count", "status", "warning")
    return told.join(wide, ["scene_id", "group_key"])


def late(assets: DataFrame, found: DataFrame, settle: str = "30 minutes") -> DataFrame:
    """Pictures that arrive after their group was claimed: longer than settle after its first cloud."""
    claimed = found.select("scene_id", "group_key", "frame_index", (F.col("pcd_ts") + F.expr(f"interval {settle}")).alias("claimed_ts"))
    return assets.where("kind = 'jpg'").join(claimed, ["scene_id", "group_key"]).where(F.col("arrival_ts") > F.col("claimed_ts"))


def quiet_periods(assets: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Runs of arrivals of a scene that end when nothing comes for longer than gap."""
    return assets.groupBy("scene_id", F.session_window("arrival_ts", gap).alias("w")).agg(F.count("url").alias("assets"), F.count_if(F.col("kind") == "pcd").alias("pcds"), F.min("arrival_ts").alias("first_ts"), F.max("arrival_ts").alias("last_ts")).drop("w")


def camera_of(assets: DataFrame) -> DataFrame:
    order = Window.partitionBy("scene_id", "group_key").orderBy("arrival_ts", "url")
    return assets.where("kind = 'jpg'").withColumn("camera", C.camera_name(F.col("url"), F.row_number().over(order)))
