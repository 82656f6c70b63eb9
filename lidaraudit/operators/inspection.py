"""From clouds, boxes and pictures to candidates with their views, in one plan.

Clusters that no box explains and boxes themselves are projected into the cameras for which a frame has a
picture; each keeps its views, judged by the limits of its kind. What could not be done in a frame is told of as a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidaraudit.functions import columns as C
from lidaraudit.functions.storage import stored
from lidaraudit.operators import cluster, projection
from lidaraudit.operators.calls import BOX, CLUSTER
from lidaraudit.operators.cloud import FRAME, residual

NO_PICTURES, NO_CLOUD = "no pictures", "no point cloud"


def with_members(voxels: DataFrame, labels: DataFrame, found: DataFrame, groups: DataFrame) -> DataFrame:
    """found (candidates with group and fragments) with members, their voxels as arrays x, y, z; a single fragment is its own group."""
    one = found.where("fragments = 1").select(*FRAME, "cluster_id", F.col("group").alias("label"))
    many = found.where("fragments > 1").select(*FRAME, "cluster_id", "group").join(groups, [*FRAME, "group"]).select(*FRAME, "cluster_id", "label")
    owner = one.unionByName(many).withColumnRenamed("label", "group")
    members = cluster.members_of(voxels, labels, labels.where("label >= 0").select(*FRAME, F.col("label").cast("long").alias("label")).distinct().withColumn("group", F.col("label")))
    each = members.join(owner, [*FRAME, "group"]).groupBy(*FRAME, "cluster_id").agg(F.flatten(F.collect_list("members")).alias("members"))
    return found.join(each, [*FRAME, "cluster_id"])


def clusters_with_points(points: DataFrame, boxes: DataFrame, clouds: dict | None = None, clusters: dict | None = None, **rest) -> DataFrame:
    """detect_clusters() with members, the voxels of each candidate. Voxels, labels and groups are written once."""
    voxels = stored(cluster.numbered_voxels(residual(points, boxes, **({} if clouds is None else clouds))), "voxels")
    labels = stored(cluster.clustered(voxels, **({"method": "hdbscan"} if clusters is None else clusters)), "labels")
    passed = cluster.merged_candidates(voxels, labels, **rest).where("reject_reason is null").drop("reject_reason")
    fragments = cluster.fragments(voxels, labels).withColumn("label", F.col("label").cast("long"))
    groups = cluster.merged_fragments(fragments, cluster.fragment_gaps(fragments, **(rest.get("merge") or {})))
    return with_members(voxels, labels, stored(passed, "passed"), groups)


def judged_views(regions: DataFrame, kind: str, expand: float = 0.25) -> DataFrame:
    """Each candidate of a kind with its views (camera, picture, rectangle, crop, quality) in order of camera, and what ranks it."""
    judged = regions.withColumns(projection.quality(projection.quality_of(kind))).withColumns(projection.crop_bounds(expand))
    good = lambda c: F.when(F.col("good"), c)
    view = F.struct("camera_id", "path", "x1", "y1", "x2", "y2", "crop_x1", "crop_y1", "crop_x2", "crop_y2", "visible_points", "good", "reasons")
    return judged.groupBy(*FRAME, "candidate_id").agg(
        F.count_if("good").alias("good_views"), F.coalesce(F.sum(good(F.col("visible_points"))), F.lit(0)).alias("good_points"), F.coalesce(F.max(good(F.col("roi_area"))), F.lit(0)).alias("largest"),
        F.sum("visible_points").alias("all_points"), F.sort_array(F.collect_list(view)).alias("views")).withColumn("candidate_type", F.lit(kind))


def in_pictures(spans: DataFrame, matched: DataFrame) -> DataFrame:
    """regions() of spans in the pictures of their frames, with the picture's path."""
    seen = projection.views_of_images(spans, matched)
    return projection.regions(seen).join(matched.select(*FRAME, "camera_id", "path"), [*FRAME, "camera_id"])


def candidates(clusters: DataFrame, boxes: DataFrame, images: DataFrame, cameras: DataFrame, wrong_enabled: bool = True) -> DataFrame:
    """Clusters (cluster_id, members) and boxes of all frames as one table of candidates with views; those seen in no picture have none.

    images: sources.images.images(); cameras: sources.calibration, with scene_id if they differ by scene.
    """
    matched = stored(projection.cameras_of_images(images, cameras), "pictures")
    cams = projection.with_inverse(matched)
    parts = [judged_views(in_pictures(projection.cluster_spans(clusters.withColumnRenamed("cluster_id", "candidate_id"), cams), matched), CLUSTER)]
    if wrong_enabled:
        parts.append(judged_views(in_pictures(projection.box_spans(boxes, cams), matched), BOX))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def frame_results(frames: DataFrame, clusters: DataFrame, boxes: DataFrame, points: DataFrame, images: DataFrame, found: DataFrame) -> DataFrame:
    """One row per frame: cluster_count, visible_roi_count, bbox_count, bbox_visible_roi_count, skipped_reason, cluster_skipped_reason (empty: none).

    A frame without pictures is skipped as a whole; one without a cloud has no clusters. found: candidates().
    """
    there = lambda df, name: df.select(*FRAME).distinct().withColumn(name, F.lit(True))
    count = lambda df, name: df.groupBy(*FRAME).agg(F.count("*").alias(name))
    rois = found.groupBy(*FRAME).agg(*[F.coalesce(F.sum(F.when(F.col("candidate_type") == kind, F.size("views"))), F.lit(0)).alias(name) for kind, name in ((CLUSTER, "visible_roi_count"), (BOX, "bbox_visible_roi_count"))])
    out = frames.select(*FRAME).distinct()
    for part in (there(images, "pictures"), there(points, "cloud"), count(clusters, "cluster_count"), count(boxes, "bbox_count"), rois):
        out = out.join(part, FRAME, "left")
    skipped, bare = F.col("pictures").isNull(), F.col("cloud").isNull()
    counts = {c: F.when(skipped, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long") for c in ("cluster_count", "visible_roi_count", "bbox_count", "bbox_visible_roi_count")}
    return out.select(*FRAME, *[v.alias(c) for c, v in counts.items()], F.when(skipped, NO_PICTURES).otherwise("").alias("skipped_reason"), F.when(~skipped & bare, NO_CLOUD).otherwise("").alias("cluster_skipped_reason"))


#: The rule on clusters alone; the model's review, when it is on, takes its place.
GEOMETRIC = "possible_missing_annotation"


def enabled_rules(enabled: tuple[str, ...], review: bool) -> tuple[str, ...]:
    """The rules that run: without GEOMETRIC if the review judges missing boxes."""
    return tuple(r for r in enabled if not (review and r == GEOMETRIC))
