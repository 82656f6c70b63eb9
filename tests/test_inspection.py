"""The plan from clouds, boxes and pictures to candidates with views, on a small scene made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidaraudit.operators import cluster, inspection
from lidaraudit.sources import fixtures

POINTS = "scene_id string, frame_index int, point_idx long, x double, y double, z double"
BOXES = "scene_id string, frame_index int, bbox_index long, position_x double, position_y double, position_z double, rotation_x double, rotation_y double, rotation_z double, scale_x double, scale_y double, scale_z double"


@pytest.fixture(scope="module")
def scene(spark):
    """Frame 1: a block in front that no box explains, one inside a box, another one behind; frame 2 has no pictures, frame 3 no cloud."""
    rng = np.random.default_rng(7)
    rows = []
    for f in (1, 2):
        for x, y in ((12.0, 0.5), (12.0, -6.0), (-12.0, 0.0)):
            for p in rng.random((160, 3)) * [1.5, 1.5, 1.4] + [x, y, 0.6]:
                rows.append(("s", f, len(rows), *map(float, p)))
    points = spark.createDataFrame(rows, POINTS)
    boxes = spark.createDataFrame([("s", f, 0, 12.75, -5.25, 1.3, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0) for f in (1, 2, 3)], BOXES)
    images = spark.createDataFrame([("s", f, "cam_front", f"f{f}.jpg", 960, 540) for f in (1, 3)], "scene_id string, frame_index int, asset_name string, path string, width int, height int")
    return points, boxes, images


OPTIONS = {"clouds": {"side": 0.2}, "clusters": {"method": "dbscan", "eps": 0.6, "min_points": 4}, "merge": {"most": 0.4}, "min_points": 8, "max_low_area": None}


def test_candidates_have_their_views(spark, scene):
    points, boxes, images = scene
    clusters = inspection.clusters_with_points(points, boxes, **OPTIONS).cache()
    passed = cluster.detect_clusters(points, boxes, **OPTIONS).collect()
    own = {(r["frame_index"], r["cluster_id"]): r for r in clusters.collect()}
    assert set(own) == {(r["frame_index"], r["cluster_id"]) for r in passed} and len(own) == 4
    for r in passed:  # members are the candidate's voxels
        members = np.array(own[r["frame_index"], r["cluster_id"]]["members"])
        assert len(members) == r["points"] and np.allclose(members.min(0), [r["min_x"], r["min_y"], r["min_z"]])
    found = inspection.candidates(clusters, boxes, images, fixtures.cameras(spark)).cache()
    seen = {(r["frame_index"], r["candidate_type"]): r for r in found.collect()}
    assert set(seen) == {(1, "residual_cluster"), (1, "existing_bbox"), (3, "existing_bbox")}
    view = seen[1, "residual_cluster"]["views"][0]
    assert (view["camera_id"], view["path"]) == ("cam_front_1", "f1.jpg") and 0 <= view["x1"] < view["x2"] < 960 and view["crop_x1"] <= view["x1"] and view["visible_points"] > 20
    assert inspection.candidates(clusters, boxes, images, fixtures.cameras(spark), wrong_enabled=False).select("candidate_type").distinct().count() == 1
    frames = spark.createDataFrame([("s", f) for f in (1, 2, 3, 4)], "scene_id string, frame_index int")
    told = {r["frame_index"]: tuple(r)[2:] for r in inspection.frame_results(frames, clusters, boxes, points, images, found).collect()}
    assert told == {1: (2, 1, 1, 1, "", ""), 2: (0, 0, 0, 0, inspection.NO_PICTURES, ""), 3: (0, 0, 1, 1, "", inspection.NO_CLOUD), 4: (0, 0, 0, 0, inspection.NO_PICTURES, "")}


def test_merged_fragments_keep_all_members(spark):
    """Two fragments of one candidate, 0.3 apart: members of both."""
    rng = np.random.default_rng(1)
    rows = [("s", 1, k, *map(float, p)) for k, p in enumerate(np.concatenate([rng.random((60, 3)) + [5, 0, 1], rng.random((60, 3)) + [6.35, 0, 1]]))]
    points, boxes = spark.createDataFrame(rows, POINTS), spark.createDataFrame([], BOXES)
    options = {"clouds": {"side": 0.01}, "clusters": {"method": "dbscan", "eps": 0.33, "min_points": 3}, "merge": {"most": 0.6}, "min_points": 8, "max_low_area": None}
    one = inspection.clusters_with_points(points, boxes, **options).collect()
    assert [(r["fragments"] > 1, len(r["members"]) == r["points"]) for r in one if r["points"] > 60] == [(True, True)]


def test_the_review_takes_the_place_of_the_geometric_rule():
    rules = ("position_jump", inspection.GEOMETRIC)
    assert inspection.enabled_rules(rules, review=True) == ("position_jump",) and inspection.enabled_rules(rules, review=False) == rules
