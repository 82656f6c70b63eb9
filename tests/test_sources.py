import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lidaraudit.operators import cloud, cluster, projection, temporal
from lidaraudit.sources import fixtures, pcd, tables
from lidaraudit.streaming import assets as stream

HEAD = "VERSION .7\nFIELDS x y intensity z\nSIZE 4 4 1 8\nTYPE F F U F\nCOUNT 1 1 2 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA {}\n"
ROWS = [(1.0, 2.0, 7, 8, 3.0), (-1.5, 0.0, 1, 2, 0.25)]


def literal(data: bytes) -> bytes:
    return b"".join(bytes([len(p) - 1]) + p for p in (data[i : i + 32] for i in range(0, len(data), 32)))


@pytest.mark.parametrize("mode", ["ascii", "binary", "binary_compressed"])
def test_pcd_modes(mode):
    if mode == "ascii":
        body = "\n".join(" ".join(map(str, r)) for r in ROWS).encode()
    elif mode == "binary":
        body = b"".join(struct.pack("<ffBBd", *r) for r in ROWS)
    else:
        raw = b"".join(struct.pack(f, *v) for f, v in (("<2f", [r[0] for r in ROWS]), ("<2f", [r[1] for r in ROWS]), ("<4B", [x for r in ROWS for x in r[2:4]]), ("<2d", [r[4] for r in ROWS])))
        body = literal(raw)
        body = struct.pack("<II", len(body), len(raw)) + body
    assert pcd.read_points(HEAD.format(mode).encode() + body).tolist() == [[1.0, 2.0, 3.0], [-1.5, 0.0, 0.25]]


def test_lzf_copies_overlap():
    assert pcd.decompressed(bytes([0, ord("a"), 32 * 5, 0]), 8) == b"a" * 8
    with pytest.raises(ValueError):
        pcd.decompressed(bytes([0, ord("a")]), 5)


def test_pcd_folder(spark, tmp_path):
    folder = tmp_path / "scene_7" / "frame_0003"
    folder.mkdir(parents=True)
    (folder / "a.pcd").write_bytes(HEAD.format("ascii").encode() + b"1 2 7 8 3\n-1.5 0 1 2 0.25")
    (folder / "b.pcd").write_bytes(b"FIELDS x y\nDATA ascii\n")
    rows = pcd.points(spark, str(tmp_path)).collect()
    assert sorted((r["scene_id"], r["frame_index"], r["x"]) for r in rows if r["error"] is None) == [("7", 3, -1.5), ("7", 3, 1.0)]
    assert [r["error"] for r in rows if r["error"]] == ["x, y and z are needed"]


def test_boxes_from_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text('﻿scene_id,frame_index,bbox_index,track_id,label,scale_x,extra\n1,2,0,,"a, ""b""",1.5,q\n1,3,1,t,,oops,q\n', encoding="utf-8")
    rows = tables.read_boxes(spark, str(tmp_path / "b.csv")).orderBy("frame_index").collect()
    assert [(r["scene_id"], r["frame_index"], r["track_id"], r["label"], r["scale_x"], r["className"]) for r in rows] == [("1", 2, "", 'a, "b"', 1.5, ""), ("1", 3, "t", "", None, "")]


def test_report_without_findings_has_a_header(spark, tmp_path):
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in tables.REPORT))
    tables.write_report(empty, str(tmp_path / "r"))
    assert any(p.read_text().startswith("scene_id,frame_index") for p in (tmp_path / "r").glob("*.csv"))


def test_points_on_a_face_are_inside(spark):
    box = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0, 0.0, 0.0, np.pi / 2, 4.0, 2.0, 2.0)], "scene_id string, frame_index int, position_x double, position_y double, position_z double, rotation_x double, rotation_y double, rotation_z double, scale_x double, scale_y double, scale_z double")
    p = spark.createDataFrame([("s", 1, i, *v) for i, v in enumerate([(0.0, 1.999, 0.0), (1.0, 0.0, 0.0), (1.5, 0.0, 0.0), (0.0, 2.5, 0.0), (0.0, 0.0, float("nan"))])], "scene_id string, frame_index int, point_idx long, x double, y double, z double")
    assert sorted(r["point_idx"] for r in cloud.outside_boxes(p, box, 0.0).collect()) == [2, 3]


def test_voxels_of_negative_coordinates(spark):
    p = spark.createDataFrame([("s", 1, 0, -0.1, 0.0, 0.3), ("s", 1, 1, 0.1, 0.0, 0.3)], "scene_id string, frame_index int, point_idx long, x double, y double, z double")
    v = cloud.voxels(p, 0.2)
    assert v.count() == 2 and cloud.above_ground(v, 0.3).count() == 0


def test_shapes_against_numpy(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(50, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([("s", 1, *map(float, r)) for r in p], "scene_id string, frame_index int, x double, y double, z double")
    r = cloud.shapes(df, ["scene_id", "frame_index"]).first()
    a, b, c = np.sort(np.linalg.eigvalsh(np.cov(p.T, bias=True)))[::-1]
    assert np.allclose([r["flatness"], r["thickness"]], [1 - max((a - b) / a, (b - c) / a), c / a])


def test_edge_points_and_region():
    assert len(projection.edge_table()) == 108 and len(set(projection.edge_table())) == 92


def test_projection_of_a_unit_box(spark):
    box = spark.createDataFrame([("s", 1, 0, 10.0, 0.0, 1.5, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "scene_id string, frame_index int, bbox_index long, position_x double, position_y double, position_z double, rotation_x double, rotation_y double, rotation_z double, scale_x double, scale_y double, scale_z double")
    cams = projection.with_inverse(fixtures.cameras(spark).where("camera_id = 'cam_back_1' or camera_id = 'cam_front_1'"))
    out = projection.regions(projection.box_spans(box, cams)).collect()
    assert [(r["camera_id"], r["visible_points"], r["total_points"]) for r in out] == [("cam_front_1", 108, 108)]
    assert (out[0]["x1"] + out[0]["x2"], out[0]["y1"] + out[0]["y2"]) == (1920, 1080)
    # The same points as a cluster's, and a picture of half the size.
    points = projection.box_edge_points(box).groupBy("scene_id", "frame_index").agg(F.lit("c").alias("candidate_id"), F.collect_list(F.array("x", "y", "z")).alias("members"))
    spans = projection.cluster_spans(points, cams.withColumn("scene_id", F.lit("s")))
    assert [tuple(r[4:8]) for r in projection.regions(spans).collect()] == [tuple(r[4:8]) for r in out]
    half = projection.regions(spans.withColumns({"image_width": F.lit(960), "image_height": F.lit(540)}), padding=4).first()
    assert (half["x1"] + half["x2"], half["y1"] + half["y2"], half["width"]) == (960, 540, 960)
    assert projection.cluster_spans(points, cams.withColumn("scene_id", F.lit("other"))).count() == 0


def test_inverse_matrices(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(4):
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        rows.append((f"c{k}", np.vstack([np.column_stack([q, rng.normal(size=3)]), [0, 0, 0, 1]]).reshape(-1).tolist()))
    rows += [("flat", [0.0] * 16), ("none", None)]
    cams = spark.createDataFrame([(n, 10, 10, 1.0, 1.0, 0.0, 0.0, m) for n, m in rows], "camera_id string, width int, height int, fx double, fy double, cx double, cy double, extrinsic array<double>")
    got = {r["camera_id"]: r["to_camera"] for r in projection.with_inverse(cams).collect()}
    assert set(got) == {"c0", "c1", "c2", "c3"}
    for n, m in rows[:4]:
        assert np.allclose(got[n], np.linalg.inv(np.array(m).reshape(4, 4))[:3].reshape(-1))


def test_pictures_meet_cameras(spark):
    images = spark.createDataFrame([("s", 1, "CAM_front", "b.jpg", 5, 6), ("s", 1, "cam_front", "a.jpg", 7, 8), ("s", 1, "cam_roof", "r.jpg", 1, 1)], "scene_id string, frame_index int, asset_name string, path string, width int, height int")
    assert [(r["camera_id"], r["path"], r["image_width"]) for r in projection.cameras_of_images(images, fixtures.cameras(spark)).collect()] == [("cam_front_1", "a.jpg", 7)]


def test_dbscan_borders_and_noise(spark):
    xs = [0.0, 0.3, 0.6, 0.9, 5.0, 5.3, 5.6, 9.0]
    p = spark.createDataFrame([("s", 1, i, x, 0.0, 0.0) for i, x in enumerate(xs)], "scene_id string, frame_index int, point_idx long, x double, y double, z double")
    out = {r["point_idx"]: (r["label"], r["core"]) for r in cluster.dbscan(p, 0.35, 3).collect()}
    assert out == {0: (0, False), 1: (0, True), 2: (0, True), 3: (0, False), 4: (1, False), 5: (1, True), 6: (1, False), 7: (-1, False)}


def test_rigid_fit_finds_the_motion():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(8, 2)) * 10
    r = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    got, shift = temporal.rigid_xy(a, a @ r.T + [2, -1])
    assert np.isclose(got, 0.3) and np.allclose(shift, [2, -1])


def test_motion_against_wrong_tracks():
    """Most tracks move together, some go their own way; too few in common give none."""
    rng = np.random.default_rng(3)
    p = np.column_stack([rng.normal(size=(12, 2)) * 20, np.zeros(12)])
    q = temporal.Motion(0.4, (3.0, -1.0, 0.25)).of(p)
    q[9:] += rng.normal(size=(3, 3)) * 30
    way = temporal.motion_between(p, q, temporal.Registration())
    assert np.isclose(way.angle, 0.4) and np.allclose(way.shift, (3.0, -1.0, 0.25))
    assert temporal.motion_between(p[:5], q[:5], temporal.Registration()) is None
    assert temporal.motion_between(p, rng.normal(size=(12, 3)) * 20, temporal.Registration()) is None
    assert np.allclose(way.then(temporal.Motion(-0.1, (1.0, 2.0, 3.0))).of(p), temporal.Motion(-0.1, (1.0, 2.0, 3.0)).of(way.of(p)))


def test_nearest_groups_against_a_plain_version():
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"frame_index": np.sort(rng.integers(1, 9, 60)), "candidate_id": [f"c{i:02}" for i in range(60)], "x": rng.integers(0, 6, 60) * 1.0, "y": rng.random(60), "z": np.where(np.arange(60) % 17, 0.0, np.nan)})
    groups, want = [], []
    for r in rows.itertuples():
        open_groups = [(np.linalg.norm(np.mean([[m.x, m.y, m.z] for m in g], 0) - [r.x, r.y, r.z]), k) for k, g in enumerate(groups) if g[-1].frame_index != r.frame_index]
        near = [x for x in open_groups if x[0] <= 1.0]
        k = min(near)[1] if near else len(groups)
        if k == len(groups):
            groups.append([])
        groups[k].append(r)
        want.append(k)
    assert temporal.nearest_groups(rows, 1.0)["group"].tolist() == want and temporal.nearest_groups(rows, 0.0)["group"].tolist() == list(range(60))


def test_stationary_cluster_seen_from_a_moving_car(spark):
    marks, seen = [], []
    for f in range(1, 5):
        c, s = np.cos(0.1 * f), np.sin(0.1 * f)
        view = lambda x, y, f=f, c=c, s=s: (float(c * (x - f) + s * y), float(-s * (x - f) + c * y))
        marks += [("s", f, f"t{k}", *view(10.0 * k, 5.0 * (k % 3)), 0.0) for k in range(7)]
        seen += [("s", f, "a", *view(20.0, 20.0), 1.0, 2.0, 2.0, 2.0, 0.1, 0.1, 0.1, 10 + f), ("s", f, "b", *view(3.0 * f, -20.0), 1.0, 2.0, 2.0, 2.0, 0.1, 0.1, 0.1, 5)]
    c = spark.createDataFrame(seen, "scene_id string, frame_index int, candidate_id string, x double, y double, z double, size_x double, size_y double, size_z double, f1 double, f2 double, f3 double, points long")
    m = spark.createDataFrame(marks, "scene_id string, frame_index int, track_id string, x double, y double, z double")
    out = temporal.stationary_clusters(c, m).collect()
    assert {r["candidate_id"] for r in out if r["group"] is not None} == {"a"} and sum(r["group"] is not None for r in out) == 4
    assert all(r["group"] is None for r in out if r["candidate_id"] == "b")
    # The candidate has one name in all frames; the member of most points stands for the group.
    assert [(r["frame_index"], r["candidate_id"]) for r in out if r["group"] is not None and r["represents"]] == [(4, "a")]
    m = m.unionByName(spark.createDataFrame([("s", 9, "t1", 1.0, 2.0, 3.0)], m.schema))  # a frame of one track and no candidates
    assert temporal.dedup_statistics(temporal.stationary_clusters(c, m), m, temporal.registered_frames(m)).first().asDict() == {
        "scene_id": "s", "raw_candidates": 8, "candidates": 5, "duplicate_groups": 1, "duplicate_observations": 4, "registered_frames": 4, "unregistered_frames": 1, "saved_calls": 3}


def test_stream_equals_batch(spark, small, tmp_path):
    from lidaraudit.plans.review import asset_events

    asset_events(spark, small).withColumn("arrival_ts", F.col("arrival_ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
    q = stream.grouped(stream.arrivals(feed, "60 days")).writeStream.outputMode("complete").format("memory").queryName("groups").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("groups").collect()))
    assert got == sorted(map(tuple, stream.grouped(stream.classified(whole)).collect())) and got


def test_pixels_of_pairs_without_points_and_outside_the_picture():
    """bounds by runs of a pair's points, against a loop over pairs."""
    rng = np.random.default_rng(12)
    many = np.array([0, 108, 3, 0, 0, 20, 1, 0])
    owner, points = np.repeat(np.arange(8), many), rng.normal(0, 10, (many.sum(), 3))
    camera = {"to_camera": rng.normal(size=(8, 12)), **{k: np.full(8, v) for k, v in {"fx": 900.0, "fy": 800.0, "cx": 960.0, "cy": 540.0, "width": 1920.0, "height": 1080.0}.items()}}
    got = projection._pixels(points, owner, camera, 8, 0.1)
    for k in range(8):
        at = np.column_stack([points[owner == k], np.ones(many[k])]) @ camera["to_camera"][k].reshape(3, 4).T
        at = at[at[:, 2] > 0.1]
        u, v = 900.0 * at[:, 0] / at[:, 2] + 960.0, 800.0 * at[:, 1] / at[:, 2] + 540.0
        seen = (u >= 0) & (u < 1920) & (v >= 0) & (v < 1080)
        want = [seen.sum(), *(f(x[seen], initial=i) for x in (u, v) for f, i in ((np.min, np.inf), (np.max, -np.inf)))]
        assert np.allclose([x[k] for x in got], want)
    assert all(len(x) == 0 for x in projection._pixels(np.zeros((0, 3)), np.zeros(0, np.int64), {k: x[:0] for k, x in camera.items()}, 0, 0.1))
