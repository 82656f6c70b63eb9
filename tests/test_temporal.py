"""Registration as a graph and matching in parts of a scene, against versions that hold a whole scene."""

import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lidaraudit.operators import components, temporal

MARKS = "scene_id string, frame_index int, track_id string, x double, y double, z double"
SEEN = "scene_id string, frame_index int, candidate_id string, x double, y double, z double, size_x double, size_y double, size_z double, f1 double, f2 double, f3 double, points long"


class PlainScene:
    """Where each track is in each frame of a scene: places[frame, track], NaN where it isn't seen."""

    def __init__(self, landmarks: pd.DataFrame) -> None:
        landmarks = landmarks.sort_values(["x", "y", "z"])
        marks = landmarks[landmarks["track_id"].notna() & (landmarks["track_id"] != "") & landmarks[["x", "y", "z"]].notna().all(axis=1)]
        self.frames, f = np.unique(marks["frame_index"].to_numpy(np.int64), return_inverse=True)
        _, t = np.unique(marks["track_id"].to_numpy(str), return_inverse=True)
        self.places = np.full((len(self.frames), t.max(initial=-1) + 1, 3), np.nan)
        self.places[f, t] = marks[["x", "y", "z"]].to_numpy(float)

    def motions(self, c) -> dict:
        """Each frame's way into the first frame's coordinates, by way of the frame reached before that shares most tracks with it.

        Frames that can't be reached are tried again as long as others are.
        """
        if not len(self.frames):
            return {}
        seen = ~np.isnan(self.places[..., 0])
        shared = seen.astype(np.int64) @ seen.T
        ways, open_frames = {0: temporal.Motion()}, list(range(1, len(self.frames)))
        while True:
            left = []
            for f in open_frames:
                reached = np.array(list(ways))
                near = reached[np.argsort(-shared[f, reached], kind="stable")]
                for g in near[shared[f, near] >= c.min_tracks].tolist():
                    both = seen[f] & seen[g]
                    if (own := temporal.motion_between(self.places[f, both], self.places[g, both], c)) is not None:
                        ways[f] = own.then(ways[g])
                        break
                else:
                    left.append(f)
            if len(left) == len(open_frames):
                return {int(self.frames[f]): way for f, way in ways.items()}
            open_frames = left





def plain_match(candidates: pd.DataFrame, landmarks: pd.DataFrame, registration, m) -> pd.DataFrame:
    """candidates with registered (their frame is), and group (None: seen once or too seldom, or in a frame that can't be registered).

    A candidate without a position is kept at the origin; one without a size matches nothing.
    """
    ways = PlainScene(landmarks).motions(registration)
    rows = candidates.sort_values(["frame_index", "candidate_id"], ignore_index=True)
    frame_of = rows["frame_index"].to_numpy(np.int64)
    raw, size, shape = (rows[list(c)].to_numpy(float) for c in (("x", "y", "z"), ("size_x", "size_y", "size_z"), ("f1", "f2", "f3")))
    nowhere = np.isnan(raw).any(1)
    place, registered = np.zeros_like(raw), np.zeros(len(rows), bool)
    members: list[list[int]] = []  # rows of each track, in the order in which tracks began
    for frame in np.unique(frame_of).tolist():
        if frame not in ways:
            continue
        own = np.flatnonzero(frame_of == frame)
        registered[own] = True
        here = own[~nowhere[own]]
        place[here] = ways[frame].of(raw[here])
        last = np.array([t[-1] for t in members], np.int64)
        step = np.hypot(*np.moveaxis(place[here][:, None, :2] - place[last][None, :, :2], -1, 0))
        a, b = np.nonzero(step <= m.max_step)
        ratio, apart = temporal.size_ratios(size[here[a]], size[last[b]]), np.linalg.norm(shape[here[a]] - shape[last[b]], axis=-1)
        fits = (ratio <= m.max_size_ratio) & (apart <= m.max_pca)
        offers = []
        for x, y, r, d in zip(a[fits].tolist(), b[fits].tolist(), ratio[fits].tolist(), apart[fits].tolist(), strict=True):
            away = np.abs(place[members[y]] - place[here[x]])
            if np.hypot(away[:, 0], away[:, 1]).max() <= m.max_diameter and away[:, 2].max() <= m.max_z:
                offers.append((float(step[x, y]), r, d, x, y))
        taken: set[int] = set()
        grown: set[int] = set()
        for *_, x, y in sorted(offers):
            if x not in taken and y not in grown:
                members[y].append(int(here[x]))
                taken.add(x)
                grown.add(y)
        members += [[int(r)] for x, r in enumerate(here.tolist()) if x not in taken] + [[int(r)] for r in own[nowhere[own]].tolist()]
    group: list[int | None] = [None] * len(rows)
    for k, track in enumerate(t for t in members if len(t) >= max(2, m.min_observations)):
        for r in track:
            group[r] = k
    return rows.assign(group=pd.array(group, "Int64"), registered=registered)


def drive(seed, frames=9, things=26):
    """A car that turns and drives; marks that come and go, some of them moving; things that stand, some in one crowded place, and some that don't."""
    rng = np.random.default_rng(seed)
    marks, seen = [], []
    stands = rng.uniform(-30, 30, (18, 2))
    spots = np.concatenate([rng.uniform(-25, 25, (things, 2)), rng.normal(0, 0.25, (14, 2)) + [5, 5]])  # the last ones are a hub
    for f in range(1, frames + 1):
        c, s = np.cos(0.07 * f), np.sin(0.07 * f)
        own = lambda p, f=f, c=c, s=s: (np.atleast_2d(p) - [1.2 * f, 0.3 * f]) @ np.array([[c, -s], [s, c]])
        here = rng.permutation(18)[: 4 if f == 4 else 11]  # too few in frame 4
        for t, p in zip(here, own(stands[here] + (np.arange(18)[here, None] > 14) * f), strict=True):
            marks.append(("s", f, f"t{t:02}", float(p[0]), float(p[1]), 0.1 * t))
        for k, p in enumerate(own(spots + rng.normal(0, 0.05, spots.shape) + (np.arange(len(spots))[:, None] < 5) * f)):
            if rng.random() < 0.8:
                size = rng.uniform(0.8, 1.2, 3) * (1 + k % 3)
                seen.append(("s", f, f"c{k:02}", *(None if rng.random() < 0.02 else float(v) for v in p), 1.0, *map(float, size), *map(float, rng.uniform(0, 0.3, 3)), int(rng.integers(5, 50))))
    marks += [("s", 2, "t01", 99.0, 99.0, 0.0), ("s", 3, "", 1.0, 1.0, 1.0), ("s", 3, None, 1.0, 1.0, 1.0), ("s", 12, "t01", 1.0, 1.0, None)]
    return pd.DataFrame(marks, columns=MARKS.replace(",", "").split()[::2]), pd.DataFrame(seen, columns=SEEN.replace(",", "").split()[::2])


@pytest.mark.parametrize("seed", range(3))
def test_parts_of_a_scene_match_as_the_whole_scene(spark, seed):
    marks, seen = drive(seed)
    registration, matching = temporal.Registration(), temporal.Matching()
    m, c = (spark.createDataFrame(df.astype(object).where(df.notna(), None).values.tolist(), kind).repartition(3) for df, kind in ((marks, MARKS), (seen, SEEN)))
    ways = {r["frame_index"]: r for r in temporal.registered_frames(m, registration).collect()}
    want = PlainScene(marks).motions(registration)
    assert set(ways) == set(want) and 4 not in ways and len(ways) >= 7
    for f, way in want.items():
        assert np.allclose([ways[f]["angle"], ways[f]["shift_x"], ways[f]["shift_y"], ways[f]["shift_z"]], [way.angle, *way.shift])
    whole = plain_match(seen, marks, registration, matching)
    got = temporal.stationary_clusters(c, m, registration, matching).toPandas()
    both = whole.merge(got, on=["frame_index", "candidate_id"], suffixes=("", "_got"))
    assert len(both) == len(seen) == len(got)
    assert (both["registered"] == both["registered_got"]).all()
    assert (both["group"].fillna(-1).astype(int) == both["group_got"].fillna(-1).astype(int)).all() and both["group"].nunique() > 8
    for _, own in got[got["group"].notna()].groupby("group"):
        one = own[own["represents"]].iloc[0]
        assert one["points"] == own["points"].max() and list(one["observed_frames"]) == sorted(own["frame_index"]) and one["observations"] == len(own) == len(one["candidate_ids"])
    placed = temporal.in_parts(c.where("x is not null and y is not null"), ["x", "y"], 0.3)
    assert placed.select("part").distinct().count() > 30  # many tasks for one scene


def test_spatial_groups_in_parts(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"scene_id": "s", "frame_index": np.sort(rng.integers(1, 12, 150)), "candidate_id": [f"c{i:03}" for i in range(150)], "x": rng.integers(0, 40, 150) * 1.0, "y": rng.random(150) * 4, "z": np.where(np.arange(150) % 17, 0.0, np.nan)})
    rows.loc[:30, "x"] = rng.normal(5, 0.6, 31)  # a crowd
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), "scene_id string, frame_index int, candidate_id string, x double, y double, z double").repartition(3)
    for distance in (1.0, 0.4, 0.0):
        want = dict(zip(rows.sort_values(["frame_index", "candidate_id"])["candidate_id"], temporal.nearest_groups(rows, distance)["group"], strict=True))
        got = {r["candidate_id"]: r["group"] for r in temporal.spatial_groups(df, distance).collect()}
        assert len(got) == 150 and len(set(zip((got[k] for k in want), want.values(), strict=True))) == len(set(want.values())) == len(set(got.values()))
        if distance:
            assert got == want


def test_cells_that_touch():
    cells = np.array([[0, 0], [1, 1], [5, 5], [-1, 0], [5, 7], [6, 6], [0, 0], [10**9, -(10**9)]])
    part = components.touching_cells(cells)
    assert part[0] == part[1] == part[3] == part[6] and part[2] == part[5] == part[4] and len(set(part)) == 3
    assert components.touching_cells(np.zeros((0, 3), np.int64)).tolist() == []


def peak_mb(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_a_motion_of_many_tracks_is_found_in_bounded_memory(monkeypatch):
    """all pairs of tracks, and all distances of all hypotheses, were held at once."""
    rng = np.random.default_rng(5)
    p = np.column_stack([rng.uniform(0, 500, (3000, 2)), np.zeros(3000)])
    way = temporal.Motion(0.3, (1.0, -2.0, 0.5))
    found = []
    assert peak_mb(lambda: found.append(temporal.motion_between(p, way.of(p), temporal.Registration()))) < 200
    assert np.allclose([found[0].angle, *found[0].shift], [0.3, 1.0, -2.0, 0.5])
    for n, side in ((2, 5.0), (40, 2.0), (70, 6.0)):  # the same hypotheses, whether listed or counted
        a, b = rng.uniform(0, side, (2, n, 3))
        for most in (7, 10**6):
            listed = temporal.hypotheses(a, b, most)
            with monkeypatch.context() as m:
                m.setattr(temporal, "LISTED", 0)
                assert all((x == y).all() for x, y in zip(listed, temporal.hypotheses(a, b, most), strict=True))


def test_frames_that_cannot_agree_are_told_without_a_fit():
    """every two frames that shared tracks were fitted."""
    rng, c, refused = np.random.default_rng(6), temporal.Registration(), 0
    for _ in range(200):
        n = int(rng.integers(2, 50))
        p, q = rng.uniform(0, 40, (2, n, 3))
        some = rng.permutation(n)[: rng.integers(0, n + 1)]
        q[some] = temporal.Motion(1.0, (3.0, 1.0, 0.0)).of(p[some]) + rng.normal(0, 0.2, (len(some), 3))
        may = temporal.may_agree(p, q, c)
        refused += not may
        assert may or temporal.motion_between(p, q, c) is None
    assert refused > 60


def test_anchors_ask_for_the_motions_on_their_way():
    """unknown pairs are taken for granted, the rest of 40 frames' 780 pairs is never looked for."""
    rng = np.random.default_rng(7)
    shared = rng.integers(6, 60, (40, 40))
    shared, has = np.maximum(shared, shared.T), rng.random((40, 40)) < 0.6
    plain = {f: {g: (int(shared[f, g]), int(has[f, g])) for g in range(40) if g != f} for f in range(40)}
    want, nothing = temporal.anchors([*range(40)], plain, 1)
    assert not nothing and len(want) == 39
    options, asked = {f: {g: (n, -1) for g, (n, _) in own.items()} for f, own in plain.items()}, 0
    for turn in range(12):
        got, wanted = temporal.anchors([*range(40)], options, 2**turn)
        if not wanted:
            break
        asked += len(wanted)
        for f, g in wanted:
            options[f][g] = plain[f][g]
    assert got == want and turn < 8 and asked < 200


def test_candidates_in_a_crowd_match_in_bounded_memory():
    """each frame's candidates met all tracks of a scene at once."""
    rng = np.random.default_rng(8)
    n = 2_000
    spots = rng.uniform(0, 400, (n, 2))
    rows = pd.concat([pd.DataFrame({"frame_index": f, "px": spots[:, 0], "py": spots[:, 1], "pz": 0.0, **{f"size_{a}": 1.0 for a in "xyz"}, **{f"f{k}": 0.1 for k in (1, 2, 3)}}) for f in range(4)], ignore_index=True)
    found = []
    assert peak_mb(lambda: found.append(temporal.match_rows(rows, temporal.Matching(max_step=1e-6)))) < 50
    assert (found[0].reshape(4, n) == np.arange(n)).all()


def test_a_crowd_is_grouped_frame_by_frame():
    """each observation looked at every group of its part: 40,000 of them took minutes."""
    rng = np.random.default_rng(11)
    n, spots = 40_000, 2_000
    spot = np.tile(np.arange(spots), n // spots)
    rows = pd.DataFrame({"frame_index": np.repeat(np.arange(n // spots), spots), "candidate_id": [f"{i:06}" for i in range(n)], "x": spot * 3.0 + rng.normal(0, 0.1, n), "y": rng.normal(0, 0.1, n), "z": 0.0})
    began = time.process_time()
    assert (temporal.nearest_groups(rows, 1.0)["group"].to_numpy() == spot).all()
    assert time.process_time() - began < 2


def plain_groups(rows: pd.DataFrame, distance: float) -> list[int]:
    """Each observation of a frame looks at the means of all groups that have none of that frame, and takes the nearest, the first one on ties."""
    groups: list[list[np.ndarray]] = []
    frames: list[float] = []
    out = []
    for frame, own in rows.groupby("frame_index", sort=True):
        means = [np.sum(g, 0) / len(g) for g in groups]
        for p in own.sort_values("candidate_id")[["x", "y", "z"]].to_numpy(float):
            far = [np.linalg.norm([p - m], axis=1)[0] if f != frame else np.inf for m, f in zip(means, frames, strict=False)]
            best = int(np.argmin(far)) if len(far) else -1
            if best >= 0 and far[best] <= distance:
                groups[best].append(p)
                frames[best] = frame
            else:
                best = len(groups)
                groups.append([p])
                frames.append(frame)
            out.append(best)
    return out


def crowd(seed: int) -> pd.DataFrame:
    """Copies in the same place, places that are equally far from one another, and a scatter; 12 frames."""
    rng = np.random.default_rng(seed)
    n = 400
    places = np.where(rng.random((n, 1)) < 0.7, rng.integers(0, 4, (n, 3)) * 0.5, rng.uniform(0, 4, (n, 3)))
    return pd.DataFrame({"frame_index": rng.integers(1, 13, n), "candidate_id": [f"{i:04}" for i in range(n)], "x": places[:, 0], "y": places[:, 1], "z": places[:, 2]})


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_a_crowd_are_those_of_the_plain_version(seed, monkeypatch):
    rows = crowd(seed)
    for distance in (0.5, 1.0):
        want = plain_groups(rows, distance)
        assert temporal.nearest_groups(rows, distance)["group"].tolist() == want and len(set(want)) > 40
        with monkeypatch.context() as m:  # in lots, with cells sorted again and again
            m.setattr(components.Cells, "MOST", 100)
            m.setattr(temporal.OpenGroups, "LOOSE", 3)
            assert temporal.nearest_groups(rows, distance)["group"].tolist() == want


def batches(rows: pd.DataFrame, size: int):
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_pandas(rows.iloc[at : at + size], preserve_index=False)


def test_frames_in_several_batches():
    """groups are found batch by batch; scenes and bundles begin anew."""
    rows = crowd(5).sort_values(["frame_index", "candidate_id"], ignore_index=True)
    want = plain_groups(rows, 1.0)
    whole = pd.concat([rows.assign(scene_id=s, bundle=b, part=b) for s, b in (("0", 1), ("0", 2), ("1", 2))], ignore_index=True)
    for size in (1, 7, 5_000):
        got = pd.concat([b.to_pandas() for b in temporal._grouped(1.0)(batches(whole, size))], ignore_index=True)
        assert got["group"].tolist() == want * 3 and got["candidate_id"].tolist() == whole["candidate_id"].tolist()
        assert got[got["begins"]].groupby(["scene_id", "part"])["group"].apply(list).tolist() == [[*range(max(want) + 1)]] * 3


def test_a_scene_that_touches_is_not_held_whole():
    """a task held all rows of a scene whose candidates touch; 300,000 of them are more than 60 MB."""
    frames, n = 300, 1_000

    def scene():
        rng = np.random.default_rng(12)
        for f in range(frames):
            yield pa.record_batch({
                "scene_id": ["0"] * n, "frame_index": np.full(n, f, np.int32), "candidate_id": [f"{f}/{k:04}" for k in range(n)], "part": np.zeros(n, np.int64), "bundle": np.zeros(n, np.int64),
                "x": np.arange(n) * 1.5 + rng.normal(0, 0.05, n), "y": rng.normal(0, 0.05, n), "z": np.zeros(n)})

    def walk():
        for k, b in enumerate(temporal._grouped(1.0)(scene())):
            assert (b.column("group").to_numpy() == np.arange(n)).all() and b.column("begins").to_pylist() == [k == 0] * n

    assert peak_mb(walk) < 10


def test_copies_in_one_place_are_not_met_pair_by_pair():
    """F1: each of a place's copies looked at all groups near it: 400 copies in seven places took 3.4 s a frame."""
    copies, frames = 400, 10
    z = np.tile(np.repeat(np.arange(7) * 0.1, copies), frames)
    rows = pd.DataFrame({"frame_index": np.repeat(np.arange(frames), 7 * copies), "candidate_id": [f"{i:06}" for i in range(len(z))], "x": 0.0, "y": 0.0, "z": z})
    began = time.process_time()
    assert (temporal.nearest_groups(rows, 1.0)["group"].to_numpy() == np.tile(np.arange(7 * copies), frames)).all()
    assert time.process_time() - began < 5
