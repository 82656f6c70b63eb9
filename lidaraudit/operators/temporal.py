"""The same thing seen in several frames: ego motion from tracked boxes, stationary clusters, spatial groups.

Frames are told apart by blocks of a scene, two in a group, by what tracks they share; a scene's own task walks the
graph of its frames, and motions are looked for where it goes. Later frames depend on the matches of earlier ones, but only among candidates that can ever
meet: these parts of a scene are groups of a grouped map. Within a group the work is done on arrays: all
hypotheses of a fit at once, all candidates of a frame against all that have been seen.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidaraudit.functions.storage import stored
from lidaraudit.operators.components import Cells, cell_codes, cells_of, neighbours, touching_cells


@dataclass(frozen=True)
class Registration:
    min_tracks: int = 6
    min_inliers: int = 4
    min_ratio: float = 0.5
    max_residual: float = 0.5
    max_hypotheses: int = 5000


@dataclass(frozen=True)
class Matching:
    max_step: float = 0.30
    max_diameter: float = 0.50
    max_z: float = 0.50
    max_size_ratio: float = 3.0
    max_pca: float = 0.50
    min_observations: int = 3


#: What ranks the members of a group, as far as the candidates have it; then the earlier frame wins.
RANKS = ("good_views", "good_points", "largest", "points", "confidence")


def turned(angle: float, p: np.ndarray) -> np.ndarray:
    """Points (x, y, ...) turned about z."""
    c, s = np.cos(angle), np.sin(angle)
    return np.stack([c * p[..., 0] - s * p[..., 1], s * p[..., 0] + c * p[..., 1]], -1)


def rigid_xy(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """Angle and shift in plan that take points a nearest to b: the angle follows from summed cross and dot products."""
    ca, cb = a[:, :2].mean(0), b[:, :2].mean(0)
    p, q = a[:, :2] - ca, b[:, :2] - cb
    angle = float(np.arctan2((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum(), (p * q).sum()))
    return angle, cb - turned(angle, ca)


def rigid_fits(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The same fit as one aggregation: angle and shift for each group of pairs (ax, ay) to (bx, by)."""
    n = F.count("ax")
    s = {c: F.sum(c) for c in ("ax", "ay", "bx", "by")}
    cross = F.sum(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx")) - (s["ax"] * s["by"] - s["ay"] * s["bx"]) / n
    dot = F.sum(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")) - (s["ax"] * s["bx"] + s["ay"] * s["by"]) / n
    fits = pairs.groupBy(*by).agg(n.alias("pairs"), F.atan2(cross, dot).alias("angle"), *[F.avg(c).alias(c) for c in s])
    c, d = F.cos("angle"), F.sin("angle")
    return fits.select(*by, "pairs", "angle", (F.col("bx") - c * F.col("ax") + d * F.col("ay")).alias("shift_x"), (F.col("by") - d * F.col("ax") - c * F.col("ay")).alias("shift_y"))


@dataclass(frozen=True)
class Motion:
    """A turn about z, then a shift."""

    angle: float = 0.0
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.concatenate([turned(self.angle, p), p[..., 2:]], -1) + np.array(self.shift)

    def then(self, other: Motion) -> Motion:
        return Motion(self.angle + other.angle, tuple(other.of(np.array(self.shift)).tolist()))


#: Tracks up to which all pairs of them are listed, and numbers that one step of a fit holds at once.
LISTED, HELD = 1_000, 2_000_000


def hypotheses(p: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of tracks at least 1 m apart in both frames, in order, thinned evenly to at most `most`.

    Of many tracks only the pairs that are too near are looked up, by cells, and counted: the k-th of the others follows from
    the counts, and pairs are listed for the tracks i that are chosen.
    """
    n = len(p)
    if n <= LISTED or not (np.isfinite(p).all() and np.isfinite(q).all()):
        i, j = np.triu_indices(n, 1)
        pick = np.flatnonzero((np.hypot(*(p[j, :2] - p[i, :2]).T) >= 1.0) & (np.hypot(*(q[j, :2] - q[i, :2]).T) >= 1.0))
        if len(pick) > most:
            pick = pick[(np.arange(most) * (len(pick) / most)).astype(np.int64)]
        return i[pick], j[pick]

    def too_near(rows: np.ndarray):
        """Pairs rows[a] < j too near in p, and those too near in q only."""
        for own, other in ((p, None), (q, p)):
            for a, j in Cells(own[:, :2], 1.0).pairs(own[rows, :2]):
                i = rows[a]
                near = (i < j) & (np.hypot(*(own[j, :2] - own[i, :2]).T) < 1.0)
                i, j = i[near], j[near]
                if other is not None:
                    far = np.hypot(*(other[j, :2] - other[i, :2]).T) >= 1.0
                    i, j = i[far], j[far]
                yield i, j

    usable = np.arange(n - 1, -1, -1)
    for i, _ in too_near(np.arange(n)):
        usable -= np.bincount(i, minlength=n)
    ends = np.cumsum(usable)
    total = int(ends[-1])
    rank = np.arange(total) if total <= most else (np.arange(most) * (total / most)).astype(np.int64)
    i = np.searchsorted(ends, rank, "right")
    rank = rank - (ends - usable)[i]
    skipped = [x * n + y for x, y in too_near(np.unique(i))]
    skipped = np.sort(np.concatenate([*skipped, np.zeros(0, np.int64)]))
    row, j = skipped // n, skipped % n
    first = np.searchsorted(row, np.arange(n))  # of each track's own list
    before = j - row - 1 - (np.arange(len(row)) - first[row])  # pairs of the row that are usable and come before it
    return i, i + 1 + rank + np.searchsorted(row * n + before, i * n + rank, "right") - first[i]


def least_inliers(n: int, c: Registration) -> int:
    """How many of n tracks have to agree with a motion."""
    least = max(int(np.floor(c.min_ratio * n)) - 1, 0)
    while least / n < c.min_ratio:
        least += 1
    return max(least, c.min_inliers, 1)


def may_agree(p: np.ndarray, q: np.ndarray, c: Registration) -> bool:
    """Whether motion_between() may find a motion; False is exact.

    Tracks that agree with one motion are all as far apart in both frames, but for twice the residual. Of n tracks any
    n - least + 1 hold one that agrees, if there are any, and it has that distance to at least as many others. With very many tracks, and
    where it is so, the answer is True.
    """
    n = len(p)
    least = least_inliers(n, c)
    if n < max(2, c.min_tracks) or least > n:
        return False
    rows = n - least + 1
    if rows > 4 * LISTED or not (np.isfinite(p).all() and np.isfinite(q).all()):
        return True
    if np.hypot(*np.ptp(p[:, :2], 0)) < 1.0 or np.hypot(*np.ptp(q[:, :2], 0)) < 1.0:  # no line of 1 m
        return False
    slack = 2 * c.max_residual + 1e-9 * (1 + np.abs(p[:, :2]).max() + np.abs(q[:, :2]).max())
    at, step = 0, 16 if n > 64 else rows
    while at < rows:
        to = min(rows, at + step)
        far = lambda x, at=at, to=to: np.sqrt(np.square(x[at:to, None, 0] - x[None, :, 0]) + np.square(x[at:to, None, 1] - x[None, :, 1]))
        if ((np.abs(far(p) - far(q)) <= slack).sum(1) >= least).any():
            return True
        at, step = to, max(1, HELD // n)
    return False


def motion_between(p: np.ndarray, q: np.ndarray, c: Registration) -> Motion | None:
    """The motion from places p to places q (rows x, y, z of the same tracks) that most tracks agree with, or None.

    Two tracks at least 1 m apart in both frames make a hypothesis: the turn between their connecting lines,
    with the first of the two kept in place. If there are too many they are thinned evenly. All
    are scored, some at a time, by their inliers, the best then by the median distance of these; the first best one is
    fitted to its inliers and once more to the inliers of that.
    """
    n = len(p)
    if n < max(2, c.min_tracks):
        return None
    i, j = hypotheses(p, q, c.max_hypotheses)
    if not len(i):
        return None
    angle = np.arctan2(*(q[j, :2] - q[i, :2]).T[::-1]) - np.arctan2(*(p[j, :2] - p[i, :2]).T[::-1])

    def off(k: np.ndarray) -> np.ndarray:
        """Distance of each track from where hypotheses k take it."""
        cos, sin = np.cos(angle[k])[:, None], np.sin(angle[k])[:, None]
        from_x, from_y = p[None, :, 0] - p[i[k], None, 0], p[None, :, 1] - p[i[k], None, 1]
        to_x, to_y = q[None, :, 0] - q[i[k], None, 0], q[None, :, 1] - q[i[k], None, 1]
        return np.hypot(cos * from_x - sin * from_y - to_x, sin * from_x + cos * from_y - to_y)

    step = max(1, HELD // n)
    some = lambda k: (k[at : at + step] for at in range(0, len(k), step))
    many = np.concatenate([(off(k) <= c.max_residual).sum(1) for k in some(np.arange(len(i)))])
    if many.max() < least_inliers(n, c):
        return None
    best = np.flatnonzero(many == many.max())
    # The first point of a hypothesis is always inside.
    median = np.concatenate([np.nanmedian(np.where((d := off(k)) <= c.max_residual, d, np.nan), 1) for k in some(best)]) if len(best) > 1 else np.zeros(1)
    chosen = off(best[[int(np.argmin(median))]])[0] <= c.max_residual
    for again in (True, False):
        if chosen.sum() < c.min_inliers or chosen.mean() < c.min_ratio:
            return None
        angle_of, shift = rigid_xy(p[chosen], q[chosen])
        if again:
            chosen = np.hypot(*(turned(angle_of, p) + shift - q[:, :2]).T) <= c.max_residual
    return Motion(angle_of, (float(shift[0]), float(shift[1]), float(np.median(q[chosen, 2] - p[chosen, 2]))))


def places(landmarks: DataFrame) -> DataFrame:
    """One row per scene, frame and track, where it is: of several the greatest (x, y, z)."""
    whole = landmarks.where("track_id is not null and track_id <> '' and x is not null and y is not null and z is not null")
    return whole.groupBy("scene_id", "frame_index", "track_id").agg(F.max(F.struct("x", "y", "z")).alias("p")).select("scene_id", "frame_index", "track_id", "p.*")


#: Rows of a block of frames, as long as a scene has more than LEAST_BLOCKS of them; smaller scenes have that many blocks, but for small ones.
BLOCK_ROWS, LEAST_BLOCKS, SMALL_BLOCK = 1_000_000, 8, 20_000


def numbered_places(landmarks: DataFrame, c: Registration) -> tuple[DataFrame, DataFrame]:
    """Frames (scene_id, scene_no, frame_index, block, blocks) and places in them (scene_no, frame_index, no, x, y, z), written; tracks are numbered in order of their names.

    block is null for a frame with too few tracks to share enough with any other; its places are left out.
    """
    placed = stored(places(landmarks), "places")
    counts = placed.groupBy("scene_id", "frame_index").count().withColumn("rich", F.when(F.col("count") >= max(2, c.min_tracks), F.col("count")))
    scene = Window.partitionBy("scene_id")
    total, before = F.sum("rich").over(scene), F.sum("rich").over(scene.orderBy("frame_index")) - F.col("rich")
    blocks = F.greatest(F.ceil(total / BLOCK_ROWS), F.least(F.lit(LEAST_BLOCKS), F.ceil(total / SMALL_BLOCK))).cast("int")
    scenes = counts.select("scene_id").distinct().orderBy("scene_id").withColumn("scene_no", F.monotonically_increasing_id())
    frames = counts.select("scene_id", "frame_index", F.floor(before * blocks / total).cast("int").alias("block"), F.when(F.col("rich").isNotNull(), blocks).alias("blocks")).join(stored(scenes, "scenes"), "scene_id")
    frames = stored(frames, "frames")
    tracks = stored(placed.select("track_id").distinct().orderBy("track_id").withColumn("no", F.monotonically_increasing_id()), "tracks")
    rich = placed.join(frames.where("block is not null"), ["scene_id", "frame_index"]).join(tracks, "track_id")
    return frames, stored(rich.select("scene_no", "frame_index", "block", "blocks", "no", "x", "y", "z"), "landmarks")


PAIR = "scene_no long, frame_index int, anchor int, shared int"


def frame_pairs(placed: DataFrame, c: Registration = Registration()) -> DataFrame:  # noqa: B008
    """PAIR rows: each two frames, frame_index < anchor, that share min_tracks tracks and may have a motion.

    Blocks of frames meet block by block: a group holds two of them, never the pairs of rows of their tracks.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("other", other).select("scene_no", "frame_index", "no", "x", "y", "z", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        scene, low, high = key
        block, frame, no = (rows[n].to_numpy() for n in ("block", "frame_index", "no"))
        order = np.lexsort((no, frame))
        block, frame, xyz = block[order], frame[order], rows[["x", "y", "z"]].to_numpy(float)[order]
        _, track = np.unique(no[order], return_inverse=True)
        frames, first = np.unique(frame, return_index=True)
        ends = np.append(first, len(frame))
        place, found = np.full(track.max(initial=-1) + 1, -1), []
        for k, f in enumerate(frames.tolist()):
            if block[first[k]] != low:
                continue
            own = slice(ends[k], ends[k + 1])
            place[track[own]] = np.arange(own.start, own.stop)
            # Frames of one block are in order; those of two are too, as blocks are.
            start = ends[k + 1] if low == high else int(np.searchsorted(block, high))
            there = np.flatnonzero(place[track[start:]] >= 0) + start
            here = place[track[there]]
            cuts = np.searchsorted(there, ends[k + 1 :])
            for g, a, b in zip(frames[k + 1 :].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a >= max(2, c.min_tracks) and may_agree(xyz[here[a:b]], xyz[there[a:b]], c):
                    found.append((scene, f, g, b - a))
            place[track[own]] = -1
        return pd.DataFrame(found, columns=[x.split()[0] for x in PAIR.split(", ")])

    return dealt.groupBy("scene_no", "low", "high").applyInPandas(work, PAIR)


def anchors(frames: list[int], options: dict[int, dict[int, tuple[int, int]]], width: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Each frame's anchor, the frame reached before that shares most tracks with it and has a motion to it; in the order in which frames are reached.

    Frames that can't be reached are tried again as long as others are. options: of each frame, of each other one, the number of
    shared tracks and 1: has a motion, 0: has none, -1: not known. What isn't known counts as a motion; such pairs come second, with up to width
    of those that a frame would turn to next. Without any the first is final.
    """
    reached, anchor, open_ = {f: 0 for f in frames[:1]}, {}, frames[1:]
    wanted: list[tuple[int, int]] = []
    while open_:
        left = []
        for f in open_:
            own = sorted((-shared, reached[g], g, known) for g, (shared, known) in options.get(f, {}).items() if known and g in reached)
            if not own:
                left.append(f)
                continue
            anchor[f] = own[0][2]
            reached[f] = len(reached)
            needed = [*itertools.takewhile(lambda x: x[3] < 0, own)]
            wanted += [(f, x[2]) for x in needed[:width]]
        if len(left) == len(open_):
            break
        open_ = left
    return anchor, wanted


MOTION = "angle double, shift_x double, shift_y double, shift_z double"
WAY = f"scene_id string, frame_index int, {MOTION}"


def motions(wanted: DataFrame, placed: DataFrame, c: Registration) -> DataFrame:
    """The motion from frame to anchor for each of wanted (scene_no, frame_index, anchor); null where there is none."""
    anchor = placed.select("scene_no", "no", F.col("frame_index").alias("anchor"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    both = placed.drop("block", "blocks").join(wanted, ["scene_no", "frame_index"]).join(anchor, ["scene_no", "anchor", "no"])

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        way = motion_between(rows[list("xyz")].to_numpy(float), rows[["qx", "qy", "qz"]].to_numpy(float), c)
        return pd.DataFrame([(*key, *((None,) * 4 if way is None else (way.angle, *way.shift)))], columns=["scene_no", "frame_index", "anchor", *MOTION.split()[::2]])

    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work: as many tasks as there are partitions
    return both.repartition(n, "scene_no", "frame_index", "anchor").groupBy("scene_no", "frame_index", "anchor").applyInPandas(work, f"scene_no long, frame_index int, anchor int, {MOTION}")


TESTED = ["scene_no", "frame_index", "anchor", *MOTION.split()[::2]]


def walk(width: int):
    """The work of a scene: pairs still to be looked for, or each frame's way."""

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        alone = own["anchor"].isna()
        options: dict[int, dict[int, tuple[int, int]]] = {}
        found: dict[tuple[int, int], Motion] = {}
        for f, g, shared, tested, angle, *shift in own.loc[~alone, ["frame_index", "anchor", "shared", "tested", *MOTION.split()[::2]]].itertuples(index=False):
            f, g, has = int(f), int(g), angle == angle and angle is not None
            options.setdefault(f, {})[g] = int(shared), -1 if not tested else int(has)
            if has:
                found[f, g] = Motion(float(angle), tuple(map(float, shift)))
        listed = sorted(own["frame_index"][alone].tolist())
        anchor, wanted = anchors(listed, options, width)
        if wanted:
            return pd.DataFrame([(key[0], f, g, None, None, None, None) for f, g in wanted], columns=TESTED)
        ways = {listed[0]: Motion()}
        for f, g in anchor.items():
            ways[f] = found[f, g].then(ways[g])
        return pd.DataFrame([(key[0], f, None, w.angle, *w.shift) for f, w in ways.items()], columns=TESTED)

    return work


def registered_frames(landmarks: DataFrame, registration: Registration = Registration()) -> DataFrame:  # noqa: B008
    """WAY rows: each frame that can be brought into its scene's first frame with landmarks.

    A scene's own task walks the graph of its frames; it takes a motion for granted until it has been looked for. Those
    on its way are then looked for, a group for each, and it walks again: each time with twice as many of a
    frame's next choices, so that there are few rounds.
    """
    frames, placed = numbered_places(landmarks, registration)
    pairs = stored(frame_pairs(placed, registration), "pairs")
    both = pairs.unionByName(pairs.select("scene_no", F.col("anchor").alias("frame_index"), F.col("frame_index").alias("anchor"), "shared"))
    known = None
    names = TESTED
    for turn in itertools.count():
        nothing = [F.lit(None).cast("int").alias(x) for x in ("anchor", "shared")] + [F.lit(False).alias("tested")] + [F.lit(None).cast("double").alias(x) for x in names[3:]]
        if known is None:
            told = both.select("*", *nothing[2:])
        else:
            told = both.join(known.withColumn("tested", F.lit(True)), names[:3], "left").withColumn("tested", F.coalesce("tested", F.lit(False)))
        rows = told.unionByName(frames.select("scene_no", "frame_index", *nothing))
        walked = stored(rows.groupBy("scene_no").applyInPandas(walk(2**turn), f"scene_no long, frame_index int, anchor int, {MOTION}"), "walked")
        wanted = walked.where("anchor is not null").select(*names[:3])
        if wanted.isEmpty():
            return walked.join(frames.select("scene_no", "frame_index", "scene_id"), ["scene_no", "frame_index"]).select(*[x.split()[0] for x in WAY.split(", ")])
        tested = stored(motions(wanted, placed, registration), "motions")
        known = tested if known is None else known.unionByName(tested)
    raise AssertionError


def in_parts(rows: DataFrame, columns: list[str], side: float) -> DataFrame:
    """rows with part: rows of a scene that could ever meet, being no farther than side apart one after the other, share it.

    Cells of that side which touch make a part. A scene's own task holds its cells, not its rows.
    """
    cells = [F.floor(F.col(c) / side).alias(f"cell_{k}") for k, c in enumerate(columns)]
    names = [f"cell_{k}" for k in range(len(columns))]

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return own.assign(part=touching_cells(own[names].to_numpy(np.int64)))[["scene_id", *names, "part"]]

    kinds = f"scene_id string, {', '.join(f'{n} long' for n in names)}, part long"
    parts = rows.select("scene_id", *cells).distinct().groupBy("scene_id").applyInPandas(work, kinds)
    return rows.select("*", *cells).join(parts, ["scene_id", *names]).drop(*names)


def size_ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest quotient of the sorted sides of boxes, either way round; NaN sides make it NaN."""
    x, y = np.maximum(np.sort(a, -1), 1e-6), np.maximum(np.sort(b, -1), 1e-6)
    return np.maximum(x / y, y / x).max(-1)


def bundled(parts: DataFrame) -> DataFrame:
    """parts with bundle: several parts of a scene that one task works on, as they don't disturb each other; as many for a scene as there are shuffle partitions."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.withColumn("bundle", F.pmod(F.xxhash64("part"), F.lit(n)))


def match_rows(rows: pd.DataFrame, m: Matching) -> np.ndarray:
    """The track of each row (px, py, pz: its place in the scene; in order of frame and candidate), numbered as tracks begin.

    Candidates meet the last members of tracks by cells of a step's side, so that memory follows those that are near.
    """
    frame_of = rows["frame_index"].to_numpy(np.int64)
    place, size, shape = (rows[list(c)].to_numpy(float) for c in (("px", "py", "pz"), ("size_x", "size_y", "size_z"), ("f1", "f2", "f3")))
    n = len(rows)
    cells = Cells(place[:, :2], max(m.max_step, 1e-9) * (1 + 1e-9))
    track, before, last = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)  # of each row: its track, the member before it, whether there is none after it
    low, high, tracks = place.copy(), place.copy(), 0  # of each last member: the bounds of its track
    cuts = [*np.flatnonzero(np.diff(frame_of, prepend=frame_of[:1] - 1)).tolist(), n]
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        offers = []
        for a, y in cells.pairs(place[start:stop, :2]):
            a, y = a[last[y]] + start, y[last[y]]
            step = np.hypot(*(place[a, :2] - place[y, :2]).T)
            near = step <= m.max_step
            a, y, step = a[near], y[near], step[near]
            # What the bounds of a track already tell, then its members.
            reach = np.maximum(np.abs(low[y] - place[a]), np.abs(high[y] - place[a]))
            fits = (reach[:, 2] <= m.max_z) & (reach[:, :2].max(1, initial=0) <= m.max_diameter)
            a, y, step, reach = a[fits], y[fits], step[fits], reach[fits]
            ratio, apart = size_ratios(size[a], size[y]), np.linalg.norm(shape[a] - shape[y], axis=-1)
            fits = (ratio <= m.max_size_ratio) & (apart <= m.max_pca)
            a, y, step, reach, ratio, apart = a[fits], y[fits], step[fits], reach[fits], ratio[fits], apart[fits]
            open_ = np.flatnonzero(np.hypot(reach[:, 0], reach[:, 1]) > m.max_diameter * (1 - 1e-9))
            fits, member = np.ones(len(a), bool), y[open_]
            while len(open_):
                far = np.hypot(*(place[member, :2] - place[a[open_], :2]).T) > m.max_diameter
                fits[open_[far]] = False
                open_, member = open_[~far], before[member[~far]]
                open_, member = open_[member >= 0], member[member >= 0]
            offers.append([c[fits] for c in (step, ratio, apart, a, track[y], y)])
        step, ratio, apart, a, number, y = (np.concatenate(c) for c in zip(*offers, strict=True)) if offers else [np.zeros(0, np.int64)] * 6
        order = np.lexsort((number, a, apart, ratio, step))
        joins: dict[int, int] = {}
        grown: set[int] = set()
        for x, t in zip(a[order].tolist(), y[order].tolist(), strict=True):
            if x not in joins and t not in grown:
                joins[x] = t
                grown.add(t)
        x, t = np.array([*joins], np.int64), np.array([*joins.values()], np.int64)
        last[start:stop], last[t] = True, False
        track[x], before[x], low[x], high[x] = track[t], t, np.minimum(low[t], place[x]), np.maximum(high[t], place[x])
        new = np.flatnonzero(track[start:stop] < 0) + start
        track[new] = tracks + np.arange(len(new))
        tracks += len(new)
    return track


def stationary_clusters(candidates: DataFrame, landmarks: DataFrame, registration: Registration = Registration(), matching: Matching = Matching(), ways: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """One row per candidate (scene_id, frame_index, candidate_id, RANKS) with its group, whether its frame is registered, and whether it represents its group.

    candidates: scene_id, frame_index, candidate_id (may recur in other frames), x, y, z, size_x, size_y, size_z, f1, f2, f3 (shape
    features) and any of RANKS. landmarks: scene_id, frame_index, track_id, x, y, z. One member represents a group:
    that of the greatest RANKS, the earlier one on ties; it has the group's observed_frames and candidate_ids, in order.
    Candidates without a group represent themselves. A candidate without a position, or in a frame that can't be
    registered, matches nothing, nor does one without a size.

    ways: registered_frames(landmarks), if it has been found before. Candidates match within parts of a scene that no step of a track can leave; a task works on some of them.
    """
    ranks = [c for c in RANKS if c in candidates.columns]
    kept = ["scene_id", "frame_index", "candidate_id", *ranks]
    kinds = dict(candidates.dtypes)
    ways = registered_frames(landmarks, registration) if ways is None else ways
    c, s = F.cos("angle"), F.sin("angle")
    placed = candidates.join(ways, ["scene_id", "frame_index"], "left").withColumns({
        "registered": F.col("angle").isNotNull(), "px": c * F.col("x") - s * F.col("y") + F.col("shift_x"), "py": s * F.col("x") + c * F.col("y") + F.col("shift_y"), "pz": F.col("z") + F.col("shift_z")})
    somewhere = F.col("px").isNotNull() & F.col("py").isNotNull() & F.col("pz").isNotNull()
    own = [*kept, "size_x", "size_y", "size_z", "f1", "f2", "f3", "px", "py", "pz"]
    placed = stored(placed.select(*own, "registered"), "placed")  # read three times; the registration is worked out once
    parts = in_parts(placed.where(somewhere).select(*own), ["px", "py"], max(matching.max_step, 1e-9))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_index", "candidate_id"], ignore_index=True)
        return rows.assign(track=match_rows(rows, matching))[[*kept, "part", "track"]]

    tracks = bundled(parts).groupBy("scene_id", "bundle").applyInPandas(work, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", part long, track long")
    order = F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ranks], (-F.col("frame_index")).alias("earlier"))
    seen = F.array_sort(F.collect_list(F.struct("frame_index", "candidate_id")))
    groups = tracks.groupBy("scene_id", "part", "track").agg(F.max_by(F.struct("frame_index", "candidate_id"), order).alias("best"), seen.alias("seen"))
    groups = groups.where(F.size("seen") >= max(2, matching.min_observations))
    groups = groups.withColumn("group", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.col("seen")[0])).cast("long") - 1)
    matched = groups.select("scene_id", "group", "best", "seen", F.explode("seen").alias("one")).select("scene_id", F.col("one.frame_index").alias("frame_index"), F.col("one.candidate_id").alias("candidate_id"), "group", "best", "seen")
    found = placed.select(*kept, "registered").join(matched, ["scene_id", "frame_index", "candidate_id"], "left")
    represents = F.col("group").isNull() | (F.struct("frame_index", "candidate_id") == F.col("best"))
    told = represents & F.col("group").isNotNull()
    return found.select(
        *kept, "group", "registered", F.when(F.col("group").isNotNull(), F.size("seen")).cast("long").alias("observations"), represents.alias("represents"),
        F.when(told, F.transform("seen", lambda x: x["frame_index"])).alias("observed_frames"), F.when(told, F.transform("seen", lambda x: x["candidate_id"])).alias("candidate_ids"))


def dedup_statistics(matched: DataFrame, landmarks: DataFrame, registered: DataFrame) -> DataFrame:
    """One row per scene with candidates: how many before and after, groups, their observations, saved calls, frames that could be registered and that couldn't.

    matched: stationary_clusters(); landmarks: those it was given; registered: registered_frames(). Frames are those of
    candidates and of landmarks.
    """
    one = ["scene_id", "frame_index"]
    frames = matched.select(*one).unionByName(landmarks.select(*one)).distinct().join(registered.select(*one, F.lit(True).alias("way")), one, "left")
    counted = frames.groupBy("scene_id").agg(F.count("way").alias("registered_frames"), F.count_if(F.col("way").isNull()).alias("unregistered_frames"))
    return matched.groupBy("scene_id").agg(
        F.count("candidate_id").alias("raw_candidates"), F.count_if("represents").alias("candidates"),
        F.count_if(F.col("represents") & F.col("group").isNotNull()).alias("duplicate_groups"), F.count("group").alias("duplicate_observations"),
    ).join(counted, "scene_id").withColumn("saved_calls", F.col("duplicate_observations") - F.col("duplicate_groups"))


def distinct(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of one of each kind of equal rows, and the kind of each row."""
    order = np.lexsort(points.T)
    new = np.concatenate([np.ones(len(points[:1]), bool), (points[order[1:]] != points[order[:-1]]).any(1)])
    kind = np.empty(len(points), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


class OpenGroups:
    """Greedy groups of observations that come in order of frame: each joins the nearest running mean within distance, one of a frame per group.

    What is held is one row for each group, not its members. A group takes nothing more of a frame once it has one of it, so the
    means of all that are open stand still within a frame, and a frame may come in several lots. Means are found by cells:
    sorted ones, and loose ones of groups that are new or have left their cell since. Observations in one place see the
    same groups in the same order, and groups with one mean are one for them, so places meet means once, not copy by copy.
    """

    #: Groups that are loose before all are sorted again: so many, and a share of all.
    LOOSE, SHARE = 1_000, 8

    def __init__(self, distance: float) -> None:
        self.distance, self.side = distance, distance * (1 + 1e-9)
        self.n, self.frame, self.turn = 0, None, 0
        # Of each group: sums of its places, their number, the turn of its last frame, the code of its mean's cell, whether it isn't among the sorted ones.
        self.sums, self.sizes, self.last, self.code, self.moved = np.zeros((0, 3)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        self.order, self.codes, self.loose = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def take(self, frame: float, places: np.ndarray) -> np.ndarray:
        """The group of each of the frame's next observations (x, y, z), in order; those that are nowhere have one of their own."""
        if frame != self.frame:
            self.frame, self.turn = frame, self.turn + 1
        groups, at, step = np.empty(len(places), np.int64), 0, len(places)
        while at < len(places):
            lot = places[at : at + step]
            found = self._nearest(lot)
            if found is None:
                step = (len(lot) + 1) // 2
                continue
            self._join(lot, found)
            groups[at : at + len(lot)] = found
            at += len(lot)
        return groups

    def _near(self, places: np.ndarray) -> np.ndarray:
        """Open groups in the cells of places and those that touch them, in order."""
        wanted = np.unique(neighbours(np.unique(cells_of(places, self.side), axis=0)))
        low = np.searchsorted(self.codes, wanted, "left")
        many = np.searchsorted(self.codes, wanted, "right") - low
        near = self.order[np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)]
        code = self.code[self.loose]
        there = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
        near = np.concatenate([near[~self.moved[near]], self.loose[there]])
        return np.sort(near[self.last[near] != self.turn])

    def _nearest(self, lot: np.ndarray) -> np.ndarray | None:
        """The group that each of the lot joins, -1 for a new one; None if the lot meets too many at once."""
        found, own = np.full(len(lot), -1), np.flatnonzero(np.isfinite(lot).all(1))
        if not self.distance > 0 or not self.n or not len(own):
            return found
        one, place_of = distinct(lot[own])
        places = lot[own[one]]
        near = self._near(places)
        means = self.sums[near] / self.sizes[near, None]
        one, mean_of = distinct(means)
        means = means[one]
        chunks = Cells(means, self.side).pairs(places)
        place, mean = next(chunks, (np.zeros(0, np.int64),) * 2)
        if next(chunks, None) is not None:
            return None
        square = np.zeros(len(place))
        for p, m in zip(places.T.copy(), means.T.copy(), strict=True):  # axis by axis, the sum in the order of a norm
            off = p[place] - m[mean]
            square += off * off
            fits = square <= self.distance * self.side * (1 + 1e-9)
            place, mean, square = place[fits], mean[fits], square[fits]
        far = np.sqrt(square)
        fits = far <= self.distance
        place, mean, far = place[fits], mean[fits], far[fits]
        turn = np.lexsort((far, place))
        ends = np.searchsorted(place, np.arange(len(places) + 1))
        at, stop, mean, far = ends[:-1].tolist(), ends[1:].tolist(), mean[turn].tolist(), far[turn].tolist()
        order = np.argsort(mean_of, kind="stable")
        ends = np.searchsorted(mean_of[order], np.arange(len(means) + 1))
        head, tail, members = ends[:-1].tolist(), ends[1:].tolist(), near[order].tolist()
        joined = []
        for p in place_of.tolist():
            k, end = at[p], stop[p]
            while k < end and head[mean[k]] == tail[mean[k]]:
                k += 1
            at[p] = k
            if k == end:
                joined.append(-1)
                continue
            best, other = mean[k], k + 1
            while other < end and far[other] == far[k]:  # as near: the group that began first
                m = mean[other]
                if head[m] < tail[m] and members[head[m]] < members[head[best]]:
                    best = m
                other += 1
            joined.append(members[head[best]])
            head[best] += 1
        found[own] = joined
        return found

    def _join(self, lot: np.ndarray, found: np.ndarray) -> None:
        """The lot joins the groups found, which gets the numbers of new ones."""
        new = np.flatnonzero(found < 0)
        found[new] = self.n + np.arange(len(new))
        self.n += len(new)
        if self.n > len(self.sizes):
            longer = lambda a: np.concatenate([a, np.zeros((self.n + len(a) // 2 - len(a), *a.shape[1:]), a.dtype)])
            self.sums, self.sizes, self.last, self.code, self.moved = map(longer, (self.sums, self.sizes, self.last, self.code, self.moved))
        self.sums[found] += lot
        self.sizes[found] += 1
        self.last[found] = self.turn
        means = self.sums[found] / self.sizes[found, None]
        begun = np.zeros(len(found), bool)
        begun[new] = True
        fine = np.isfinite(means).all(1)
        found, means, begun = found[fine], means[fine], begun[fine]
        code = cell_codes(cells_of(means, self.side)) if self.distance > 0 else self.code[found]
        left = begun | (code != self.code[found])
        self.code[found] = code
        self.loose = np.concatenate([self.loose, found[left & ~self.moved[found]]])
        self.moved[found[left]] = True
        if len(self.loose) > self.LOOSE + self.n // self.SHARE:
            order = np.concatenate([self.order[~self.moved[self.order]], self.loose])
            self.order = order[np.argsort(self.code[order], kind="stable")]
            self.codes = self.code[self.order]
            self.moved[self.loose] = False
            self.loose = self.loose[:0]


def runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of rows that are equal in all columns begin and end."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return itertools.pairwise([*np.flatnonzero(new).tolist(), len(new)])


def nearest_groups(rows: pd.DataFrame, distance: float) -> pd.DataFrame:
    """rows in order of frame and candidate, with the group of each by OpenGroups."""
    order = ["frame_index", *(c for c in ("candidate_no",) if c in rows), "candidate_id"]
    rows = rows.sort_values(order, ignore_index=True)
    places, frames, groups = rows[["x", "y", "z"]].to_numpy(float), rows["frame_index"].to_numpy(), OpenGroups(distance)
    own = [groups.take(frames[a], places[a:b]) for a, b in runs(frames)]
    return rows.assign(group=np.concatenate([np.zeros(0, np.int64), *own]))


def _grouped(distance: float):
    """A function for mapInArrow: to rows sorted by scene, bundle and frame the group of each within its bundle, and whether it begins it.

    A batch and the open groups of one bundle are held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups = None, OpenGroups(distance)
        for rows in batches:
            scene, bundle, frame, *axes = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("scene_id", "bundle", "frame_index", "x", "y", "z"))
            places, group, begins = np.column_stack(axes).astype(float), np.empty(len(scene), np.int64), np.empty(len(scene), bool)
            for a, b in runs(scene, bundle, frame):
                if (scene[a], bundle[a]) != now:
                    now, groups = (scene[a], bundle[a]), OpenGroups(distance)
                n = groups.n
                group[a:b] = groups.take(frame[a], places[a:b])
                begins[a:b] = group[a:b] >= n
            yield rows.drop_columns(["bundle", "x", "y", "z"]).append_column("group", pa.array(group)).append_column("begins", pa.array(begins))

    return work


def spatial_groups(candidates: DataFrame, distance: float = 1.0) -> DataFrame:
    """scene_id, frame_index, candidate_id, group of OpenGroups over each scene.

    The last member of a group is within distance of its mean, so a group's next member is within twice that of it: parts of
    a scene that are farther apart never meet, and a task works on some of them. Its rows come sorted, and it
    holds the groups, not the rows. Groups are numbered as they begin.
    """
    number = ["candidate_no"] if "candidate_no" in candidates.columns else []
    rows = candidates.select("scene_id", "frame_index", *number, F.col("candidate_id").cast("string").alias("candidate_id"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    nowhere = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull() | F.isnan("x") | F.isnan("y") | F.isnan("z")
    order = ["frame_index", *number, "candidate_id"]
    last = [F.col(c).asc_nulls_last() for c in order]
    alone = rows.where(nowhere).select("scene_id", *order, (-1 - F.monotonically_increasing_id()).alias("part"), F.lit(0).cast("long").alias("group"), F.lit(True).alias("begins"))  # each a group of its own
    parts = bundled(in_parts(rows.where(~nowhere), list("xyz"), 2 * max(distance, 1e-9)))
    parts = stored(parts.select("scene_id", *order, *"xyz", "part", "bundle"), "parts")  # ranges are found by a look at the rows
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("scene_id", *order)) + ", part long, group long, begins boolean"
    # By ranges a bundle of many rows has a task of its own.
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartitionByRange(n, "scene_id", "bundle").sortWithinPartitions("scene_id", "bundle", *last)
    found = stored(dealt.mapInArrow(_grouped(distance), schema).unionByName(alone), "groups")  # read twice; the groups are worked out once
    first = found.where("begins").select("scene_id", "part", "group", F.row_number().over(Window.partitionBy("scene_id").orderBy(*last, "part", "group")).cast("long").alias("no"))
    return found.join(first, ["scene_id", "part", "group"]).select("scene_id", "frame_index", "candidate_id", (F.col("no") - 1).alias("group"))
