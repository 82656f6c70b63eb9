"""Assets claimed by frames as a stream with state: claim once by stamp or by window, sweep, late assets, readiness.

Events are rows of EVENT, one stream for all scenes, told apart by `action`:

    asset   a file has come (kind, group_key and url tell which)
    start   a frame begins (frame_index)
    claim   a frame takes its assets (frame_index)
    end     the scene is over: what nobody has claimed is swept
    tick    nothing but the time

Order. Events of a scene take effect in order of (ts, action, url), an asset before a mark of its time, once the scene has
seen an event `delay` later; so arrivals may be shuffled by less than `delay` without another result. What comes later
than that takes effect when it comes, before anything that waits, and is marked as delayed.

Each asset has one row of OUTCOME: `claimed` (by a frame), `rest` (by a frame that found no stamp with a
cloud and takes all), `swept` (at the end) or `late` (after the end). A frame that claims nothing has one row without url.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "scene_id string, ts long, action string, frame_index int, kind string, group_key string, url string"
OUTCOME = "scene_id string, frame_index int, claim_ts long, group_key string, kind string, url string, arrival_ts long, how string, delayed boolean"
#: Order of actions of one time.
RANK = {"asset": 0, "claim": 1, "start": 2, "end": 3, "tick": 4}
#: State of a scene: latest time seen, time up to which all has taken effect, number of starts, whether it has ended.
PROGRESS = "seen long, done long, starts long, ended boolean"
ASSETS = "kinds array<string>, urls array<string>, times array<long>, starts array<long>, delayed array<boolean>"
NAMES = [c.split()[0] for c in EVENT.split(", ")]
OUT = [c.split()[0] for c in OUTCOME.split(", ")]


def _plain(v, kind=None):
    """A cell of pandas as a plain value, its missing values as None; whole numbers stand as floats beside missing ones."""
    return None if v is None or v != v else kind(v) if kind else v


def _events(part: pd.DataFrame) -> list[tuple]:
    """Rows as EVENT without scene_id."""
    return [(int(ts), action, _plain(frame, int), *map(_plain, rest)) for ts, action, frame, *rest in part[NAMES[1:]].itertuples(index=False)]


def _keep(state, rows: list[tuple]) -> None:
    """The rows of a list state from now on; a list can't be stored empty."""
    state.put(rows) if rows else state.clear()


def ordered(events: list[tuple]) -> list[tuple]:
    """Events (as EVENT without scene_id) as they take effect."""
    return sorted(events, key=lambda e: (e[0], RANK[e[1]], e[5] or "", e[2] or 0))


class _Groups:
    """Unclaimed assets by stamp ("" for none) over two map states; what a batch touches is written once, at its end."""

    def __init__(self, assets, clouds) -> None:
        self.assets, self.clouds, self.touched = assets, clouds, {}

    def of(self, key: str) -> list[tuple]:
        if key not in self.touched:
            there = self.assets.getValue((key,)) if self.assets.containsKey((key,)) else None
            self.touched[key] = list(zip(*there, strict=True)) if there is not None else []
        return self.touched[key]

    def first_cloud(self) -> str | None:
        """The least stamp that has an unclaimed cloud."""
        keys = {k[0] for k in self.clouds.keys()} - set(self.touched)  # noqa: SIM118
        keys |= {k for k, own in self.touched.items() if k and any(a[0] == "pcd" for a in own)}
        return min(keys, key=lambda k: (float(k), k), default=None)

    def take(self, key: str, wanted=lambda a: True) -> list[tuple]:
        own = self.of(key)
        self.touched[key] = [a for a in own if not wanted(a)]
        return [(key or None, *a) for a in own if wanted(a)]

    def take_all(self, wanted=lambda a: True) -> list[tuple]:
        keys = sorted({k[0] for k in self.assets.keys()} | set(self.touched))  # noqa: SIM118
        return [a for k in keys for a in self.take(k, wanted)]

    def store(self) -> None:
        for key, own in self.touched.items():
            if own:
                self.assets.updateValue((key,), tuple(list(c) for c in zip(*own, strict=True)))
            elif self.assets.containsKey((key,)):
                self.assets.removeKey((key,))
            if key and any(a[0] == "pcd" for a in own):
                self.clouds.updateValue((key,), (1,))
            elif self.clouds.containsKey((key,)):
                self.clouds.removeKey((key,))


class Claims(StatefulProcessor):
    """Claim-once state of a scene. by: "stamp" (the least stamp with a cloud) or "window" (what has come since the frame began)."""

    def __init__(self, delay_us: int, by: str = "stamp") -> None:
        if by not in ("stamp", "window"):
            raise ValueError(f"by is stamp or window, not {by}")
        self.delay_us, self.by = delay_us, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", PROGRESS)
        self.waiting = handle.getListState("waiting", EVENT.partition(", ")[2])
        self.assets = handle.getMapState("assets", "group_key string", ASSETS)
        self.clouds = handle.getMapState("clouds", "group_key string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        seen, done, starts, ended = self.progress.get() or (None, None, 0, False)
        new = [e for part in rows for e in _events(part)]
        groups, out = _Groups(self.assets, self.clouds), []
        seen = max([e[0] for e in new] + ([seen] if seen is not None else []))
        behind = [e for e in new if done is not None and e[0] <= done]
        waiting = [tuple(e) for e in self.waiting.get()] + [e for e in new if done is None or e[0] > done]
        now = seen - self.delay_us
        ready = ordered([e for e in waiting if e[0] <= now])
        for event in [*ordered(behind), *ready]:
            starts, ended = self.apply(event, done is not None and event[0] <= done, starts, ended, groups, out)
        _keep(self.waiting, [e for e in waiting if e[0] > now])
        self.progress.update((seen, max(now, done) if done is not None else now, starts, ended))
        groups.store()
        if out:
            found = pd.DataFrame(out, columns=OUT[1:])
            found.insert(0, "scene_id", key[0])
            yield found.astype({"frame_index": "Int32", "claim_ts": "Int64", "arrival_ts": "Int64"})

    def apply(self, event: tuple, delayed: bool, starts: int, ended: bool, groups: _Groups, out: list) -> tuple[int, bool]:
        ts, action, frame, kind, stamp, url = event
        tell = lambda found, how: out.extend((frame if how in ("claimed", "rest") else None, ts, k, kd, u, t, how, late) for k, kd, u, t, _, late in found)
        if action == "asset" and ended:
            out.append((None, None, stamp, kind, url, ts, "late", delayed))
        elif action == "asset":
            groups.of(stamp or "").append((kind, url, ts, starts, delayed))
        elif action == "start":
            starts += 1
        elif action == "end" and not ended:
            tell(groups.take_all(), "swept")
            ended = True
        elif action == "claim":
            before = len(out)
            if self.by == "window":
                tell(groups.take_all(lambda a: a[3] == starts), "claimed")
            elif (first := groups.first_cloud()) is not None:
                tell(groups.take(first), "claimed")
            else:
                tell(groups.take_all(), "rest")
            if len(out) == before:
                out.append((frame, ts, None, None, None, None, "claimed", delayed))
        return starts, ended


def claims(events: DataFrame, delay_seconds: float, by: str = "stamp") -> DataFrame:
    """OUTCOME rows of a stream of EVENT; needs the RocksDB state store (see with_state_store)."""
    return events.select(*NAMES).groupBy("scene_id").transformWithStateInPandas(Claims(round(delay_seconds * 1e6), by), OUTCOME, "Append", "None")


def with_state_store(spark) -> None:
    """Sets the state store that maps and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def to_two_sinks(found: DataFrame, folder: str, checkpoint: str):
    """A writer of two Parquet tables, `assets` and `late`: each batch owns one folder in each, written anew when the batch is run again."""

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            late = F.col("how") == "late"
            batch.where(~late).write.mode("overwrite").parquet(f"{folder}/assets/batch={number}")
            batch.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        finally:
            batch.unpersist()

    return found.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


# Readiness

READY = "scene_id string, frame_index int, ready_status string, pcd_count int, jpg_count int, elapsed_ms long, reason string"


class Needs:
    """What a frame waits for: clouds and pictures (None: not waited for), quiet, at most timeout; then it settles."""

    def __init__(self, pcds: int | None = 1, jpgs: int | None = 5, quiet_ms: float = 800, timeout_ms: float = 60_000, settle_ms: float = 3000) -> None:
        self.pcds, self.jpgs, self.quiet_ms, self.timeout_ms, self.settle_ms = pcds, jpgs, quiet_ms, timeout_ms, settle_ms


def readiness(start: int, arrivals: list[tuple[int, str]], needs: Needs, upto: int | None = None) -> tuple | None:
    """status, pcds, jpgs, elapsed ms, reason of a frame that began at start; arrivals in order. None: not decided by upto.

    Before anything has come the scene is quiet, so a frame that waits for no files is ready at once.
    """
    quiet, deadline = int(needs.quiet_ms * 1000), start + int(needs.timeout_ms * 1000)
    counts = {"pcd": 0, "jpg": 0}
    last, at = None, 0
    while at < len(arrivals) and arrivals[at][0] <= start:
        last, at = arrivals[at][0], at + 1

    def met() -> bool:
        return (needs.pcds is None or counts["pcd"] >= needs.pcds) and (needs.jpgs is None or counts["jpg"] >= needs.jpgs)

    while True:
        calm = start if last is None else max(start, last + quiet)
        following = arrivals[at][0] if at < len(arrivals) else math.inf
        if met() and calm < min(following, deadline):
            if upto is not None and calm > upto:
                return None
            return "ok", counts["pcd"], counts["jpg"], (calm - start) // 1000 + int(needs.settle_ms), ""
        if following >= deadline:
            break
        counts[arrivals[at][1]] += 1
        last, at = following, at + 1
    if upto is not None and deadline > upto:
        return None
    idle = "inf" if last is None else f"{(deadline - last) / 1000:.0f}"
    want = lambda n: "-" if n is None else n
    reason = f"timeout ({needs.timeout_ms / 1000:g}s): pcd={counts['pcd']}/{want(needs.pcds)}, jpg={counts['jpg']}/{want(needs.jpgs)}, idle_ms={idle} (needs >= {needs.quiet_ms:g})"
    return "timeout", counts["pcd"], counts["jpg"], int(needs.timeout_ms), reason


class Readiness(StatefulProcessor):
    """Frames of a scene that wait, and the arrivals since the first of them; timers at each quiet time and deadline decide."""

    def __init__(self, needs: Needs) -> None:
        self.needs = needs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.starts = handle.getListState("starts", "ts long, frame_index int")
        self.arrivals = handle.getListState("arrivals", "ts long, kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for ts, action, frame, kind in part[["ts", "action", "frame_index", "kind"]].itertuples(index=False):
                if action == "start":
                    self.starts.appendValue((int(ts), _plain(frame, int)))
                    wait = [0, self.needs.timeout_ms]
                elif action == "asset" and kind in ("pcd", "jpg"):
                    self.arrivals.appendValue((int(ts), kind))
                    wait = [self.needs.quiet_ms]
                else:
                    continue
                for ms in wait:
                    self.handle.registerTimer(int(ts) // 1000 + int(ms) + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        starts, arrivals = sorted(map(tuple, self.starts.get())), sorted(map(tuple, self.arrivals.get()))
        out, left = [], []
        for ts, frame in starts:
            found = readiness(ts, arrivals, self.needs, upto)
            left.append((ts, frame)) if found is None else out.append((key[0], frame, *found))
        if out:
            since = min([upto, *(ts for ts, _ in left)])
            before = [a for a in arrivals if a[0] <= since][-1:]  # how long it has been quiet
            _keep(self.starts, left)
            _keep(self.arrivals, before + [a for a in arrivals if a[0] > since])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in READY.split(", ")]).astype({"frame_index": "Int32"})
        else:
            yield pd.DataFrame()


def ready_frames(events: DataFrame, needs: Needs, delay: str = "1 minute") -> DataFrame:
    """READY rows of a stream of EVENT, each as soon as the watermark (delay) tells that nothing can change it."""
    timed = events.select(*NAMES, F.timestamp_micros("ts").alias("at")).withWatermark("at", delay)
    return timed.groupBy("scene_id").transformWithStateInPandas(Readiness(needs), READY, "Append", "EventTime")
