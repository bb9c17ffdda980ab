"""Streams of observations and events: keyed state and windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinetra.operators import kalman
from kinetra.operators.events import Thresholds
from kinetra.operators.grouped import box_iou


class Lifecycle(StatefulProcessor):
    """Per track: ACTIVE when observed; an absence shows when the track is next seen, as DORMANT or LOST before it.

    State is the last frame seen. Rows of a key are taken in order of frames within a batch; a frame that was
    already passed changes nothing.
    """

    def __init__(self, lost: int) -> None:
        self.lost = lost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "frame long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = sorted({int(f) for part in rows for f in part["frame_idx"]})
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for f in frames:
            if last is not None and f <= last:
                continue
            gap = 0 if last is None else f - last - 1
            out.append((key[0], key[1], f, gap, "LOST" if gap > self.lost else "DORMANT" if gap else "ACTIVE"))
            last = f
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["seq_id", "track_id", "frame_idx", "gap", "came_from"])

    def close(self) -> None:
        pass


def lifecycle(stream: DataFrame, lost: int) -> DataFrame:
    """(seq_id, track_id, frame_idx, gap, came_from) for each new frame of each track."""
    return stream.groupBy("seq_id", "track_id").transformWithStateInPandas(
        statefulProcessor=Lifecycle(lost), outputStructType="seq_id long, track_id long, frame_idx long, gap long, came_from string", outputMode="Append", timeMode="None"
    )


class PairEvents(StatefulProcessor):
    """Per sequence: begin and end of events of pairs of boxes (see ``events.pair_events``), told in the frame in which they happen.

    State is a map by pair: how often in a row the overlap was above the threshold, and when the event began (-1: there is none). Frames are taken in order
    within a batch and have to come whole; pairs that are apart and have no event leave no state.
    """

    def __init__(self, at: Thresholds) -> None:
        self.at = at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getMapState("pairs", "a long, b long", "in_a_row long, began long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        state = {tuple(k): tuple(v) for k, v in self.pairs.iterator()}
        known = set(state)
        for frame, boxes in pd.concat(list(rows)).groupby("frame_idx", sort=True):
            boxes = boxes.sort_values("track_id")
            ids, xy = boxes["track_id"].tolist(), boxes[["x1", "y1", "x2", "y2"]].to_numpy(float)
            here = set(ids)
            for pair, (n, began) in list(state.items()):
                if began >= 0 and not here.issuperset(pair):
                    out.append((key[0], *pair, began, int(frame)))
                    state[pair] = (n, -1)
            for i, a in enumerate(ids[:-1]):
                for b, iou in zip(ids[i + 1 :], box_iou(xy[i], xy[i + 1 :]), strict=True):
                    n, began = state.get((a, b), (0, -1))
                    n = n + 1 if iou > self.at.enter else 0
                    if began >= 0 and iou < self.at.leave:
                        out.append((key[0], a, b, began, int(frame)))
                        began = -1
                    elif began < 0 and n >= self.at.frames and n:
                        began = int(frame)
                        out.append((key[0], a, b, began, -1))
                    state[a, b] = (n, began)
            state = {p: v for p, v in state.items() if v != (0, -1)}
        for pair in known - set(state):
            self.pairs.removeKey(pair)
        for pair, value in state.items():
            self.pairs.updateValue(pair, value)
        yield pd.DataFrame(out, columns=["seq_id", "a", "b", "entry_frame", "exit_frame"])

    def close(self) -> None:
        pass


def pair_events(stream: DataFrame, at: Thresholds) -> DataFrame:
    """(seq_id, a, b, entry_frame, exit_frame): a row where an event begins (exit -1) and one where it ends."""
    return stream.groupBy("seq_id").transformWithStateInPandas(
        statefulProcessor=PairEvents(at), outputStructType="seq_id long, a long, b long, entry_frame long, exit_frame long", outputMode="Append", timeMode="None"
    )


class Kalman(StatefulProcessor):
    """Per track: the filter of ``kalman``. State is its numbers, last centres and frame."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "frame long, state array<double>, centres array<array<double>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = kalman.Filter(*self.held.get()) if self.held.exists() else None
        after, out = kalman.run_on(before, pd.concat(list(rows)).sort_values("frame_idx"))
        if after is not None:
            self.held.update((after.frame, after.state(), after.centres))
        yield pd.DataFrame([(*key, *o) for o in out], columns=[c.split()[0] for c in kalman.OUT.split(", ")])

    def close(self) -> None:
        pass


def filtered(stream: DataFrame) -> DataFrame:
    """``kalman.filtered`` of observations as they come."""
    return stream.groupBy("seq_id", "track_id").transformWithStateInPandas(statefulProcessor=Kalman(), outputStructType=kalman.OUT, outputMode="Append", timeMode="None")


class Absences(StatefulProcessor):
    """Per track: DORMANT when it was away for more than ``dormant`` frames and LOST for more than ``lost``, told when it happens, by timers on the time of the stream.

    State is the last frame seen and the last state told. A frame lasts ``1000 / fps`` milliseconds of event time, the first begins after one, as time 0 is always late. What is
    LOST leaves no state: a later row of the track is a new one.
    """

    def __init__(self, dormant: int, lost: int, fps: float) -> None:
        self.dormant, self.lost, self.fps = dormant, lost, fps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "frame long, told string")

    def _due(self, frame: int, away: int) -> int:
        """When a track last seen in ``frame`` has been away for more than ``away`` frames."""
        return int((frame + away + 2) * 1000 / self.fps)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = sorted({int(f) for part in rows for f in part["frame_idx"]})
        last, told = self.last.get() if self.last.exists() else (None, "")
        out = []
        if last is not None and frames[-1] <= last:
            return
        for f in frames:
            if last is None or told != "ACTIVE":
                out.append((*key, f, "ACTIVE"))
                told = "ACTIVE"
            last = f
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last, told))
        self.handle.registerTimer(self._due(last, self.dormant))
        self.handle.registerTimer(self._due(last, self.lost))
        yield pd.DataFrame(out, columns=["seq_id", "track_id", "frame_idx", "state"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.last.exists():
            return
        last, _ = self.last.get()
        lost = expiredTimerInfo.getExpiryTimeInMs() >= self._due(last, self.lost)
        if lost:
            self.last.clear()
        else:
            self.last.update((last, "DORMANT"))
        yield pd.DataFrame([(*key, last + (self.lost if lost else self.dormant) + 1, "LOST" if lost else "DORMANT")], columns=["seq_id", "track_id", "frame_idx", "state"])

    def close(self) -> None:
        pass


def absences(stream: DataFrame, dormant: int = 0, lost: int = 300, fps: float = 30.0, late: str = "0 seconds") -> DataFrame:
    """(seq_id, track_id, frame_idx, state): changes of state of each track, absences without a later row of it."""
    timed = stream.withColumn("at", F.timestamp_millis(((F.col("frame_idx") + 1) * 1000 / fps).cast("long"))).withWatermark("at", late)
    return timed.groupBy("seq_id", "track_id").transformWithStateInPandas(
        statefulProcessor=Absences(dormant, lost, fps), outputStructType="seq_id long, track_id long, frame_idx long, state string", outputMode="Append", timeMode="EventTime"
    )


class Trajectories(StatefulProcessor):
    """Per sequence: a bank of tracks; a row of a new track wakes the inactive one that it is most like.

    State is a map by track: its last frame, whether it is active, and its last ``KEPT`` appearances; it is forgotten ``forget`` frames after its last one.
    Rows are ``seen`` (an observation), ``lost`` (the track is no longer active) or ``ask`` (what an unknown detection looks like), in order of frames.
    """

    #: Appearances that count when a track is held against a detection.
    KEPT = 5

    def __init__(self, like: float, forget: int) -> None:
        self.like, self.forget = like, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bank = handle.getMapState("bank", "track_id long", "last long, active boolean, looks array<array<double>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bank = {k[0]: (v[0], v[1], [list(x) for x in v[2]]) for k, v in self.bank.iterator()}
        known, out = set(bank), []
        for row in pd.concat(list(rows)).sort_values(["frame_idx", "kind", "track_id"]).itertuples(index=False):
            at, t = int(row.frame_idx), int(row.track_id)
            bank = {k: v for k, v in bank.items() if v[1] or v[0] >= at - self.forget}
            if row.kind == "seen":
                looks = bank[t][2] if t in bank else []
                bank[t] = (at, True, [*looks, list(map(float, row.look))][-self.KEPT :])
            elif row.kind == "lost" and t in bank:
                bank[t] = (bank[t][0], False, bank[t][2])
            elif row.kind == "ask":
                alike = [(sum(sum(p * q for p, q in zip(row.look, look, strict=True)) for look in v[2]) / len(v[2]), -k) for k, v in bank.items() if not v[1] and at > v[0]]
                score, k = max(alike, default=(0.0, 0))
                if score > self.like:
                    bank[-k] = (bank[-k][0], True, bank[-k][2])
                    out.append((key[0], at, t, -k, score))
        for t in known - set(bank):
            self.bank.removeKey((t,))
        for t, (last, active, looks) in bank.items():
            self.bank.updateValue((t,), (last, active, looks))
        yield pd.DataFrame(out, columns=["seq_id", "frame_idx", "asked", "track_id", "score"])

    def close(self) -> None:
        pass


def trajectories(stream: DataFrame, like: float = 0.6, forget: int = 1000) -> DataFrame:
    """(seq_id, frame_idx, asked, track_id, score): inactive tracks that detections wake. Rows: seq_id, frame_idx, track_id, kind, look."""
    return stream.groupBy("seq_id").transformWithStateInPandas(
        statefulProcessor=Trajectories(like, forget), outputStructType="seq_id long, frame_idx long, asked long, track_id long, score double", outputMode="Append", timeMode="None"
    )


class OneEuro(StatefulProcessor):
    """Per track and joint: the One-Euro filter of x and y; a sample under ``least`` gives the last output and leaves the state alone.

    State is the last output and slope of both axes and the frame of the last sure sample. Rows of a key are taken in
    order of frames within a batch; a sure sample of a frame that was already passed gives the last output.
    """

    def __init__(self, least: float, cutoff: float, beta: float, fps: float) -> None:
        self.least, self.cutoff, self.beta, self.fps = least, cutoff, beta, fps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "frame long, x double, y double, dx double, dy double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        share = lambda dt, c: (r := 2 * math.pi * c * dt) / (r + 1)
        at, x, y, dx, dy = self.held.get() if self.held.exists() else (None, None, None, 0.0, 0.0)
        out = []
        for row in pd.concat(list(rows)).sort_values("frame_idx").itertuples(index=False):
            if row.s >= self.least and at is None:
                at, x, y = int(row.frame_idx), float(row.x), float(row.y)
            elif row.s >= self.least and row.frame_idx > at:
                dt = (row.frame_idx - at) / self.fps
                a = share(dt, 1.0)
                dx, dy = (a * (v - o) / dt + (1 - a) * d for v, o, d in ((row.x, x, dx), (row.y, y, dy)))
                x, y = (share(dt, self.cutoff + self.beta * abs(d)) * (v - o) + o for v, o, d in ((row.x, x, dx), (row.y, y, dy)))
                at = int(row.frame_idx)
            out.append((*key, int(row.frame_idx), float(row.x) if x is None else x, float(row.y) if y is None else y, float(row.s)))
        if at is not None:
            self.held.update((at, float(x), float(y), float(dx), float(dy)))
        yield pd.DataFrame(out, columns=["seq_id", "track_id", "j", "frame_idx", "x", "y", "s"])

    def close(self) -> None:
        pass


def smoothed(stream: DataFrame, least: float = 0.3, cutoff: float = 1.0, beta: float = 0.7, fps: float = 30.0) -> DataFrame:
    """Keypoints (seq_id, track_id, frame_idx, j, x, y, s) smoothed as they come."""
    return stream.groupBy("seq_id", "track_id", "j").transformWithStateInPandas(
        statefulProcessor=OneEuro(least, cutoff, beta, fps), outputStructType="seq_id long, track_id long, j int, frame_idx long, x double, y double, s double", outputMode="Append", timeMode="None"
    )


def counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and values by tumbling window and type; late ones count up to the watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of users: closed after a gap without events."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def chunk_peaks(obs: DataFrame, frames: int = 300) -> DataFrame:
    """Most tracks in one frame of each chunk of frames, and whether the next chunk should use the larger detector size."""
    n = obs.groupBy("seq_id", "frame_idx").agg(F.count("*").alias("n"))
    peaks = n.groupBy("seq_id", F.floor(F.col("frame_idx") / frames).alias("chunk")).agg(F.max("n").alias("peak"))
    return peaks.withColumn("enlarge_next", F.col("peak") > 4)
