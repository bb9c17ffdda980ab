"""A Kalman filter of boxes with constant velocity whose process noise grows where a prediction leaves what the track has done of late.

Centre, width and height are four filters of place and velocity side by side; only the noise's scale joins them. A track's state is twenty numbers,
the scale and its last centres, so a stream keeps the same as a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.operators.tiles import BOX

#: Noise of place and velocity of centre x, centre y, width, height; of what is measured; and the first variance.
PLACE_NOISE, VELOCITY_NOISE, MEASURED, FIRST = np.array([10.0] * 4), np.array([25.0, 25.0, 10.0, 10.0]), 10.0, 100.0
#: Last centres that a prediction is held against (at least ``FEWEST``), in deviations, and the largest scale of the noise.
RECENT, FEWEST, FAR, LARGEST = 10, 3, 2.0, 10.0
OUT = "seq_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double, cx double, cy double, w double, h double, vx double, vy double, scale double"


class Filter:
    """State of one track: places, velocities, their variances and covariance, the noise's scale, last centres and the frame."""

    def __init__(self, frame: int, state: list[float], centres: list[list[float]]) -> None:
        self.frame, self.scale, self.centres = frame, state[20], [list(c) for c in centres]
        self.place, self.speed, self.pp, self.pv, self.vv = np.array(state[:20]).reshape(5, 4)

    @staticmethod
    def begun(frame: int, z: np.ndarray) -> Filter:
        return Filter(frame, [*z, *[0.0] * 4, *[FIRST] * 4, *[0.0] * 4, *[FIRST] * 4, 1.0], [z[:2].tolist()])

    def state(self) -> list[float]:
        return [*np.concatenate([self.place, self.speed, self.pp, self.pv, self.vv]).tolist(), self.scale]

    def predict(self) -> None:
        """One frame on."""
        self.frame += 1
        self.place = self.place + self.speed
        self.pp, self.pv, self.vv = self.pp + 2 * self.pv + self.vv + PLACE_NOISE * self.scale, self.pv + self.vv, self.vv + VELOCITY_NOISE * self.scale
        if len(self.centres) >= FEWEST:
            recent = np.array(self.centres)
            apart = np.abs(self.place[:2] - recent.mean(axis=0)) / (recent.std(axis=0) + 1e-6)
            self.scale = min(1 + float(np.hypot(*apart)) / 2, LARGEST) if (apart > FAR).any() else 1.0

    def update(self, z: np.ndarray) -> None:
        size = self.pp + MEASURED
        gain, turn, missed = self.pp / size, self.pv / size, z - self.place
        self.place, self.speed = self.place + gain * missed, self.speed + turn * missed
        self.vv, self.pp, self.pv = self.vv - turn * self.pv, (1 - gain) * self.pp, (1 - gain) * self.pv
        self.centres = [*self.centres, z[:2].tolist()][-RECENT:]

    def box(self) -> list[float]:
        x, y, w, h = self.place
        w, h = max(w, 1.0), max(h, 1.0)
        return [x - w / 2, y - h / 2, x + w / 2, y + h / 2]


def run_on(held: Filter | None, rows: pd.DataFrame) -> tuple[Filter | None, list[tuple]]:
    """The filter after observations (in order of frames; frames already passed are left out), and for each the box predicted before it and the state after."""
    out = []
    for r in rows.itertuples(index=False):
        z = np.array([(r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2, r.x2 - r.x1, r.y2 - r.y1], float)
        if held is None:
            held = Filter.begun(int(r.frame_idx), z)
            seen = held.box()
        elif r.frame_idx <= held.frame:
            continue
        else:
            while held.frame < r.frame_idx:
                held.predict()
            seen = held.box()
            held.update(z)
        out.append((int(r.frame_idx), *seen, *held.place.tolist(), *held.speed[:2].tolist(), held.scale))
    return held, out


def side_by_side(tracks: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """What ``run_on`` tells of each track (frames, which grow, and boxes), from the box predicted to the scale, with all tracks' filters moved on together."""
    order = np.argsort([-len(f) for f, _ in tracks], kind="stable")
    sizes = np.array([len(tracks[k][0]) for k in order])
    n, most = len(sizes), int(sizes.max(initial=0))
    frames, z = np.zeros((most, n), np.int64), np.zeros((most, n, 4))
    for at, k in enumerate(order):
        f, b = tracks[k]
        frames[: len(f), at] = f
        z[: len(f), at] = np.column_stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]])
    out = np.zeros((most, n, 11))
    place, speed, pp, pv, vv = (np.zeros((n, 4)) for _ in range(5))
    scale, held, centres = np.ones(n), np.zeros(n, np.int64), np.zeros((n, RECENT, 2))
    for step in range(most):
        m = int(np.searchsorted(-sizes, -step, "left"))  # the tracks that have a place more
        now = z[step, :m]
        if step == 0:
            place[:m], pp[:m], vv[:m], held[:m] = now, FIRST, FIRST, frames[0, :m]
            centres[:m, 0] = now[:, :2]
        else:
            # Centres in their order, as a sum over one track's would add them.
            known = min(step, RECENT)
            mean = sum((centres[:m, k] for k in range(1, known)), centres[:m, 0]) / known
            deviation = np.sqrt(sum(((centres[:m, k] - mean) ** 2 for k in range(1, known)), (centres[:m, 0] - mean) ** 2) / known)
            while len(at := np.flatnonzero(held[:m] < frames[step, :m])):
                held[at] += 1
                by = scale[at][:, None]
                place[at] += speed[at]
                pp[at] = pp[at] + 2 * pv[at] + vv[at] + PLACE_NOISE * by
                pv[at], vv[at] = pv[at] + vv[at], vv[at] + VELOCITY_NOISE * by
                if known >= FEWEST:
                    apart = np.abs(place[at, :2] - mean[at]) / (deviation[at] + 1e-6)
                    scale[at] = np.where((apart > FAR).any(axis=1), np.minimum(1 + np.hypot(apart[:, 0], apart[:, 1]) / 2, LARGEST), 1.0)
        size = np.maximum(place[:m, 2:], 1.0)
        out[step, :m, :4] = np.concatenate([place[:m, :2] - size / 2, place[:m, :2] + size / 2], axis=1)
        if step:
            whole = pp[:m] + MEASURED
            gain, turn, missed = pp[:m] / whole, pv[:m] / whole, now - place[:m]
            place[:m], speed[:m] = place[:m] + gain * missed, speed[:m] + turn * missed
            vv[:m], pp[:m], pv[:m] = vv[:m] - turn * pv[:m], (1 - gain) * pp[:m], (1 - gain) * pv[:m]
            if step >= RECENT:
                centres[:m, :-1] = centres[:m, 1:].copy()
            centres[:m, min(step, RECENT - 1)] = now[:, :2]
        out[step, :m, 4:8], out[step, :m, 8:10], out[step, :m, 10] = place[:m], speed[:m, :2], scale[:m]
    told: list[np.ndarray] = [np.zeros((0, 11))] * n
    for at, k in enumerate(order):
        told[k] = out[: sizes[at], at]
    return told


#: Tracks whose filters are moved on together.
TOGETHER = 256


def filtered(obs: DataFrame) -> DataFrame:
    """Per observation: the box that the track's past predicts for it (of the first the box itself), and centre, size, velocity and noise scale after it.

    A task takes tracks from its batches, ``TOGETHER`` at a time, side by side.
    """
    columns = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (batch.iloc[at : at + TOGETHER] for batch in batches for at in range(0, len(batch), TOGETHER)):
            tracks = []
            for f, *box in zip(*[part[c] for c in ("frame_idx", *BOX)], strict=True):
                f = np.asarray(f, np.int64)
                new = np.diff(f, prepend=f[0] - 1) > 0
                tracks.append((f[new], np.column_stack(box).astype(float)[new]))
            keys = [np.repeat(part[c].to_numpy(), [len(f) for f, _ in tracks]) for c in ("seq_id", "track_id")]
            told = np.concatenate(side_by_side(tracks))
            yield pd.DataFrame(dict(zip(columns, (*keys, np.concatenate([f for f, _ in tracks]), *told.T), strict=True)))

    whole = obs.groupBy("seq_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", *BOX))).alias("r"))
    return whole.select("seq_id", "track_id", *[F.col(f"r.{c}").alias(c) for c in ("frame_idx", *BOX)]).mapInPandas(run, OUT)
