"""Merging of broken tracks one after another, where each merge changes what may merge next.

Which tracks go on as which is told by the rules of ``pairs``. Tracks merge within their sequence only, so a task takes the facts of one sequence (a row
for a track, with five last places, never its observations) and goes through its tracks in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.operators import pairs
from kinetra.operators.tracks import fill_gaps

TRACK = ["seq_id", "track_id"]


class _Sequence:
    """A sequence's tracks in order of their starts, and what merging makes of them."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["f0", "track_id"])
        self.ids, self.at = rows["track_id"].to_numpy(), pairs.Places.of(rows)
        self.tails = [np.array(t, float).T for t in zip(rows["tail_f"], rows["tail_x"], rows["tail_y"], strict=True)]
        self.there, self.into = np.ones(len(rows), bool), np.arange(len(rows))

    def successors(self, i: int, rule: pairs.Stitching | pairs.Waking) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Places of the tracks that the one at ``i`` may go on as, and what the rule tells of them."""
        p, (least, most) = self.at, rule.gaps
        first, last = np.searchsorted(p.f0, [p.f1[i] + least, p.f1[i] + most + 1])
        gap = p.f0[first:last] - p.f1[i]
        fits, told = rule.judged(p[i : i + 1], p[first:last], gap)
        j = np.flatnonzero(fits & self.there[first:last])
        return first + j, {c: v[j] for c, v in told.items()}

    def predecessors(self, j: int, rule: pairs.Stitching | pairs.Waking) -> np.ndarray:
        """Places of the tracks that may go on as the one at ``j``."""
        p, (least, most) = self.at, rule.gaps
        gap = p.f0[j] - p.f1[:j]
        i = np.flatnonzero((gap >= least) & (gap <= most) & self.there[:j])
        return i[rule.judged(p[i], p[j : j + 1], gap[i])[0]]

    def merge(self, i: int, j: int, fill: bool) -> None:
        """The track at ``j`` goes, and the one at ``i`` goes on with it; with ``fill`` the frames between count as observed."""
        p, old, new = self.at, self.tails[i], self.tails[j]
        if fill and (gap := p.f0[j] - p.f1[i]) > 1:
            start, end = np.array([p.f0[j], *((p.b0[j, :2] + p.b0[j, 2:]) / 2)]), old[-1]
            f = np.arange(max(start[0] - pairs.TAIL, end[0] + 1), start[0])
            line = end[1:] + (start[1:] - end[1:]) * ((f - end[0]) / gap)[:, None]
            old = np.concatenate([old, np.column_stack([f, line])])
        p.n[i] += p.n[j] + (p.f0[j] - p.f1[i] - 1 if fill else 0)
        p.f1[i], p.b1[i], self.tails[i] = p.f1[j], p.b1[j], np.concatenate([old, new])[-pairs.TAIL :]
        tail = self.tails[i]
        for k, x, y in ((pairs.TAIL, p.vx, p.vy), (2, p.ux, p.uy)):
            first = tail[max(len(tail) - k, 0)]
            x[i], y[i] = (tail[-1, 1:] - first[1:]) / (tail[-1, 0] - first[0]) if tail[-1, 0] != first[0] else (0.0, 0.0)
        self.there[j], self.into[j] = False, i


def merged_ids(obs: DataFrame, rule: pairs.Stitching | pairs.Waking, order: list[str], best: list[str], fill: bool) -> DataFrame:
    """(seq_id, track_id, merged_id): which track each ends up in.

    Again and again the first track that has a successor takes the best one, and its facts are made from both. ``order`` are facts (n, f0, f1) that say which
    track is first, ``best`` columns of a link (``near``: the smaller of dist and missed) or ``f0`` of b that say which successor it takes; ties go to the smaller id.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = _Sequence(rows)
        by = np.lexsort([s.ids, *[getattr(s.at, c) for c in reversed(order)]])
        turn = np.empty(len(by), int)
        turn[by] = np.arange(len(by))
        k = 0
        while k < len(by):
            i = by[k]
            j, told = s.successors(i, rule) if s.there[i] else ((), {})
            if not len(j):
                k += 1
                continue
            worth = {"near": lambda: np.minimum(told["dist"], told["missed"]), "f0": lambda: s.at.f0[j]}
            s.merge(i, j[np.lexsort([s.ids[j], *[worth[c]() for c in reversed(best)]])[0]], fill)
            # A track that found nothing may go on as what the merged one has become; nothing else of what comes earlier has changed.
            if rule.later and len(before := turn[s.predecessors(i, rule)]):
                k = min(k, before.min())
        while (s.into[s.into] != s.into).any():
            s.into = s.into[s.into]
        return pd.DataFrame({"seq_id": rows["seq_id"].iloc[0], "track_id": s.ids, "merged_id": s.ids[s.into]})

    tracks = pairs.with_speed(pairs.facts(obs))
    tracks = tracks.select("*", *[F.col(f"tail.{c}").alias(f"tail_{c}") for c in "fxy"]).drop("tail")
    return tracks.groupBy("seq_id").applyInPandas(run, "seq_id long, track_id long, merged_id long")


def stitched_ids(obs: DataFrame, total_frames: int, **rule: float) -> DataFrame:
    """Tracks in order of their ids take the successor that is nearest to where they were or were led; gaps count as observed."""
    return merged_ids(obs, pairs.Stitching(total_frames, **rule), [], ["near"], True)


def dormant_ids(obs: DataFrame, **rule: float) -> DataFrame:
    """Tracks in order of their starts take the earliest track that they wake as."""
    return merged_ids(obs, pairs.Waking(**rule), ["f0"], ["f0"], False)


def renamed(obs: DataFrame, ids: DataFrame, longest: int = 0) -> DataFrame:
    """Observations under their merged ids; gaps of up to ``longest`` frames are filled on a straight line."""
    out = obs.join(ids, TRACK).withColumn("track_id", F.col("merged_id")).drop("merged_id")
    return out.unionByName(fill_gaps(out, longest)) if longest else out
