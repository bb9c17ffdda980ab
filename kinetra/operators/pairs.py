"""Joins of tracks with tracks: overlap within a frame, and ends with later starts.

Every join has the sequence as an equal key, and the frame or a bucket of frames besides, so that no range join
turns into a product of whole tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions import geometry as g
from kinetra.operators import tiles

BOX = ("x1", "y1", "x2", "y2")


def frame_pairs(obs: DataFrame) -> DataFrame:
    """Pairs of tracks (a < b) in each frame: IoU, DIoU, containments and distance of centres."""
    side = {s: obs.select("seq_id", "frame_idx", F.col("track_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in BOX]) for s in "ab"}
    pairs = side["a"].join(side["b"], ["seq_id", "frame_idx"]).where("a < b")
    return pairs.select(
        "seq_id", "frame_idx", "a", "b", g.iou("a_", "b_").alias("iou"), g.diou("a_", "b_").alias("diou"),
        g.containment("a_", "b_").alias("a_in_b"), g.containment("b_", "a_").alias("b_in_a"), g.distance("a_", "b_").alias("dist"),
    )


def _runs(a: tiles.Side, b: tiles.Side, same: bool, follows: dict[int, int], threshold: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What a tile knows of runs of frames in which pairs overlap by more than ``threshold``, some rows at a time: the last frame, the present one, tracks, lengths of their runs up to the last frame, and up to the present one, and since when.

    At last all runs end, in a frame -1. Frames that follow each other in the sequence are in a row.
    """
    length, since, every = np.zeros((len(a.ids), len(b.ids)), np.int32), np.zeros((len(a.ids), len(b.ids)), np.int64), np.arange(len(a.ids))
    last, follow, none = -1, -1, np.zeros(1, np.int32)

    def ended(rows: np.ndarray, frame: int) -> Iterator[tuple]:
        rows = rows[length[rows].any(axis=1)]
        yield last, frame, rows, length[rows], np.broadcast_to(none, (len(rows), len(b.ids))), since[rows]
        length[rows] = 0

    for frame, i, _, boxes, parts in tiles.columned(a, b):
        yield from ended(every if follow != frame else np.flatnonzero(~tiles.present(a, i)), frame)
        for part in parts:
            rows = a.at[part]
            above = tiles.over(a.boxes[part], boxes) > threshold
            if same:
                above &= rows[:, None] < np.arange(len(b.ids))
            before = length[rows]
            now = np.where(above, before + 1, 0)
            if before.any() or now.any():
                yield last, frame, rows, before, now, since[rows]
                length[rows] = now
                since[rows] = np.where(now == 1, frame, since[rows])
        last, follow = frame, follows[frame]
    yield from ended(every, -1)


def overlap_runs(obs: DataFrame, threshold: float, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive observed frames in which a pair overlaps by more than ``threshold``.

    Frames are numbered among those with any observation in the sequence. Pairs go by tiles; only the runs leave them.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, same = tiles.sides(rows)
        found = []
        for last, _, at, before, now, since in _runs(a, b, same, dict(zip(rows["frame_idx"], rows["follows"], strict=True)), threshold):
            i, j = np.nonzero((now == 0) & (before >= max(least, 1)))
            found.append((a.ids[at[i]], b.ids[j], since[i, j], np.full(len(i), last), before[i, j]))
        x, y, first, last, n = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"seq_id": rows["seq_id"].iloc[0], "a": np.minimum(x, y), "b": np.maximum(x, y), "run_start": first, "run_end": last, "run_len": n.astype(np.int64)})

    return tiles.within(tiles.with_next(obs.select("seq_id", "track_id", "frame_idx", *BOX)), run, "seq_id long, a long, b long, run_start long, run_end long, run_len long")


def coalesced(obs: DataFrame, threshold: float, least: int) -> DataFrame:
    """Tracks to drop: of each pair with such a run the one with fewer observations (of equals the larger id).

    Pairs go by tiles, which tell tracks only.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, same = tiles.sides(rows)
        long = np.zeros((len(a.ids), len(b.ids)), bool)
        for _, _, at, _, now, _ in _runs(a, b, same, dict(zip(rows["frame_idx"], rows["follows"], strict=True)), threshold):
            long[at] |= now >= max(least, 1)
        n_a, n_b = (np.bincount(s.at, minlength=len(s.ids)) for s in (a, b))
        fewer = (n_a[:, None] < n_b) | ((n_a[:, None] == n_b) & (a.ids[:, None] > b.ids))
        gone = np.union1d(a.ids[(long & fewer).any(axis=1)], b.ids[(long & ~fewer).any(axis=0)])
        return pd.DataFrame({"seq_id": np.full(len(gone), rows["seq_id"].iloc[0]), "track_id": gone})

    return tiles.within(tiles.with_next(obs.select("seq_id", "track_id", "frame_idx", *BOX)), run, "seq_id long, track_id long").distinct()


def overlap_clusters(obs: DataFrame, trigger: float) -> DataFrame:
    """Observations that overlap another of their frame by at least ``trigger``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        boxes = rows[list(BOX)].to_numpy(float)
        rest, hit = tiles.lonely(boxes, lambda a, b: tiles.iou(a, b) >= trigger), np.ones(len(rows), bool)
        for part in tiles.stripes(len(rest)):
            over = tiles.overlap(boxes[rest[part]], boxes) >= trigger
            over[np.arange(len(over)), rest[part]] = False
            hit[rest[part]] = over.any(axis=1)
        return rows.loc[hit, ["seq_id", "frame_idx", "track_id"]]

    hits = obs.select("seq_id", "frame_idx", "track_id", *BOX).groupBy("seq_id", "frame_idx").applyInPandas(run, "seq_id long, frame_idx long, track_id long")
    return obs.join(hits, ["seq_id", "frame_idx", "track_id"], "left_semi")


def coexisting(obs: DataFrame, frames: int = 5, near: float = 0.6, ratio: float = 1.6, overlap: float = 0.25) -> DataFrame:
    """Pairs that share at least ``frames`` frames, are closer than half the larger height in a share of ``near`` of them, of like height at the median, and overlap.

    Pairs go by tiles. Sums choose them first; the median, which has to keep its values, is for those alone, one track with its partners at a time.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, same = tiles.sides(rows)
        shared, close, total = (np.zeros((len(a.ids), len(b.ids)), t) for t in (np.int32, np.int32, float))
        for _, _, j, boxes, parts in tiles.columned(a, b):
            there, x, y, tall = tiles.present(b, j), (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2, np.maximum(tiles.tall(boxes), 1.0)
            for part in parts:
                at, p = a.at[part], a.boxes[part].T[:, :, None]
                shared[at] += there
                total[at] += tiles.over(a.boxes[part], boxes)
                far, dy = (p[0] + p[2]) / 2 - x, (p[1] + p[3]) / 2 - y
                np.sqrt(np.add(np.multiply(far, far, out=far), np.multiply(dy, dy, out=dy), out=far), out=far)
                near_by = far <= np.multiply(np.maximum(p[3] - p[1], tall, out=dy), 0.5, out=dy)
                close[at] += np.logical_and(near_by, there, out=near_by)
        if same:
            shared = np.triu(shared, 1)
        n = np.maximum(shared, 1)
        chosen = (shared >= max(frames, 1)) & (close / n >= near) & (total / n >= overlap)
        h_a, h_b = (np.where(tiles.tall(s.boxes) > 0, tiles.tall(s.boxes), np.nan) for s in (a, b))
        for k in np.flatnonzero(chosen.any(axis=1)):
            mine, place = np.flatnonzero(a.at == k), np.full(len(b.ids), -1)
            partners = np.flatnonzero(chosen[k])
            place[partners] = np.arange(len(partners))
            at = np.searchsorted(a.frames[mine], b.frames)
            met = (a.frames[mine][np.minimum(at, len(mine) - 1)] == b.frames) & (place[b.at] >= 0)
            heights = np.full((len(mine), len(partners)), np.nan)
            heights[at[met], place[b.at[met]]] = h_b[met]
            own = h_a[mine][:, None]
            sizes = np.sort(np.maximum(heights, own) / np.minimum(heights, own), axis=0)
            known, columns = (~np.isnan(sizes)).sum(axis=0), np.arange(len(partners))
            middle = (sizes[np.maximum((known - 1) // 2, 0), columns] + sizes[np.minimum(known // 2, len(mine) - 1), columns]) / 2
            chosen[k, partners] = (known > 0) & (middle <= ratio)
        i, j = np.nonzero(chosen)
        out = {"seq_id": np.full(len(i), rows["seq_id"].iloc[0]), "a": np.minimum(a.ids[i], b.ids[j]), "b": np.maximum(a.ids[i], b.ids[j])}
        return pd.DataFrame(out | {"shared": shared[i, j].astype(np.int64), "close": close[i, j] / n[i, j], "mean_iou": total[i, j] / n[i, j]})

    return tiles.within(obs.select("seq_id", "track_id", "frame_idx", *BOX), run, "seq_id long, a long, b long, shared long, close double, mean_iou double")


TAIL = 5


def facts(obs: DataFrame) -> DataFrame:
    """Per track: number of observations, first and last frame and box, and the centres of its last ``TAIL`` places, the latest last."""
    box, at = F.struct(*BOX), "frame_idx"
    back = F.row_number().over(Window.partitionBy("seq_id", "track_id").orderBy(F.desc(at)))
    place = F.struct(F.col(at).alias("f"), g.cx().alias("x"), g.cy().alias("y"))
    e = obs.withColumn("back", back).groupBy("seq_id", "track_id").agg(
        F.count("*").alias("n"), F.min(at).alias("f0"), F.max(at).alias("f1"), F.min_by(box, at).alias("b0"), F.max_by(box, at).alias("b1"),
        F.array_sort(F.collect_list(F.when(F.col("back") <= TAIL, place))).alias("tail"),
    )
    return e.select("seq_id", "track_id", "n", "f0", "f1", *[F.col(f"{b}.{c}").alias(f"{b}_{c}") for b in ("b0", "b1") for c in BOX], "tail")


def with_speed(tracks: DataFrame, tail: int = TAIL) -> DataFrame:
    """Facts with the velocity over the last ``tail`` places (vx, vy) and the last two (ux, uy); 0 for one place."""
    last = F.element_at("tail", -1)

    def speed(k: int, c: str) -> Column:
        first = F.get("tail", F.greatest(F.size("tail") - k, F.lit(0)))
        return F.coalesce((last[c] - first[c]) / F.nullif(last["f"] - first["f"], F.lit(0)), F.lit(0.0))

    return tracks.select("*", speed(tail, "x").alias("vx"), speed(tail, "y").alias("vy"), speed(2, "x").alias("ux"), speed(2, "y").alias("uy"))


def ends(obs: DataFrame) -> DataFrame:
    """Facts of each track with its velocities."""
    return with_speed(facts(obs)).drop("tail")


@dataclass
class Places:
    """Facts and velocities of tracks as arrays; first and last boxes have four values in the last axis."""

    n: np.ndarray
    f0: np.ndarray
    f1: np.ndarray
    b0: np.ndarray
    b1: np.ndarray
    vx: np.ndarray
    vy: np.ndarray
    ux: np.ndarray
    uy: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Places:
        boxes = [rows[[f"{b}_{c}" for c in BOX]].to_numpy(float) for b in ("b0", "b1")]
        return cls(*[rows[c].to_numpy() for c in ("n", "f0", "f1")], *boxes, *[rows[c].to_numpy(float) for c in ("vx", "vy", "ux", "uy")])

    def __getitem__(self, at: object) -> Places:
        return Places(*[getattr(self, f.name)[at] for f in fields(self)])


def _middle(boxes: np.ndarray, axis: int) -> np.ndarray:
    return (boxes[..., axis] + boxes[..., axis + 2]) / 2


#: Tracks in a block where ends meet starts; a task takes the ends a stripe at a time.
ENDS = 4096


def met_ends(tracks: DataFrame, starts: DataFrame, gaps: tuple[int, int], judged: Callable[[Places, Places, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], told: tuple[str, ...] = ("dist",)) -> DataFrame:
    """(seq_id, a, b, gap, ``told``): pairs of one sequence where b (of ``starts``) starts ``gaps`` (least, most) frames after the end of a (of ``tracks``), and ``judged`` says that they fit.

    Both sides (see ``with_speed``) meet in tiles; only what fits leaves a task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ended, started = (rows[rows[c]].sort_values([f, "track_id"]) for c, f in (("in_p", "f1"), ("in_q", "f0")))
        a, b, found = Places.of(ended), Places.of(started), []
        for part in tiles.stripes(len(ended)):
            near = slice(*np.searchsorted(b.f0, [a.f1[part][0] + gaps[0], a.f1[part][-1] + gaps[1] + 1]))
            gap = b.f0[near][None] - a.f1[part][:, None]
            fits, more = judged(a[part][:, None], b[near][None], gap)
            i, j = np.nonzero(fits & (gap >= gaps[0]) & (gap <= gaps[1]) & (ended["track_id"].to_numpy()[part][:, None] != started["track_id"].to_numpy()[near]))
            found.append([ended["track_id"].to_numpy()[part][i], started["track_id"].to_numpy()[near][j], gap[i, j], *[np.broadcast_to(more[c], gap.shape)[i, j] for c in told]])
        columns = [np.concatenate([f[k] for f in found]) if found else [] for k in range(3 + len(told))]
        return pd.DataFrame({"seq_id": rows["seq_id"].iloc[0], **dict(zip(("a", "b", "gap", *told), columns, strict=True))})

    side = lambda df: df.select("seq_id", "track_id", *["n", "f0", "f1"], *[f"{b}_{c}" for b in ("b0", "b1") for c in BOX], "vx", "vy", "ux", "uy")
    return tiles.between(side(tracks), side(starts), run, "seq_id long, a long, b long, gap long" + "".join(f", {c} double" for c in told), ENDS)


@dataclass(frozen=True)
class Stitching:
    """When a broken track goes on as another: the other starts near its last place or where its velocity leads.

    Radii are shares of a's height (``near``, ``ahead``; all of it for a gap of at most ``short`` frames), but not under
    a share of ``radius`` pixels. Heights are alike, the speed over the gap is possible, and after a longer gap
    tracks that both move do not move against each other. Tracks that last to the end do not go on.
    """

    total_frames: int
    most: int = 60
    near: float = 0.5
    ahead: float = 0.75
    radius: float = 120.0
    short: int = 20
    ratio: float = 1.6
    speed: float = 0.25

    #: Whether a link depends on what b becomes after its start.
    later = True

    @property
    def gaps(self) -> tuple[int, int]:
        return 1, self.most

    def judged(self, a: Places, b: Places, gap: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which of the tracks in step go on as which (a's end, b's start), with ``dist`` from the last place and ``missed`` from where the velocity leads."""
        h, hb, soon = tiles.tall(a.b1), tiles.tall(b.b0), gap <= self.short
        moves, pace = (a.vx != 0) | (a.vy != 0), lambda t: np.sqrt(t.vx * t.vx + t.vy * t.vy)
        last = np.where(h > 0, np.maximum(self.near * h, 0.5 * self.radius), self.radius)
        led = np.where(moves & (h > 0), np.maximum(self.ahead * h, 0.75 * self.radius), last)
        at_once = np.where(h > 0, np.maximum(h, self.radius), last)
        alike = (h <= 0) | (hb <= 0) | (np.maximum(h, hb) / np.where(np.minimum(h, hb) == 0, 1.0, np.minimum(h, hb)) <= self.ratio)
        dx, dy = _middle(b.b0, 0) - _middle(a.b1, 0), _middle(b.b0, 1) - _middle(a.b1, 1)
        mx, my = _middle(b.b0, 0) - (_middle(a.b1, 0) + a.vx * gap), _middle(b.b0, 1) - (_middle(a.b1, 1) + a.vy * gap)
        dist, missed = np.sqrt(dx * dx + dy * dy), np.sqrt(mx * mx + my * my)
        fits = alike & (a.f1 < self.total_frames - 1) & (dist / np.maximum(gap, 1) <= np.maximum(self.speed * h, 30.0))
        fits &= (dist <= np.where(soon, at_once, last)) | (missed <= np.where(soon, at_once, led))
        fits &= np.minimum(dist, missed) < np.maximum(last, led) + 1.0
        against = ~soon & moves & (b.n >= 3) & (pace(a) > 1) & (pace(b) > 1) & (a.vx * b.vx + a.vy * b.vy < 0)
        return fits & ~against, {"dist": dist, "missed": missed}


@dataclass(frozen=True)
class Waking:
    """When a track wakes as another: more than ``least`` empty frames between, and the last box, moved on by the last velocity, near b's first and over it.

    Tracks with one observation have no velocity and do not wake; near is ``sigma`` diagonals of b's box.
    """

    least: int = 90
    most: int = 150
    sigma: float = 2.0
    overlap: float = 0.2

    later = False

    @property
    def gaps(self) -> tuple[int, int]:
        return self.least + 2, self.most + 1

    def judged(self, a: Places, b: Places, gap: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which of the tracks in step wake as which, with ``dist`` from where the last velocity leads and the ``iou`` there."""
        dx, dy = _middle(b.b0, 0) - (_middle(a.b1, 0) + a.ux * gap), _middle(b.b0, 1) - (_middle(a.b1, 1) + a.uy * gap)
        missed, w, h = np.sqrt(dx * dx + dy * dy), b.b0[..., 2] - b.b0[..., 0], tiles.tall(b.b0)
        both = np.nan_to_num(tiles.iou(a.b1 + np.stack(np.broadcast_arrays(a.ux * gap, a.uy * gap) * 2, axis=-1), b.b0))
        fits = (a.n >= 2) & (missed <= self.sigma * np.maximum(np.sqrt(w * w + h * h), 1.0)) & (both >= self.overlap)
        return fits, {"dist": missed, "iou": both}


def stitch_candidates(obs: DataFrame, total_frames: int, **rule: float) -> DataFrame:
    """(seq_id, a, b, gap, dist, missed): broken tracks that may go on (see ``Stitching``)."""
    rule, tracks = Stitching(total_frames, **rule), ends(obs)
    return met_ends(tracks, tracks, rule.gaps, rule.judged, ("dist", "missed"))


def dormant_candidates(obs: DataFrame, least: int = 90, most: int = 150, sigma: float = 2.0, overlap: float = 0.2) -> DataFrame:
    """(seq_id, a, b, gap of empty frames, dist, iou): tracks that may wake as another (see ``Waking``)."""
    rule, tracks = Waking(least, most, sigma, overlap), ends(obs)
    return met_ends(tracks, tracks, rule.gaps, rule.judged, ("dist", "iou")).withColumn("gap", F.col("gap") - 1)


def global_candidates(obs: DataFrame, most: int = 30, share: float = 0.35, size: tuple[float, float] = (1920.0, 1080.0)) -> DataFrame:
    """Ended tracks and starts at most ``most`` empty frames later, nearer than a share of the picture's diagonal."""
    far, tracks = share * (size[0] ** 2 + size[1] ** 2) ** 0.5, ends(obs)

    def judged(a: Places, b: Places, gap: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        dist = tiles.distance(a.b1, b.b0)
        return dist <= far, {"dist": dist}

    return met_ends(tracks, tracks, (1, most + 1), judged).withColumn("gap", F.col("gap") - 1)


def best_link(candidates: DataFrame, first: str = "gap") -> DataFrame:
    """Per ended track the start with the smallest gap (or distance, if ``first`` says so), then the smaller id."""
    return candidates.groupBy("seq_id", "a").agg(F.min_by(F.struct("b", "gap", "dist"), F.struct(first, "b")).alias("m")).select("seq_id", "a", "m.b", "m.gap", "m.dist")


#: Tracks in a block where those that never share a frame meet, with all their places; a task takes them a stripe at a time.
WHOLE = 8192


def complementary(obs: DataFrame, near: float = 0.5, speed: float = 0.25, ratio: float = 1.6) -> DataFrame:
    """(seq_id, a, b, boundaries, farthest): pairs of tracks (a < b) that never share a frame and are near wherever one takes over from the other.

    At each boundary of their union in time heights are alike by ``ratio`` (up to 2), centres no farther apart than ``near`` times the larger height, and the speed
    over the gap is possible. Boxes without height take over from none.

    Tracks meet in tiles, a row for each with its places: an end with a start after it is one boundary; tracks that lie in each other's gaps (their frames as
    bits tell which) are gone through place by place. Only what fits leaves a task.
    """

    def fits(gap: np.ndarray, far: np.ndarray, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        tall = np.maximum(np.maximum(h, k), 1.0)
        alike = (h > 0) & (k > 0) & (np.maximum(h, k) <= ratio * np.minimum(h, k))
        return alike & (far <= near * tall) & (far / np.maximum(gap, 1) <= np.maximum(speed * tall, 30.0))

    def turns(p: np.ndarray, q: np.ndarray) -> tuple[int, float] | None:
        """Boundaries of two tracks' places (frame, x, y, h) and the farthest, if all fit."""
        rows = np.concatenate([p, q])
        who = np.repeat([0, 1], [len(p), len(q)])
        order = np.argsort(rows[:, 0], kind="stable")
        rows, who = rows[order], who[order]
        at = np.flatnonzero(np.diff(who)) + 1
        f, x, y, h = (rows[at] - rows[at - 1]).T[0], *(rows[at] - rows[at - 1]).T[1:3], rows[at, 3]
        far = np.sqrt(x * x + y * y)
        return (len(at), far.max()) if fits(f, far, h, rows[at - 1, 3]).all() else None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("f0", kind="stable").reset_index(drop=True)
        ids, f0, f1, places = rows["track_id"].to_numpy(), rows["f0"].to_numpy(), rows["f1"].to_numpy(), [np.array([p["f"], p["x"], p["y"], p["h"]], float).T for p in rows["places"]]
        first, last = (np.stack([p[k] for p in places]) for k in (0, -1))
        known, at = np.unique(np.concatenate([p[:, 0] for p in places]), return_inverse=True)
        bits = np.zeros((len(rows), -(-len(known) // 64)), np.uint64)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(rows)), [len(p) for p in places]), at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        flat, begin = np.concatenate(places), np.cumsum([0, *map(len, places)])
        ins, found = [np.flatnonzero(rows[c]) for c in ("in_p", "in_q")], []
        same = bool((rows["in_p"] & rows["in_q"]).any())

        def keep(i: np.ndarray, j: np.ndarray, n: np.ndarray, far: np.ndarray) -> None:
            found.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), n, far))

        for mine, other in [(ins[0], ins[1])] if same else [(ins[0], ins[1]), (ins[1], ins[0])]:
            for part in tiles.stripes(len(mine)):
                # The stripe's tracks come first; starts are in order.
                p, q = mine[part], other[np.searchsorted(f0[other], f1[mine[part]].min(), "right") :]
                gap, x, y = f0[q] - f1[p][:, None], first[q, 1] - last[p, 1][:, None], first[q, 2] - last[p, 2][:, None]
                far = np.sqrt(x * x + y * y)
                i, j = np.nonzero((gap > 0) & fits(gap, far, first[q, 3], last[p, 3][:, None]))
                keep(p[i], q[j], np.ones(len(i), int), far[i, j])
                # Those that start later, but before the end: in gaps only. Of two that start together one would share that frame.
                q = other[slice(*np.searchsorted(f0[other], [f0[p].min(), f1[p].max()], "right"))]
                spot = np.zeros((len(known), p.max() - p.min() + 1), int)
                for k in p:
                    spot[:, k - p.min()] = begin[k] + np.searchsorted(places[k][:, 0], known, "right") - 1
                free = (f0[q] > f0[p][:, None]) & (f0[q] < f1[p][:, None])
                for word in bits.T:
                    free &= (word[p][:, None] & word[q]) == 0
                i, j = np.nonzero(free)
                # The first boundary is tried for all at once: the latest place before the other's start.
                taken = spot[np.searchsorted(known, f0[q[j]]) - 1, p[i] - p.min()] if len(i) else i
                was = flat[taken]
                x, y = first[q[j], 1] - was[:, 1], first[q[j], 2] - was[:, 2]
                begins = fits(f0[q[j]] - was[:, 0], np.sqrt(x * x + y * y), first[q[j], 3], was[:, 3])
                for i, j in zip(i[begins], j[begins], strict=True):
                    told = turns(places[p[i]], places[q[j]])
                    if told:
                        keep(p[[i]], q[[j]], np.array([told[0]]), np.array([told[1]]))
        columns = [np.concatenate([f[k] for f in found]) if found else [] for k in range(4)]
        return pd.DataFrame({"seq_id": rows["seq_id"].iloc[0], **dict(zip(("a", "b", "boundaries", "farthest"), columns, strict=True))})

    place = F.struct(F.col("frame_idx").alias("f"), g.cx().alias("x"), g.cy().alias("y"), g.height().alias("h"))
    listed = obs.groupBy("seq_id", "track_id").agg(F.array_sort(F.collect_list(place)).alias("places"))
    apart = F.struct(*[F.col(f"places.{c}").alias(c) for c in "fxyh"])
    tracks = listed.select("seq_id", "track_id", F.col("places.f")[0].alias("f0"), F.element_at("places.f", -1).alias("f1"), apart.alias("places"))
    return tiles.within(tracks, run, "seq_id long, a long, b long, boundaries long, farthest double", WHOLE)


def id_votes(forward: DataFrame, backward: DataFrame, overlap: float = 0.45, least: int = 4) -> DataFrame:
    """Per backward track the forward track that it overlaps in most frames, if in at least ``least``.

    Votes are counted by tiles; of each a backward track keeps its best one.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, _ = tiles.sides(rows)
        votes = np.zeros((len(a.ids), len(b.ids)), np.int32)
        for _, _, j, boxes, parts in tiles.columned(a, b):
            there = tiles.present(b, j)
            for part in parts:
                hits = tiles.over(a.boxes[part], boxes) >= overlap
                votes[a.at[part]] += np.logical_and(hits, there, out=hits)
        best = votes.argmax(axis=0) if votes.size else np.zeros(0, int)
        told = np.flatnonzero(votes[best, np.arange(len(best))] >= max(least, 1))
        return pd.DataFrame({"seq_id": np.full(len(told), rows["seq_id"].iloc[0]), "backward_id": b.ids[told], "forward_id": a.ids[best[told]], "votes": votes[best[told], told].astype(np.int64)})

    sides = (df.select("seq_id", "track_id", "frame_idx", *BOX) for df in (forward, backward))
    votes = tiles.between(*sides, run, "seq_id long, backward_id long, forward_id long, votes long")
    best = Window.partitionBy("seq_id", "backward_id").orderBy(F.desc("votes"), "forward_id")
    return votes.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def merge_keep_first(*passes: DataFrame) -> DataFrame:
    """Union of passes; of rows for one track and frame the earliest pass stays."""
    rows = passes[0].withColumn("_pass", F.lit(0))
    for k, p in enumerate(passes[1:], 1):
        rows = rows.unionByName(p.withColumn("_pass", F.lit(k)))
    first = Window.partitionBy("seq_id", "track_id", "frame_idx").orderBy("_pass")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_pass")


def merged_passes(forward: DataFrame, backward: DataFrame, overlap: float = 0.45, least: int = 4) -> DataFrame:
    """Both passes as one: a backward track takes the id of the forward track that it votes for and adds the frames that this lacks.

    Backward tracks without one keep their observations under new ids, in order of theirs, after the largest forward id of
    the sequence. Of two backward rows for one frame of a forward track the smaller backward id stays.
    """
    names = id_votes(forward, backward, overlap, least).select("seq_id", F.col("backward_id").alias("track_id"), F.col("forward_id").alias("named"))
    back = backward.join(names, ["seq_id", "track_id"], "left")
    lone = back.where("named is null").select("seq_id", "track_id").distinct()
    top = forward.groupBy("seq_id").agg(F.max("track_id").alias("top"))
    fresh = lone.withColumn("k", F.row_number().over(Window.partitionBy("seq_id").orderBy("track_id"))).join(top, "seq_id", "left")
    fresh = fresh.select("seq_id", "track_id", (F.coalesce("top", F.lit(0)) + F.col("k")).alias("fresh"))
    columns = ["seq_id", "track_id", "frame_idx", *BOX, "conf"]
    added = back.join(fresh, ["seq_id", "track_id"], "left").withColumn("own", F.coalesce("named", "fresh"))
    first = Window.partitionBy("seq_id", "own", "frame_idx").orderBy("track_id")
    added = added.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("seq_id", F.col("own").alias("track_id"), *columns[2:])
    return merge_keep_first(forward.select(*columns), added)
