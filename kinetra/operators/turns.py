"""Links of ends with starts near them that are taken one after another, where a table of all links would grow with the square of the tracks.

As each link depends on those before it, a task takes one sequence: a row for each track with its first and last place and its frames. Links are made
from cells of the picture where they are asked for, at most ``PAIRS`` at once, so memory grows with the tracks and not with the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.functions import geometry as g

#: Pairs of an end and a start that are looked at together, and links that are kept to be sorted.
PAIRS, KEPT = 1 << 21, 1 << 21


def places(obs: DataFrame) -> DataFrame:
    """Per track: first and last frame and centre, and its frames."""
    at = "frame_idx"
    e = obs.withColumn("_c", F.struct(g.cx().alias("x"), g.cy().alias("y"))).groupBy("seq_id", "track_id").agg(F.min(at).alias("f0"), F.max(at).alias("f1"), F.min_by("_c", at).alias("c0"), F.max_by("_c", at).alias("c1"), F.collect_set(at).alias("frames"))
    return e.select("seq_id", F.col("track_id").alias("node"), "f0", "f1", *[F.col(f"{c}.{v}").alias(f"{v}{c[1]}") for c in ("c0", "c1") for v in "xy"], "frames")


class Groups:
    """Groups of tracks (by their places) and the frames that each holds; groups that share a frame stay apart."""

    def __init__(self, frames: list[np.ndarray]) -> None:
        n, sizes = len(frames), [len(f) for f in frames]
        known, at = np.unique(np.concatenate(frames), return_inverse=True)
        self.bits = np.zeros((n, -(-len(known) // 64)), np.uint64)
        np.bitwise_or.at(self.bits, (np.repeat(np.arange(n), sizes), at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        self.held = [int.from_bytes(row.tobytes(), "little") for row in self.bits.astype("<u8")]
        self.root, self.members = np.arange(n), [[k] for k in range(n)]

    def free(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs in step are in groups that may still be joined."""
        a, b = self.root[a], self.root[b]
        both = a != b
        for word in self.bits.T:
            both &= (word[a] & word[b]) == 0
        return both

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the groups of each pair in turn, if they may be."""
        left = self.free(a, b)
        root, held = self.root, self.held
        for x, y in zip(a[left].tolist(), b[left].tolist(), strict=True):
            p, q = int(root[x]), int(root[y])
            if p != q and not held[p] & held[q]:
                p, q = min(p, q), max(p, q)
                held[p] |= held[q]
                self.bits[p] |= self.bits[q]
                root[self.members[q]] = p
                self.members[p] += self.members[q]


def _near(x: np.ndarray, y: np.ndarray, to_x: np.ndarray, to_y: np.ndarray, radius: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (in order of the first side) among which are all that are not farther apart than ``radius``: those of cells that touch, ``most`` or one's own at once."""
    if not len(x) or not len(to_x):
        return
    cell = lambda v: np.floor(v / radius).astype(np.int64)
    cx, cy, tx, ty = cell(x), cell(y), cell(to_x), cell(to_y)
    low, wide = min(cx.min(), tx.min()) - 1, max(cx.max(), tx.max()) - min(cx.min(), tx.min()) + 3
    key = ty * wide + tx - low
    order = np.argsort(key, kind="stable")
    key = key[order]
    rows = (cy[:, None] + np.array([-1, 0, 1])) * wide + (cx - low)[:, None]
    first, n = np.searchsorted(key, rows - 1), np.searchsorted(key, rows + 1, "right")
    n -= first
    total, begin = np.cumsum(n.sum(axis=1)), 0
    while begin < len(x):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
        sizes = n[begin:end].ravel()
        i = np.repeat(np.repeat(np.arange(begin, end), 3), sizes)
        j = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[begin:end].ravel(), sizes)
        yield i, order[j]
        begin = end


def merged_near(obs: DataFrame, most: int, far: float, steps: float = 4.0, pairs: int = PAIRS, kept: int = KEPT) -> DataFrame:
    """(seq_id, node, root): tracks merged along the links from an end to a start at most ``most`` empty frames later and not farther than ``far``, never two groups that share a frame.

    The shortest link is taken first, lengths by whole ``steps`` of a pixel, ties by a and b. It is what ``merged_apart`` gives for the table of these links; here
    they are made by bands of their length, and only those that the groups so far still allow are kept and sorted. A band with too many is halved.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        groups = Groups(list(rows["frames"]))
        f0, f1, x0, y0, x1, y1 = (rows[c].to_numpy() for c in ("f0", "f1", "x0", "y0", "x1", "y1"))

        def band(first: int, last: int) -> bool:
            """Takes the links of ``first`` to ``last`` - 1 steps, unless they are too many to be sorted at once; those of one step are in order already."""
            found, size = [], 0
            for i, j in _near(x1, y1, x0, y0, last / steps, pairs):
                gap = f0[j] - f1[i]
                ok = (gap >= 1) & (gap <= most + 1) & (i != j)
                i, j = i[ok], j[ok]
                dx, dy = x1[i] - x0[j], y1[i] - y0[j]
                dist = np.sqrt(dx * dx + dy * dy)
                step = np.floor(dist * steps)
                ok = (dist <= far) & (step >= first) & (step < last)
                i, j, step = i[ok], j[ok], step[ok]
                ok = groups.free(i, j)
                found.append((step[ok], i[ok], j[ok]))
                size += int(ok.sum())
                if size > kept:
                    if last - first > 1:
                        return False
                    take(found)
                    found, size = [], 0
            take(found)
            return True

        def take(found: list[tuple[np.ndarray, ...]]) -> None:
            if found:
                step, i, j = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((j, i, step))
                groups.join(i[order], j[order])

        at, wide, end = 0, 1, int(np.floor(far * steps)) + 1
        while at < end:
            while not band(at, min(at + wide, end)):
                wide = max(wide // 2, 1)
            at, wide = at + wide, 2 * wide
        node = rows["node"].to_numpy()
        return pd.DataFrame({"seq_id": rows["seq_id"], "node": node, "root": node[groups.root]})

    return places(obs).groupBy("seq_id").applyInPandas(run, "seq_id long, node long, root long")


def merged_links(obs: DataFrame, links: DataFrame) -> DataFrame:
    """(seq_id, node, root): tracks merged along ``links`` (seq_id, a, b, weight), heaviest first, ties by a and b, never two groups that share a frame; a task holds a sequence's tracks and links."""

    def run(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c: [] for c in ("seq_id", "node", "root")})
        rows = rows.sort_values("node", ignore_index=True)
        node, groups = rows["node"].to_numpy(), Groups(list(rows["frames"]))
        given = given[(given["a"] != given["b"]) & given["a"].isin(node) & given["b"].isin(node)].sort_values(["weight", "a", "b"], ascending=[False, True, True])
        groups.join(np.searchsorted(node, given["a"]), np.searchsorted(node, given["b"]))
        return pd.DataFrame({"seq_id": rows["seq_id"], "node": node, "root": node[groups.root]})

    mine = links.select(F.col("seq_id").alias("of_seq"), "a", "b", "weight").groupBy("of_seq")  # another name, as both may come of the same rows
    return places(obs).groupBy("seq_id").cogroup(mine).applyInPandas(run, "seq_id long, node long, root long")


def layers_near(obs: DataFrame, most: int, far: float, pairs: int = PAIRS) -> DataFrame:
    """(seq_id, node, layer): tracks after all whose end leads to their start, at most ``most`` empty frames later and not farther than ``far``; from 0.

    Links lead on in time, so a sequence's starts are taken frame by frame. It is what ``layers`` gives for the table of these links.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("f0", kind="stable", ignore_index=True)
        f0, f1, x0, y0, x1, y1 = (rows[c].to_numpy() for c in ("f0", "f1", "x0", "y0", "x1", "y1"))
        layer, ended = np.zeros(len(rows), np.int64), np.argsort(f1, kind="stable")
        ends = f1[ended]
        for frame in np.unique(f0):
            begun = np.arange(*np.searchsorted(f0, [frame, frame + 1]))
            before = ended[slice(*np.searchsorted(ends, [frame - most - 1, frame]))]
            for i, j in _near(x0[begun], y0[begun], x1[before], y1[before], far, pairs):
                i, j = begun[i], before[j]
                dx, dy = x1[j] - x0[i], y1[j] - y0[i]
                ok = np.sqrt(dx * dx + dy * dy) <= far
                np.maximum.at(layer, i[ok], layer[j[ok]] + 1)
        return pd.DataFrame({"seq_id": rows["seq_id"], "node": rows["node"], "layer": layer})

    return places(obs).groupBy("seq_id").applyInPandas(run, "seq_id long, node long, layer int")


def taken_near(ended: DataFrame, starts: DataFrame, most: int, scale: float, least: float) -> DataFrame:
    """(seq_id, a, b, gap, sim, b_f1): ended tracks (seq_id, a, end, x, y) take, in order of their ids, the most similar start (seq_id, b, f0, b_f1, x, y) left, of equals the smaller id.

    Similar is 1 / (1 + distance / ``scale``), ``least`` at least; a start is at most ``most`` frames after the end. It is what the candidates' table
    gives in ``links.forward_reverse``, but an end looks only at the starts in the cells around it.
    """
    radius = scale * (1 / least - 1) * (1 + 1e-9)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right, told = left.sort_values("a"), right.sort_values("b"), []
        if len(left) and len(right):
            cell = lambda v: np.floor(v / radius).astype(np.int64)
            cx, cy, tx, ty = cell(left["x"].to_numpy()), cell(left["y"].to_numpy()), cell(right["x"].to_numpy()), cell(right["y"].to_numpy())
            low, wide = min(cx.min(), tx.min()) - 1, max(cx.max(), tx.max()) - min(cx.min(), tx.min()) + 3
            key = ty * wide + tx - low
            order = np.argsort(key, kind="stable")
            b, f0, last, x, y = (right[c].to_numpy()[order] for c in ("b", "f0", "b_f1", "x", "y"))
            rows = (cy[:, None] + np.array([-1, 0, 1])) * wide + (cx - low)[:, None]
            spans = np.stack([np.searchsorted(key[order], rows - 1), np.searchsorted(key[order], rows + 1, "right")], axis=-1).tolist()
            free = np.ones(len(b), bool)
            for a, end, ax, ay, mine in zip(left["a"].tolist(), left["end"].tolist(), left["x"].tolist(), left["y"].tolist(), spans, strict=True):
                best = None
                for s in (slice(*m) for m in mine if m[0] < m[1]):
                    gap, dx, dy = f0[s] - end, ax - x[s], ay - y[s]
                    sim = np.where(free[s] & (gap >= 0) & (gap <= most), 1 / (1 + np.sqrt(dx * dx + dy * dy) / scale), -1.0)
                    top = sim.max()
                    if top >= least:
                        equal = np.flatnonzero(sim == top) + s.start
                        at = int(equal[b[equal].argmin()])
                        if best is None or (-top, b[at]) < best[:2]:
                            best = (-top, b[at], at)
                if best is not None:
                    at = best[2]
                    free[at] = False
                    told.append((left["seq_id"].iloc[0], a, b[at], f0[at] - end, -best[0], last[at]))
        return pd.DataFrame(told, columns=["seq_id", "a", "b", "gap", "sim", "b_f1"])

    other = starts.select(F.col("seq_id").alias("of_seq"), "b", "f0", "b_f1", "x", "y").groupBy("of_seq")  # another name, as both may come of the same rows
    return ended.select("seq_id", "a", "end", "x", "y").groupBy("seq_id").cogroup(other).applyInPandas(run, "seq_id long, a long, b long, gap long, sim double, b_f1 long")
