"""Pairs of tracks by tiles, where a row for each pair and frame would be too many.

The tracks of a sequence are dealt into blocks, and each two blocks meet in a task. It goes through their frames in order and keeps one value for
each pair, as a matrix; only what is found leaves it. So the shuffle carries the observations once for each block, and no pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]
#: Tracks and observations that meet at once should be at most.
TRACKS, ROWS = 1024, 1 << 18
#: Blocks that a sequence is dealt into (each observation is shuffled once for each of them), as long as none has more rows than that. A task goes
#: through larger blocks part by part, so that the copies don't grow with the tracks.
SPREAD, LARGE = 6, 1 << 19


def _dealt(obs: DataFrame, tracks: int | None = None, spread: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations with their block and its ``part``, and each sequence's number of blocks."""
    parts = F.greatest(F.ceil(F.count("*") / (tracks or TRACKS)), F.ceil(F.sum("n") / ROWS))
    size = obs.groupBy("seq_id", "track_id").agg(F.count("*").alias("n")).groupBy("seq_id").agg(parts.alias("parts"), F.greatest(F.least(parts, F.lit(spread or SPREAD)), F.ceil(F.sum("n") / LARGE)).cast("int").alias("blocks"))
    size = size.withColumn("parts", F.ceil(F.col("parts") / F.col("blocks")).cast("int"))
    slot = F.pmod(F.xxhash64("track_id"), F.col("blocks") * F.col("parts")).cast("int")
    dealt = obs.join(F.broadcast(size), "seq_id").withColumn("_slot", slot).withColumns({"block": F.floor(F.col("_slot") / F.col("parts")).cast("int"), "part": F.col("_slot") % F.col("parts")})
    return dealt.drop("blocks", "parts", "_slot"), size.drop("parts")


def with_next(obs: DataFrame) -> DataFrame:
    """Observations with the sequence's next frame that has any, ``follows`` (-1: none)."""
    frames = obs.select("seq_id", "frame_idx").distinct()
    frames = frames.withColumn("follows", F.coalesce(F.lead("frame_idx").over(Window.partitionBy("seq_id").orderBy("frame_idx")), F.lit(-1)))
    return obs.join(frames, ["seq_id", "frame_idx"])


def _by_parts(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` on each two parts of a tile's blocks, one after another; what it finds leaves the task at once."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        part, in_p, in_q = rows.pop("part").to_numpy(), rows["in_p"].to_numpy(), rows["in_q"].to_numpy()
        same, place = bool((in_p & in_q).any()), np.arange(len(rows))
        p, q = ({k: place[side & (part == k)] for k in np.unique(part[side])} for side in (in_p, in_q))
        for s, left in p.items():
            for t, right in q.items():
                if same and s >= t:
                    told = run(rows.iloc[left]) if s == t else None
                else:
                    two = rows.iloc[np.concatenate([left, right])]
                    first = np.arange(len(two)) < len(left)
                    told = run(two.assign(in_p=first, in_q=~first))
                if told is not None and len(told):
                    yield told

    return whole


def within(obs: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tracks: int | None = None, spread: int | None = None) -> DataFrame:
    """``run`` on each two parts (those in ``p`` and those in ``q``) of a sequence, of at most ``tracks`` tracks (else ``TRACKS``), dealt into ``spread`` blocks (else ``SPREAD``); see ``sides``."""
    dealt, size = _dealt(obs, tracks, spread)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = dealt.join(F.broadcast(size), "seq_id").withColumn("_other", other).withColumns({"p": F.least("block", "_other"), "q": F.greatest("block", "_other"), "in_p": F.col("block") <= F.col("_other"), "in_q": F.col("block") >= F.col("_other")})
    return rows.drop("blocks", "block", "_other").groupBy("seq_id", "p", "q").applyInPandas(_by_parts(run), schema)


def between(left: DataFrame, right: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tracks: int | None = None) -> DataFrame:
    """``run`` on each part of ``left`` with each of ``right`` in a sequence, of at most ``tracks`` tracks (else ``TRACKS``)."""
    (a, n_a), (b, n_b) = _dealt(left, tracks), _dealt(right, tracks)
    spread = lambda df, n, own, other: df.join(F.broadcast(n), "seq_id").withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumnRenamed("block", own)
    rows = spread(a, n_b, "p", "q").withColumns({"in_p": F.lit(True), "in_q": F.lit(False)}).unionByName(spread(b, n_a, "q", "p").withColumns({"in_p": F.lit(False), "in_q": F.lit(True)}))
    return rows.groupBy("seq_id", "p", "q").applyInPandas(_by_parts(run), schema)


class Side:
    """One block's tracks in a tile: their ids in order, and what of them is in a frame."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("frame_idx", kind="stable")
        self.ids, self.at = np.unique(rows["track_id"].to_numpy(), return_inverse=True)
        self.frames, self.boxes, self.rows = rows["frame_idx"].to_numpy(), rows[BOX].to_numpy(float), rows

    def of(self, frame: int) -> slice:
        return slice(*np.searchsorted(self.frames, [frame, frame + 1]))


def sides(rows: pd.DataFrame) -> tuple[Side, Side, bool]:
    """Both blocks of a tile, and whether they are the same one, in which pairs count once."""
    return Side(rows[rows["in_p"]]), Side(rows[rows["in_q"]]), bool((rows["in_p"] & rows["in_q"]).any())


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (last axis) in step; nan for two empty boxes."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    both = np.maximum(0.0, w) * np.maximum(0.0, h)
    union = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]) + (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1]) - both
    return np.divide(both, union, out=np.full_like(both, np.nan), where=union != 0)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``iou`` of each of ``a`` with each of ``b``."""
    return iou(a[:, None, :], b[None, :, :])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between centres (last axis: box) in step."""
    dx, dy = (a[..., 0] + a[..., 2]) / 2 - (b[..., 0] + b[..., 2]) / 2, (a[..., 1] + a[..., 3]) / 2 - (b[..., 1] + b[..., 3]) / 2
    return np.sqrt(dx * dx + dy * dy)


def tall(boxes: np.ndarray) -> np.ndarray:
    return boxes[..., 3] - boxes[..., 1]


#: Boxes of a frame that meet all others at once, and neighbours in order that are tried before.
STRIPE, NEIGHBOURS = 128, 16


def stripes(n: int) -> Iterator[slice]:
    for first in range(0, n, STRIPE):
        yield slice(first, min(first + STRIPE, n))


def lonely(boxes: np.ndarray, meets: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Places of the boxes of a frame that may meet none: neighbours in order of x that meet are left out, as where a frame is crowded almost all of them are.

    ``meets`` (a, b) says in step whether a meets b.
    """
    order, left = np.argsort(boxes[:, 0], kind="stable"), np.ones(len(boxes), bool)
    for step in range(1, min(NEIGHBOURS, len(boxes) - 1) + 1):
        low, high = order[:-step], order[step:]
        left[low[meets(boxes[low], boxes[high])]] = False
        left[high[meets(boxes[high], boxes[low])]] = False
    return np.flatnonzero(left)


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``overlap``, but 0 where boxes don't meet; in place, as this is done for each two boxes of a frame."""
    a, b = a.T[:, :, None], b.T
    both = np.minimum(a[2], b[2])
    other = np.maximum(a[0], b[0])
    np.fmax(np.subtract(both, other, out=both), 0.0, out=both)
    tall = np.minimum(a[3], b[3])
    np.fmax(np.subtract(tall, np.maximum(a[1], b[1], out=other), out=tall), 0.0, out=tall)
    np.multiply(both, tall, out=both)
    np.add((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]), out=other)
    np.fmax(np.subtract(other, both, out=other), 1e-300, out=other)
    return np.divide(both, other, out=both)


def cached(n: int, wide: int) -> Iterator[slice]:
    """Rows whose pairs with ``wide`` others stay in a core's cache."""
    step = max(1, (1 << 16) // max(wide, 1))
    for first in range(0, n, step):
        yield slice(first, min(first + step, n))


def columned(rows_of: Side, columns_of: Side) -> Iterator[tuple[int, slice, slice, np.ndarray, list[slice]]]:
    """In order of frames that both sides have: frame, rows of both sides in it, a box for each track of the second side (empty where it is not there), and the first side's rows some at a time."""
    for frame in np.intersect1d(rows_of.frames, columns_of.frames):
        i, j = rows_of.of(frame), columns_of.of(frame)
        boxes = np.zeros((len(columns_of.ids), 4))
        boxes[columns_of.at[j]] = columns_of.boxes[j]
        yield int(frame), i, j, boxes, [slice(i.start + part.start, i.start + part.stop) for part in cached(i.stop - i.start, len(boxes))]


def present(side: Side, rows: slice) -> np.ndarray:
    """Which of a side's tracks have one of some rows."""
    there = np.zeros(len(side.ids), bool)
    there[side.at[rows]] = True
    return there
