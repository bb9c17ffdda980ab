"""Camera geometry of joints: normalisation, joint layouts, mirroring, rotation, unprojection and angles in space.

A pose is one row with an array ``kp`` of 17 joints (see ``pose.wide``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Joints of the left and right side that change places in a mirror.
LEFT, RIGHT = (1, 3, 5, 7, 9, 11, 13, 15), (2, 4, 6, 8, 10, 12, 14, 16)
#: Places of the limbs' joints in the layout with a pelvis, and the joints they come from.
PELVIS_AT, PELVIS_FROM = (9, 11, 14, 12, 15, 13, 16, 4, 1, 5, 2, 6, 3), (0, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)


def _at(j: int, c: str, kp: str = "kp") -> Column:
    return F.col(kp)[j][c]


def _mean(joints: tuple[int, ...], c: str) -> Column:
    return sum((_at(j, c) for j in joints), F.lit(0.0)) / len(joints)


def on_screen(x: Column, y: Column, width: float, height: float) -> tuple[Column, Column]:
    """x to -1 .. 1, y by the same scale."""
    return x / width * 2.0 - 1.0, y / width * 2.0 - height / width


def from_screen(x: Column, y: Column, width: float, height: float) -> tuple[Column, Column]:
    return (x + 1.0) * width / 2.0, (y + height / width) * width / 2.0


def per_person(poses: DataFrame) -> DataFrame:
    """Joints about the middle of the hips, in 1.2 times the larger side of their extent (1 at least), times 2."""
    span = lambda c: F.array_max(F.transform("kp", lambda k: k[c])) - F.array_min(F.transform("kp", lambda k: k[c]))
    scale = F.greatest(F.greatest(span("x"), span("y")) * 1.2, F.lit(1.0))
    rows = poses.withColumns({"_cx": _mean((11, 12), "x"), "_cy": _mean((11, 12), "y"), "_scale": scale})
    moved = F.transform("kp", lambda k: F.struct(k["j"].alias("j"), ((k["x"] - F.col("_cx")) / F.col("_scale") * 2.0).alias("x"), ((k["y"] - F.col("_cy")) / F.col("_scale") * 2.0).alias("y"), k["s"].alias("s")))
    return rows.withColumn("kp", moved).drop("_cx", "_cy", "_scale")


def mirrored(poses: DataFrame) -> DataFrame:
    """Joints of both sides change places and x its sign."""
    swap = dict(zip(LEFT + RIGHT, RIGHT + LEFT, strict=True))
    joint = lambda j: F.struct(F.lit(j).alias("j"), (-_at(swap.get(j, j), "x")).alias("x"), _at(swap.get(j, j), "y").alias("y"), _at(swap.get(j, j), "s").alias("s"))
    return poses.withColumn("kp", F.array(*[joint(j) for j in range(17)]))


def with_pelvis(poses: DataFrame) -> DataFrame:
    """(keys, h): the layout with pelvis (0), spine (7), thorax (8), nose (9) and head (10), as an array of x and y.

    Head, thorax and spine are made from face, shoulders and hips and then set right as the layout's own tools do.
    """
    source = dict(zip(PELVIS_AT, PELVIS_FROM, strict=True))
    xs, ys = ({h: _at(j, c) for h, j in source.items()} for c in "xy")
    (sx, hx), (sy, hy) = ((_mean((5, 6), c), _mean((11, 12), c)) for c in "xy")
    nx, ny, eyes = _at(0, "x"), _at(0, "y"), _at(1, "y") + _at(2, "y")
    xs[10], ys[10] = _mean((1, 2, 3, 4), "x"), eyes - ny
    xs[8], ys[8] = sx + (nx - sx) / 3.0, sy + (ny - sy) / 3.0 - (eyes / 2.0 - ny) * (2.0 / 3.0)
    xs[0], ys[0] = hx, hy
    xs[7], ys[7] = _mean((5, 6, 11, 12), "x"), _mean((5, 6, 11, 12), "y")
    xs[9], ys[9] = nx - (nx - sx) / 4.0, ny - (ny - sy) / 4.0
    xs[7] = xs[7] + 2.0 * (xs[7] - (xs[0] + xs[8]) / 2.0)
    return poses.select("seq_id", "track_id", "frame_idx", F.array(*[F.struct(xs[h].alias("x"), ys[h].alias("y")) for h in range(17)]).alias("h"))


def from_pelvis(h: str = "h", axes: str = "xyz") -> Column:
    """The 17 joints of such an array: limbs back at their places, the face between nose and head."""
    of = {j: at for at, j in zip(PELVIS_AT, PELVIS_FROM, strict=True)}

    def joint(j: int, c: str) -> Column:
        return 0.65 * _at(9, c, h) + 0.35 * _at(10, c, h) if 1 <= j <= 4 else _at(of[j], c, h)

    return F.array(*[F.struct(*[joint(j, c).alias(c) for c in axes]) for j in range(17)])


def rotated(q: tuple[float, float, float, float], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A vector turned by the quaternion (w, x, y, z)."""
    w, a, b, c = q
    cross = lambda u: (b * u[2] - c * u[1], c * u[0] - a * u[2], a * u[1] - b * u[0])
    once = cross((x, y, z))
    twice = cross(once)
    return tuple(v + 2.0 * (w * o + t) for v, o, t in zip((x, y, z), once, twice, strict=True))  # type: ignore[return-value]


def pinhole(width: float, height: float, fov: float = 70.0, focal: tuple[float, float] | None = None) -> tuple[float, float, float, float]:
    """fx, fy, cx, cy of a camera with a focal length in pixels or a horizontal field of view in degrees."""
    fx, fy = focal or (0.5 * width / max(math.tan(math.radians(fov) / 2), 1e-6),) * 2
    return fx, fy, width / 2, height / 2


def unprojected(x: Column, y: Column, depth: Column, camera: tuple[float, float, float, float]) -> tuple[Column, Column, Column]:
    """A pixel at a depth as a place in front of the camera."""
    fx, fy, cx, cy = camera
    return (x - cx) * depth / fx, (y - cy) * depth / fy, depth


def angle_3d(p: tuple[Column, ...], vertex: tuple[Column, ...], q: tuple[Column, ...], least: float = 1e-6) -> Column:
    """Inner angle at ``vertex`` in degrees; null where an arm has next to no length."""
    u, v = ([a - b for a, b in zip(end, vertex, strict=True)] for end in (p, q))
    size = lambda w: F.sqrt(sum((c * c for c in w), F.lit(0.0)))
    dot = sum((a * b for a, b in zip(u, v, strict=True)), F.lit(0.0))
    return F.when((size(u) >= least) & (size(v) >= least), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (size(u) * size(v)))))))
