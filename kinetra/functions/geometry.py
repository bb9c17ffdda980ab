"""Box and angle expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cx(p: str = "") -> Column:
    return (F.col(f"{p}x1") + F.col(f"{p}x2")) / 2


def cy(p: str = "") -> Column:
    return (F.col(f"{p}y1") + F.col(f"{p}y2")) / 2


def height(p: str = "") -> Column:
    return F.col(f"{p}y2") - F.col(f"{p}y1")


def width(p: str = "") -> Column:
    return F.col(f"{p}x2") - F.col(f"{p}x1")


def area(p: str = "") -> Column:
    return width(p) * height(p)


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    h = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: str, b: str) -> Column:
    """Intersection over union; null for two empty boxes."""
    both = intersection(a, b)
    return both / F.nullif(area(a) + area(b) - both, F.lit(0.0))


def iou_padded(a: str, b: str) -> Column:
    """The same with 1e-9 added to the union: 0 for two empty boxes."""
    both = intersection(a, b)
    return both / (area(a) + area(b) - both + 1e-9)


def iou_floored(a: str, b: str) -> Column:
    """The same with a union of 1e-6 at least."""
    both = intersection(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-6))


def edge_distance(a: str, b: str) -> Column:
    """Between the boxes' borders; 0 where they touch."""
    dx = F.greatest(F.lit(0.0), F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.least(F.col(f"{a}x2"), F.col(f"{b}x2")))
    dy = F.greatest(F.lit(0.0), F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.least(F.col(f"{a}y2"), F.col(f"{b}y2")))
    return F.sqrt(dx * dx + dy * dy)


def centred(frame_width: float, frame_height: float) -> tuple[Column, ...]:
    """Centre and size as shares of the picture."""
    return cx() / frame_width, cy() / frame_height, width() / frame_width, height() / frame_height


def padded(frame_width: float, frame_height: float, share: float) -> tuple[Column, ...]:
    """The box with a share of its size on every side, within the picture."""
    w, h = share * width(), share * height()
    return F.greatest(F.lit(0.0), F.col("x1") - w), F.greatest(F.lit(0.0), F.col("y1") - h), F.least(F.lit(frame_width), F.col("x2") + w), F.least(F.lit(frame_height), F.col("y2") + h)


def with_previous(obs: DataFrame) -> DataFrame:
    """``obs`` with its centre's move since the track's observation before (dx, dy; null for the first)."""
    w = Window.partitionBy("seq_id", "track_id").orderBy("frame_idx")
    return obs.withColumns({"dx": cx() - F.lag(cx()).over(w), "dy": cy() - F.lag(cy()).over(w)})


def smart(frame_width: float, frame_height: float, pad: float = 0.12, shape: float = 0.5, lead: float = 0.20, lift: float = 0.40) -> tuple[Column, ...]:
    """The box for a pose crop (needs dx and dy): ahead of a move, above a jump, towards a width of ``shape`` heights, padded, within the picture."""
    zero, dx, dy = F.lit(0.0), F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))
    w, h = F.greatest(width(), F.lit(1.0)), F.greatest(height(), F.lit(1.0))
    x1, x2 = F.col("x1") - F.when(dx < -6, lead * w).otherwise(zero), F.col("x2") + F.when(dx > 6, lead * w).otherwise(zero)
    y1, y2 = F.col("y1") - F.when((dy < -5) & (F.abs(dx) < 5), lift * h).otherwise(zero), F.col("y2")
    w, h = F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1)
    taller = F.when(w / h > shape + 1e-3, F.greatest(zero, w / shape - h) / 2).otherwise(zero)
    wider = F.when(w / h < shape - 1e-3, F.greatest(zero, h * shape - w) / 2).otherwise(zero)
    x1, x2, y1, y2 = x1 - wider, x2 + wider, y1 - taller, y2 + taller
    px, py = pad * F.greatest(F.lit(1.0), x2 - x1), pad * F.greatest(F.lit(1.0), y2 - y1)
    left, top = F.greatest(zero, F.least(F.lit(frame_width - 1), x1 - px)), F.greatest(zero, F.least(F.lit(frame_height - 1), y1 - py))
    return left, top, F.greatest(left + 1, F.least(F.lit(frame_width), x2 + px)), F.greatest(top + 1, F.least(F.lit(frame_height), y2 + py))


def containment(a: str, b: str) -> Column:
    """Share of a's area that lies in b."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1e-6))


def diou(a: str, b: str) -> Column:
    """IoU less the squared centre distance over the squared diagonal of the enclosing box."""
    far = F.pow(F.greatest(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.least(F.col(f"{a}x1"), F.col(f"{b}x1")), F.lit(2)) + F.pow(
        F.greatest(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.least(F.col(f"{a}y1"), F.col(f"{b}y1")), F.lit(2)
    )
    near = F.pow(cx(a) - cx(b), F.lit(2)) + F.pow(cy(a) - cy(b), F.lit(2))
    return iou(a, b) - near / (far + 1e-7)


def distance(a: str, b: str) -> Column:
    """Between centres."""
    return F.sqrt(F.pow(cx(a) - cx(b), F.lit(2)) + F.pow(cy(a) - cy(b), F.lit(2)))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule."""
    crossed = F.lit(0)
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1], strict=True):
        if ya != yb:
            spans = (F.lit(ya) > y) != (F.lit(yb) > y)
            crossed += F.when(spans & (x < (xb - xa) * (y - ya) / (yb - ya) + xa), 1).otherwise(0)
    return crossed % 2 == 1


def angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Inner angle at b in degrees; null where an arm has no length."""
    dot = (ax - bx) * (cx - bx) + (ay - by) * (cy - by)
    size = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) * F.sqrt((cx - bx) * (cx - bx) + (cy - by) * (cy - by))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.nullif(size, F.lit(0.0))))))
