"""Box arithmetic on four columns x1, y1, x2, y2; a prefix names the box."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + s) for s in SIDES)


def fields(of: Column) -> tuple[Column, ...]:
    """The sides of a box kept as a struct."""
    return tuple(of[s] for s in SIDES)


def center(b: tuple[Column, ...]) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def area(b: tuple[Column, ...], floor: float = 1.0) -> Column:
    return F.greatest(F.lit(floor), (b[2] - b[0]) * (b[3] - b[1]))


def aspect(b: tuple[Column, ...]) -> Column:
    """Longer over shorter side, sides of less than 1 counting as 1."""
    w, h = F.greatest(F.lit(1.0), b[2] - b[0]), F.greatest(F.lit(1.0), b[3] - b[1])
    return F.greatest(w / h, h / w)


def padded(b: tuple[Column, ...], share: float) -> tuple[Column, ...]:
    w, h = (b[2] - b[0]) * share, (b[3] - b[1]) * share
    return b[0] - w, b[1] - h, b[2] + w, b[3] + h


def blended(a: tuple[Column, ...], b: tuple[Column, ...], w: Column) -> tuple[Column, ...]:
    """a at w = 0, b at w = 1."""
    return tuple(p * (1 - w) + q * w for p, q in zip(a, b))


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    none = F.lit(0.0)
    return F.greatest(none, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(none, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: tuple[Column, ...], b: tuple[Column, ...], floor: float = 1.0) -> Column:
    """Overlap over union. With floor 0 the areas are as they are, and empty unions give 0."""
    inter = overlap(a, b)
    return F.when(inter > 0, inter / (area(a, floor) + area(b, floor) - inter)).otherwise(0.0)


def nested(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of the smaller box that the other one covers."""
    return overlap(a, b) / F.least(area(a), area(b))


def holds(b: tuple[Column, ...], x: Column, y: Column, pad: float = 0.0) -> Column:
    p = padded(b, pad)
    return x.between(p[0], p[2]) & y.between(p[1], p[3])


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def yolo(b: tuple[Column, ...], w: Column, h: Column) -> tuple[Column, ...]:
    """Centre and size as shares of the image, clamped to it."""
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    x, y = center(b)
    return clamp(x / w), clamp(y / h), clamp((b[2] - b[0]) / w), clamp((b[3] - b[1]) / h)


def from_yolo(x: Column, y: Column, bw: Column, bh: Column, w: Column, h: Column, least: float = 0.02, most: float = 0.985, fallback: float = 0.92) -> tuple[Column, ...]:
    """Pixel box, rounded and clipped; a centred box where the area's share of the image is not between least and most."""
    ok = (bw * bh).between(least, most)
    x, y, bw, bh = (F.when(ok, v).otherwise(other) for v, other in ((x, 0.5), (y, 0.5), (bw, fallback), (bh, fallback)))
    clip = lambda v, top: F.least(top, F.greatest(F.lit(0.0), F.bround(v)))
    return clip((x - bw / 2) * w, w), clip((y - bh / 2) * h, h), clip((x + bw / 2) * w, w), clip((y + bh / 2) * h, h)
