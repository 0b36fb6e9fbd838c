"""Boxes as column expressions: ``Box(x0, y0, x1, y1)`` with the origin at the top left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")])

    @classmethod
    def from_array(cls, column: Column) -> Box:
        return cls(*[F.element_at(column, i) for i in (1, 2, 3, 4)])

    def array(self) -> Column:
        return F.array(self.x0, self.y0, self.x1, self.y1)

    @property
    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2


def overlaps(a: Box, b: Box) -> Column:
    """Open intervals: boxes that only touch don't overlap."""
    return (F.greatest(a.x0, b.x0) < F.least(a.x1, b.x1)) & (F.greatest(a.y0, b.y0) < F.least(a.y1, b.y1))


def contains_center(outer: Box, inner: Box) -> Column:
    """Whether the middle of ``inner`` lies in ``outer``, edges included."""
    x, y = inner.center
    return x.between(outer.x0, outer.x1) & y.between(outer.y0, outer.y1)


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def overlap_ratio(outer: Box, inner: Box) -> Column:
    """The share of ``inner`` that lies in ``outer``; 0 where inner has no area."""
    return F.when(inner.area > 0, intersection(outer, inner) / inner.area).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def scaled(box: Box, x: Column | float, y: Column | float | None = None) -> Box:
    y = x if y is None else y
    return Box(box.x0 * x, box.y0 * y, box.x1 * x, box.y1 * y)


def uniform_scale(page: Box, width: Column, height: Column, tolerance: float = 1e-3, residual: float = 0.5) -> Column:
    """The scale from a frame of width x height to the page's box: null unless both axes agree and the origin is at 0."""
    sx, sy = (page.x1 - page.x0) / width, (page.y1 - page.y0) / height
    scale = (sx + sy) / 2
    fits = (
        (F.abs(sx - sy) <= tolerance * F.greatest(F.abs(sx), F.abs(sy)))
        & (F.abs(page.x0) <= residual) & (F.abs(page.y0) <= residual)
        & (F.greatest(F.abs(width * scale - (page.x1 - page.x0)), F.abs(height * scale - (page.y1 - page.y0))) <= residual)
    )
    return F.when((width > 0) & (height > 0) & fits, scale)


def padded(box: Box, by: float, width: Column, height: Column) -> Box:
    """Widened on each side, but not beyond the page."""
    return Box(F.greatest(F.lit(0), box.x0 - by), F.greatest(F.lit(0), box.y0 - by), F.least(width, box.x1 + by), F.least(height, box.y1 + by))


def flipped(box: Box, height: Column) -> Box:
    """From an origin at the bottom left to one at the top left."""
    return Box(box.x0, height - box.y1, box.x1, height - box.y0)


def rotated(box: Box, angle: Column, width: Column, height: Column) -> Box:
    """Turned with its page by 0, 90, 180 or 270 degrees clockwise; -1 stands for no known turn."""
    def pick(none: Column, quarter: Column, half: Column, three: Column) -> Column:
        return F.when(angle.isin(-1, 0), none).when(angle == 90, quarter).when(angle == 180, half).when(angle == 270, three)

    return Box(
        pick(box.x0, height - box.y1, width - box.x1, box.y0), pick(box.y0, box.x0, height - box.y1, width - box.x1),
        pick(box.x1, height - box.y0, width - box.x0, box.y1), pick(box.y1, box.x1, height - box.y0, width - box.x0),
    )


def framed(box: Box, source: Box, target: Box) -> Box:
    """Mapped from one page frame to another, each axis by its own scale."""
    sx = (target.x1 - target.x0) / (source.x1 - source.x0)
    sy = (target.y1 - target.y0) / (source.y1 - source.y0)
    return Box(target.x0 + (box.x0 - source.x0) * sx, target.y0 + (box.y0 - source.y0) * sy, target.x0 + (box.x1 - source.x0) * sx, target.y0 + (box.y1 - source.y0) * sy)


def clamped(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = [x if isinstance(x, Column) else F.lit(x) for x in (low, high)]
    return F.greatest(low, F.least(high, value))


def cropped(box: Box, crop: Box, scale: Column | float) -> Box:
    """In the coordinates of a crop, scaled."""
    return Box((box.x0 - crop.x0) * scale, (box.y0 - crop.y0) * scale, (box.x1 - crop.x0) * scale, (box.y1 - crop.y0) * scale)


def envelope_of_points(points: Column) -> Column:
    """The box around an array of [x, y] points, as an array of four."""
    xs, ys = F.transform(points, lambda p: F.element_at(p, 1)), F.transform(points, lambda p: F.element_at(p, 2))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def product(m: list[Column], n: list[Column]) -> list[Column]:
    """Affine matrices a, b, c, d, e, f as rows [a b], [c d], [e f]: first m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def transformed(box: Box, m: list[Column]) -> Box:
    """The envelope of the four corners under an affine matrix."""
    a, b, c, d, e, f = m
    xs = [a * x + c * y + e for x in (box.x0, box.x1) for y in (box.y0, box.y1)]
    ys = [b * x + d * y + f for x in (box.x0, box.x1) for y in (box.y0, box.y1)]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def valid_box(column: Column) -> Column:
    """Four finite numbers, strictly ordered."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(column) == 4) & finite & (F.element_at(column, 1) < F.element_at(column, 3)) & (F.element_at(column, 2) < F.element_at(column, 4)), F.lit(False))


def against_rule(box: Box, y: Column, slack: float = 0.0) -> Column:
    """above, below or crossing a horizontal rule."""
    return F.when(box.y1 <= y + slack, "above").when(box.y0 >= y - slack, "below").otherwise("crossing")


def rule_covers(rule_x0: Column, rule_x1: Column, x0: Column, x1: Column, tolerance: float) -> Column:
    """Whether a rule spans [x0, x1], but for a tolerance."""
    return (rule_x0 <= x0 + tolerance) & (rule_x1 >= x1 - tolerance)


def rule_fits(rule_x0: Column, rule_x1: Column, x0: Column, x1: Column, tolerance: float) -> Column:
    """Whether a rule covers [x0, x1] and reaches no further than the tolerance beyond it."""
    return rule_covers(rule_x0, rule_x1, x0, x1, tolerance) & (rule_x0 >= x0 - tolerance) & (rule_x1 <= x1 + tolerance)


def progress_bucket(completed: Column, total: Column, buckets: int = 20) -> Column:
    """The number of whole buckets done, at most all."""
    return F.when(total > 0, F.least(F.floor(completed * buckets / total), F.lit(buckets))).otherwise(F.lit(buckets)).cast("int")


def elapsed(seconds: Column) -> Column:
    """``d j HH:MM:SS``; without days ``HH:MM:SS``."""
    s = F.floor(seconds).cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(s % 86400 / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(s >= 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit(" j "), clock)).otherwise(clock)
