"""Column expressions for planar geometry. Everything here stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def col(c: Column | str | float | int) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def fixed(value: Column | str, places: int = 4) -> Column:
    """Rounded for output, with -0.0 turned into 0.0."""
    return F.round(col(value), places) + F.lit(0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null on division by zero."""
    return F.when(bottom != 0.0, top / bottom)


def length(x1, y1, x2, y2) -> Column:
    return F.hypot(col(x2) - col(x1), col(y2) - col(y1))


def length3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def signed_length(x1, y1, x2, y2) -> Column:
    """Distance, positive when the second point lies farther from the origin."""
    farther = F.hypot(col(x2), col(y2)) > F.hypot(col(x1), col(y1))
    return F.when(farther, 1.0).otherwise(-1.0) * length(x1, y1, x2, y2)


def angle(x1, y1, x2, y2) -> Column:
    """Direction in radians. Adding 0.0 keeps a negative zero rise from turning the angle over."""
    return F.atan2(col(y2) - col(y1) + F.lit(0.0), col(x2) - col(x1) + F.lit(0.0))


def positive_angle(a: Column) -> Column:
    return F.when(a < 0, a + TWO_PI).otherwise(a)


def gradient(x1, y1, x2, y2) -> Column:
    return ratio(col(y2) - col(y1), col(x2) - col(x1))


def sweep(a0, a1) -> Column:
    """Angle swept from a0 to a1, counter-clockwise."""
    a0, a1 = col(a0), col(a1)
    return F.when(a1 < a0, a1 + TWO_PI - a0).otherwise(a1 - a0)


def polar(cx, cy, r, a) -> tuple[Column, Column]:
    return col(cx) + col(r) * F.cos(a), col(cy) + col(r) * F.sin(a)


def mix(a, b, t) -> Column:
    """Value at fraction t between a and b."""
    return col(a) + (col(b) - col(a)) * col(t)


def turn(delta: Column) -> Column:
    """Angle difference wrapped to (-pi, pi]."""
    wrapped = F.pmod(delta + math.pi, F.lit(TWO_PI)) - math.pi
    return F.when(wrapped <= -math.pi, F.lit(math.pi)).otherwise(wrapped)


def snap(value, tol) -> Column:
    """Integer key of a coordinate at a tolerance."""
    return F.floor(col(value) / F.lit(float(tol)) + 0.5)


def at_first(order: str, prefix: str, *names: str) -> list[Column]:
    """Values of the row with the least ``order``, one fixed-width aggregate each."""
    return [F.min_by(n, order).alias(prefix + n) for n in names]


def at_last(order: str, prefix: str, *names: str) -> list[Column]:
    """Values of the row with the greatest ``order``."""
    return [F.max_by(n, order).alias(prefix + n) for n in names]


def segment_box(x1="x1", y1="y1", x2="x2", y2="y2", prefix="") -> dict[str, Column]:
    """Bounding-box columns of a segment, for the cell join."""
    return {
        f"{prefix}min_x": F.least(col(x1), col(x2)),
        f"{prefix}min_y": F.least(col(y1), col(y2)),
        f"{prefix}max_x": F.greatest(col(x1), col(x2)),
        f"{prefix}max_y": F.greatest(col(y1), col(y2)),
    }
