"""Affine maps of space, as three rows of four numbers: x' = m[0] . (x, y, z, 1), and so on."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from geoloom.functions.geometry import col

Row = tuple[float, float, float, float]


@dataclass(frozen=True)
class Affine3:
    rows: tuple[Row, Row, Row] = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))

    def then(self, other: "Affine3") -> "Affine3":
        """This map followed by ``other``."""
        own = (*self.rows, (0.0, 0.0, 0.0, 1.0))
        return Affine3(tuple(tuple(sum(r[k] * own[k][j] for k in range(4)) for j in range(4)) for r in other.rows))

    def apply(self, x, y, z) -> tuple[Column, Column, Column]:
        x, y, z = col(x), col(y), col(z)
        return tuple(a * x + b * y + c * z + d for a, b, c, d in self.rows)


def translate(dx: float, dy: float, dz: float) -> Affine3:
    return Affine3(((1.0, 0.0, 0.0, dx), (0.0, 1.0, 0.0, dy), (0.0, 0.0, 1.0, dz)))


def scale(sx: float, sy: float, sz: float) -> Affine3:
    return Affine3(((sx, 0.0, 0.0, 0.0), (0.0, sy, 0.0, 0.0), (0.0, 0.0, sz, 0.0)))


def rotate(roll: float, pitch: float, yaw: float) -> Affine3:
    """About x, then y, then z, in radians."""
    (cx, sx), (cy, sy), (cz, sz) = ((math.cos(a), math.sin(a)) for a in (roll, pitch, yaw))
    about_x = Affine3(((1.0, 0.0, 0.0, 0.0), (0.0, cx, -sx, 0.0), (0.0, sx, cx, 0.0)))
    about_y = Affine3(((cy, 0.0, sy, 0.0), (0.0, 1.0, 0.0, 0.0), (-sy, 0.0, cy, 0.0)))
    about_z = Affine3(((cz, -sz, 0.0, 0.0), (sz, cz, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)))
    return about_x.then(about_y).then(about_z)


def about(x: float, y: float, z: float, inner: Affine3) -> Affine3:
    """``inner`` with its fixed point moved to a centre."""
    return translate(-x, -y, -z).then(inner).then(translate(x, y, z))


def apply_transform_3d(points: DataFrame, move: Affine3, columns: tuple[tuple[str, str, str], ...] = (("x", "y", "z"),)) -> DataFrame:
    """Move every (x, y, z) column triple of a table by one map; a pure projection."""
    moved = {}
    for names in columns:
        moved |= dict(zip(names, move.apply(*names)))
    return points.withColumns(moved)
