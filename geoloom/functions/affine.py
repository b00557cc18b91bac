"""Affine maps of the plane: x' = a x + c y + tx, y' = b x + d y + ty.

A map is six values (a, b, c, d, tx, ty), either numbers known up front or Columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geometry import col

Cell = Column | float


@dataclass(frozen=True)
class Affine:
    a: Cell = 1.0
    b: Cell = 0.0
    c: Cell = 0.0
    d: Cell = 1.0
    tx: Cell = 0.0
    ty: Cell = 0.0

    def then(self, other: "Affine") -> "Affine":
        """This map followed by ``other``."""
        return Affine(
            other.a * self.a + other.c * self.b,
            other.b * self.a + other.d * self.b,
            other.a * self.c + other.c * self.d,
            other.b * self.c + other.d * self.d,
            other.a * self.tx + other.c * self.ty + other.tx,
            other.b * self.tx + other.d * self.ty + other.ty,
        )

    def apply(self, x, y) -> tuple[Column, Column]:
        x, y = col(x), col(y)
        return self.a * x + self.c * y + self.tx, self.b * x + self.d * y + self.ty


def translate(dx: Cell, dy: Cell) -> Affine:
    return Affine(tx=dx, ty=dy)


def scale(sx: Cell, sy: Cell) -> Affine:
    return Affine(a=sx, d=sy)


def shear(kx: Cell, ky: Cell) -> Affine:
    return Affine(b=ky, c=kx)


def rotate(radians: Cell) -> Affine:
    if isinstance(radians, Column):
        cos, sin = F.cos(radians), F.sin(radians)
    else:
        import math

        cos, sin = math.cos(radians), math.sin(radians)
    return Affine(a=cos, b=sin, c=-sin, d=cos)


def about(centre_x: Cell, centre_y: Cell, inner: Affine) -> Affine:
    """``inner`` with its fixed point moved to a centre."""
    return translate(-centre_x, -centre_y).then(inner).then(translate(centre_x, centre_y))


def combine(*maps: Affine) -> Affine:
    """Left-to-right product; the identity when empty."""
    out = Affine()
    for m in maps:
        out = out.then(m)
    return out


def from_columns(prefix: str = "") -> Affine:
    """The map held in the columns a, b, c, d, tx, ty."""
    return Affine(*(F.col(prefix + n) for n in ("a", "b", "c", "d", "tx", "ty")))
