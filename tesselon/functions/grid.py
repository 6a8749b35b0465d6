"""Tile grid and affine arithmetic: cell keys, pixel indices and membership predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Square tiles of ``size`` metres every ``stride`` metres; row 0 is at the top."""

    # The origin of the tile numbering, the stride and size of tiles, and the slack of its bounds.
    x0: float = 2715098.0
    y0: float = 1120181.0
    stride: float = 89.6
    size: float = 102.4
    slack: float = 1e-6

    def columns(self, x: Column) -> Column:
        return self._range(x - F.lit(self.x0))

    def rows(self, y: Column) -> Column:
        return self._range(F.lit(self.y0) - y)

    def _range(self, offset: Column) -> Column:
        first = F.ceil((offset - self.size) / self.stride - self.slack)
        last = F.floor(offset / self.stride + self.slack)
        return F.when(last >= first, F.sequence(first, last))

    def key(self, c: Column, r: Column) -> Column:
        return F.format_string("c%03d_r%03d", c, r)

    def left(self, c: Column) -> Column:
        return F.lit(self.x0) + c * F.lit(self.stride)

    def top(self, r: Column) -> Column:
        return F.lit(self.y0) - r * F.lit(self.stride)


def within_open(x, y, x0, y0, x1, y1) -> Column:
    """Strictly inside."""
    return (x > x0) & (x < x1) & (y > y0) & (y < y1)


def within_half_open(x, y, x0, y0, x1, y1) -> Column:
    """[left, right) and (bottom, top]."""
    return (x >= x0) & (x < x1) & (y > y0) & (y <= y1)


def within_closed(x, y, x0, y0, x1, y1) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def pixel_row(y: Column, y0: Column, res: float) -> Column:
    return F.floor((y0 - y) / res)


def pixel_column(x: Column, x0: Column, res: float) -> Column:
    return F.floor((x - x0) / res)


def pixel_centre(col: Column, row: Column, x0: Column, y0: Column, res: float) -> tuple[Column, Column]:
    return x0 + (col + 0.5) * res, y0 - (row + 0.5) * res


def clamp(i: Column, n: int) -> Column:
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))


def half_even(x: Column, digits: int) -> Column:
    """Ties go to the even neighbour."""
    return F.bround(x, digits)


def radius_pixels(metres: float, res: float = 0.1) -> int:
    return max(1, round(metres / res))
