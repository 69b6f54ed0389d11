"""Column expressions for plane geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_angle(a: Column) -> Column:
    """An angle brought to [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """(x, y) turned counter-clockwise by angle."""
    c, s = F.cos(angle), F.sin(angle)
    return x * c - y * s, x * s + y * c


def box_corners(x: Column, y: Column, length: Column, width: Column, heading: Column) -> Column:
    """Array of the corners of a box, from front left on, counter-clockwise."""
    corners = []
    for a, b in ((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5)):
        dx, dy = rotated(length * a, width * b, heading)
        corners.append(F.struct((x + dx).alias("x"), (y + dy).alias("y")))
    return F.array(*corners)


def segment_hits_box(x1: Column, y1: Column, x2: Column, y2: Column, cx: Column, cy: Column, length: Column, width: Column, heading: Column) -> Column:
    """Whether a segment meets a rotated box: the slab test in the box's own frame."""
    ax, ay = rotated(x1 - cx, y1 - cy, -heading)
    bx, by = rotated(x2 - cx, y2 - cy, -heading)

    def slab(a: Column, b: Column, half: Column) -> tuple[Column, Column]:
        d = b - a
        flat = F.abs(d) < 1e-12
        outside = flat & (F.abs(a) > half)
        t1, t2 = (-half - a) / d, (half - a) / d
        low = F.when(outside, 2.0).when(flat, 0.0).otherwise(F.least(t1, t2))
        high = F.when(outside, -1.0).when(flat, 1.0).otherwise(F.greatest(t1, t2))
        return low, high

    (lx, hx), (ly, hy) = slab(ax, bx, length / 2), slab(ay, by, width / 2)
    return F.greatest(lx, ly, F.lit(0.0)) <= F.least(hx, hy, F.lit(1.0))
