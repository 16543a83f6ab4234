"""Boxes (x0, y0, x1, y1) and segments as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("x0", "y0", "x1", "y1")


def box(*edges: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in zip(FIELDS, edges)])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def square(b: Column) -> Column:
    """The shorter side grows on both ends until the box is a square."""
    more_x, more_y = F.greatest(height(b) - width(b), F.lit(0.0)) / 2, F.greatest(width(b) - height(b), F.lit(0.0)) / 2
    return box(b["x0"] - more_x, b["y0"] - more_y, b["x1"] + more_x, b["y1"] + more_y)


def padded(b: Column, x: float = 1.0, y: float = 1.0) -> Column:
    """Every side moves out by so many widths or heights."""
    return box(b["x0"] - width(b) * x, b["y0"] - height(b) * y, b["x1"] + width(b) * x, b["y1"] + height(b) * y)


def centred(b: Column, on: Column | None = None, point: tuple[Column, Column] | None = None) -> Column:
    """The smallest box around ``b`` (and ``on``) with its centre on that of ``on`` or on the point."""
    if on is None and point is None:
        raise ValueError("centred needs a box or a point")
    if on is not None:
        b = box(F.least(b["x0"], on["x0"]), F.least(b["y0"], on["y0"]), F.greatest(b["x1"], on["x1"]), F.greatest(b["y1"], on["y1"]))
    cx, cy = point if point is not None else ((on["x0"] + on["x1"]) / 2, (on["y0"] + on["y1"]) / 2)
    half_x = F.greatest(F.abs(cx - b["x0"]), F.abs(cx - b["x1"]))
    half_y = F.greatest(F.abs(cy - b["y0"]), F.abs(cy - b["y1"]))
    return box(cx - half_x, cy - half_y, cx + half_x, cy + half_y)


def at_least(b: Column, inner: Column, share: float) -> Column:
    """``b`` with both sides cut, where it is too large, so that ``inner`` has ``share`` of its width and height."""
    cut_x = F.greatest(width(b) - width(inner) / share, F.lit(0.0)) / 2
    cut_y = F.greatest(height(b) - height(inner) / share, F.lit(0.0)) / 2
    return box(b["x0"] + cut_x, b["y0"] + cut_y, b["x1"] - cut_x, b["y1"] - cut_y)


def ring(b: Column) -> Column:
    """The corners as a closed ring."""
    p = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def axis_units(b: Column, fraction: float, reduction: str | None = "max") -> Column:
    """A fraction of the axes in data units: the larger or smaller one, or both."""
    if reduction == "max":
        return fraction * F.greatest(width(b), height(b))
    if reduction == "min":
        return fraction * F.least(width(b), height(b))
    return F.array(fraction * width(b), fraction * height(b))


def ccw(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """a, b, c turn to the left."""
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def crossing(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """The segments a-b and c-d cross."""
    return (ccw(*a, *c, *d) != ccw(*b, *c, *d)) & (ccw(*a, *b, *c) != ccw(*a, *b, *d))
