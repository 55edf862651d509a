"""Rectangle arithmetic over ``array<double>`` boxes ``[x0, y0, x1, y1]``.

A null, short or empty box has no overlap with anything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge(box: Column, i: int) -> Column:
    """Edge ``i`` of a box, null where the box lacks it."""
    return F.get(box, F.lit(i))


def is_box(box: Column) -> Column:
    """A complete box with a positive area."""
    whole = (F.size(box) == 4) & (edge(box, 2) > edge(box, 0)) & (edge(box, 3) > edge(box, 1))
    return F.coalesce(box.isNotNull() & whole, F.lit(False))


def area(box: Column) -> Column:
    return F.greatest(edge(box, 2) - edge(box, 0), F.lit(0.0)) * F.greatest(edge(box, 3) - edge(box, 1), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(edge(a, 2), edge(b, 2)) - F.greatest(edge(a, 0), edge(b, 0))
    h = F.least(edge(a, 3), edge(b, 3)) - F.greatest(edge(a, 1), edge(b, 1))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap."""
    both = intersection(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(F.lit(0.0))


def covered(a: Column, b: Column) -> Column:
    """Share of ``a`` inside ``b``."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def x_overlap(a: Column, b: Column) -> Column:
    """Horizontal overlap as a share of the narrower box."""
    both = F.least(edge(a, 2), edge(b, 2)) - F.greatest(edge(a, 0), edge(b, 0))
    narrow = F.least(edge(a, 2) - edge(a, 0), edge(b, 2) - edge(b, 0))
    return F.greatest(both, F.lit(0.0)) / F.greatest(narrow, F.lit(1.0))


def y_gap(a: Column, b: Column) -> Column:
    """Vertical distance; 0 where the boxes overlap in height."""
    return F.greatest(edge(b, 1) - edge(a, 3), edge(a, 1) - edge(b, 3), F.lit(0.0))


def padded(box: Column, width: Column, height: Column, pad: float = 3.0) -> Column:
    """The box grown by ``pad`` and clipped to the page."""
    return F.array(
        F.greatest(edge(box, 0) - pad, F.lit(0.0)), F.greatest(edge(box, 1) - pad, F.lit(0.0)),
        F.least(edge(box, 2) + pad, width), F.least(edge(box, 3) + pad, height),
    )


def halves(width: Column, height: Column, two_columns: Column, overlap: float = 2.0) -> Column:
    """Two clips of a page with a small overlap: side by side for two columns, else one above the other."""
    x, y = width / 2, height / 2
    zero = F.lit(0.0)
    beside = F.array(F.array(zero, zero, x + overlap, height), F.array(x - overlap, zero, width, height))
    above = F.array(F.array(zero, zero, width, y + overlap), F.array(zero, y - overlap, width, height))
    return F.when(two_columns, beside).otherwise(above)
