"""Rectangles as column expressions. A box is anything indexable by "x1", "y1", "x2", "y2": a struct column, or the dict
that `box()` makes of columns. Divisions are guarded, so empty rectangles give 0 instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRUCTURED = ["table", "formula"]
FIGURES = ["image", "chart"]


def box(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")}


def at_least(v: Column, low: float = 0.0) -> Column:
    return F.greatest(v, F.lit(low))


def intersection(a, b) -> Column:
    w = at_least(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = at_least(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h


def raw_area(a) -> Column:
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def area(a) -> Column:
    return at_least(a["x2"] - a["x1"]) * at_least(a["y2"] - a["y1"])


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def iou(a, b) -> Column:
    both = intersection(a, b)
    return share(both, raw_area(a) + raw_area(b) - both)


def containment(a, b) -> Column:
    """How much of `a` lies in `b`."""
    return share(intersection(a, b), raw_area(a))


def iom(a, b) -> Column:
    return share(intersection(a, b), F.least(raw_area(a), raw_area(b)))


def overlaps(a, b) -> Column:
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def union(a, b) -> dict[str, Column]:
    return {c: (F.least if c.endswith("1") else F.greatest)(a[c], b[c]) for c in ("x1", "y1", "x2", "y2")}


def is_figure(b) -> Column:
    return b["label"].isin(FIGURES)


def rank(label: Column) -> Column:
    """Merge priority: structured, then figures, then text."""
    return F.when(label.isin(STRUCTURED), 0).when(label.isin(FIGURES), 1).otherwise(2)


def absorbs(candidate, kept, iou_limit: float = 0.5, limit: float = 0.35, structured: float = 0.25) -> Column:
    """Does `candidate` detect `kept` again? A figure keeps the text inside it."""
    bound = F.when(kept["label"].isin(STRUCTURED), F.lit(structured)).otherwise(F.lit(limit))
    inside = ~(is_figure(kept) & ~is_figure(candidate)) & (containment(candidate, kept) > bound)
    return (iou(candidate, kept) > iou_limit) | inside


def expand(a, pixels: float, ratio: float = 0.0) -> dict[str, Column]:
    dx, dy = (a["x2"] - a["x1"]) * ratio + pixels, (a["y2"] - a["y1"]) * ratio + pixels
    return {"x1": a["x1"] - dx, "y1": a["y1"] - dy, "x2": a["x2"] + dx, "y2": a["y2"] + dy}


def clamp(a, width: Column, height: Column) -> dict[str, Column]:
    """Cut to the page at the far side for the second corner, at 0 for the first, as detections are."""
    return {"x1": at_least(a["x1"]), "y1": at_least(a["y1"]), "x2": F.least(a["x2"], width), "y2": F.least(a["y2"], height)}


def within(v: Column, low: Column, high: Column) -> Column:
    """`v` in [low, high]; NaN counts as the low end."""
    return F.when(F.isnan(v), low).otherwise(F.least(F.greatest(v, low), high))


def round2(v: Column) -> Column:
    """Half away from zero on the binary value, which decimal rounding isn't."""
    x = v * 100
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)) / 100


def to_points(px: Column, scale: Column) -> Column:
    return round2(px / scale)


def tiles(width: Column, height: Column, overlap: float = 0.08, least_height: int = 200) -> Column:
    """Top and bottom half of a page as an array of rectangles; none for a page that is too low."""
    o = min(max(overlap, 0.0), 0.49)
    cut, margin = F.floor(height / 2).cast("int"), F.floor(height * o).cast("int")
    rect = lambda y1, y2: F.struct(F.lit(0).alias("x1"), y1.cast("int").alias("y1"), width.alias("x2"), y2.cast("int").alias("y2"))
    both = F.array(rect(F.lit(0), F.least(height, cut + margin)), rect(F.greatest(F.lit(0), cut - margin), height))
    return F.when(height < least_height, F.filter(both, lambda _: F.lit(False))).otherwise(both)


def downscale(width: Column, height: Column, most: int = 2048) -> Column:
    long_side = F.greatest(width, height)
    return F.when(long_side > most, F.lit(float(most)) / long_side).otherwise(F.lit(1.0))
