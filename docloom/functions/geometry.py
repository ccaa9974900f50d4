"""Boxes struct<x0, top, x1, bottom> and vectors array<float>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    """A box, or null if a side is no number or it has no area."""
    a, b, c, d = (x.try_cast("double") for x in (x0, top, x1, bottom))
    return F.when((c > a) & (d > b), F.struct(a.alias("x0"), b.alias("top"), c.alias("x1"), d.alias("bottom")))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["bottom"] - b["top"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a's area inside b."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return F.struct(
        F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["top"], b["top"]).alias("top"),
        F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["bottom"], b["bottom"]).alias("bottom"),
    )


def row_box(table: Column, index: Column, rows: Column) -> Column:
    """The box of row ``index`` of ``rows`` equal rows of a table, to two places."""
    step = (table["bottom"] - table["top"]) / rows
    return F.struct(
        table["x0"].alias("x0"), F.round(table["top"] + step * index, 2).alias("top"),
        table["x1"].alias("x1"), F.round(table["top"] + step * (index + 1), 2).alias("bottom"),
    )


def rescale(b: Column, x_factor: Column, y_factor: Column) -> Column:
    return F.struct(
        (b["x0"] * x_factor).alias("x0"), (b["top"] * y_factor).alias("top"),
        (b["x1"] * x_factor).alias("x1"), (b["bottom"] * y_factor).alias("bottom"),
    )


def percent_rect(b: Column, width: Column, height: Column) -> Column:
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    return F.struct(
        clip(b["x0"] / width * 100).alias("left"), clip(b["top"] / height * 100).alias("top"),
        clip((b["x1"] - b["x0"]) / width * 100).alias("width"), clip((b["bottom"] - b["top"]) / height * 100).alias("height"),
    )


def side_of(b: Column, width: Column) -> Column:
    centre = (b["x0"] + b["x1"]) / 2
    return F.when(centre < width * 0.42, "left").when(centre > width * 0.58, "right").otherwise("center")


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
