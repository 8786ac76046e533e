"""Column functions over boxes: bounds, centres, overlap, containment, bands, frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center(box: Column) -> Column:
    """[x, y] of the mean of a box's points, cut to whole numbers (A10)."""
    n = F.size(box)
    mean = lambda k: (F.aggregate(box, F.lit(0.0), lambda a, p: a + p[k]) / n).cast("int")
    return F.array(mean(0), mean(1))


def bounds(box: Column) -> Column:
    """struct(x, y, w, h) around a box's points."""
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two rectangles; 0 if the union is empty."""
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = w * h
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def inside(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Point in rectangle, edges included."""
    return px.between(x, x + w) & py.between(y, y + h)


def in_band(y: Column, lines: Column, radius: Column) -> Column:
    """y within radius of one of the lines."""
    return F.exists(lines, lambda c: F.abs(y - c) <= radius)


def upright(center_: Column, width: Column, height: Column) -> Column:
    """x and y exchanged where a centre lies outside the screen and fits only so (F8)."""
    x, y = center_[0], center_[1]
    swap = ((x >= width) | (y >= height)) & (y < width) & (x < height)
    return F.when(swap, F.array(y, x)).otherwise(center_)


#: Priority of a colour.
COLOUR_PRIORITY = {"orange": 10, "red": 9, "blue": 7, "green": 6, "purple": 5, "yellow": 4, "gray": 2, "white": 1, "unknown": 0}


def colour_priority(name: Column) -> Column:
    """How soon something of a colour is tapped; 0 for others and null."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLOUR_PRIORITY.items() for x in kv]), name), F.lit(0))


def fraction(size: Column, part: float) -> Column:
    """Whole number at a part of a frame's side."""
    return (size * F.lit(part)).cast("int")


def mean(values: Column) -> Column:
    """Mean of an array, such as the grey or hue values of an image (A18); null for none."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def largest_first(blobs: Column) -> Column:
    """Array of struct(area, ...) by area, the largest first."""
    return F.sort_array(blobs, asc=False)


def rows_by_y(boxes: Column) -> Column:
    """Recognised texts from top to bottom, in their order on ties (O13). boxes: array of struct(text, confidence, center, ...)."""
    at = F.transform(boxes, lambda r, i: F.struct(r["center"][1].alias("y"), i.alias("i"), r["text"].alias("text"), r["confidence"].alias("confidence")))
    return F.transform(F.sort_array(at), lambda r: F.struct(r["y"].alias("y"), r["text"].alias("text"), r["confidence"].alias("confidence")))


def surest_text(boxes: Column) -> Column:
    """Text of the highest confidence, the first on ties."""
    return F.array_max(F.transform(boxes, lambda r, i: F.struct(r["confidence"].alias("c"), (-i).alias("o"), r["text"].alias("t"))))["t"]


def scaled(px: Column, scale: Column) -> Column:
    """Device pixels to points, cut to whole numbers."""
    return (px / scale).cast("int")


def side(x: Column, right: int = 1050, left: int = 600) -> Column:
    """Part of the screen a point lies in."""
    return F.when(x > right, "right").when(x < left, "left").otherwise("center")


def nearest(x: Column, centers: list[int]) -> Column:
    """The centre nearest to x, the first on ties."""
    return F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(centers)]))["c"]


def colour(h: Column, s: Column, v: Column) -> Column:
    """Name of a colour from hue (0-179), saturation and value (0-255)."""
    grey = F.when(v > 180, "white").otherwise("gray")
    hue = F.when((h < 10) | (h > 155), "red").when(h < 25, "orange").when(h < 35, "yellow").when(h < 85, "green").when(h < 125, "blue").otherwise("purple")
    return F.when(s < 40, grey).otherwise(hue)


def button_like(w: Column, h: Column, width: Column, height: Column) -> Column:
    """Shape of a button on a screen: 1000 pixels up to a quarter of it, 40 by 20 or more, half to twelve times as wide as high."""
    return (w * h >= 1000) & (w * h <= width * height * 0.25) & (w >= 40) & (h >= 20) & F.try_divide(w, h).between(0.5, 12)


def crop(height: Column) -> Column:
    """struct(top, bottom) cut off a recorded window: 3.5 and 5.5 % of its height, 40 and 60 pixels at most; nothing if
    less than 100 would be left (F30)."""
    top = F.greatest(F.lit(0), F.least((height * F.lit(0.035)).cast("int"), F.lit(40)))
    bottom = F.greatest(F.lit(0), F.least((height * F.lit(0.055)).cast("int"), F.lit(60)))
    fits = height - top - bottom >= 100
    return F.struct(F.when(fits, top).otherwise(0).alias("top"), F.when(fits, bottom).otherwise(0).alias("bottom"))
