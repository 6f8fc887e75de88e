"""Positions, units and rectangles. Device units are 1/100 inch from the top left of the uncropped page; points are 1/72 inch."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


@dataclass(frozen=True)
class Config:
    # Fixed values of the coordinate system.
    points_per_inch: float = 72.0
    units_per_inch: float = 100.0
    page_width: float = 595.3
    page_height: float = 841.9

    @property
    def scale(self) -> float:
        return 0.72


CONFIG = Config()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_NUMBERS = ("page", "sequence", "char_pos", "unknown", "x", "y", "width", "height")


#: Printable characters with one space between: as positions are written, and so cheap to cut.
_PLAIN = r"\A[!-~]++(?: [!-~]++)*+\z"


def parts(c: Column | str) -> Column:
    """What white space parts in a text, whose ends are stripped; texts that are not plain are made so first, as a pattern to cut by would be compiled for every row."""
    c = _col(c)
    plain = F.when(F.regexp_like(c, F.lit(_PLAIN)), c).otherwise(F.regexp_replace(strip(c), r"(?U)\s+", " "))
    return F.split(plain, " ")


def numbered(raw: Column, n: Column, v: list[Column]) -> Column:
    """Position struct of a text of ``n`` parts whose first eight are the integers ``v``, null where one is none."""
    long = n >= 8
    valid = F.coalesce((n >= 4) & reduce(and_, [x.isNotNull() for x in v[:4]]) & (~long | reduce(and_, [x.isNotNull() for x in v[4:]])), F.lit(False))
    used = [F.when(valid if i < 4 else valid & long, v[i]).otherwise(0).alias(name) for i, name in enumerate(_NUMBERS)]
    return F.struct(F.coalesce(raw, F.lit("")).alias("raw"), *used, valid.alias("valid"))


def position(c: Column | str) -> Column:
    """Position struct of "page sequence char_pos unknown x y width height"; the short form has the first four.

    Fewer parts, or one that is no whole number, make all numbers 0 and valid false.
    """
    c = _col(c)
    read = lambda p: F.struct(F.size(p).alias("n"), *[F.get(p, F.lit(i)).try_cast("int").alias(f"v{i}") for i in range(8)])
    shaped = lambda s: numbered(c, s.getField("n"), [s.getField(f"v{i}") for i in range(8)])
    return let(let(parts(c), read), shaped)


def position_rect(p: Column) -> Column:
    """[x, y, x + width, y + height] of a position struct, zeros if it isn't valid."""
    f = p.getField
    return F.when(f("valid"), F.array(*(x.cast("double") for x in (f("x"), f("y"), f("x") + f("width"),
        f("y") + f("height"))))).otherwise(F.array(*[F.lit(0.0)] * 4))


def end_point(c: Column | str) -> Column:
    """struct<x, y> in device units of a position string with six parts or more, else nulls."""
    p = parts(c)
    enough = F.size(p) >= 6
    at = lambda i: F.when(enough, F.get(p, F.lit(i)).try_cast("double"))
    ok = at(4).isNotNull() & at(5).isNotNull()
    return F.struct(F.when(ok, at(4)).alias("x"), F.when(ok, at(5)).alias("y"))


def page_size(value: Column | str, default: float) -> Column:
    """A page's width or height, the default where it is missing or not positive."""
    v = _col(value).try_cast("double")
    return F.when(v > 0, v).otherwise(F.lit(default))


def _limit(v: Column, most: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, most))


def to_points(unit: Column, offset: Column, crop_size: Column, page_limit: Column | None) -> Column:
    """A device coordinate in points: less the crop box's offset and kept inside it, else inside the page, else free."""
    raw = unit * CONFIG.scale
    free = raw if page_limit is None else F.when(page_limit.isNull(), raw).otherwise(_limit(raw, page_limit))
    return F.when(crop_size.isNull(), free).otherwise(_limit(raw - offset, crop_size))


def point(x: Column, y: Column, width: Column | None, height: Column | None, cropbox: Column) -> Column:
    """struct<x, y> in points; ``cropbox`` is a rect struct or null."""
    c = cropbox.getField
    return F.struct(to_points(x, c("x0"), c("x1") - c("x0"), width).alias("x"), to_points(y, c("y0"), c("y1") - c("y0"), height).alias("y"))


def length_to_points(units: Column, page_length: Column | None, start: Column | None = None) -> Column:
    """A device length in points, no longer than what is left of the page from ``start``."""
    v = units * CONFIG.scale
    if page_length is not None:
        left = F.greatest(F.lit(0.0), page_length - (F.lit(0.0) if start is None else start))
        v = F.when(page_length.isNull(), v).otherwise(F.least(v, left))
    return F.when(units > 0, F.greatest(F.lit(0.0), v)).otherwise(F.lit(0.0))


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def union(a: Column, b: Column) -> Column:
    f, g = a.getField, b.getField
    return rect(F.least(f("x0"), g("x0")), F.least(f("y0"), g("y0")), F.greatest(f("x1"), g("x1")), F.greatest(f("y1"), g("y1")))


def area(a: Column) -> Column:
    f = a.getField
    return F.greatest(F.lit(0.0), f("x1") - f("x0")) * F.greatest(F.lit(0.0), f("y1") - f("y0"))


def intersection_area(a: Column, b: Column) -> Column:
    f, g = a.getField, b.getField
    w = F.least(f("x1"), g("x1")) - F.greatest(f("x0"), g("x0"))
    h = F.least(f("y1"), g("y1")) - F.greatest(f("y0"), g("y0"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def bounding_box(rects: Column) -> Column:
    """Union of an array of rect structs, null if it is empty."""
    side = lambda name: F.transform(rects, lambda r: r.getField(name))
    return F.when(F.size(rects) > 0, rect(F.array_min(side("x0")), F.array_min(side("y0")), F.array_max(side("x1")), F.array_max(side("y1"))))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def round_tenth(c: Column) -> Column:
    """One decimal, half to even."""
    return F.bround(c, 1)


def line_count(height: Column, line_height: float = 16.0) -> Column:
    """Lines that a vertical span covers: at least one."""
    return F.greatest(F.lit(1), (F.bround(height / line_height) + 1).cast("int"))


def char_boxes(r: Column, length: Column) -> Column:
    """A span's box cut into ``length`` boxes of equal width; none for an empty span."""
    f = r.getField
    w = (f("x1") - f("x0")) / length
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1),
        lambda i: rect(f("x0") + i * w, f("y0"), f("x0") + (i + 1) * w,
            f("y1")))).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))


def column_of(columns: Column, x: Column, y: Column) -> Column:
    """The column that holds a point, else the one whose centre is nearest by x, the first of equals; null without columns."""
    inside = F.filter(columns, lambda c: x.between(c.getField("left"), c.getField("right")) & y.between(c.getField("top"), c.getField("bottom")))
    ranked = F.array_min(
        F.transform(columns, lambda c, i: F.struct(F.abs(x - (c.getField("left") + c.getField("right")) / 2).alias("d"), i.alias("i"), c.alias("c")))
    )
    return F.coalesce(F.get(inside, F.lit(0)), ranked.getField("c"))


def constrain_width(width: Column, x: Column, column: Column) -> Column:
    """A width that ends at its column's edge, ten points at least; unchanged without a column."""
    return F.when(column.isNull(), width).otherwise(F.greatest(F.least(width, column.getField("right") - x), F.lit(10.0)))


def clip_to_columns(rects: Column, columns: Column) -> Column:
    """Rects cut to the column of their centre; those left with five points or less are dropped."""

    def cut(r: Column) -> Column:
        f = r.getField
        c = column_of(columns, (f("x0") + f("x1")) / 2, (f("y0") + f("y1")) / 2)
        return F.when(c.isNull(), r).otherwise(rect(F.greatest(f("x0"), c.getField("left")), f("y0"), F.least(f("x1"), c.getField("right")), f("y1")))

    wide = lambda r: (r.getField("x1") - r.getField("x0") > 5) | (F.size(columns) == 0)
    return F.filter(F.transform(rects, cut), wide)


def is_multi_column(columns: Column) -> Column:
    return F.size(columns) > 1


def column_gap(columns: Column) -> Column:
    return F.when(F.size(columns) > 1, F.get(columns, F.lit(1)).getField("left") - F.get(columns, F.lit(0)).getField("right")).otherwise(0.0)


def position_point(c: Column | str) -> Column:
    """struct<x, y> in points of a position string on the default page; null if it can't be read."""

    def read(p: Column) -> Column:
        numbers = F.forall(p, lambda x: x.try_cast("double").isNotNull()) & (F.size(p) >= 6)
        at = lambda i, most: _limit(F.get(p, F.lit(i)).try_cast("double") * CONFIG.scale, F.lit(most))
        return F.when(numbers, F.struct(at(4, CONFIG.page_width).alias("x"), at(5, CONFIG.page_height).alias("y")))

    return let(parts(c), read)


def segments(start: Column, end: Column) -> Column:
    """Start and end rects of a multi-line highlight, from the top down."""
    return F.array_sort(F.array(start, end),
        lambda a, b: F.when(a.getField("y0") < b.getField("y0"), -1).when(a.getField("y0") > b.getField("y0"), 1).otherwise(0))
