"""Text columns of pages. All native: lines of one page are folded inside an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import COLUMN

LEAST_LINES, LEAST_SECOND, TOLERANCE, GAP = 15, 10, 15.0, 50.0


def column(left: Column, right: Column, top: Column, bottom: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((left, right, top, bottom), ("left", "right", "top", "bottom"), strict=True)])


def first_fit_lefts(lefts: Column, tolerance: float = TOLERANCE) -> Column:
    """array<struct<pos, n, i>>: left edges in order, each counted with the first group whose first edge is near."""
    kind = "array<struct<pos:double,n:int,i:int>>"

    def step(groups: Column, x: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: F.abs(x - g.getField("pos")) <= tolerance), F.lit(True))
        grown = F.transform(groups, lambda g, k: F.struct(g.getField("pos").alias("pos"),
            F.when(k + 1 == at, g.getField("n") + 1).otherwise(g.getField("n")).alias("n"), g.getField("i").alias("i")))
        new = F.concat(groups, F.array(F.struct(x.alias("pos"), F.lit(1).alias("n"), F.size(groups).alias("i"))))
        return F.when(at > 0, grown).otherwise(new).cast(kind)

    return F.aggregate(lefts, F.array().cast(kind), step)


def _box(lines: Column, right_most: Column | None = None) -> Column:
    side = lambda f, n: f(F.transform(lines, lambda q: q.getField(n)))
    right = side(F.array_max, "x1")
    return column(side(F.array_min, "x0"), right if right_most is None else F.least(right, right_most), side(F.array_min, "y0"), side(F.array_max, "y1"))


def detect(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, page, columns): one or two columns of every page. ``lines`` have x0, y0, x1, y1, ord; ``pages`` width, height."""
    packed = lines.groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "x0", "y0", "x1", "y1"))).alias("ls"))
    p = pages.select("book_id", "page", "width", "height").join(packed, ["book_id", "page"], "left")
    ls = F.col("ls")
    groups = F.array_sort(first_fit_lefts(F.transform("ls", lambda q: q.getField("x0"))),
        lambda a, b: F.when(a.getField("n") != b.getField("n"), b.getField("n") - a.getField("n")).otherwise(a.getField("i") - b.getField("i")))
    p = p.withColumn("_g", F.when(F.size("ls") >= LEAST_LINES, groups))
    one, two = F.get("_g", F.lit(0)), F.get("_g", F.lit(1))
    low, high = F.least(one.getField("pos"), two.getField("pos")), F.greatest(one.getField("pos"), two.getField("pos"))
    p = p.withColumn("_low", F.when(two.getField("n") >= LEAST_SECOND, low)).withColumn("_high", F.when(two.getField("n") >= LEAST_SECOND, high))
    near = lambda at: F.filter("ls", lambda q: F.abs(q.getField("x0") - F.col(at)) <= TOLERANCE)
    whole = F.array(_box(ls))
    default = F.array(column(F.lit(50.0), F.col("width") - 50, F.lit(50.0), F.col("height") - 50))
    few = F.array(column(F.array_min(F.transform("ls", lambda q: q.getField("x0"))), F.array_max(F.transform("ls", lambda q: q.getField("x1"))),
        F.lit(50.0), F.col("height") - 50))
    both = F.array(_box(near("_low"), F.col("_high") - 10), _box(near("_high")))
    chosen = F.when(ls.isNull(), default).when(F.size("ls") < LEAST_LINES, few).when(F.col("_high") - F.col("_low") > GAP, both).otherwise(whole)
    return p.select("book_id", "page", chosen.cast(f"array<{COLUMN}>").alias("columns"))


def detect_by_range(lines: DataFrame, tolerance: float = 20.0, least: int = 3, few: int = 10) -> DataFrame:
    """The other rule: every distinct left edge with three lines or more within reach; the first two if far enough apart.

    One row for each column: (book_id, page, place, left, right, top, bottom).
    """
    keys = ["book_id", "page"]
    lefts = lines.select(*keys, F.col("x0").alias("pos")).distinct()
    near = lefts.join(lines, keys).where(F.abs(F.col("x0") - F.col("pos")) <= tolerance)
    groups = near.groupBy(*keys, "pos").agg(F.count("*").alias("n"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y0").alias("top"),
        F.max("y1").alias("bottom")).where(F.col("n") >= least)
    w = Window.partitionBy(*keys)
    ranked = groups.withColumn("place", F.row_number().over(w.orderBy("pos"))).where("place <= 2").withColumn("_far",
        F.max("pos").over(w) - F.min("pos").over(w) > GAP)
    whole = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y0").alias("top"),
        F.max("y1").alias("bottom"))
    two = ranked.where("_far").join(whole.select(*keys, "n_lines"), keys).where(F.col("n_lines") >= few).select(*keys, "place", "left", "right",
        "top", "bottom")
    one = whole.join(two.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(1).alias("place"), "left", "right", "top", "bottom")
    return two.unionByName(one)
