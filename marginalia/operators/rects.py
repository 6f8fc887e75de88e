"""The rects that a highlight is drawn with: from words, from start and end with margins, or from lines between positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.bands import band_join
from ..schemas import RECTS

LINE_HEIGHT = 16.0


def snake(sx: Column, sy: Column, ex: Column, ey: Column, left: Column, right: Column) -> Column:
    """Rects of lines from a start to an end point: the first runs to the right margin, the last from the left one, those between fill both."""
    top = F.least(sy, ey)
    n = G.line_count(F.greatest(sy, ey) - top, LINE_HEIGHT)

    def line(i: Column) -> Column:
        y = top + i * LINE_HEIGHT
        x0 = F.when(i == 0, sx).otherwise(left)
        x1 = F.when(i == n - 1, ex).otherwise(right)
        return G.rect(x0, y, x1, y + LINE_HEIGHT)

    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), line), lambda r: r.getField("x1") > r.getField("x0")).cast(RECTS)


def start_and_end(margins: Column, start: Column, end: Column) -> Column:
    """struct<sx, sy, ex, ey> of an annotation row: its four coordinates, its point and width, its positions (points ``start`` and ``end``),
    else the page's margins."""
    coordinates = F.col("coordinates")
    at = lambda i: F.get(coordinates, F.lit(i))
    make = lambda a, b, c, d: F.struct(a.cast("double").alias("sx"), b.cast("double").alias("sy"), c.cast("double").alias("ex"),
        d.cast("double").alias("ey"))
    sized = (F.abs("pdf_width") >= 0.01) & (F.abs("pdf_height") >= 0.01)
    own = F.when(sized, make(F.col("pdf_x"), F.col("pdf_y"), F.col("pdf_x") + F.col("pdf_width"), F.col("pdf_y"))).otherwise(
        make(F.col("pdf_x"), F.col("pdf_y"), F.coalesce(end.getField("x"), F.col("pdf_x") - 50), F.coalesce(end.getField("y"), F.col("pdf_y") + 48))
    )
    m = margins.getField
    return F.when(F.size(coordinates) >= 4, make(at(0), at(1), at(2), at(3))).when(F.col("pdf_x").isNotNull() & F.col("pdf_y").isNotNull(), own).when(
        start.isNotNull() & end.isNotNull(), make(start.getField("x"), start.getField("y"), end.getField("x"), end.getField("y"))
    ).when(margins.isNotNull(), make(m("left"), m("top"), m("right"), m("bottom")))


def from_margins(rows: DataFrame, margins: DataFrame, columns: DataFrame | None = None, out: str = "margin_rects") -> DataFrame:
    """Adds the snake of rects between an annotation's start and end, inside the column of its start, else the page's margins.

    ``margins`` (book_id, page, left, right, top, bottom) and ``columns`` (book_id, page, columns) may lack a page.
    """
    m = margins.select(F.col("book_id").alias("_b"), F.col("page").alias("_p"), F.struct("left", "right", "top", "bottom").alias("_m"))
    j = rows.join(m, (rows.book_id == m["_b"]) & (rows.page == m["_p"]), "left").drop("_b", "_p")
    if columns is not None:
        c = columns.select(F.col("book_id").alias("_b"), F.col("page").alias("_p"), F.col("columns").alias("_cs"))
        j = j.join(c, (j.book_id == c["_b"]) & (j.page == c["_p"]), "left").drop("_b", "_p")
    else:
        j = j.withColumn("_cs", F.lit(None).cast("array<struct<left:double,right:double,top:double,bottom:double>>"))
    # Unpacked from arrays of one: as plain columns they would be put into each other wherever they are used, and into filters that are
    # pushed down, and positions would be parsed hundreds of times a row.
    once = lambda df, name, c: df.select("*", F.explode(F.array(F.struct(c.alias("v")))).alias("_one")).select(*df.columns, F.col("_one.v").alias(name))
    points = F.struct(G.position_point("start_position").alias("start"), G.position_point("end_position").alias("end"))
    j = once(j, "_points", points)
    j = once(j, "_se", start_and_end(F.col("_m"), F.col("_points.start"), F.col("_points.end")))
    j = once(j, "_c", G.column_of(F.col("_cs"), F.col("_se.sx"), F.col("_se.sy")))
    left = F.coalesce("_c.left", "_m.left", F.lit(50.0))
    right = F.coalesce("_c.right", "_m.right", F.lit(G.CONFIG.page_width) - 50)
    made = F.when(F.col("_se").isNotNull(), snake(F.col("_se.sx"), F.col("_se.sy"), F.col("_se.ex"), F.col("_se.ey"), left, right))
    return once(j.drop(out), out, made).drop("_m", "_cs", "_points", "_se", "_c")


def select_lines(spans: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """Lines that touch each vertical span [top, bottom] of a page; where none does, those whose middle is within half a point of it."""
    # Every touching line also has the wider condition, so one join gives both and a window tells which holds.
    touches = ~((F.col("l.y1") < F.col("s.top")) | (F.col("l.y0") > F.col("s.bottom")))
    middle = ((F.col("l.y0") + F.col("l.y1")) / 2).between(F.col("s.top") - 0.5, F.col("s.bottom") + 0.5)
    j = band_join(spans, lines, (F.col("top"), F.col("bottom")), (F.col("y0"), F.col("y1")), touches | middle, ("s", "l"), 0.5)
    picked = j.select(*[F.col(f"s.{k}").alias(k) for k in ("book_id", "page", *keys)], touches.alias("_t"),
        *[F.col(f"l.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")], F.col("l.ord").alias("line_ord"))
    any_touch = F.max("_t").over(Window.partitionBy("book_id", "page", *keys))
    picked = picked.repartition("book_id", "page")  # serves this window and those by page that may follow, which would be a shuffle each
    return picked.withColumn("_any", any_touch).where("_t = _any").drop("_t", "_any")


def from_lines(rows: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, rects): the lines between start and end positions, cut at both and held inside the text's sides."""
    a, b = G.position_point("start_position"), G.position_point("end_position")
    # Unpacked from an array: a filter on the points would be pushed down, even to rows that are made distinct first, and parse the positions there once more.
    both = F.filter(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: p.getField("a").isNotNull() & p.getField("b").isNotNull())
    s = rows.select("book_id", "page", *keys, F.explode(both).alias("_p")).select("book_id", "page", *keys, "_p.a", "_p.b")
    s = s.select("book_id", "page", *keys, F.least("a.y", "b.y").alias("top"), F.greatest("a.y", "b.y").alias("bottom"), F.col("a.x").alias("sx"),
        F.col("b.x").alias("ex"))
    got = select_lines(s, lines, "sx", "ex", *keys)
    w = Window.partitionBy("book_id", "page", *keys)
    got = got.select("*", F.row_number().over(w.orderBy("y0", "line_ord")).alias("_i"), F.count("*").over(w).alias("_n"),
        F.min("x0").over(w).alias("_l"), F.max("x1").over(w).alias("_r"))
    only = F.least(F.greatest("sx", "_l"), F.col("_r"))
    x0 = F.when(F.col("_n") == 1, only).when(F.col("_i") == 1, F.greatest("sx", "_l")).otherwise(F.col("_l"))
    x1 = F.when(F.col("_n") == 1, F.least(F.greatest(F.col("ex"), only + 0.1), F.col("_r"))).when(F.col("_i") == F.col("_n"),
        F.least("ex", "_r")).otherwise(F.col("_r"))
    made = got.withColumn("r", G.rect(x0, F.col("y0"), x1, F.col("y1"))).where("r.x1 > r.x0 AND r.y1 > r.y0")
    return made.groupBy("book_id", "page", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "r"))), lambda x: x.getField("r")).alias("rects"))


def from_words(hits: DataFrame, words: DataFrame, *keys: str) -> DataFrame:
    """(keys, rects) of matched words (book_id, page, keys, ord): one rect for each line, the first to the block's right side, the last from its left.

    Of words that are matched in part ``hits`` have the sides x0 and x1 of that part.
    """
    j = hits.join(words.drop("x0", "x1") if "x0" in hits.columns else words, ["book_id", "page", "ord"])
    blocks = words.groupBy("book_id", "page", "block").agg(F.min("x0").alias("_l"), F.max("x1").alias("_r"))
    per = j.groupBy("book_id", "page", *keys, "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"),
        F.max("y1").alias("y1")).join(blocks, ["book_id", "page", "block"])
    w = Window.partitionBy("book_id", "page", *keys)
    per = per.select("*", F.row_number().over(w.orderBy("block", "line")).alias("_i"), F.count("*").over(w).alias("_n"))
    x0 = F.when(F.col("_i") == 1, F.col("x0")).otherwise(F.col("_l"))
    x1 = F.when(F.col("_i") == F.col("_n"), F.col("x1")).otherwise(F.col("_r"))
    return per.groupBy("book_id", "page", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i",
        G.rect(x0, F.col("y0"), x1, F.col("y1")).alias("r")))), lambda x: x.getField("r")).alias("rects"))


def choose(precise: Column, segment_rects: Column, margin_rects: Column, line_rects: Column) -> Column:
    """The first of: precise rects, the row's own rect if it has a size, segments, the snake of margins, lines between positions."""
    some = lambda a: F.when(F.size(a) > 0, a.cast(RECTS))
    own = F.when((F.abs("pdf_width") >= 0.01) & (F.abs("pdf_height") >= 0.01),
        F.array(G.rect(F.col("pdf_x"), F.col("pdf_y"), F.col("pdf_x") + F.col("pdf_width"), F.col("pdf_y") + F.col("pdf_height"))).cast(RECTS))
    return F.coalesce(some(precise), own, some(segment_rects), some(margin_rects), some(line_rects))
