"""Resolved rows to records that can be drawn: filters, boxes, titles and draw commands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..schemas import RECTS


def adapt(rows: DataFrame) -> DataFrame:
    """Adds coordinates [left, top, right, bottom], segment_rects and is_multi_line. Blank rows go unless they are highlights or bookmarks."""
    body = T.strip(F.coalesce("content", F.lit("")))
    kept = rows.where(F.col("type").isin("highlight", "bookmark") | (body != "")).withColumn("content", body)
    small = (F.abs("pdf_width") < 0.01) | (F.abs("pdf_height") < 0.01)
    w = F.when(small, G.length_to_points(F.col("unit_width").cast("double"), F.col("page_width"))).otherwise(F.col("pdf_width"))
    h = F.when(small, G.length_to_points(F.col("unit_height").cast("double"), None)).otherwise(F.col("pdf_height"))
    # Step by step, so that each position is cut once a row and its numbers are read once. Reading them in a lambda also parts the generated code in two
    # methods: one with all of this, and what it is made of, is too long for the JVM to compile, and is interpreted row by row.
    kept = kept.select(*rows.columns, w.alias("_w"), h.alias("_h"), *[F.transform(G.parts(c), lambda x: x.try_cast("int")).alias(v) for v, c in (("_s", "start_position"), ("_e", "end_position"))])
    # Eight whole numbers or none: null | n is null.
    whole_numbers = lambda v: (F.size(v) >= 8) & reduce(lambda a, b: a.bitwiseOR(b), [F.get(v, F.lit(i)) for i in range(8)]).isNotNull()
    kept = kept.select("*", *[F.coalesce(whole_numbers(v), F.lit(False)).alias(f"{v}ok") for v in ("_s", "_e")])
    number = lambda v, i: F.when(F.col(f"{v}ok"), F.get(v, F.lit(i))).otherwise(0)
    eight = (F.size("_s") >= 8) & (F.size("_e") >= 8)
    kept = kept.select("*", eight.alias("_eight"), number("_s", 5).alias("_sy"), *[number("_e", i).alias(f"_e{n}") for i, n in ((4, "x"), (5, "y"), (6, "w"), (7, "h"))])
    multi = F.coalesce((F.col("type") == "highlight") & F.col("_eight") & (F.col("start_position") != F.col("end_position")) & (F.abs(F.col("_ey") - F.col("_sy")) > 10), F.lit(False))
    start = G.rect(F.col("pdf_x"), F.col("pdf_y"), F.col("pdf_x") + F.col("_w"), F.col("pdf_y") + F.col("_h"))
    end_at = G.point(F.col("_ex").cast("double"), F.col("_ey").cast("double"), F.col("page_width"), F.col("page_height"),
        F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    ex, ey = end_at.getField("x"), end_at.getField("y")
    end = G.rect(ex, ey, ex + G.length_to_points(F.col("_ew").cast("double"), F.col("page_width")),
        ey + G.length_to_points(F.col("_eh").cast("double"), None))
    kept = kept.select(*rows.columns, multi.alias("is_multi_line"), start.alias("_a"), end.alias("_b"))
    whole = F.when(F.col("is_multi_line"), G.rect(F.col("pdf_x"), F.least("_a.y0", "_b.y0"), F.greatest("_a.x1", "_b.x1"),
        F.greatest("_a.y1", "_b.y1"))).otherwise(F.col("_a"))
    kept = kept.withColumn("_r", whole)
    right = F.when(F.col("_r.x1") <= F.col("pdf_x"), F.col("pdf_x") + 5).otherwise(F.col("_r.x1"))
    bottom = F.when(F.col("_r.y1") <= F.col("_r.y0"), F.col("_r.y0") + 12).otherwise(F.col("_r.y1"))
    icon = lambda dx, dy: F.array("pdf_x", "pdf_y", F.col("pdf_x") + dx, F.col("pdf_y") + dy)
    coordinates = F.when(F.col("type") == "highlight", F.array(F.col("pdf_x"), F.col("_r.y0"), right, bottom)).when(F.col("type") == "note",
        icon(20, 20)).when(F.col("type") == "bookmark", icon(18, 18)).otherwise(icon(100, 20))
    return kept.withColumn("coordinates", coordinates).withColumn("segment_rects",
        F.when(F.col("is_multi_line"), G.segments(F.col("_a"), F.col("_b"))).cast(RECTS)).drop("_a", "_b", "_r")


def page_of(*columns: str):
    """The first page column that has a value."""
    return F.coalesce(*[F.col(c) for c in columns])


def drawable(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with the type they are drawn as (a note with a highlight's text is a highlight), on pages that exist."""
    kind = F.when((F.col("type") == "note") & (F.coalesce("highlight_content", F.lit("")) != ""), "highlight").otherwise(F.col("type"))
    typed = rows.withColumn("draw_type", kind).where(F.col("draw_type").isin("highlight", "note", "bookmark"))
    return typed.join(pages.select("book_id", "page").distinct(), ["book_id", "page"], "left_semi")


def commands(rows: DataFrame) -> DataFrame:
    """One draw command for each drawable row that has what its kind needs: rects, a point, or an outline entry."""
    unified = (F.col("type") == "note") & (T.strip(F.coalesce("content", F.lit(""))) != "")
    title = F.when(F.col("draw_type") == "highlight",
        F.when(unified, "Kindle Note").otherwise("Kindle Highlight")).when(F.col("draw_type") == "note", "Kindle Note").otherwise(T.bookmark_title("timestamp"))
    ok = F.when(F.col("draw_type") == "highlight", F.size("rects") > 0).when(F.col("draw_type") == "note", F.size("coordinates") >= 4).otherwise(True)
    return rows.where(ok).select(
        "book_id", "page", "ord", F.col("draw_type").alias("command"), title.alias("title"),
            F.when(F.col("draw_type") != "highlight", F.col("content")).when(unified, F.col("content")).otherwise("").alias("content"),
        F.when(F.col("draw_type") == "highlight", F.col("rects")).alias("rects"),
            F.when(F.col("draw_type") == "note", F.slice("coordinates", 1, 2)).alias("point"),
        F.when(F.col("draw_type") == "bookmark", F.col("page") + 1).alias("outline_page"),
            F.when(F.col("draw_type") == "highlight", F.array(*[F.lit(v) for v in (1.0, 1.0, 0.0)])).alias("color"),
    )
