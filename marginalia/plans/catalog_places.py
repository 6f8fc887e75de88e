"""Queries of positions, annotation rows, columns and rects, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import location as L
from ..operators import adapter, annotations, matching, quads, rects, reports
from ..operators import columns as column_ops
from ..sources import clippings as clipping_source
from ..sources import pages as page_source
from ..sources import sidecar
from . import inputs as I
from .catalog_text import PRINTED_SQL, printed
from .registry import query

_BOX = ("x0", "y0", "x1", "y1")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "lineitem")


def _sides(c: str) -> list:
    return [F.round(F.col(f"{c}.{n}"), 6).alias(n) for n in _BOX]


# --- annotation rows -------------------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'note' WHEN 'A' THEN 'bookmark' ELSE 'highlight' END AS type,
     CAST(l_linenumber AS INT) AS page, CASE WHEN l_linenumber % 2 = 0 THEN '9 0 ' || l_partkey || ' 1'
      ELSE l_linenumber || ' 0 ' || l_partkey || ' 1' END AS end_position
 FROM lineitem WHERE l_partkey % 4 <> 0 AND l_partkey % 5 <> 0"""
)
def valid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with a position that can be read, and of the kinds that have a place; the end defaults to the start."""
    li = _lineitem(spark, sf_dir)
    text = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.lit("0"), F.col("l_partkey").cast("string"), F.lit("1"))
    start = F.when(F.col("l_partkey") % 4 == 0, F.when(F.col("l_partkey") % 8 == 0, "1 x 3 4").otherwise("1 2 3")).otherwise(text)
    kind = F.when(F.col("l_partkey") % 5 == 0, "annotation.personal.underline").when(F.col("l_returnflag") == "R",
        "annotation.personal.note").when(F.col("l_returnflag") == "A", "annotation.personal.bookmark").otherwise("annotation.personal.highlight")
    rows = li.select("l_orderkey", "l_linenumber", kind.alias("annotation_type"), start.alias("start_position"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("9 0 "), F.col("l_partkey").cast("string"), F.lit(" 1"))).alias("end_position"))
    return annotations.with_positions(rows).select("l_orderkey", "l_linenumber", "type", F.col("start.page").alias("page"),
        F.col("end_raw").alias("end_position"))


_W, _H = "612e0", "792e0"


@query(
    f"""WITH r AS (SELECT *, l_partkey % 800 AS ux, l_suppkey % 1000 AS uy, CAST(l_quantity AS INT) AS uw, l_orderkey % 2 = 1
     AND l_linenumber % 3 < 2 AS boxed FROM lineitem),
p AS (SELECT *, CASE WHEN boxed THEN greatest(0.0, least(ux * 0.72e0 - 40.5e0, 571.5)) ELSE greatest(0.0, least(ux * 0.72e0, {_W})) END AS x, CASE
 WHEN boxed THEN greatest(0.0, least(uy * 0.72e0 - 10, 782.0)) ELSE greatest(0.0, least(uy * 0.72e0, {_H})) END AS y,
 CASE WHEN boxed THEN greatest(0.0, least((ux + 90) * 0.72e0 - 40.5e0, 571.5)) ELSE greatest(0.0, least((ux + 90) * 0.72e0, {_W})) END AS xe, CASE
  WHEN boxed THEN greatest(0.0, least((uy + 20) * 0.72e0 - 10, 782.0)) ELSE greatest(0.0, least((uy + 20) * 0.72e0, {_H})) END AS ye FROM r)
SELECT CAST(l_orderkey AS VARCHAR) AS book_id, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2
 ELSE 0 END * 1099511627776 + l_linenumber * 10000000 + l_partkey AS ord, CAST(l_linenumber % 3 + 1 AS INT) AS page_label, CAST(ux AS INT) AS unit_x,
  CAST(uy AS INT) AS unit_y, uw AS unit_width, 14 AS unit_height,
 (l_linenumber % 3) || ' 0 ' || l_partkey || ' 1 ' || ux || ' ' || uy || ' ' || uw || ' 14' AS start_position,
  (l_linenumber % 3) || ' 0 ' || l_partkey || ' 1 ' || (ux + 90) || ' ' || (uy + 20) || ' ' || uw || ' 14' AS end_position, {_W} AS page_width,
   {_H} AS page_height,
 round(ux / 100e0, 6) AS x_inches, round(uy / 100e0, 6) AS y_inches, round(xe, 6) AS pdf_x_end, round(ye, 6) AS pdf_y_end, round(CASE
  WHEN uw > 0 THEN greatest(0.0, least(uw * 0.72e0, greatest(0.0, {_W} - x))) ELSE 0.0 END, 6) AS pdf_width, round(greatest(0.0, least(14 * 0.72e0,
   greatest(0.0, {_H} - y))), 6) AS pdf_height, CAST(NULL AS VARCHAR) AS highlight_content FROM p"""
)
def resolved_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other columns of a resolved row: units, inches, ends, sizes, page size and positions."""
    rows = annotations.resolve(annotations.with_positions(I.sidecar_rows(spark, sf_dir)), I.book_pages(spark, sf_dir))
    exact = ("book_id", "ord", "page_label", "unit_x", "unit_y", "unit_width", "unit_height", "start_position", "end_position", "page_width",
        "page_height", "highlight_content")
    return rows.select(*exact, *[F.round(c, 6).alias(c) for c in ("x_inches", "y_inches", "pdf_x_end", "pdf_y_end", "pdf_width", "pdf_height")])


@query("SELECT event_id, CASE WHEN event_type LIKE '%a%' THEN 'highlight' ELSE event_type END AS kind, "
    "CASE WHEN user_id % 3 = 0 THEN 595.3e0 WHEN user_id % 3 = 1 THEN user_id + 0.5e0 ELSE 595.3e0 END AS width, "
    "CAST(CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS INT) AS page FROM events")
def category_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short category names, the default page size, and the first page column with a value."""
    e, u = I.table(spark, sf_dir, "events"), F.col("user_id")
    named = F.when(F.contains("event_type", F.lit("a")), "annotation.personal.highlight").otherwise(F.col("event_type"))
    size = F.when(u % 3 == 0, F.lit(None).cast("double")).when(u % 3 == 1, u + 0.5).otherwise(F.lit(-1.0))
    pages = e.select("*", *[F.when(u % 4 <= i, F.lit(i + 1)).alias(f"_p{i}") for i in range(3)])
    pages = pages.withColumn("_p1", F.when(u % 4 == 1, F.col("_p1"))).withColumn("_p2", F.when(u % 4 == 2, F.col("_p2")))
    return pages.select("event_id", sidecar.categories(named).alias("kind"), G.page_size(size, 595.3).alias("width"),
        adapter.page_of("_p0", "_p1", "_p2").alias("page"))


@query(
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'highlight' ELSE 'note' END AS kind, text FROM conversations)
SELECT 'clipping.' || kind AS type, 0 AS page, text AS content, 'clippings' AS source, 520.0e0 AS total, conv_id || '/' || turn AS timestamp FROM c
UNION ALL SELECT 'highlight', CAST(l_linenumber AS INT), 'n', 'kindle_highlight', NULL, l_orderkey || '/' || l_partkey FROM lineitem
 WHERE l_returnflag <> 'R'"""
)
def appended_clippings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's own rows with clippings put behind them as rows without a place."""
    li = _lineitem(spark, sf_dir).select(
        F.lit("highlight").alias("type"), F.col("l_linenumber").cast("int").alias("page"), F.lit("n").alias("content"),
            F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", "text_based_matching").otherwise("kindle_highlight").alias("source"),
    )
    c = I.table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 2 == 0, "highlight").otherwise("note").alias("type"),
        F.col("text").alias("content"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("date_added"))
    rows = annotations.append_clippings(annotations.from_reader(li), c)
    return rows.select("type", "page", "content", "source", F.aggregate("coordinates", F.lit(0.0), lambda s, x: s + x).alias("total"), "timestamp")


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS book_id, l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN CASE
     WHEN l_partkey % 2 = 0 THEN 'highlight' ELSE 'note' END WHEN l_returnflag = 'A' THEN 'bookmark' ELSE 'highlight' END AS command,
 CASE WHEN l_returnflag = 'R' AND l_partkey % 2 = 1 THEN 'Kindle Note' WHEN l_returnflag = 'R' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'Kindle Note'
  ELSE 'Kindle Highlight' END WHEN l_returnflag = 'A' THEN 'Kindle Bookmark' ELSE 'Kindle Highlight' END AS title,
 CASE WHEN l_returnflag = 'A' THEN 'body' WHEN l_returnflag = 'R' AND l_suppkey % 2 = 0 THEN 'body' WHEN l_returnflag = 'R'
  AND l_partkey % 2 = 1 THEN ' ' ELSE '' END AS content,
 CASE WHEN l_returnflag = 'R' AND l_partkey % 2 = 1 THEN CAST(l_partkey % 100 AS DOUBLE) END AS point_x, CAST(CASE
  WHEN l_returnflag = 'A' THEN l_linenumber % 3 + 1 END AS INT) AS outline_page FROM lineitem
 WHERE l_linenumber % 3 < 2 AND NOT (l_suppkey % 3 = 0 AND (l_returnflag NOT IN ('R', 'A') OR (l_returnflag = 'R' AND l_partkey % 2 = 0)))
  AND NOT (l_suppkey % 5 = 0 AND l_returnflag = 'R' AND l_partkey % 2 = 1)"""
)
def mark_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw commands: notes with a highlight's text are highlights, pages that don't exist and rows without rects or a point draw nothing."""
    li, note = _lineitem(spark, sf_dir), F.col("l_returnflag") == "R"
    rows = li.select(
        F.col("l_orderkey").cast("string").alias("book_id"), (F.col("l_linenumber") % 3).cast("int").alias("page"),
            F.col("l_linenumber").alias("ord"), F.when(note, "note").when(F.col("l_returnflag") == "A", "bookmark").otherwise("highlight").alias("type"),
        F.when(F.col("l_suppkey") % 2 == 0, "body").when(F.col("l_returnflag") == "A", "body").otherwise(" ").alias("content"),
            F.when(note & (F.col("l_partkey") % 2 == 0), "its text").alias("highlight_content"), F.lit("no date").alias("timestamp"),
        F.when(F.col("l_suppkey") % 3 != 0, F.array(G.rect(F.lit(1), F.lit(2), F.lit(3),
            F.lit(4)))).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")).alias("rects"),
        F.when(F.col("l_suppkey") % 5 != 0, F.array(*[(F.col("l_partkey") % 100).cast("double")] * 4)).otherwise(F.array(F.lit(1.0))).alias("coordinates"),
    )
    made = adapter.commands(adapter.drawable(rows, I.book_pages(spark, sf_dir)))
    return made.select("book_id", "ord", "command", "title", "content", F.get("point", F.lit(0)).alias("point_x"), "outline_page")


# --- positions and columns -------------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 AND l_linenumber % 5 <> 0 THEN round(greatest(0.0, least(l_partkey * 0.72e0,
     595.3e0)), 6) END AS x, CASE WHEN l_linenumber % 4 <> 0 AND l_linenumber % 5 <> 0 THEN round(greatest(0.0, least(l_suppkey * 0.72e0, 841.9e0)),
      6) END AS y FROM lineitem"""
)
def position_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    place = [F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")]
    text = F.when(F.col("l_linenumber") % 4 == 0, "1 2 3 4").when(F.col("l_linenumber") % 5 == 0,
        F.concat_ws(" ", F.lit("1 2 x 4"), *place)).otherwise(F.concat_ws(" ", F.lit("1 2 3 4"), *place))
    p = G.position_point(text)
    return li.select("l_orderkey", "l_linenumber", F.round(p.getField("x"), 6).alias("x"), F.round(p.getField("y"), 6).alias("y"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey % 800 AS DOUBLE) AS y, l_quantity * 6 AS w
     FROM lineitem),
c AS (SELECT *, CASE WHEN x + w / 2 BETWEEN 50 AND 280 AND y + 6 BETWEEN 60 AND 700 THEN 1 WHEN x + w / 2 BETWEEN 300 AND 540 AND y + 6 BETWEEN 60
 AND 700 THEN 2 WHEN abs(x + w / 2 - 165) <= abs(x + w / 2 - 420) THEN 1 ELSE 2 END AS k,
 CASE WHEN x BETWEEN 50 AND 280 AND y BETWEEN 60 AND 700 THEN 1 WHEN x BETWEEN 300 AND 540 AND y BETWEEN 60 AND 700 THEN 2
  WHEN abs(x - 165) <= abs(x - 420) THEN 1 ELSE 2 END AS z FROM r),
d AS (SELECT *, greatest(x, CASE k WHEN 1 THEN 50 ELSE 300 END) AS x0, least(x + w, CASE k WHEN 1 THEN 280 ELSE 540 END) AS x1 FROM c)
SELECT l_orderkey, l_linenumber, greatest(least(w, CASE z WHEN 1 THEN 280 ELSE 540 END - x), 10.0) AS width, CASE
 WHEN x1 - x0 > 5 THEN x0 END AS clipped_x0, CASE WHEN x1 - x0 > 5 THEN x1 END AS clipped_x1, l_linenumber % 2 = 0 AS several, CASE
  WHEN l_linenumber % 2 = 0 THEN 20e0 ELSE 0e0 END AS gap FROM d"""
)
def columns_of_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths held inside a column, rects cut to the column of their centre, and whether a page has several columns, and their gap."""
    cols = F.array(*[column_ops.column(*[F.lit(float(v)) for v in c]) for c in ((50, 280, 60, 700), (300, 540, 60, 700))])
    x, y, w = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 800).cast("double"), F.col("l_quantity") * 6
    li = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), w.alias("w"))
    cut = G.clip_to_columns(F.array(G.rect(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + 12)), cols)
    shown = F.when(F.col("l_linenumber") % 2 == 0, cols).otherwise(F.slice(cols, 1, 1))
    return li.select(
        "l_orderkey", "l_linenumber", G.constrain_width(F.col("w"), F.col("x"), G.column_of(cols, F.col("x"), F.col("y"))).alias("width"),
            F.get(cut, F.lit(0)).getField("x0").alias("clipped_x0"), F.get(cut, F.lit(0)).getField("x1").alias("clipped_x1"),
        G.is_multi_column(shown).alias("several"), G.column_gap(shown).alias("gap"),
    )


@query("SELECT l_orderkey, l_linenumber, least(l_partkey % 90, l_suppkey % 90) * 1.0e0 AS first_y, greatest(l_partkey % 90, "
    "l_suppkey % 90) * 1.0e0 AS last_y, CASE WHEN l_partkey % 90 <= l_suppkey % 90 THEN 1e0 ELSE 2e0 END AS first_x FROM lineitem")
def ordered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end rects from the top down; of equals the start comes first."""
    a, b = F.col("l_partkey") % 90, F.col("l_suppkey") % 90
    s = G.segments(G.rect(F.lit(1), a, F.lit(9), a + 5), G.rect(F.lit(2), b, F.lit(9), b + 5))
    at = lambda i, n: F.get(s, F.lit(i)).getField(n)
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", at(0, "y0").alias("first_y"), at(1, "y0").alias("last_y"),
        at(0, "x0").alias("first_x"))


# --- rects of highlights ---------------------------------------------------------------------------------------------

_SNAKE = """n AS (SELECT *, least(sy, ey) AS top, greatest(1, CAST(round_even(CAST((greatest(sy, ey) - least(sy, ey)) / 16 AS DECIMAL(18, 6)),
 0) AS INT) + 1) AS k FROM s), l AS (SELECT *, unnest(range(0, k)) AS i FROM n),
r AS (SELECT book_id, CASE WHEN i = 0 THEN sx ELSE ml END AS x0, top + i * 16 AS y0, CASE WHEN i = k - 1 THEN ex ELSE mr END AS x1 FROM l)"""


@query(
    f"""WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS kind, CAST(o_orderkey % 300 AS DOUBLE) AS x, CAST(o_custkey % 600 AS DOUBLE) AS y FROM orders),
s AS (SELECT o_orderkey AS book_id, x AS sx, CASE kind WHEN 2 THEN y + 40 ELSE y END AS sy, CASE kind WHEN 0 THEN x + 60 WHEN 1 THEN greatest(0.0,
 least(800 * 0.72e0, 595.3e0)) ELSE x + 90 END AS ex, CASE kind WHEN 0 THEN y WHEN 1 THEN greatest(0.0, least((o_orderkey % 900) * 0.72e0, 841.9e0))
  ELSE y END AS ey, 30e0 AS ml, 380e0 AS mr FROM o), {_SNAKE}
SELECT CAST(book_id AS VARCHAR) AS book_id, count(*) AS n_rects, round(sum(x0), 4) AS lefts, round(sum(x1), 4) AS rights, round(min(y0), 4) AS top
 FROM r WHERE x1 > x0 GROUP BY book_id"""
)
def margin_snakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from start to end inside a page's margins: by a row's size, by its positions, or by its four coordinates."""
    o, kind = I.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    x, y = (F.col("o_orderkey") % 300).cast("double"), (F.col("o_custkey") % 600).cast("double")
    end = F.concat(F.lit("0 0 1 1 800 "), (F.col("o_orderkey") % 900).cast("string"), F.lit(" 9 9"))
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("book_id"), F.lit(0).alias("page"), F.lit("0 0 1 1 5 5 9 9").alias("start_position"),
            end.alias("end_position"), x.alias("pdf_x"), y.alias("pdf_y"), F.when(kind == 0, 60.0).otherwise(0.0).alias("pdf_width"),
        F.when(kind == 0, 12.0).otherwise(0.0).alias("pdf_height"), F.when(kind == 2, F.array(x, y + 40, x + 90, y)).alias("coordinates"),
    )
    margins = o.select(F.col("o_orderkey").cast("string").alias("book_id"), F.lit(0).alias("page"), F.lit(30.0).alias("left"),
        F.lit(380.0).alias("right"), F.lit(0.0).alias("top"), F.lit(700.0).alias("bottom"))
    made = rects.from_margins(rows, margins).select("book_id", F.explode("margin_rects").alias("r"))
    return made.groupBy("book_id").agg(F.count("*").alias("n_rects"), F.round(F.sum("r.x0"), 4).alias("lefts"),
        F.round(F.sum("r.x1"), 4).alias("rights"), F.round(F.min("r.y0"), 4).alias("top"))


@query(
    f"""WITH w AS ({I.WORDS_SQL}), l AS (SELECT book_id, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM w GROUP BY book_id, line),
t AS (SELECT *, (CAST(book_id AS BIGINT) % 40) * 0.72e0 AS top, (CAST(book_id AS BIGINT) % 40 + 30) * 0.72e0 AS bottom, 100 * 0.72e0 AS sx,
 300 * 0.72e0 AS ex FROM l), g AS (SELECT * FROM t WHERE NOT (y1 < top OR y0 > bottom)),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY y0) AS i, count(*) OVER (PARTITION BY book_id) AS n,
 min(x0) OVER (PARTITION BY book_id) AS ml, max(x1) OVER (PARTITION BY book_id) AS mr FROM g),
r AS (SELECT *, least(greatest(sx, ml), mr) AS single FROM n),
q AS (SELECT book_id, i, CASE WHEN n = 1 THEN single WHEN i = 1 THEN greatest(sx, ml) ELSE ml END AS a, CASE WHEN n = 1 THEN least(greatest(ex,
 single + 0.1e0), mr) WHEN i = n THEN least(ex, mr) ELSE mr END AS b, y0, y1 FROM r)
SELECT book_id, count(*) AS n_rects, round(sum(a), 4) AS lefts, round(sum(b), 4) AS rights, min(y0) AS top, max(y1) AS bottom FROM q WHERE b > a
 GROUP BY book_id"""
)
def rects_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real lines between a start and an end position, cut at both."""
    w, b = I.words(spark, sf_dir), F.col("book_id").cast("long") % 40
    text = lambda x, y: F.concat(F.lit(f"0 0 1 1 {x} "), y.cast("string"), F.lit(" 9 9"))
    rows = w.select("book_id", "page").distinct().withColumns({"start_position": text(100, b), "end_position": text(300, b + 30)})
    made = rects.from_lines(rows, page_source.lines(w)).select("book_id", F.explode("rects").alias("r"))
    return made.groupBy("book_id").agg(F.count("*").alias("n_rects"), F.round(F.sum("r.x0"), 4).alias("lefts"),
        F.round(F.sum("r.x1"), 4).alias("rights"), F.min("r.y0").alias("top"), F.max("r.y1").alias("bottom"))


@query(
    f"""WITH w AS ({PRINTED_SQL}), h AS (SELECT * FROM w WHERE ord BETWEEN 2 AND 5), s AS (SELECT book_id, min(x0) AS l, max(x1) AS r FROM w GROUP BY book_id),
p AS (SELECT book_id, line, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0 FROM h GROUP BY book_id, line), n AS (SELECT *,
 row_number() OVER (PARTITION BY book_id ORDER BY line) AS i, count(*) OVER (PARTITION BY book_id) AS n FROM p)
SELECT book_id, i - 1 AS i, CASE WHEN i = 1 THEN x0 ELSE l END AS x0, y0, CASE WHEN i = n THEN x1 ELSE r END AS x1 FROM n JOIN s USING (book_id)"""
)
def rects_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched words, a rect a line: the first runs to the block's right side, the last comes from its left."""
    w = printed(spark, sf_dir)
    made = rects.from_words(w.where("ord BETWEEN 2 AND 5").select("book_id", "page", "ord"), w).select("book_id", F.posexplode("rects").alias("i", "r"))
    return made.select("book_id", F.col("i").cast("long").alias("i"), "r.x0", "r.y0", "r.x1")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 1e0 WHEN l_suppkey % 2 = 0 THEN 100e0 WHEN l_partkey % 5 = 1 THEN 2e0
     WHEN l_partkey % 5 = 2 THEN 3e0 WHEN l_partkey % 5 = 3 THEN 4e0 END AS x0,
 CAST(CASE WHEN l_partkey % 5 < 4 OR l_suppkey % 2 = 0 THEN 1 END AS INT) AS n FROM lineitem"""
)
def rect_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first that there is: precise rects, the row's own rect, segments, the snake of margins, lines between positions."""
    k, none = F.col("l_partkey") % 5, F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    some = lambda i, empty: F.when(k == i, F.array(G.rect(F.lit(i + 1), F.lit(0), F.lit(9),
        F.lit(9)))).otherwise(F.slice(F.array(G.rect(F.lit(0), F.lit(0), F.lit(0), F.lit(0))), 1, 0) if empty else none)
    size = F.when(F.col("l_suppkey") % 2 == 0, 5.0).otherwise(0.001)
    li = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", some(0, True).alias("a"), some(1, False).alias("b"), some(2, True).alias("c"),
        some(3, False).alias("d"), F.lit(100.0).alias("pdf_x"), F.lit(7.0).alias("pdf_y"), size.alias("pdf_width"), size.alias("pdf_height"))
    got = rects.choose(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return li.select("l_orderkey", "l_linenumber", F.get(got, F.lit(0)).getField("x0").alias("x0"), F.when(got.isNotNull(), F.size(got)).alias("n"))


# --- reports ---------------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT l_suppkey % 20 AS page, count(*) AS expected FROM lineitem GROUP BY 1), m AS (SELECT o_custkey % 25 AS page, "
    "count(*) AS matched FROM orders WHERE o_custkey % 25 > 3 GROUP BY 1) SELECT page, coalesce(expected, 0) AS expected, coalesce(matched, "
    "0) AS matched, round(CASE WHEN coalesce(expected, 0) = 0 THEN 1.0 ELSE coalesce(matched, 0) / expected END, "
    "9) AS coverage FROM e FULL JOIN m USING (page)")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = _lineitem(spark, sf_dir).select((F.col("l_suppkey") % 20).alias("page"))
    matched = I.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("page")).where("page > 3")
    return reports.coverage(expected, matched, "page").withColumn("coverage", F.round("coverage", 9))


@query("SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS spread, round(avg(l_quantity), 6) AS mean_width, "
    "max(l_quantity) - min(l_quantity) <= 0.3e0 * avg(l_quantity) AS even FROM lineitem GROUP BY l_orderkey")
def width_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lineitem(spark, sf_dir).select("l_orderkey", F.col("l_partkey").cast("double").alias("x0"), (F.col("l_partkey") + F.col("l_quantity")).alias("x1"))
    return reports.width_spread(r, "l_orderkey").withColumn("mean_width", F.round("mean_width", 6))


@query(
    """WITH k AS (SELECT l_orderkey AS b, count(*) AS k FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS b, k, o_custkey % 3 = 0 AS far
     FROM orders LEFT JOIN k ON b = o_orderkey)
SELECT count(*) AS highlights, CAST(count_if(k > 1) AS BIGINT) AS with_regions, CAST(count_if(far) AS BIGINT) AS disconnected,
 round(count_if(far) / count(*), 9) AS error_rate FROM o"""
)
def highlight_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over all highlights: how many have several regions, and how many have regions far apart."""
    o = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("b"), (F.col("o_custkey") % 3 == 0).alias("all_far"))
    got = reports.highlight_quality(o, _lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("b")), o, "b")
    return got.select(*[F.col(c).cast("long").alias(c) for c in ("highlights", "with_regions", "disconnected")], F.round("error_rate", 9).alias("error_rate"))


@query("SELECT DISTINCT o_custkey AS page FROM orders ORDER BY page LIMIT 10")
def sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten pages that have rows: the report's own limit."""
    return reports.sample_pages(I.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page")))


@query(
    """WITH r AS (SELECT l_suppkey AS b, l_orderkey * 10 + l_linenumber AS ord, l_partkey % 40 AS loc, l_quantity AS pg FROM lineitem)
SELECT CAST(b AS VARCHAR) AS title, ord, row_number() OVER (PARTITION BY b ORDER BY CASE WHEN loc < 10 THEN 0 ELSE loc END, CAST(pg AS INT),
 ord) AS place FROM r"""
)
def order_in_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clippings by the first number of their location, then of their page; a location without a number comes first."""
    loc = F.col("l_partkey") % 40
    c = _lineitem(spark, sf_dir).select(
        F.col("l_suppkey").cast("string").alias("title"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
            F.when(loc < 10, "none").otherwise(F.concat(loc.cast("string"), F.lit("-99"))).alias("location"),
        F.concat(F.lit("p. "), F.col("l_quantity").cast("int").cast("string")).alias("page"),
    )
    return clipping_source.in_book_order(c).select("title", "ord", F.col("place").cast("long").alias("place"))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'Supplier ' || l_suppkey
     WHEN 1 THEN 'supplier-' || l_suppkey || '_Extra' WHEN 2 THEN 'plier' || l_suppkey ELSE 'none of them' END AS title, l_suppkey FROM lineitem),
b AS (SELECT s_suppkey, 'Supplier_' || s_suppkey AS t FROM supplier), q AS (SELECT DISTINCT title, lower(translate(title, ' -_', '')) AS x FROM c),
 y AS (SELECT s_suppkey, lower(translate(t, ' -_', '')) AS y FROM b),
m AS (SELECT title, min(s_suppkey) AS s FROM q JOIN y ON contains(x, y) OR contains(y, x) GROUP BY title) SELECT l_orderkey, l_linenumber, title,
 CAST(s AS VARCHAR) AS book_id FROM c JOIN m USING (title)"""
)
def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first book whose title holds a clipping's, or is held by it, when spaces, hyphens and underscores are left out."""
    k, s = F.col("l_linenumber") % 4, F.col("l_suppkey").cast("string")
    title = F.when(k == 0, F.concat(F.lit("Supplier "), s)).when(k == 1, F.concat(F.lit("supplier-"), s, F.lit("_Extra"))).when(k == 2,
        F.concat(F.lit("plier"), s)).otherwise("none of them")
    clips = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", title.alias("title"))
    books = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("book_id"),
        F.concat(F.lit("Supplier_"), F.col("s_suppkey").cast("string")).alias("title"), F.col("s_suppkey").alias("ord"))
    return matching.first_title(clips, books)


@query(
    f"""WITH w AS ({I.WORDS_SQL}), s AS (SELECT book_id, ord, (x0 - 150) * (x0 - 150) + (y0 - 20) * (y0 - 20) AS d, x0, y0, x1,
     count(*) OVER (PARTITION BY book_id) AS n FROM w)
SELECT book_id, CAST(count(*) AS INT) AS n_kept, min(x0) AS x0 FROM s WHERE n = 1 GROUP BY book_id UNION ALL SELECT book_id, 1, arg_min(x0,
 struct_pack(d := d, o := ord)) FROM s WHERE n > 1 GROUP BY book_id"""
)
def short_text_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of eight characters or less keep the one occurrence nearest to their place."""
    w = I.words(spark, sf_dir).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord",
        G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r")))).alias("q"))
    r = w.select("book_id", F.transform("q", lambda x: x.getField("r")).alias("rects")).withColumns({"x": F.lit(150.0), "y": F.lit(20.0), "length": F.lit(8)})
    return quads.filter_by_proximity(r).select("book_id", F.size("kept").alias("n_kept"), F.get("kept", F.lit(0)).getField("x0").alias("x0"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE k WHEN 3 THEN 'extracted' WHEN 4 THEN 'range' WHEN 5 THEN 'error' ELSE 'error' END AS kind, CAST(CASE k
     WHEN 3 THEN a WHEN 4 THEN a END AS INT) AS start_location, CAST(CASE k WHEN 3 THEN a WHEN 4 THEN a + 3 END AS INT) AS end_location,
 CASE k WHEN 0 THEN a || '-x' WHEN 1 THEN '-' || a WHEN 2 THEN 'x-' || a WHEN 3 THEN CAST(a AS VARCHAR) WHEN 4 THEN a || '-' || (a + 3)
  WHEN 5 THEN '' END AS normal
 FROM (SELECT *, l_partkey AS a, l_partkey % 6 AS k FROM lineitem)"""
)
def broken_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with one hyphen that are no range are errors, whatever digits they hold; several hyphens are no range either."""
    a, k = F.col("l_partkey").cast("string"), F.col("l_partkey") % 6
    loc = F.when(k == 0, F.concat(a, F.lit("-x"))).when(k == 1, F.concat(F.lit("-"), a)).when(k == 2, F.concat(F.lit("x-"), a)).when(k == 3,
        F.concat(a, F.lit("-2-3"))).when(k == 4, F.concat(F.lit(" "), a, F.lit(" - "), (F.col("l_partkey") + 3).cast("string"))).otherwise("")
    d = _lineitem(spark, sf_dir).withColumn("loc", loc).withColumn("d", L.decode("loc"))
    return d.select("l_orderkey", "l_linenumber", F.col("d.type").alias("kind"), "d.start_location", "d.end_location", L.normalize("loc").alias("normal"))
