"""The driver's tables in the shapes of the annotation operators, made by expressions that the SQL oracles repeat.

``benchmark`` plays clippings, ``documents`` pages, ``lineitem`` positions and words, ``conversations`` log records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of one record for each conversation turn."""
    c = table(spark, sf_dir, "conversations")
    record = F.concat(
        F.lit("Book "), F.col("conv_id").cast("string"), F.lit(" ("), F.coalesce("role", F.lit("none")), F.lit(")\n- Your "),
            F.when(F.col("turn") % 2 == 0, "Highlight").otherwise("Note"), F.lit(" on Page "), (F.col("turn") + 1).cast("string"),
        F.lit(" | Added on Monday, March 4, 2024 1:02:0"), (F.col("turn") % 10).cast("string"), F.lit(" PM\n\n"), F.coalesce("text", F.lit("")),
            F.lit("\n==========\n"),
    )
    return c.select("conv_id", "turn", record.alias("text"))


LOGS_SQL = """SELECT conv_id, turn, 'Book ' || conv_id || ' (' || coalesce(role, 'none') || ')' AS title_line, CASE
 WHEN turn % 2 = 0 THEN 'Highlight' ELSE 'Note' END AS kind,
 turn + 1 AS page_no, coalesce(text, '') AS content FROM conversations"""


def position_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position strings of order lines: eight parts, or four where the line number is a multiple of three."""
    li = table(spark, sf_dir, "lineitem")
    four = [F.col("l_linenumber"), F.lit(0), F.col("l_partkey"), F.lit(1)]
    geo = [F.col("l_partkey") % 800, F.col("l_suppkey") % 1000, F.col("l_quantity").cast("int"), F.col("l_linenumber") * 7]
    text = lambda parts: F.concat_ws(" ", *[p.cast("string") for p in parts])
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
        F.when(F.col("l_linenumber") % 3 == 0, text(four)).otherwise(text(four + geo)).alias("pos"))


POSITIONS_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linenumber % 3 <> 0 AS long_form,
 l_partkey % 800 AS ux, l_suppkey % 1000 AS uy,
 CAST(l_quantity AS INT) AS uw, l_linenumber * 7 AS uh FROM lineitem"""


def sidecar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as annotations: the order is the book, the line's page one of three, the flag the type."""
    li = table(spark, sf_dir, "lineitem")
    geo = lambda dx, dy: F.concat_ws(" ", *[x.cast("string") for x in ((F.col("l_linenumber") % 3), F.lit(0), F.col("l_partkey"), F.lit(1),
        F.col("l_partkey") % 800 + dx, F.col("l_suppkey") % 1000 + dy, F.col("l_quantity").cast("int"), F.lit(14))])
    kind = F.when(F.col("l_returnflag") == "R", "annotation.personal.note").when(F.col("l_returnflag") == "A",
        "annotation.personal.bookmark").otherwise("annotation.personal.highlight")
    return li.select(
        F.col("l_orderkey").cast("string").alias("book_id"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).cast("long").alias("ord"),
            kind.alias("annotation_type"), geo(0, 0).alias("start_position"), geo(90, 20).alias("end_position"),
        F.col("l_shipdate").alias("creation_time"), F.col("l_shipdate").alias("last_modification_time"), F.lit("t").alias("template"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("note "), F.col("l_partkey").cast("string"))).alias("note_text"),
                F.lit(None).cast("string").alias("error"),
    )


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 0 and 1 of each order's book; pages of odd orders have a crop box."""
    o = table(spark, sf_dir, "orders")
    box = F.when(F.col("o_orderkey") % 2 == 1, G.rect(F.lit(40.5), F.lit(10.0), F.lit(612.0), F.lit(792.0)))
    return o.select(F.col("o_orderkey").cast("string").alias("book_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page"),
        F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), box.alias("cropbox"), F.lit("").alias("text"))


def point_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as resolved rows: part modulo as place, so many lines of a supplier's page coincide."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "note").when(F.col("l_returnflag") == "A", "bookmark").otherwise("highlight")
    x, y = (F.col("l_partkey") % 37).cast("double") * 3, (F.col("l_partkey") % 11).cast("double") * 4
    return li.select(
        F.col("l_suppkey").cast("string").alias("book_id"), (F.col("l_linenumber") % 4).cast("int").alias("page"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), kind.alias("type"), x.alias("pdf_x"), y.alias("pdf_y"),
        (x + 90).alias("pdf_x_end"), (y + 12).alias("pdf_y_end"),
            F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.concat(F.lit("text "), (F.col("l_partkey") % 7).cast("string"))).alias("content"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("timestamp"), F.lit(None).cast("string").alias("highlight_content"),
    )


POINTS_SQL = """SELECT CAST(l_suppkey AS VARCHAR) AS book_id, CAST(l_linenumber % 4 AS INT) AS page, l_orderkey * 10 + l_linenumber AS ord,
 CASE l_returnflag WHEN 'R' THEN 'note' WHEN 'A' THEN 'bookmark' ELSE 'highlight' END AS type, CAST(l_partkey % 37 AS DOUBLE) * 3 AS pdf_x,
  CAST(l_partkey % 11 AS DOUBLE) * 4 AS pdf_y,
 CAST(l_partkey % 37 AS DOUBLE) * 3 + 90 AS pdf_x_end, CAST(l_partkey % 11 AS DOUBLE) * 4 + 12 AS pdf_y_end,
 CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE 'text ' || (l_partkey % 7) END AS content, strftime(l_shipdate, '%Y-%m-%d') AS timestamp FROM lineitem"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words: the order is a page, two words stand on a line."""
    li = table(spark, sf_dir, "lineitem")
    li = li.withColumn("_n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    n = F.col("_n")
    x0, y0 = (F.col("l_partkey") % 300).cast("double"), (F.floor((n - 1) / 2) * 16).cast("double")
    return li.select(
        F.col("l_orderkey").cast("string").alias("book_id"), F.lit(0).alias("page"), n.cast("long").alias("ord"), F.lit(0).alias("block"),
            F.floor((n - 1) / 2).cast("int").alias("line"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 12).alias("y1"),
        F.concat(F.lit("W"), (F.col("l_partkey") % 5).cast("string"), F.when(n % 4 == 1, "-").otherwise("")).alias("word"),
    )


WORDS_SQL = """SELECT CAST(l_orderkey AS VARCHAR) AS book_id, 0 AS page, CAST(n AS BIGINT) AS ord, 0 AS block, CAST((n - 1) // 2 AS INT) AS line,
 CAST(l_partkey % 300 AS DOUBLE) AS x0,
 CAST(((n - 1) // 2) * 16 AS DOUBLE) AS y0, CAST(l_partkey % 300 AS DOUBLE) + l_quantity AS x1, CAST(((n - 1) // 2) * 16 AS DOUBLE) + 12 AS y1,
 'W' || (l_partkey % 5) || CASE WHEN n % 4 = 1 THEN '-' ELSE '' END AS word FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as clippings; every fourth is spoiled at its end."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.when(F.col("item_id") % 4 == 3, F.concat("text", F.lit(" Zq zq zq zq."))).otherwise(F.col("text")).alias("content"))
