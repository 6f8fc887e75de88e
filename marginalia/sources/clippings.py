"""Clippings logs: text files of records that end in a line of equals signs.

:func:`read_log` reads each file whole; :func:`read_records` reads byte ranges of files of any size and numbers the records
as if each file had been read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.containment import contained
from ..functions.similarity import decode_with_fallback
from ..session import cut


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of each file: UTF-8, else Latin-1. Files are read in the executors, each whole."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source_file"), F.regexp_replace(decode_with_fallback("content"), "\r\n?", "\n").alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, ord, lines) of the records of logs of any size, as :func:`records` of :func:`read_log` has them.

    Files are read in splits, and records written once with their place in the split, since another reading may be split
    elsewhere. A pass over them counts the records of each split, sees whether all of a file is UTF-8, and
    whether it begins with a byte order mark, which Spark's reader leaves out (the file is three bytes longer than its records).
    A running sum over a file's splits then gives each split its first number.
    """
    raw = cut(spark.read.option("lineSep", T.RECORD_END).text(path).select("value", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_split"), F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_id")))
    by_split = raw.groupBy("source_file", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"), F.max("_size").alias("_size"),
        F.sum(F.octet_length("value")).alias("_bytes"), F.bool_and(F.is_valid_utf8("value")).alias("_utf8"))
    w = Window.partitionBy("source_file")
    before = w.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    between = F.sum("_n").over(w) - 1  # ends of records, without one at the end of the file
    rest = F.col("_size") - F.sum("_bytes").over(w) - len(T.RECORD_END) * between
    splits = cut(by_split.select(F.col("source_file").alias("_file"), F.col("_split").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        "_least", F.bool_and("_utf8").over(w).alias("_utf8"), rest.isin(3, 3 + len(T.RECORD_END)).alias("_marked")))
    r = raw.join(splits, (F.col("source_file") == F.col("_file")) & (F.col("_split") == F.col("_at")))
    text = F.when(F.col("_utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    ord = F.col("_before") + F.col("_id") - F.col("_least")
    mark = F.when(F.col("_marked") & (ord == 0), F.when(F.col("_utf8"), "\ufeff").otherwise("ï»¿")).otherwise("")
    lines = _lines(F.regexp_replace(F.concat(mark, text), "\r\n?", "\n"))
    return r.select("source_file", ord.alias("ord"), lines.alias("lines")).where(F.size("lines") >= 2)


def _lines(c: Column) -> Column:
    return F.split(T.strip(c), "\n")


def records(logs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each record of two lines or more: the other columns, ord (its place among a log's parts) and lines."""
    parts = logs.select(*[c for c in logs.columns if c != text], F.posexplode(F.split(text, T.RECORD_END)).alias("ord", "_part"))
    return parts.select(*[c for c in parts.columns if c != "_part"],
        _lines(F.col("_part")).alias("lines")).where(F.size("lines") >= 2).withColumn("ord", F.col("ord").cast("long"))


def parse(logs: DataFrame, text: str = "text", strip_bom: bool = False) -> DataFrame:
    """Clippings with title, author, type, location, page, date_added, content and raw_location_info.

    ``logs`` hold whole texts, or records as :func:`read_records` gives them. A byte order mark before the first title
    stays part of it, unless ``strip_bom``.
    """
    r = logs if "lines" in logs.columns else records(logs, text)
    keep = [c for c in r.columns if c != "lines"]
    title = F.get("lines", F.lit(0))
    if strip_bom:
        title = F.regexp_replace(title, "\\A\ufeff", "")
    head, meta = T.title_author(T.strip(title)), T.meta_line(T.strip(F.get("lines", F.lit(1))))
    body = F.transform(F.slice("lines", F.lit(3), F.size("lines")), T.strip)
    r = r.select(*keep, head.alias("_h"), meta.alias("_m"), T.strip(F.array_join(body, "\n")).alias("content"),
        T.strip(F.get("lines", F.lit(1))).alias("raw_location_info"))
    return r.select(
        *keep, F.col("_h.title").alias("title"), F.col("_h.author").alias("author"), F.col("_m.type").alias("type"),
            F.col("_m.location").alias("location"), F.col("_m.page").alias("page"),
        T.added_date(F.col("_m.added")).alias("date_added"), "content", "raw_location_info",
    )


def parse_for_books(logs: DataFrame, books: DataFrame, text: str = "text") -> DataFrame:
    """Clippings of each book (a table with book_id and name) whose key is part of a record's title line.

    Records without a page are left out; what isn't a note is a highlight.
    """
    r = (logs if "lines" in logs.columns else records(logs, text)).select("ord", "lines", F.lower(F.get("lines", F.lit(0))).alias("_title"), T.strip(F.get("lines", F.lit(1))).alias("raw_meta"))
    named = books.select("book_id", F.lower(T.book_key("name")).alias("_key"))
    # A log repeats its titles: each is held against the books' keys once, and records meet their books by title.
    joined = r.join(contained(r, named, "_title", "_key"), "_title").join(named, "_key")
    page = F.regexp_extract("raw_meta", r"(?i)page\s+(\d+(?:-\d+)?)", 1)
    body = F.array_join(F.slice("lines", F.lit(3), F.size("lines")), "\n")
    return joined.where(page != "").select(
        "book_id", "ord", F.when(F.contains(F.lower("raw_meta"), F.lit("note")), "note").otherwise("highlight").alias("type"),
            T.range_start(page).alias("pdf_page"), T.strip(body).alias("content"),
        T.added_on("raw_meta").alias("timestamp"), "raw_meta", page.alias("page_str"),
    )


def by_book(clippings: DataFrame, *keys: str) -> DataFrame:
    """One row for each title: the first author, the number of clippings, and the clippings in order of location and page.

    The list is for exports, where a title's clippings go into one record; :func:`in_book_order` gives the same order as rows.
    """
    item = F.struct(T.first_int("location").alias("location_no"), T.first_int("page").alias("page_no"), "ord", "type", "location", "page",
        "date_added", "content")
    return clippings.groupBy(*keys, "title").agg(
        F.min_by("author", "ord").alias("author"), F.count("*").alias("n_clippings"), F.array_sort(F.collect_list(item)).alias("clippings")
    )


def totals(clippings: DataFrame) -> DataFrame:
    return clippings.agg(F.count("*").alias("total_clippings"), F.count_distinct("title").alias("total_books"))


def in_book_order(clippings: DataFrame, *keys: str) -> DataFrame:
    """``clippings`` with place: the rank within its title by first number of location, then of page, then input order."""
    w = Window.partitionBy(*keys, "title").orderBy(T.first_int("location"), T.first_int("page"), "ord")
    return clippings.withColumn("place", F.row_number().over(w))
