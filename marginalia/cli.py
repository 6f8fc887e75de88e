"""Command line: side-cars, a clippings log and tables of pages and words in, draw commands out.

python -m marginalia.cli --sidecars FOLDER --pages PAGES.parquet --words WORDS.parquet --output FOLDER
                         [--clippings LOG] [--labels LABELS.parquet] [--all-sidecars] [--export-json FOLDER] [--learn-output FOLDER] [--verbose]

A book is known by its document's name: pages, words and labels have it as book_id, and a side-car belongs to the book
whose name its own file or folder name holds. One side-car of each book is used, the first by path, unless --all-sidecars.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .functions.containment import contained
from .operators import annotations, reports
from .plans import pipeline
from .schemas import BOOK_CLIPPING
from .session import cut, prepare
from .sinks import files as sinks
from .sources import clippings, files, sidecar


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="marginalia", description="Resolve reader annotations against document pages.")
    for name in ("sidecars", "pages", "words", "output"):
        p.add_argument(f"--{name}", required=True)
    for name in ("clippings", "labels", "export-json", "learn-output"):
        p.add_argument(f"--{name}")
    for name in ("all-sidecars", "verbose"):
        p.add_argument(f"--{name}", action="store_true")
    return p.parse_args(argv)


def missing_inputs(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Input paths that don't exist, asked of the store that each is in."""
    context = spark.sparkContext
    given = [p for p in (a.sidecars, a.pages, a.words, a.clippings, a.labels) if p]
    found = lambda p: (at := context._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(context._jsc.hadoopConfiguration()).globStatus(at)
    return [p for p in given if not found(p)]


def books_of_sidecars(spark: SparkSession, folder: str, books: DataFrame, every: bool) -> DataFrame:
    """(path, book_id): store files by the book whose stem their name or folder holds; the first of each book unless ``every``."""
    listed = files.listing(spark, folder, "*.pds", recursive=True).select("path", "name", "parent")
    listed, books = listed.withColumn("_name", F.explode(F.array_distinct(F.array("name", "parent")))), books.withColumn("_stem", T.book_key("book_id"))
    hit = listed.join(contained(listed, books, "_name", "_stem"), "_name").join(books, "_stem").select("path", "book_id").distinct()
    if every:
        return hit
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy("book_id").orderBy("path"))).where("_n = 1").drop("_n")


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """Write the commands and return how many there are; 0 writes nothing. An input that isn't there ends the run before it starts."""
    prepare(spark)
    if missing := missing_inputs(spark, a):
        raise SystemExit(f"not found: {', '.join(missing)}")
    pages, words = spark.read.parquet(a.pages), spark.read.parquet(a.words)
    books = pages.select("book_id").distinct()
    labels = spark.read.parquet(a.labels) if a.labels else None
    chosen = books_of_sidecars(spark, a.sidecars, books, a.all_sidecars).withColumnRenamed("book_id", "_book")
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pds").load(a.sidecars)
    decoded = sidecar.decode_annotations(stored.join(chosen.select("path"), "path", "left_semi"))
    decoded = decoded.join(chosen, F.col("book_id") == F.col("path")).drop("book_id", "path").withColumnRenamed("_book", "book_id").where("error IS NULL")
    if a.clippings:
        clips = clippings.parse_for_books(clippings.read_records(spark, a.clippings), books.withColumn("name", F.col("book_id")))
    else:
        clips = spark.createDataFrame([], BOOK_CLIPPING)
    # Without clippings nothing is refined by text, the text under a rect included.
    resolved = cut(pipeline.resolve_annotations(cut(decoded), cut(clips), pages, words, labels, rectangle_text=bool(a.clippings)))
    if a.verbose:
        reports.by_type(resolved).show()
        reports.sample_pages(resolved).show()
    if a.export_json:
        sinks.export_json(annotations.final_order(resolved), a.export_json)
    if a.learn_output and a.clippings:
        sinks.export_unmatched(pipeline.unmatched_clippings(clips, pages, words, labels), a.learn_output)
    if resolved.isEmpty():
        return 0
    commands = cut(pipeline.draw_commands(resolved, pages, words))
    total = commands.count()
    if total:
        sinks.write_commands(commands, a.output)
    return total


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("marginalia").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(f"{run(spark, a)} annotations written")


if __name__ == "__main__":
    main()
