"""Batches of books that go on where they stopped.

A manifest beside the output says for each book which state of its inputs is done. A run takes up the books whose state is
new, part by part; a part's rows are written first, each with its book's state, and then entered in the manifest. So a broken run
repeats no finished part, an unchanged book is never computed or written again, and what a broken part left behind is not read,
because its state isn't entered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

MANIFEST = "book_id string, state string, added bigint, run bigint"


def states(files: DataFrame) -> DataFrame:
    """(book_id, state) from the inputs of each book (book_id, path, size, modified), in whatever order and number they come."""
    h = F.xxhash64("path", "size", "modified")
    return files.groupBy("book_id").agg(F.concat_ws(":", F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).alias("state"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def done(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, state, added, run): what was last entered for each book."""
    if not _exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    spark.catalog.refreshByPath(f"{folder}/manifest")
    entered = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return entered.groupBy("book_id").agg(F.max_by("state", "run").alias("state"), F.max_by("added", "run").alias("added"), F.max("run").alias("run"))


def pending(wanted: DataFrame, folder: str) -> DataFrame:
    """Books of ``wanted`` (book_id, state) whose state isn't the one that is done."""
    return wanted.join(done(wanted.sparkSession, folder), ["book_id", "state"], "left_anti")


def run(wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], folder: str, parts: int = 8) -> int:
    """Compute and write the books that are pending, and return how many there were.

    ``compute`` makes the rows (with book_id) of the books that it is given as (book_id, state). Books are dealt into
    ``parts`` by hash; a part rewrites only its own books' partitions of ``folder``/rows.
    """
    spark = wanted.sparkSession
    todo = cut(pending(wanted, folder).withColumn("_part", F.pmod(F.xxhash64("book_id"), F.lit(parts)).cast("int")))
    last = done(spark, folder).agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    count = 0
    for r in todo.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # at most ``parts`` rows
        books = todo.where(F.col("_part") == r["_part"]).select("book_id", "state")
        rows = cut(compute(books).join(books, "book_id"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(f"{folder}/rows")
        added = rows.groupBy("book_id").agg(F.count("*").alias("added"))
        entered = books.join(added, "book_id", "left").select("book_id", "state", F.coalesce("added", F.lit(0)).alias("added"), F.lit(last + 1).cast("long").alias("run"))
        entered.write.mode("append").parquet(f"{folder}/manifest")
        count += r["n"]
    return count


def read(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """The rows of all books as they were last entered; of the books of ``wanted`` only, where it is given."""
    if not _exists(spark, f"{folder}/rows"):
        raise FileNotFoundError(f"{folder} has no rows")
    spark.catalog.refreshByPath(f"{folder}/rows")
    known = done(spark, folder).where("added > 0").select("book_id", "state")
    if wanted is not None:
        known = known.join(wanted.select("book_id"), "book_id", "left_semi")
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").withColumn("book_id", F.col("book_id").cast("string"))
    return rows.join(known, ["book_id", "state"]).drop("state")
