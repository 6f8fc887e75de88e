"""File listings as tables, and the rules that choose side-cars, logs and documents from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def listing(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, name, stem, suffix, parent, size and modified of files; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return describe(reader.load(path).select("path", "length", "modificationTime"))


def describe(files: DataFrame) -> DataFrame:
    """File information columns from (path, length, modificationTime)."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select(
        "path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*\z", "").alias("stem"),
            F.regexp_extract(name, r"(\.[^.]*)\z", 1).alias("suffix"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("parent"),
        F.col("length").alias("size"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), F.col("modificationTime").alias("modified"),
    )


def list_documents(files: DataFrame) -> DataFrame:
    """PDF files by path."""
    return files.where(F.lower("suffix") == ".pdf").orderBy("path")


def find_sidecars(files: DataFrame, name: str) -> DataFrame:
    """Store files whose name holds ``name``, and all store files in a side-car folder whose name does."""
    store = F.lower("suffix").isin(".pds", ".pdt")
    return files.where(store & (F.contains("name", F.lit(name)) | (F.endswith("parent", F.lit(".sdr")) & F.contains("parent", F.lit(name))))).orderBy("path")


def find_reader_files(files: DataFrame, document: str) -> DataFrame:
    """Distinct store files under four spellings of a document's name."""
    stem = document.rsplit(".", 1)[0]
    names = list(dict.fromkeys((document, stem, stem.replace(" ", "_"), stem.replace("_", " "))))
    hit = F.lit(False)
    for n in names:
        hit = hit | F.startswith("name", F.lit(n)) | F.startswith("parent", F.lit(n))
    return files.where(hit & (F.lower("suffix").isin(".pds", ".pdt") | F.endswith("parent", F.lit(".sdr")))).dropDuplicates(["path"])


def select_sidecar(files: DataFrame, stem: str) -> DataFrame:
    """The one store file to use: the first whose name or folder holds the document's stem, else the first."""
    rank = F.when(F.contains("name", F.lit(stem)) | F.contains("parent", F.lit(stem)), 0).otherwise(1)
    return files.where(F.lower("suffix") == ".pds").withColumn("_r", rank).orderBy("_r", "path").limit(1).drop("_r")


def match_sidecars(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(document, path, rule) of each document's store files, by the first rule that gives any.

    1: its own side-car or folder; 2: a folder of equal normalised name; 3: any store file will do, said by one row without a
    path rather than by a row for each file there is (see :func:`first_per_document`).
    """
    d = documents.select(F.col("path").alias("document"), "name", "stem", T.token_norm("name").alias("_n"), T.token_norm("stem").alias("_s"))
    f = files.where(F.lower("suffix") == ".pds").select("path", F.col("stem").alias("file_stem"), F.col("name").alias("file_name"), "parent")
    folder = F.regexp_replace("parent", r"\.sdr\z", "")
    own = d.join(f, F.col("file_stem") == F.col("stem")).select("document", "path", F.lit(1).alias("rule"))
    in_own = d.join(f.withColumn("_folder", folder), F.col("_folder") == F.col("stem")).select("document", "path", F.lit(1).alias("rule"))
    g = f.where(F.endswith("parent", F.lit(".sdr"))).withColumn("_k", T.token_norm(folder))
    by_name = d.join(g, F.col("_k") == F.col("_n")).select("document", "path", F.lit(2).alias("rule"))
    by_stem = d.join(g, F.col("_k") == F.col("_s")).select("document", "path", F.lit(2).alias("rule"))
    found = own.union(in_own).union(by_name).union(by_stem).groupBy("document", "path").agg(F.min("rule").alias("rule"))
    found = found.union(d.select("document", F.lit(None).cast("string").alias("path"), F.lit(3).alias("rule")))
    best = F.min("rule").over(Window.partitionBy("document"))
    return found.withColumn("_best", best).where("rule = _best").drop("_best")


def find_document(documents: DataFrame, candidates: list[str], book: str) -> DataFrame:
    """The first candidate path that exists, else the first PDF whose stem holds the book's name (hidden copies left out)."""
    order = F.array_position(F.array(*[F.lit(c) for c in candidates] or [F.lit(None).cast("string")]), F.col("path"))
    named = F.contains(F.lower("stem"), F.lower(F.lit(book))) & ~F.startswith("name", F.lit("._")) & (F.lower("suffix") == ".pdf")
    rank = F.when(order > 0, order).when(named, F.lit(2**31))
    return documents.withColumn("_rank", rank).where("_rank IS NOT NULL").orderBy("_rank", "path").limit(1).drop("_rank")


# Where devices keep the log, in the order looked at.
LOG_PLACES = ("My Clippings.txt", "MyClippings.txt", "documents/My Clippings.txt", "documents/MyClippings.txt", "Documents/My Clippings.txt", "system/My Clippings.txt")


def logs_of_devices(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, path): for each device the first clippings log in the usual places under its ``folder``, the first path of one place."""
    places = F.array(*[F.concat(F.regexp_replace("folder", "/*$", "/"), F.lit(p)) for p in LOG_PLACES])
    order = F.array_position(places, F.regexp_replace("path", r"\A[a-z]+:/*", "/"))
    return files.withColumn("_o", order).where("_o > 0").groupBy(*keys).agg(F.min_by("path", F.struct("_o", "path")).alias("path"))


def find_log(files: DataFrame, folder: str) -> DataFrame:
    """The first clippings log in the usual places under a device's folder."""
    order = F.array_position(F.array(*[F.lit(f"{folder}/{p}") for p in LOG_PLACES]), F.regexp_replace("path", r"\A[a-z]+:/*", "/"))
    return files.withColumn("_o", order).where("_o > 0").orderBy("_o").limit(1).drop("_o")


def first_per_document(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(document, path, rule) with the first file of each document by path; the first store file of all where any will do, none where there is none."""
    any_file = files.where(F.lower("suffix") == ".pds").agg(F.min("path").alias("_any"))
    first = pairs.groupBy("document", "rule").agg(F.min("path").alias("path"))
    return first.crossJoin(F.broadcast(any_file)).select("document", F.coalesce("path", F.when(F.col("rule") == 3, F.col("_any"))).alias("path"),
        "rule")  # one row
