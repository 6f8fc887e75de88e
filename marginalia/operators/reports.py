"""Counts, fits and quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.bands import band_join
from ..functions.similarity import could_be_alike, sequence_ratio


def by_page(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page").agg(F.count("*").alias("n"))


def by_type(rows: DataFrame) -> DataFrame:
    """One row: how many highlights, notes and bookmarks."""
    return rows.agg(*[F.count_if(F.col("type") == t).alias(f"{t}s") for t in ("highlight", "note", "bookmark")])


def sample_pages(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.select("page").distinct().orderBy("page").limit(n)


def linear_fit(pairs: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """slope and intercept of the least-squares line; groups with fewer than two pairs are left out."""
    return pairs.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n")).where("n >= 2")


def shared_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page").intersect(b.select("page"))


def pages_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page").subtract(b.select("page"))


def overlap_matches(expected: DataFrame, actual: DataFrame, *keys: str, least: float = 0.8) -> DataFrame:
    """Each expected rect with the actual one of its page that covers most of it, if that is ``least`` or more: (book_id, page, keys, actual_ord, ratio)."""
    if least <= 0:
        raise ValueError("rects that don't meet cover nothing: least has to be more than 0")
    ratio = G.intersection_area(F.col("e.r"), F.col("a.r")) / F.nullif(G.area(F.col("e.r")), F.lit(0.0))
    y = (F.col("r.y0"), F.col("r.y1"))
    j = band_join(expected, actual, y, y, ratio >= least, ("e", "a"))
    scored = j.select(*[F.col(f"e.{k}").alias(k) for k in ("book_id", "page", *keys)], F.col("a.ord").alias("actual_ord"),
        ratio.alias("ratio"))
    w = Window.partitionBy("book_id", "page", *keys).orderBy(F.desc("ratio"), "actual_ord")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def similar_texts(expected: DataFrame, actual: DataFrame, *keys: str, least: float = 0.80) -> DataFrame:
    """Each expected text with the most similar actual text of its page, from ``least`` on.

    Pairs of a page that native bounds rule out never reach the similarity.
    """
    j = expected.select("book_id", "page", *keys,
        F.col("content").alias("_e")).join(actual.select("book_id", "page", F.col("ord").alias("actual_ord"), F.col("content").alias("_a")),
            ["book_id", "page"])
    scored = j.where(could_be_alike("_e", "_a", least)).withColumn("ratio", sequence_ratio("_e", "_a")).where(F.col("ratio") >= least)
    w = Window.partitionBy("book_id", "page", *keys).orderBy(F.desc("ratio"), "actual_ord")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_e", "_a")


def coverage(expected: DataFrame, matched: DataFrame, *keys: str) -> DataFrame:
    """expected, matched and their ratio for each key; 1 where nothing is expected."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("expected"))
    m = matched.groupBy(*keys).agg(F.count("*").alias("matched"))
    j = e.join(m, list(keys), "full") if keys else e.crossJoin(m)  # two single rows
    n = F.coalesce("expected", F.lit(0))
    k = F.coalesce("matched", F.lit(0))
    return j.select(*keys, n.alias("expected"), k.alias("matched"), F.when(n == 0, 1.0).otherwise(k / n).alias("coverage"))


def width_spread(rects: DataFrame, *keys: str) -> DataFrame:
    """Difference of the widest and narrowest rect against three tenths of the mean width."""
    w = F.col("x1") - F.col("x0")
    return rects.groupBy(*keys).agg((F.max(w) - F.min(w)).alias("spread"), F.avg(w).alias("mean_width")).withColumn("even",
        F.col("spread") <= 0.3 * F.col("mean_width"))


def highlight_quality(annotations: DataFrame, regions: DataFrame, flags: DataFrame, *keys: str) -> DataFrame:
    """One row of counters: highlights, those with several regions, those with regions far apart, and the share of these."""
    several = regions.groupBy(*keys).agg(F.count("*").alias("_k"))
    j = annotations.select(*keys).join(several, list(keys), "left").join(flags.select(*keys, "all_far"), list(keys), "left")
    return j.agg(F.count("*").alias("highlights"), F.count_if(F.col("_k") > 1).alias("with_regions"), F.count_if("all_far").alias("disconnected"),
        (F.count_if("all_far") / F.nullif(F.count("*"), F.lit(0))).alias("error_rate"))
