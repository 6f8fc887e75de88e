"""Which short texts hold which, as an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts up to this number are given to every task, so that what the wholes are cut into is never shuffled.
SHARED_ROWS = 50_000


def contained(wholes: DataFrame, parts: DataFrame, whole: str, part: str) -> DataFrame:
    """Distinct (whole, part) of two tables' values where the whole holds the part, without comparing all with all.

    Short texts such as titles, names and words are cut into their own parts of just those lengths that the parts have, seen in a
    count of them first, and what has a part's length and hash meets it. So parts that begin alike don't meet all that holds
    their beginning: rows grow with what is found. A whole gives at most its length in rows for each of these lengths. An empty part is
    held by every text and meets them without a key; a null is held by none. ``parts`` are read twice.
    """
    p = parts.select(F.col(part).alias(part)).where(F.col(part).isNotNull()).distinct().withColumns({"_k": F.length(part), "_hash": F.xxhash64(part)})
    w = wholes.select(F.col(whole).alias(whole)).where(F.col(whole).isNotNull()).distinct()
    counted = {r.n: r.k for r in p.groupBy(F.col("_k").alias("n")).agg(F.count("*").alias("k")).collect()}  # a row for each length
    lengths = F.array(*[F.lit(n) for n in sorted(counted) if n]).cast("array<int>")
    keyed = p.where("_k > 0")
    cuts = w.select(whole, F.explode(F.filter(lengths, lambda k: k <= F.length(whole))).alias("_k"))
    each = F.transform(F.sequence(F.lit(1), F.length(whole) - F.col("_k") + 1), lambda i: F.xxhash64(F.substring(whole, i, F.col("_k"))))
    cuts = cuts.select(whole, "_k", F.explode(F.array_distinct(each)).alias("_hash"))
    # Spark doesn't know how many rows a whole is cut into: by its estimate millions of cuts of a small table would be brought to the driver to be given to all.
    few = sum(counted.values()) <= SHARED_ROWS
    held = cuts.join(F.broadcast(keyed), ["_k", "_hash"]) if few else cuts.hint("merge").join(keyed, ["_k", "_hash"])
    held = held.where(F.contains(F.col(whole), F.col(part))).select(whole, part)
    return held.unionByName(w.withColumn(part, F.lit(""))) if counted.get(0) else held
