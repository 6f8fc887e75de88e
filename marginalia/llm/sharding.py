"""Sharding by a hypergeometric communication matrix, with DataFrame operations only.

The input partitions are the senders. The driver draws, from a multivariate hypergeometric law, how many rows each
sender gives to each shard, so that every shard's size is exact (counts at most one apart). Each sender permutes its
rows and deals them out by these counts; after the exchange every shard permutes again. Together this is a uniform
shuffle of all rows. Both permutations work in blocks of about ``BLOCK_ROWS`` rows: a hash chooses a row's block, another
one its place there, so neither a large input partition nor a large shard is ever sorted by one task.

The driver holds the matrix and the senders' sizes, nothing else. Partitions are taken together as one sender where
there are more than ``MAX_SENDERS`` of them, or where senders times shards would exceed ``MATRIX_CELLS``. Draws are
exact at any size: :func:`large_draw` rejects from a hat over probabilities that keep their precision.

Defined results: a null text has 16 bytes and crc 0, like an empty one; texts of any length are read whole; repeated
rows are separate rows; equal keys never matter because rows are numbered before they are dealt; an empty table gives no
rows. Extra columns pass as they are; columns of the input called shard or slot give way to the results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, table

BLOCK_ROWS = 250_000
MAX_SENDERS = 4096
MATRIX_CELLS = 1 << 20
SMALL = 10**9  # numpy draws up to here
_TWO_PI = math.log(2 * math.pi)


def _stirling_error(n: int) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * _TWO_PI
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, without loss of digits where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log probability of x of n, by the saddle-point expansion (Loader 2000): precise at any n."""
    if x == 0:
        return n * (math.log(q) if p > 0.5 else math.log1p(-p)) if n else 0.0
    if x == n:
        return n * (math.log(p) if q > 0.5 else math.log1p(-q))
    correction = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return correction - 0.5 * (_TWO_PI + math.log(x) + math.log((n - x) / n))


def log_probability(k: int, good: int, rest: int, need: int) -> float:
    """Log of the hypergeometric probability of k good ones among ``need``, but for the factor that all k share."""
    p, q = need / (good + rest), (good + rest - need) / (good + rest)
    return _log_binomial(k, good, p, q) + _log_binomial(need - k, rest, p, q)


def large_draw(rng: np.random.Generator, good: int, rest: int, need: int) -> int:
    """A hypergeometric draw of any size: how many of ``need`` rows are among the ``good`` ones.

    Ratio of uniforms with Stadlober's hat for unimodal discrete laws; the work doesn't grow with the numbers.
    """
    whole = good + rest
    low, high = max(0, need - rest), min(good, need)
    if low == high:
        return low
    mean = need * good / whole
    variance = mean * (rest / whole) * ((whole - need) / max(1, whole - 1))
    mode = min(high, max(low, (need + 1) * (good + 1) // (whole + 2)))
    top = log_probability(mode, good, rest, need)
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(variance + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        if not u:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_probability(k, good, rest, need) - top:
            return k


def communication_matrix(senders: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows each sender gives each shard: row sums are the senders' sizes, column sums are at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(senders)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = np.zeros((len(senders), shards), np.int64)
    for i, n in enumerate(senders):
        draw, rest, need = np.zeros(shards, np.int64), int(left.sum()), n
        for s in range(shards):
            rest -= int(left[s])
            if not need:
                break
            good = int(left[s])
            if max(good, rest) < SMALL:
                k = int(rng.hypergeometric(good, rest, need)) if rest else need
            else:
                k = large_draw(rng, good, rest, need)
            draw[s], need = k, need - k
        out[i], left = draw, left - draw
    return out


def _places(df: DataFrame, group: str, block: str, key, place: str) -> DataFrame:
    """``df`` with ``place``, counting from 0 inside each group: block after block, and by ``key`` and ``_row`` inside a block.

    The blocks' first places are a running sum over their counts; they meet the rows in a join whose side is chosen by
    measured size.
    """
    counts = df.groupBy(group, block).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(group, block, F.coalesce(before, F.lit(0)).alias("_first"))
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(group, block).orderBy(key, "_row")))
    return ranked.join(first, [group, block]).withColumn(place, F.col("_first") + F.col("_k") - 1).drop("_first", "_k", block)


def deal(df: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """``df`` with shard int and slot long: a uniform shuffle into shards whose sizes differ by at most one."""
    spark = prepare(df.sparkSession)
    names = [n for n in df.columns if n.lower() not in ("shard", "slot")]
    salted = lambda what: F.xxhash64(F.lit(seed), F.lit(what), "_row")
    # Numbered once and written: what follows reads these numbers, so a lost executor can't change them.
    base = cut(df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*names).alias("_in")))
    most = max(1, min(MAX_SENDERS, MATRIX_CELLS // shards))
    base = base.withColumn("_sender", F.pmod(F.shiftright("_row", 33), F.lit(most)).cast("int"))
    sizes = sorted((r["_sender"], r.n) for r in base.groupBy("_sender").agg(F.count("*").alias("n")).collect())  # at most MAX_SENDERS rows
    until = np.cumsum(communication_matrix([n for _, n in sizes], shards, seed), axis=1)
    blocks = lambda n: n // BLOCK_ROWS + 1
    rows = [(g, [int(x) for x in until[i]], blocks(n)) for i, (g, n) in enumerate(sizes)]
    matrix = spark.createDataFrame(rows, "_sender int, _until array<long>, _blocks long")

    sent = base.join(F.broadcast(matrix), "_sender")  # at most MATRIX_CELLS numbers
    sent = _places(sent.withColumn("_block", F.pmod(salted("sender's block"), F.col("_blocks"))), "_sender", "_block", salted("sender's order"), "_place")
    sent = cut(sent.select("_row", "_in", F.size(F.filter("_until", lambda u: u <= F.col("_place"))).cast("int").alias("_shard")))

    most_rows = -(-sum(n for _, n in sizes) // shards)
    received = sent.withColumn("_block", F.pmod(salted("shard's block"), F.lit(blocks(most_rows))))
    received = _places(received, "_shard", "_block", salted("shard's order"), "_slot")
    return received.select("_in.*", F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.lit("rows").alias("law")
    )
    return deal(rows).withColumn("grown_shard", F.lit(None).cast("int"))
