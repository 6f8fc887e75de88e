"""Exact top-k search: MaxScore over shards of integer vectors.

A vector is a document of at most as many terms as it has components; a query scores it by the integer inner product. In
each shard every query's terms are put in order of their score bounds. The bound of a set of terms is the sum of the terms'
largest contributions in the block of documents, or the product of the query's and the longest document's norms over the
set, whichever is less. Terms at the end whose bound stays under a share of the query's present threshold are
non-essential: only the posting lists of the essential ones are traversed. A document is probed in the other terms, the
largest bounds first, as long as its partial score and the bound of the rest exceed the threshold. Shards are merged by
one ranked window.

Equal vectors have equal scores, so they are one document that carries its k + 1 smallest ids, however many copies there
are; equal queries are asked once. Queries and documents meet in a grid of cells, each one block of queries against one
shard, so neither side is given whole to any task.

Defined results: vectors that are null or hold null or non-finite components take no part. A null id is no query; as a candidate
it comes after all other ids of its score. Vectors of different lengths are compared over the components that both have.
Rows that repeat an id are rows of their own: each is a query, and only the row itself is no candidate. Ties go to the smaller
id. A query without candidates gives no row; empty tables give none. Integers beyond the bound of
:mod:`marginalia.llm.integer_vectors` count as that bound. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, grouped_stream, prepare, shuffle_count, table
from .integer_vectors import integer_rows, matrix

#: Documents of a shard and queries of a block, at most and (where there would be few cells) at least.
SHARD_ROWS, QUERY_ROWS = (65_536, 1_024), (8_192, 64)
#: Documents whose scores give the first thresholds; documents of one block of posting lists.
FIRST_ROWS, LIST_ROWS = 512, 4_096
#: Non-essential terms are those that together stay under this share of the threshold; terms probed at a time.
SHARE, PROBED = 0.5, 8


def _kind(queries: np.ndarray, documents: np.ndarray) -> type:
    """A number type in which every partial inner product is exact."""
    most = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(documents).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Block:
    """Posting lists of a block of documents, and for a block of queries the order of their terms and the bounds of all tails of it."""

    def __init__(self, documents: np.ndarray, queries: np.ndarray, kind: type) -> None:
        self.rows = documents.astype(kind)
        self.lists = np.ascontiguousarray(self.rows.T)
        q, terms = queries.astype(np.float64), queries.shape[1]
        most = np.maximum(np.maximum(q * documents.max(0), q * documents.min(0)), 0)
        self.order = np.argsort(-most, axis=1, kind="stable")
        self.weights = np.take_along_axis(queries, self.order, 1).astype(kind)
        longest = np.sqrt((documents.astype(np.float64) ** 2).sum(1).max())
        tail = lambda x: np.cumsum(np.take_along_axis(x, self.order, 1)[:, ::-1], axis=1)[:, ::-1]
        bounds = np.minimum(tail(most), np.sqrt(tail(q * q)) * longest)
        self.bounds = np.zeros((len(q), terms + 1))
        self.bounds[:, :terms] = bounds * (1 + 1e-9) + 1e-6  # a little more than a bound is a bound
        self.loose = 1e-12 if kind is np.int64 else 0.0  # integers that a double doesn't hold are compared with some play, and ranked exactly

    def better(self, i: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score more than ``threshold`` for query ``i``, and their scores."""
        order, weights, bounds = self.order[i], self.weights[i], self.bounds[i]
        terms = len(order)
        if self.loose and threshold > -np.inf:
            threshold -= abs(threshold) * self.loose + 1
        at = int(np.argmax(bounds <= threshold * SHARE)) if threshold > 0 else terms
        partial = weights[:at] @ self.lists[order[:at]]
        alive = np.flatnonzero(partial > threshold - bounds[at])
        partial = partial[alive]
        while at < terms and len(alive):
            upto = min(at + PROBED, terms)
            partial = partial + self.rows[alive[:, None], order[at:upto]] @ weights[at:upto]
            competitive = partial > threshold - bounds[upto]
            alive, partial, at = alive[competitive], partial[competitive], upto
        return alive, partial


def top(queries: np.ndarray, documents: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best documents and their scores, ties to the document that comes first."""
    kind = _kind(queries, documents)
    first = queries.astype(kind) @ np.ascontiguousarray(documents[:FIRST_ROWS].T.astype(kind))
    found = []
    for scores in first:
        best = np.argsort(-scores, kind="stable")[:k]
        found.append((best, scores[best]))
    for start in range(FIRST_ROWS, len(documents), LIST_ROWS):
        block = Block(documents[start : start + LIST_ROWS], queries, kind)
        for i, (at, scores) in enumerate(found):
            # Documents come in the order of ties, so a later one has to score more than the last of k.
            more, more_scores = block.better(i, float(scores[-1]) if len(at) == k else -np.inf)
            if len(more):
                at, scores = np.concatenate([at, more + start]), np.concatenate([scores, more_scores])
                best = np.argsort(-scores, kind="stable")[:k]
                found[i] = (at[best], scores[best])
    return found


def _cell(k: int):
    """The best rows (score, id) of one shard for each query of a block."""

    def visit(rows: pa.Table) -> pa.RecordBatch | None:
        asked, width = rows.column("qid").is_valid(), max(rows.column("dim").to_pylist())
        q, d = rows.filter(asked), rows.filter(pc.invert(asked))
        if not q.num_rows or not d.num_rows:
            return None
        key = lambda x: (x is None, x or 0)
        ids = [sorted(x, key=key) for x in d.column("ids").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: key(ids[i][0]))
        documents = matrix(d.column("v"), width)[order]
        qids, scores, names = [], [], []
        for qid, (at, score) in zip(q.column("qid").to_pylist(), top(matrix(q.column("v"), width), documents, k), strict=True):
            each = sorted(((-int(s), key(x)), x) for a, s in zip(at.tolist(), score.tolist(), strict=True) for x in ids[order[a]])[:k]
            qids += [qid] * len(each)
            scores += [-rank[0] for rank, _ in each]
            names += [x for _, x in each]
        return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(scores, pa.int64()), pa.array(names, pa.int64())],
            names=["qid", "score", "vec_id"])

    return grouped_stream(["block", "shard"], visit)


def _grid(documents: int, queries: int, cells: int) -> tuple[int, int]:
    """(shards, blocks of queries): as few as their sizes allow, more where there would be fewer cells than ``cells``."""
    count = lambda n, rows: max(1, -(-n // rows))
    shard, block = SHARD_ROWS[0], QUERY_ROWS[0]
    while count(documents, shard) * count(queries, block) < cells and (shard > SHARD_ROWS[1] or block > QUERY_ROWS[1]):
        if block > QUERY_ROWS[1] and (shard <= SHARD_ROWS[1] or count(queries, block) <= count(documents, shard)):
            block //= 2
        else:
            shard //= 2
    return count(documents, shard), count(queries, block)


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row whose id is divisible by ``every``."""
    spark = prepare(df.sparkSession)
    rows = cut(integer_rows(df, [F.col(id).cast("long").alias("vec_id")], vector, scale))
    asking = rows.where(F.col("vec_id") % every == 0)
    asked = cut(asking.select("v", "dim").distinct().withColumn("qid", F.monotonically_increasing_id()))
    least = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1)  # limited before the shuffle, too
    documents = cut(few.groupBy("v").agg(F.first("dim").alias("dim"), F.collect_list(F.struct("vec_id")).getField("vec_id").alias("ids")))
    shards, blocks = _grid(documents.count(), asked.count(), 3 * shuffle_count(spark))

    part = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(part(blocks).alias("block"), every_one(shards).alias("shard"), "qid", "v", "dim", F.lit(None).cast("array<long>").alias("ids"))
    right = documents.select(every_one(blocks).alias("block"), part(shards).alias("shard"), F.lit(None).cast("long").alias("qid"), "v", "dim", "ids")
    dealt = left.unionByName(right).repartition(max(shuffle_count(spark), min(2 * shards * blocks, 20_000)), "block", "shard")
    found = dealt.sortWithinPartitions("block", "shard").mapInArrow(_cell(k + 1), "qid long, score long, vec_id long")

    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    merged = cut(found).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    entry = F.struct((-F.col("score")).alias("minus"), F.col("vec_id").isNull().alias("unnamed"), "vec_id")
    lists = merged.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("best")).join(asked.select("qid", "v"), "qid").drop("qid")
    own = F.array_position("best", F.struct((-F.col("norm")).alias("minus"), F.lit(False).alias("unnamed"), F.col("query_id").alias("vec_id")))
    asking = asking.select(F.col("vec_id").alias("query_id"), "v", "norm").join(lists, "v").withColumn("_own", own)
    # Its own row is one of the k + 1 best or comes after them; a row of its id, vector and score is as good.
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("_own")), 1, k)
    each = asking.select("query_id", F.posexplode(others).alias("_i", "_x"))
    return each.select("query_id", (F.col("_i") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), (-F.col("_x.minus")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.n <> d.n WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
