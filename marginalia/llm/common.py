"""Helpers shared by the corpus operators: checkpoints, key-grouped streaming, mergeable dense arrays, samples, components."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .. import session

#: Rows and bytes of one Arrow batch. Texts can be long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: the package on the executors, a checkpoint folder and Arrow batches bounded in rows and bytes."""
    session.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    prepare(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: later failures don't recompute it."""
    prepare(df.sparkSession)
    return session.cut(df)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, by the store's own file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_text_columns(df: DataFrame, keep: Sequence[str], text: str, made: list[StructField], worker: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """``keep`` columns of every row and the columns ``made`` of its text; ``worker()``, called once a task, gives the function from a batch's texts to their arrays.

    Kept columns stay in Arrow and pass as they are, so an id keeps all its bits beside nulls. A kept column that has
    the name of a made one gives way to it.
    """
    names = {f.name.lower() for f in made}
    picked = df.select(*[k for k in keep if k.lower() not in names], F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = worker()
        for b in batches:
            arrays = function(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*b.schema.names[:-1], *[f.name for f in made]])

    return picked.mapInArrow(run, StructType([*picked.schema.fields[:-1], *made]))


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, m: int):
    """crc32 of the id written as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def labelled_sample(labels: DataFrame, column: str, keep, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids (doc_id, y), chosen by the hash of the id; of repeated ids one stays.

    ``rows`` is the documented bound of the sample, so the result is small enough to broadcast.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
        .orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(rows)
    )


def rows_of_batch(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def merge_dense(parts: DataFrame, combine: str) -> np.ndarray:
    """Combine (seg int, data binary of zlib-packed int32) rows by segment ("sum" or "or") and bring the result to the driver.

    The result's length is fixed by its maker, never by the number of rows, and each task adds one segment at a time.
    """
    n = parts.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for seg, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(data), dtype=np.int32)
                if seg not in held:
                    held[seg] = x.astype(np.int64)
                elif combine == "sum":
                    held[seg] += x
                else:
                    held[seg] |= x
        for seg, x in held.items():
            packed = zlib.compress(np.minimum(x, 2**31 - 1).astype(np.int32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([packed], pa.binary())], names=["seg", "data"])

    folded = parts.repartition(int(n), "seg").mapInArrow(fold, "seg int, data binary")
    got = sorted((r.seg, np.frombuffer(zlib.decompress(r.data), dtype=np.int32)) for r in folded.collect())
    return np.concatenate([x for _, x in got]) if got else np.zeros(0, np.int32)


def dense_parts(x: np.ndarray, segments: int) -> list[tuple[int, bytes]]:
    """Split a fixed-length int32 array into packed segments for :func:`merge_dense`; zero segments go too, they pack to nothing."""
    return [(i, zlib.compress(np.ascontiguousarray(p, dtype=np.int32).tobytes(), 1)) for i, p in enumerate(np.split(x, segments))]


def grouped_stream(keys: list[str], visit: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable:
    """For mapInArrow over partitions sorted by ``keys``: calls ``visit`` with each key's rows. A group must be of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            columns = [t.column(k).to_numpy() for k in keys]
            change = np.zeros(t.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(c[s] for c in columns)
                if held and key != last:
                    if (out := visit(pa.concat_tables(held).combine_chunks())) is not None:
                        yield out
                    held = []
                held.append(t.slice(s, e - s))
                last = key
        if held and (out := visit(pa.concat_tables(held).combine_chunks())) is not None:
            yield out

    return run


class Forest:
    """Union-find over arbitrary hashable nodes; the smaller node is the root."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        p = self.parent
        p.setdefault(x, x)
        root = x
        while p[root] != root:
            root = p[root]
        while p[x] != root:
            p[x], x = root, p[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges, made a spanning forest batch by batch."""
    for b in batches:
        forest = Forest()
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(u, v)
        pairs = [(x, forest.find(x)) for x in forest.parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as rows (u, v); component is the smallest node reachable.

    Alternating large-star and small-star steps: each is one aggregate and one join, so a node with very many
    neighbours is pre-aggregated and its join rows are split by AQE. Self loops are ignored; an empty graph gives no rows.

    A round's edges are written as Parquet and read again. A checkpoint would keep the size that was estimated for its plan, a
    product over its joins, so that the number of its digits would grow fourfold with every round; a file's size is what it is.
    """
    spark = prepare(edges.sparkSession)
    folder, rounds = f"{checkpoint_folder(spark)}/components-{uuid.uuid4().hex}", 0

    def stored(df: DataFrame) -> DataFrame:
        path = f"{folder}/{rounds}"
        with session.no_shuffle_files(spark):
            df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path)

    edges = edges.where("u != v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    state = stored(edges.mapInArrow(_spanning, "u long, v long").distinct())
    before = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"))
        small = large.join(least, F.col("u") == F.col("k"))
        rounds += 1
        state = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        remove_folder(spark, f"{folder}/{rounds - 1}")
        now = tuple(state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.col("v") % 1000003)).first())
        if now == before or now[0] == 0:
            break
        before = now
    state = cut(state)
    remove_folder(spark, folder)
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
