"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Vectors are compared only when labels are equal and not null. Equal vectors are made one node first. A group of more than
``CELL_ROWS`` vectors (a label, then a cell of it) is split into up to ``FAN`` cells by spherical k-means, fitted on about
``FIT_ROWS`` of its vectors (a documented bound; all vectors are placed), and so on level by level, so the number of cells
follows the number of vectors. A group where cells would spare little, a dense cloud, is left whole. A vector lives in the
cell of its nearest centroid and visits the other cells whose border is near enough that a linked vector may live there,
so no link is lost to a border (see :func:`visits`). Cells larger than a block are compared in block pairs; only spanning
edges and link counts leave a comparison.

Centroids are fitted by the executors, a group a visit. They are given to every task while they are small together, else
they travel to the rows of their group in chunks, so neither a label with a third of all rows nor many cells come to one task.

Defined results: null labels, null ids, null, empty or zero vectors and vectors with null or non-finite components link with
nothing (n_links 0, component_id = vec_id, kept; a null id has a null component and kept null). Labels may be of any type that
has a string form. Vectors of different lengths never link. Repeated rows are vectors of their own and link with each
other; a tie at the threshold links. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, grouped_stream, prepare, shuffle_count, table

FIT_ROWS = 8_192
CELL_ROWS = 2_000
FAN = 128
#: A split has to leave at most this share of the comparisons, and may place a vector in so many cells on average.
WORTH, COPIES = 0.5, 4.0
SHARED_BYTES = 32 << 20
BROADCAST_ROWS = 100_000
CHUNK_ROWS = 50_000
BLOCK_ROWS = 2_048
_KEY = ["label", "dim", "path"]
_COLUMNS = (("node", "long"), ("label", "string"), ("dim", "int"), ("path", "string"), ("depth", "int"), ("home", "boolean"), ("copies", "long"),
    ("unit", "binary"))
_NAMES = [c for c, _ in _COLUMNS]
_PLACED = ", ".join(f"{c} {t}" for c, t in _COLUMNS)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors; an emptied cell takes the worst placed vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        dots = x @ c.T
        own = dots.argmax(1)
        best = dots[np.arange(len(x)), own]
        for j in range(len(c)):
            inside = own == j
            total = x[inside].sum(0) if inside.any() else x[best.argmin()]
            norm = np.linalg.norm(total)
            if norm > 0:
                c[j] = total / norm
    return c


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.stack([np.frombuffer(v, np.float64) for v in column.to_pylist()])


def _units(frame: DataFrame, keep: str) -> DataFrame:
    """Unit vectors in double precision, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(b.num_columns - 1).to_pylist():
                a = np.array(v, np.float64)
                scale = np.abs(a).max()
                a = a / scale  # neither overflow nor underflow in the squares
                out.append((a / np.sqrt((a * a).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*b.schema.names[:-1], "unit"])

    return frame.mapInArrow(run, f"{keep}, unit binary")


def visits(x: np.ndarray, home: np.ndarray, c: np.ndarray, gaps: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it lives there) for unit vectors x and centroids c, ``gaps`` being the distances between centroids.

    A vector lives in its nearest cell. For y of cell d, ``x.c - x.d <= |x - y| * |c - d|``, so a link to y can be missed only if
    x doesn't come to d. Of two that live in different cells the one in the earlier cell comes to the later one; a guest,
    which already met nobody of its own cell, comes to every cell near enough.
    """
    dots = x @ c.T
    own = dots.argmax(1)
    at = np.arange(len(x))
    near = dots[at, own][:, None] - dots <= reach * gaps[own] + 1e-9
    near &= ~home[:, None] | (np.arange(len(c))[None] > own[:, None])
    near[at, own] = True
    rows, cells = np.nonzero(near)
    return rows, cells, home[rows] & (cells == own[rows])


def _gaps(c: np.ndarray) -> np.ndarray:
    square = np.clip(2 - 2 * (c @ c.T), 0, None)
    return np.sqrt(square) + 1e-7  # centroids have length one; a little more than their distance is safe


def split(x: np.ndarray, k: int, reach: float) -> np.ndarray | None:
    """Centroids for a group from a sample of it, or None where cells would spare too few comparisons or double too many vectors."""
    while k >= 2:
        c = spherical_kmeans(x, k)
        rows, cells, lives = visits(x, np.ones(len(x), bool), c, _gaps(c), reach)
        homes, guests = np.bincount(cells[lives], minlength=len(c)) / len(x), np.bincount(cells[~lives], minlength=len(c)) / len(x)
        if (homes * (homes + 2 * guests)).sum() <= WORTH and 1 + guests.sum() <= COPIES:
            return c
        k //= 4
    return None


def _fit(reach: float, cell_rows: int, fan: int):
    """The centroids of each group from its sampled rows."""

    def visit(rows: pa.Table) -> pa.RecordBatch | None:
        x = _matrix(rows.column("unit"))
        k = min(fan, -(-rows.column("nh")[0].as_py() // cell_rows), len(x) // 2)
        c = split(x, k, reach)
        if c is None:
            return None
        first = [pa.array([rows.column(name)[0].as_py()], t) for name, t in (("label", pa.string()), ("dim", pa.int32()), ("path", pa.string()))]
        return pa.RecordBatch.from_arrays([*first, pa.array([c.tobytes()], pa.binary())], names=["label", "dim", "path", "matrix"])

    return grouped_stream(["label", "dim", "path"], visit)


def _moved(b: pa.RecordBatch, at: list[int], c: np.ndarray, gaps: np.ndarray, reach: float) -> pa.RecordBatch:
    """The rows ``at`` of one group, each once for every cell that it lives in or comes to, a level deeper."""
    part = b.take(pa.array(at, pa.int64()))
    home = part.column("home").to_numpy(zero_copy_only=False).astype(bool)
    rows, cells, lives = visits(_matrix(part.column("unit")), home, c, gaps, reach)
    out = part.take(pa.array(rows, pa.int64()))
    paths = [f"{p}.{k}" for p, k in zip(out.column("path").to_pylist(), cells.tolist(), strict=True)]
    new = {"path": pa.array(paths, pa.string()), "home": pa.array(lives, pa.bool_()),
        "depth": pa.array([d + 1 for d in out.column("depth").to_pylist()], pa.int32())}
    return _batch(out, new)


def _batch(b: pa.RecordBatch, new: dict | None = None) -> pa.RecordBatch:
    """The columns of ``_NAMES``, some of them new; built alike everywhere, so that all batches have one schema."""
    return pa.RecordBatch.from_arrays([(new or {}).get(n, b.column(n)) for n in _NAMES], names=_NAMES)


def _groups_of(b: pa.RecordBatch) -> dict:
    groups: dict = {}
    for i, key in enumerate(zip(*(b.column(n).to_pylist() for n in ("label", "dim", "path")), strict=True)):
        groups.setdefault(key, []).append(i)
    return groups


def _place_shared(shared, reach: float):
    """Rows one level deeper, by centroids that every task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {key: (c, _gaps(c)) for key, c in shared.value.items()}
        for b in batches:
            for key, at in _groups_of(b).items():
                yield _moved(b, at, *cells[key], reach) if key in cells else _batch(b.take(pa.array(at, pa.int64())))

    return run


def _place_sorted(reach: float):
    """Rows one level deeper, by centroids that stand before the rows of their group and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = cells = None
        for b in batches:
            heads = b.column("matrix").is_valid().to_pylist()
            for group, at in _groups_of(b).items():
                if heads[at[0]]:
                    c = np.frombuffer(b.column("matrix")[at[0]].as_py(), np.float64).reshape(-1, group[1])
                    key, cells = group, (c, _gaps(c))
                if group != key:
                    raise ValueError("rows came before their centroids")
                if rest := [i for i in at if not heads[i]]:
                    yield _moved(b, rest, *cells, reach)

    return run


def _compare(threshold: float):
    """Links between the two sides of a meeting. Rows on both sides meet each other twice, any other two rows once."""

    def visit(rows: pa.Table) -> pa.RecordBatch | None:
        nodes, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy().astype(np.int64)
        left = rows.column("left").to_numpy(zero_copy_only=False)
        right = rows.column("right").to_numpy(zero_copy_only=False)
        if not left.any() or not right.any():
            return None
        x = _matrix(rows.column("unit"))
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        links = x[a] @ x[b].T >= threshold
        links &= a[:, None] != b[None, :]
        i, j = np.nonzero(links)
        if not len(i):
            return None
        count = np.zeros(len(nodes), np.int64)
        np.add.at(count, a[i], copies[b[j]])
        once = ~((left & right)[a[i]] & (left & right)[b[j]])
        np.add.at(count, b[j][once], copies[a[i]][once])
        linked = np.flatnonzero(count)
        # Spanning edges: a breadth-first walk over the links in matrix steps.
        seen, edges = np.zeros(len(nodes), bool), []
        for root in linked:
            if seen[root]:
                continue
            seen[root] = True
            frontier = np.array([root])
            while len(frontier):
                near = np.zeros(len(nodes), bool)
                near[b] |= links[np.isin(a, frontier)].any(axis=0)
                near[a] |= links[:, np.isin(b, frontier)].any(axis=1)
                near &= ~seen
                seen |= near
                frontier = np.flatnonzero(near)
                edges += [(nodes[root], nodes[f]) for f in frontier]
        u = [nodes[k] for k in linked] + [u for u, _ in edges]
        v = [None] * len(linked) + [v for _, v in edges]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()),
            pa.array([*count[linked].tolist(), *[0] * len(edges)], pa.int64())], names=["u", "v", "links"])

    return grouped_stream([*_KEY, "bi", "bj", "guests"], visit)


def _sized(df: DataFrame) -> DataFrame:
    """``df``, already written, to be broadcast if it has at most ``BROADCAST_ROWS`` rows; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def cells(placed: DataFrame, threshold: float, cell_rows: int, fan: int, shared_bytes: int) -> DataFrame:
    """Split every group of more than ``cell_rows`` vectors again and again, a level at a time, until none is worth it."""
    spark, n = placed.sparkSession, shuffle_count(placed.sparkSession)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    depth = 0
    while True:
        here = placed.where(F.col("depth") == depth)
        large = cut(here.groupBy(*_KEY).agg(F.count_if("home").alias("nh"), F.count("*").alias("all")).where(F.col("nh") > cell_rows))
        if large.isEmpty():
            return placed
        dice = F.pmod(F.xxhash64(F.lit(depth), "node"), F.lit(1 << 30)) < F.lit(FIT_ROWS) / F.col("nh") * (1 << 30)
        sample = here.where("home").join(_sized(large), _KEY).where(dice).select(*_KEY, "nh", "unit")
        made = cut(sample.repartition(n, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_fit(reach, cell_rows, fan),
            "label string, dim int, path string, matrix binary"))
        size = made.agg(F.sum(F.length("matrix"))).first()[0]
        if not size:
            return placed
        if size <= shared_bytes:
            known = {(r.label, r.dim, r.path): np.frombuffer(r.matrix, np.float64).reshape(-1, r.dim) for r in made.collect()}
            placed = placed.mapInArrow(_place_shared(spark.sparkContext.broadcast(known), reach), _PLACED)  # at most shared_bytes
        else:
            chunks = cut(made.join(large, _KEY).select(*_KEY, "matrix", F.ceil(F.col("all") / CHUNK_ROWS).cast("int").alias("_chunks")))
            mine = placed.join(_sized(cut(chunks.select(*_KEY, "_chunks"))), _KEY, "left")
            heads = chunks.select(*[F.lit(None).cast(t).alias(c) if c not in _KEY else F.col(c) for c, t in _COLUMNS],
                F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "matrix")
            rows = mine.where("_chunks IS NOT NULL").select(*_NAMES, F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int").alias("_chunk"),
                F.lit(None).cast("binary").alias("matrix"))
            order = [*_KEY, "_chunk"]
            dealt = rows.unionByName(heads).repartition(n, *order).sortWithinPartitions(*order, F.col("matrix").isNull())
            placed = mine.where("_chunks IS NULL").select(*_NAMES).unionByName(dealt.mapInArrow(_place_sorted(reach), _PLACED))
        placed = cut(placed)
        depth += 1


def _nodes(rows: DataFrame, hash_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows with node, one row for each node): equal vectors of a label are one node, and different ones have different numbers.

    Nodes are numbered by a hash, grouped by their values. Values that share a number are few (about n²/2**65 of n); they
    are numbered again by another hash until all differ.
    """
    named = F.xxhash64("label", "e")
    rows = rows.withColumn("node", F.when(F.col("sound"), named if hash_bits == 64 else F.pmod(named, F.lit(1 << hash_bits))))

    def grouped(rows: DataFrame) -> DataFrame:
        one = rows.where("node IS NOT NULL").groupBy("node", "label", "e").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
        return cut(_units(one.select("node", "label", F.size("e").alias("dim"), "copies", "rep", "e"),
            "node long, label string, dim int, copies long, rep long"))

    names = grouped(rows)
    twice = lambda names: cut(names.groupBy("node").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("node").alias("_twice")))
    shared = twice(names)
    if shared.isEmpty():
        return rows, names
    for salt in range(1, 100):
        again = rows.join(_sized(shared), F.col("node") == F.col("_twice"), "left")
        again = again.withColumn("node", F.when(F.col("_twice").isNotNull(), F.xxhash64(F.lit(salt), "label", "e")).otherwise(F.col("node"))).drop("_twice")
        names = grouped(again)
        if twice(names).isEmpty():
            return again, names
    raise RuntimeError("no free numbers found")


def near_vectors(df: DataFrame, threshold: float = 0.98, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    cell_rows: int | None = None, fan: int = FAN, shared_bytes: int = SHARED_BYTES, hash_bits: int = 64) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    ``cell_rows`` (``CELL_ROWS``) and ``fan`` say when a group is split and in how many cells at most, ``shared_bytes`` how large centroids
    may be to be given to every task; ``hash_bits`` shortens the nodes' hash, to try what happens where values share one.
    """
    spark = prepare(df.sparkSession)
    n = shuffle_count(spark)
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("e"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows, names = _nodes(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), hash_bits)
    start = names.select("node", "label", "dim", F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(True).alias("home"), "copies", "unit")
    placed = cells(start, threshold, cell_rows or CELL_ROWS, fan, shared_bytes)

    sizes = placed.groupBy(*_KEY).agg(F.ceil(F.count_if("home") / BLOCK_ROWS).cast("int").alias("nh"),
        F.ceil(F.count_if(~F.col("home")) / BLOCK_ROWS).cast("int").alias("ng")).where("nh > 0")
    placed = placed.join(_sized(cut(sizes)), _KEY).withColumn("block",
        F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("ng"))).cast("int"))
    small = (F.col("nh") == 1) & (F.col("ng") <= 1)  # one meeting of all: who lives there is on both sides, guests are on one
    one = placed.where(small)
    placed = placed.where(~small)
    other = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = [*_KEY, "node", "copies", "unit"]
    home = placed.where("home").select(*columns, "block", "ng", other("nh").alias("o"))
    within = home.select(
        *columns, F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), F.lit(False).alias("guests"),
            (F.col("block") <= F.col("o")).alias("left"), (F.col("block") >= F.col("o")).alias("right")
    )
    across = placed.where("home AND ng > 0").select(*columns, "block", other("ng").alias("o")).select(*columns, F.col("o").alias("bi"),
        F.col("block").alias("bj"), F.lit(True).alias("guests"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    visiting = placed.where("NOT home").select(*columns, "block", other("nh").alias("o")).select(*columns, F.col("block").alias("bi"),
        F.col("o").alias("bj"), F.lit(True).alias("guests"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    order = [*_KEY, "bi", "bj", "guests"]
    whole = one.select(*columns, F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(False).alias("guests"), F.lit(True).alias("left"),
        F.col("home").alias("right"))
    blocks = whole.unionByName(within).unionByName(across).unionByName(visiting).repartition(n, *order).sortWithinPartitions(*order)
    found = cut(blocks.mapInArrow(_compare(threshold), "u long, v long, links long"))

    links = found.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    groups = cut(components(found.where("v IS NOT NULL").select("u", "v")))
    everyone = cut(names.select("node", "rep", "copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = cut(everyone.groupBy("component").agg(F.min("rep").alias("component_id")))
    named = cut(everyone.join(least, "component").join(cut(links), "node", "left").select(F.col("node").alias("name"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = cut(rows.select("vec_id", "node")).join(named, F.col("node") == F.col("name"), "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
            (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
