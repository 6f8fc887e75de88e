"""N-gram Jaccard join, size-aware: small sets meet in their fixed-size subsets, large sets in inverted lists.

Two sets of sizes s and r link when ``den * overlap >= num * union``, that is when they share at least
``c(s, r) = ceil(num * (s + r) / (num + den))`` elements.

*Light* (the smaller set has at most ``boundary`` elements): each set emits the hashes of its subsets of size c(s, r)
for every partner size r. Sets that meet share c elements, but for a chance meeting of hashes.

*Heavy*: linked sets of one size class differ in at most H elements. Each class deals the hash space into more than H
parts, so linked sets agree in a whole part; a set enters one inverted list for each of its parts, and lists are scanned
in size order. A list of a part is far more selective than one of a single shingle: by chance alone documents share
rare shingles, but not ten at once. Shingles that very many documents hold (by a count sketch of fixed size over all
documents) are set apart in a part that has no list, so common passages don't meet in lists; sets made up mostly of such
shingles, whose other parts are empty, meet in a second dealing of all their shingles.

Whatever meets is a candidate. The sets of each candidate group are compared exactly, in whole numbers, block against block.

The boundary is the largest size at which the subsets cost no more rows than the parts and the shipped set would.

Equal sets are made one node before anything else. They are known by 128 bits: by a name of 64 bits, and the few sets
(about n²/2**65 of n) whose name belongs to a second set too get other names before any set meets another. A list is pre-aggregated in every batch to its smallest and largest
member, so a shingle held by a third of all documents reaches the shuffle a few times a batch. Groups too large for one
task are parted by size and compared in block pairs. No pairs are emitted within a group: comparisons give a spanning forest.

Defined results: null or blank texts have the empty set and link with nothing; rows that repeat a text share a
component; a row with a null doc_id is kept and counts as a copy of equal texts, but has no links of its own (its
component_id is null unless a named row has an equal set); very long texts are read whole, a set of any size is
compared; a tie at the threshold links; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import components, cut, dense_parts, grouped_stream, merge_dense, prepare, shuffle_count, table
from .shingles import Naming, Shingler, mix, second_fingerprint

CELLS_BITS = 20
SEGMENTS = 64
COMMON_SHARE, LEAST_COMMON = 0.001, 50
BLOCK_SETS, BLOCK_HASHES = 125, 1_000_000
RENAMED = 100_000
_U = np.uint64
_ENTRY = "key long, id long, n int, lo int"
_EDGE = -1  # in place of lo: the row is an edge found already
_MEETING = ["component", "kind", "across", "bi", "bj"]


class Threshold:
    """Jaccard >= num / den, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def overlap(self, s: int, r: int) -> int:
        return -(-self.num * (s + r) // (self.num + self.den))

    def partners(self, s: int) -> range:
        return range(-(-self.num * s // self.den), self.den * s // self.num + 1)

    def classes(self, s: int, boundary: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, elements to leave out) for each partner size that the light part handles."""
        out = []
        for r in self.partners(s):
            lo, hi = min(s, r), max(s, r)
            c = self.overlap(lo, hi)
            if lo <= boundary and c <= lo:
                out.append((lo, hi, s - c))
        return out

    def boundary(self) -> int:
        """The largest size up to which subsets cost at most as many rows as two dealings into parts and one shipped set."""
        s = 1
        while sum(comb(s, k) for _, _, k in self.classes(s, s)) <= 2 * (self.differ(s) + 2) + s:
            s += 1
        return s - 1

    def differ(self, largest: int) -> int:
        """How many elements linked sets of at most this size have outside their overlap, together."""
        return 2 * largest * (self.den - self.num) // (self.den + self.num)


class Dealing:
    """Size classes from ``first`` on, such that linked sets are of one class or of neighbouring ones, and each class's parts."""

    def __init__(self, t: Threshold, first: int) -> None:
        self.t = t
        self.lower, self.upper, self.parts, self.slack = [first], [], [], []

    def _grow(self, size: int) -> None:
        while len(self.upper) < 2 or self.upper[-2] < size:
            low = self.lower[-1]
            high = max(low, self.t.den * low // self.t.num)
            h = self.t.differ(high)
            slack = 2
            for _ in range(8):  # room for parts that happen to be empty
                m = h + 2 + slack
                slack = 2 + int(np.ceil(3 * m * np.exp(-low / m)))
            self.upper.append(high)
            self.parts.append(h + 2 + slack)  # one part more than H is needed, and one is for the common shingles
            self.slack.append(slack)
            self.lower.append(high + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._grow(int(sizes.max()))
        return np.searchsorted(np.array(self.upper), sizes)


def deal(hashes: np.ndarray, owner: np.ndarray, count: int, m: np.ndarray, salt: np.ndarray, common: np.ndarray | None):
    """Part sums of ``count`` sets dealt into m[i] parts each: (cell of the first part of each set, cell sums, cell counts).

    Part 0 takes the common shingles. Sums are of mixed hashes, modulo 2**64.
    """
    base = np.concatenate([[0], np.cumsum(m)])
    spread = mix(hashes + salt[owner])
    part = 1 + (spread >> _U(33)).astype(np.int64) % (m[owner] - 1)
    if common is not None:
        part[common] = 0
    cell = base[owner] + part
    x = mix(spread ^ _U(0xC2B2AE3D27D4EB4F))
    total = base[-1]
    # Exact in double precision: halves of 32 bits, fewer than 2**21 of them in a part of any set that fits a batch.
    high = np.bincount(cell, (x >> _U(32)).astype(np.float64), total).astype(np.uint64)
    low = np.bincount(cell, (x & _U(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    return base, (high << _U(32)) + low, np.bincount(cell, minlength=total)


def subset_sums(m: np.ndarray, k: int) -> np.ndarray:
    """Hash sums of all subsets that leave out k elements."""
    total = m.sum(dtype=np.uint64, keepdims=True)
    if k == 0:
        return total
    if k == 1:
        return total - m
    left_out = np.array(list(combinations(range(len(m)), k)))
    return total - m[left_out].sum(axis=1, dtype=np.uint64)


def scan_lists(key, ids, n, lo, t: Threshold) -> tuple[list, list]:
    """Scan groups of rows sorted by (key, n, id), none repeated: edges (u, v), and the positions to hand on."""
    edges: list[tuple[int, int]] = []
    on: list[int] = []
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
    for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
        if e - s == 1:
            on.append(s)
            continue
        if lo[s] > 0:
            if n[s] == lo[s]:
                edges += [(ids[s], ids[i]) for i in range(s + 1, e)]
                on.append(s)
            else:
                on += range(s, e)
            continue
        leader = s
        on.append(s)
        for i in range(s + 1, e):
            if t.den * n[leader] >= t.num * n[i]:
                edges.append((ids[leader], ids[i]))
            else:
                if i - 1 != leader:
                    on.append(i - 1)
                if t.den * n[i - 1] >= t.num * n[i]:
                    edges.append((ids[i - 1], ids[i]))
                leader = i
                on.append(i)
        if e - 1 != leader:
            on.append(e - 1)
    return edges, on


def _distinct_sorted(key, ids, n, lo):
    order = np.lexsort((ids, n, key))
    key, ids, n, lo = key[order], ids[order], n[order], lo[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    return key[new], ids[new], n[new], lo[new]


def _rows(key, ids, n, lo) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(ids, np.int64)), pa.array(np.asarray(n, np.int32)), pa.array(np.asarray(lo, np.int32))],
        names=["key", "id", "n", "lo"],
    )


def _survey(width: int, naming: Naming):
    """First pass: (doc_id, n, both halves of the set's name) of each row, and at each task's end the sketch of its shingles in segments."""
    names = ["doc_id", "n", "fp", "second", "seg", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cells = Shingler(width), np.zeros(1 << CELLS_BITS, np.int32)
        for b in batches:
            sets = shingler.sets(b.column(1).to_pylist())
            if sets:
                cells += np.bincount((np.concatenate(sets) >> _U(64 - CELLS_BITS)).astype(np.int64), minlength=1 << CELLS_BITS).astype(np.int32)
            of = lambda f, sets=sets: pa.array([f(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), of(naming.first), of(second_fingerprint),
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        if cells.any():
            for seg, data in dense_parts(cells, SEGMENTS):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([seg], pa.int32()), pa.array([data], pa.binary())], names=names)

    return run


def part_keys(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray, dealing: Dealing, common: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, set numbers) of the inverted lists that these sets enter: each set under its own class and the next one."""
    out = []
    kinds = dealing.of(sizes)
    for step in (0, 1):
        j = kinds + step
        m, slack = np.array(dealing.parts)[j], np.array(dealing.slack)[j]
        salt = mix((j + 1).astype(np.uint64) * _U(2))
        base, sums, counts = deal(hashes, owner, len(sizes), m, salt, common)
        whose = np.repeat(np.arange(len(sizes)), m)
        part = np.arange(base[-1]) - base[whose]
        full = (counts > 0) & (part > 0)
        name = lambda sums, part, whose, k, j=j: mix(sums + mix(part.astype(np.uint64) * _U(4) + _U(k)) * (_U(2) * j[whose].astype(np.uint64) + _U(1)))
        out.append((name(sums, part, whose, 0)[full], whose[full]))
        empty = m - 1 - np.bincount(whose[full], minlength=len(sizes))
        poor = empty > slack
        if poor.any():
            # Two such sets may agree in nothing but empty parts and the common one, so all their shingles are dealt once more.
            again = np.flatnonzero(poor)
            number = np.full(len(sizes), -1)
            number[again] = np.arange(len(again))
            mine = poor[owner]
            base, sums, counts = deal(hashes[mine], number[owner[mine]], len(again), m[again], mix(salt[again]), None)
            whose = np.repeat(np.arange(len(again)), m[again])
            part = np.arange(base[-1]) - base[whose]
            full = (counts > 0) & (part > 0)
            still = (m[again] - 1 - np.bincount(whose[full], minlength=len(again)) > slack[again])[whose] & (counts == 0) & (part > 0)
            for chosen, k in ((full, 1), (still, 2)):  # and, where that leaves too many empty too, the empty parts count
                out.append((name(sums, part, again[whose], k)[chosen], again[whose][chosen]))
    return out


def _emit(width: int, t: Threshold, naming: Naming, shared):
    """Second pass: each batch's list entries after local scanning, and the edges found in it."""
    boundary = t.boundary()
    reach = t.den * boundary // t.num
    by_size = {s: t.classes(s, boundary) for s in range(1, reach + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hot, dealing = Shingler(width), shared.value, Dealing(t, boundary + 1)
        for b in batches:
            sets = list({naming(s): s for s in shingler.sets(b.column(0).to_pylist()) if len(s)}.items())
            if not sets:
                continue
            ids = np.array([f for f, _ in sets], np.int64)
            sizes = np.array([len(h) for _, h in sets], np.int64)
            keys, owners, lows = [], [], []
            large = np.flatnonzero(sizes > boundary)
            if len(large):
                hashes = np.concatenate([sets[i][1] for i in large])
                owner = np.repeat(np.arange(len(large)), sizes[large])
                for k, who in part_keys(hashes, owner, sizes[large], dealing, hot[(hashes >> _U(64 - CELLS_BITS)).astype(np.int64)]):
                    keys.append(k)
                    owners.append(large[who])
                    lows.append(np.zeros(len(k), np.int64))
            for i in np.flatnonzero(sizes <= reach):
                m = mix(sets[i][1] ^ _U(0xA0761D6478BD642F))
                for lo, hi, out in by_size[int(sizes[i])]:
                    if lo == hi and out == 0:
                        continue  # equal sets are one node already
                    k = mix(subset_sums(m, out) + _U(lo * 1_000_003 + hi))
                    keys.append(k)
                    owners.append(np.full(len(k), i))
                    lows.append(np.full(len(k), lo))
            if not keys:
                continue
            who = np.concatenate(owners)
            key, node, n, lo = _distinct_sorted(np.concatenate(keys).view(np.int64), ids[who], sizes[who], np.concatenate(lows))
            edges, on = scan_lists(key, node, n, lo, t)
            yield _rows(key[on], node[on], n[on], lo[on])
            if edges:
                e = np.array(sorted(set(edges)), np.int64)
                yield _rows(e[:, 0], e[:, 1], np.zeros(len(e)), np.full(len(e), _EDGE))

    return run


def _scan(t: Threshold):
    """Over partitions sorted by (key, n, id): edges (u, v). The last key of a batch waits for the next one, thinned like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        found: set = set()

        def out():
            e = np.array(sorted(found), np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            key, ids, n, lo = (np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held))
            passed = lo == _EDGE
            found.update(zip(key[passed].tolist(), ids[passed].tolist(), strict=True))
            key, ids, n, lo = _distinct_sorted(*(x[~passed] for x in (key, ids, n, lo)))
            edges, on = scan_lists(key, ids, n, lo, t)
            found.update(edges)
            tail = [i for i in on if key[i] == key[-1]]
            held = [x[tail] for x in (key, ids, n, lo)]
            if len(found) > 20_000:
                yield out()
        if found:
            yield out()

    return run


def enough(overlap: np.ndarray, together: np.ndarray, t: Threshold) -> np.ndarray:
    """Whether overlaps (int64) reach the threshold for sets of so many elements together."""
    return overlap * (t.num + t.den) >= t.num * together


def compare(ids: np.ndarray, sets: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets, by exact overlaps in whole numbers."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    used, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlaps = np.zeros((k, k), np.int64)
    for s in range(0, len(used), 4096):
        a, b = np.searchsorted(column, [s, s + 4096])
        part = np.zeros((k, min(4096, len(used) - s)), np.float32)
        part[owner[a:b], column[a:b] - s] = 1
        overlaps += (part @ part.T).astype(np.int64)  # at most 4096 in a step, exact in single precision
    links = enough(overlaps, sizes[:, None] + sizes[None, :], t)
    seen, out = np.zeros(k, bool), []
    for i in range(k):
        if seen[i]:
            continue
        seen[i] = True
        frontier = np.array([i])
        while len(frontier):
            near = links[frontier].any(axis=0) & ~seen
            frontier = np.flatnonzero(near)
            seen[frontier] = True
            out += [(int(ids[i]), int(ids[j])) for j in frontier]
    return out


def _verify(t: Threshold):
    def visit(rows: pa.Table) -> pa.RecordBatch | None:
        by_id = dict(zip(rows.column("fp").to_pylist(), rows.column("hashes").to_pylist(), strict=True))
        if len(by_id) < 2:
            return None
        edges = compare(np.array(list(by_id), np.int64), [np.frombuffer(x, np.uint64) for x in by_id.values()], t)
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], names=["u", "v"])

    return grouped_stream(_MEETING, visit)


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) + _U(77)) >> _U(64 - bits)).astype(np.int64)


def _bitmap(nodes: DataFrame, column: str, count: int) -> np.ndarray:
    """A bit map of hashed ids, 16 bits to each, at most 2**30 bits: who is not in it is surely not among the ids."""
    bits = min(30, max(16, (16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            at = _places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if marks.any():
            for seg, data in dense_parts(marks.view(np.int32), SEGMENTS):
                yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([data], pa.binary())], names=["seg", "data"])

    got = merge_dense(nodes.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "seg int, data binary"), "or")
    return got.view(np.uint8) if len(got) else np.zeros(1 << (bits - 3), np.uint8)


def _ship(width: int, naming: Naming, shared):
    """Third pass: the shingle sets of the rows whose id may be a candidate's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, marks = Shingler(width), shared.value
        bits = (len(marks) * 8).bit_length() - 1
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = _places(ids, bits)
            b = b.filter(pa.array((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            if b.num_rows:
                sets = shingler.sets(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([naming(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "got", "hashes"])

    return run


def with_set_names(rows: DataFrame, width: int, out: str, text: str = "text") -> DataFrame:
    """Rows with the 128-bit name of their text's shingle set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, naming = Shingler(width), Naming()
        for b in batches:
            sets = shingler.sets(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns,
                pa.array([f"{naming.first(s)},{second_fingerprint(s)}" if len(s) else None for s in sets], pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def _names(meta: DataFrame) -> DataFrame:
    """(fp, rep, n, a, b) of each name: its smallest doc_id, its size and the least and greatest second half, which differ where two sets share it."""
    return cut(meta.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("second").alias("a"),
        F.max("second").alias("b")))


def _renamed(meta: DataFrame, names: DataFrame, bits: int) -> tuple[Naming, DataFrame]:
    """Other names for the sets that share one, and ``meta`` with them. They are few by odds; a check of their number guards the driver."""
    spark = meta.sparkSession
    pairs = cut(meta.join(names.where("a <> b").select("fp"), "fp").select("fp", "second").distinct())
    if pairs.count() > RENAMED:
        raise RuntimeError(f"more than {RENAMED} sets share a 64-bit name; that many don't occur by chance")
    rows = sorted((r.fp, r.second) for r in pairs.collect())
    for attempt in range(100):
        new = mix(np.array([s for _, s in rows], np.int64).view(np.uint64) + _U(attempt)).view(np.int64).tolist()
        table = spark.createDataFrame([(f, s, n) for (f, s), n in zip(rows, new, strict=True)], "_f long, _s long, _new long")
        if len(set(new)) == len(new) and names.join(F.broadcast(table), names.fp == table["_new"], "left_semi").isEmpty():  # at most RENAMED rows
            break
    else:
        raise RuntimeError("no free names found")
    joined = meta.join(F.broadcast(table), (meta.fp == table["_f"]) & (meta.second == table["_s"]), "left")
    changed = joined.select("doc_id", "n", F.coalesce("_new", "fp").alias("fp"), "second", "set_name")
    return Naming(bits, dict(zip(rows, new, strict=True))), cut(changed)


def _placed(nodes: DataFrame, t: Threshold) -> DataFrame:
    """Where each set of a candidate group is compared: rows of (fp, rep) and the key of a meeting of two blocks.

    A group of one block meets in it. A larger one is parted by size, into kinds such that linked sets are of one kind or
    of neighbouring ones; each kind has blocks of its own, and only blocks of one kind or of neighbouring kinds meet.
    """
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int")
    step = log(t.den / t.num) * (1 + 1e-7)  # a little wide, so that rounding can't part linked sets by two kinds
    kind = F.floor(F.log("n") / step) if step else F.col("n")
    whole = cut(nodes.groupBy("component").agg(blocks.alias("_all")))
    nodes = cut(nodes.join(whole, "component").withColumn("kind", F.when(F.col("_all") > 1, kind).otherwise(0).cast("int")).drop("_all"))
    w = Window.partitionBy("component").orderBy("kind")  # as many rows as a group has kinds of size
    beside = lambda f, by: F.when(f("kind").over(w) == F.col("kind") + by, f("_own").over(w)).otherwise(0)
    counts = nodes.groupBy("component", "kind").agg(blocks.alias("_own")).select("*", beside(F.lead, 1).alias("_above"), beside(F.lag, -1).alias("_below"))
    b = F.col("_b")
    meeting = lambda kind, across, i, j: F.struct(kind.cast("int").alias("kind"), F.lit(across).alias("across"), i.alias("bi"), j.alias("bj"))

    def each(count: str, place) -> Column:
        met = F.transform(F.sequence(F.lit(0), F.greatest(F.col(count), F.lit(1)) - 1), place)
        return F.when(F.col(count) > 0, met).otherwise(F.slice(met, 1, 0))

    own = each("_own", lambda o: meeting(F.col("kind"), False, F.least(b, o), F.greatest(b, o)))
    above = each("_above", lambda o: meeting(F.col("kind"), True, b, o))
    below = each("_below", lambda o: meeting(F.col("kind") - 1, True, o, b))
    dealt = nodes.join(cut(counts), ["component", "kind"]).withColumn("_b", F.pmod(F.xxhash64("fp"), F.col("_own")).cast("int"))
    return dealt.select("fp", "rep", "component", F.explode(F.concat(own, above, below)).alias("_m")).select("fp", "rep", "component", "_m.*")


def near_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text", named: bool = False,
    name_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its shingle set and the smallest id reachable by links.

    ``named`` adds fp, the 128-bit name of the row's set (see :func:`with_set_names`), null for an empty one. ``name_bits``
    shortens the names that sets have on the way, to try what happens where sets share one.
    """
    spark = prepare(docs.sparkSession)
    t, naming = Threshold(num, den), Naming(name_bits)
    n = shuffle_count(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    first = cut(rows.mapInArrow(_survey(width, naming), "doc_id long, n long, fp long, second long, seg int, data binary"))
    meta = first.where("seg IS NULL").select("doc_id", "n", "fp", "second", F.when(F.col("fp").isNotNull(), F.concat_ws(",", "fp", "second")).alias("set_name"))
    counts = merge_dense(first.where("seg IS NOT NULL").select("seg", "data"), "sum")
    fp = [F.col("set_name").alias("fp")] if named else []
    if not len(counts):
        return meta.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *fp)
    # Cells that stand out from the mean load hold a shingle of very many documents. One byte a cell, 1 MB at any size of the corpus.
    hot = spark.sparkContext.broadcast(counts > counts.mean() + np.maximum(LEAST_COMMON, meta.count() * COMMON_SHARE))
    names = _names(meta)
    if not names.where("a <> b").isEmpty():
        naming, meta = _renamed(meta, names, name_bits)
        names = _names(meta)

    entries = rows.select("text").mapInArrow(_emit(width, t, naming, hot), _ENTRY)
    edges = cut(entries.repartition(n, "key").sortWithinPartitions("key", "n", "id").mapInArrow(_scan(t), "u long, v long").distinct())
    groups = cut(components(edges))

    nodes = cut(names.join(groups, names.fp == groups.node).select("fp", "rep", "n", "component"))
    placed = _placed(nodes, t)
    marks = spark.sparkContext.broadcast(_bitmap(nodes, "rep", nodes.count()))  # at most 128 MB
    sets = rows.mapInArrow(_ship(width, naming, marks), "doc_id long, got long, hashes binary")
    blocks = sets.join(placed, (sets.doc_id == placed.rep) & (sets.got == placed.fp)).select(*_MEETING, "fp", "hashes")
    blocks = blocks.repartition(n, *_MEETING).sortWithinPartitions(*_MEETING)
    linked = cut(blocks.mapInArrow(_verify(t), "u long, v long"))

    whole = cut(components(linked))
    joined = cut(names.join(whole, names.fp == whole.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")))
    least = cut(joined.groupBy("component").agg(F.min("rep").alias("component_id")))
    ids = cut(joined.join(least, "component").select(F.col("fp").alias("name"), "component_id"))
    meta = cut(meta)
    return meta.join(ids, meta.fp == ids.name, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *fp
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, chr(10)) || chr(9)] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
