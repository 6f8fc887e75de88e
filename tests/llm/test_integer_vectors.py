"""op11, op12 and op13 against plain Python over exact integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from marginalia.llm import hamerly, integer_vectors, max_score, vector_codes

ROWS = "vec_id long, label int, embedding array<double>"


def integers(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    most = integer_vectors.limit(len(v))
    return [max(-most, min(most, math.floor(x * scale) if abs(x) < 1e300 else int(math.copysign(most, x)))) for x in v]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def odd_rows(dims):
    """What takes no part: no vector, a null or non-finite component."""
    return [(9001, 1, None), (9002, None, [None] + [0.5] * (dims - 1)), (9003, 1, [math.nan] * dims), (9004, 1, [0.5] * (dims - 1) + [-math.inf])]


def made(seed, n, dims, centres=9):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dims)) * 0.3
    rows = [(i, None if i % 11 == 0 else int(i % 4), (base[rng.integers(centres)] + rng.normal(size=dims) * rng.choice([0, 0.05, 0.3])).tolist()) for i in range(n)]
    rows += [(i + n, 3, rows[7][2]) for i in range(n // 3)]  # a third of all is one vector
    return rows


def frame(spark, rows, parts=3):
    """Rows in a table whose other columns bear the operators' own names."""
    df = spark.createDataFrame(rows, ROWS).repartition(parts)
    return df.selectExpr("*", "'x' AS v", "1 AS dim", "2 AS norm", "3 AS rank", "4 AS score", "5 AS code", "6 AS error", "7 AS cluster", "8 AS part")


def brute_top(rows, k=20, every=20, scale=64):
    kept = [(i, x) for i, _, v in rows if (x := integers(v, scale)) is not None]
    out = []
    for n, (q, a) in enumerate(kept):
        if q is not None and q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0, i) for m, (i, b) in enumerate(kept) if m != n)[:k]
            out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(best)]
    return sorted(out, key=str)


def got_top(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_top_k_against_brute_force(spark, monkeypatch, small):
    if small:  # several shards, blocks of queries and blocks of lists
        monkeypatch.setattr(max_score, "SHARD_ROWS", (40, 40))
        monkeypatch.setattr(max_score, "QUERY_ROWS", (4, 4))
        monkeypatch.setattr(max_score, "FIRST_ROWS", 8)
        monkeypatch.setattr(max_score, "LIST_ROWS", 16)
    rows = made(1, 240, 16) + odd_rows(16)
    rows += [(20, 1, rows[3][2]), (20, 1, rows[20][2]), (40, 1, rows[40][2]), (None, 1, rows[41][2]), (None, 1, rows[41][2]), (-20, 0, [0.0] * 16),
        (8000, 0, rows[5][2][:7]), (8020, 0, []), (8001, 0, rows[6][2] + [2.0, -3.0]), (8040, 2, [-x for x in rows[7][2]])]
    assert got_top(max_score.top_k(frame(spark, rows))) == brute_top(rows)


@pytest.mark.parametrize("size", [1e5, 1e300])
def test_top_k_of_large_numbers(spark, monkeypatch, size):
    monkeypatch.setattr(max_score, "FIRST_ROWS", 8)
    monkeypatch.setattr(max_score, "LIST_ROWS", 16)
    rows = [(i, 0, [x * size for x in v]) for i, _, v in made(2, 90, 8)]
    assert got_top(max_score.top_k(frame(spark, rows), k=5)) == brute_top(rows, 5)


def test_few_rows_and_none(spark):
    rows = [(0, 1, [1.0, 2.0])]
    assert max_score.top_k(frame(spark, rows)).count() == 0
    rows += [(7, 1, [1.0, -2.0]), (7, 1, [1.0, -2.0])]
    assert got_top(max_score.top_k(frame(spark, rows))) == brute_top(rows)
    none = frame(spark, rows).limit(0)
    for df in (max_score.top_k(none), vector_codes.encode(none), hamerly.cluster(none)):
        assert df.count() == 0
    only_odd = frame(spark, odd_rows(3))
    assert vector_codes.encode(only_odd).columns == vector_codes.encode(frame(spark, rows)).columns
    assert max_score.top_k(only_odd).count() == vector_codes.encode(only_odd).count() == hamerly.cluster(only_odd, dims=3).count() == 0
    assert hamerly.cluster(only_odd, dims=3).columns == hamerly.cluster(frame(spark, rows), dims=2).columns


def test_postings_are_not_all_traversed():
    """The essential terms are few for a query that stands out, and most documents end before all terms are probed."""
    rng = np.random.default_rng(3)
    documents = np.floor(rng.normal(size=(3000, 64)) * 8).astype(np.int64)
    q = np.zeros((1, 64), np.int64)
    q[0, :6] = 90
    q[0, 6:] = 1
    block = max_score.Block(documents, q, np.float32)
    scores = documents @ q[0]
    threshold = float(np.sort(scores)[-20])
    assert int(np.argmax(block.bounds[0] <= threshold * max_score.SHARE)) <= 8
    at, found = block.better(0, threshold)
    assert sorted(zip(at.tolist(), found.astype(int).tolist(), strict=True)) == [(i, s) for i, s in enumerate(scores.tolist()) if s > threshold]


def brute_codes(rows, entries, rounds=4, scale=1024):
    kept = [(i, label, x) for i, label, v in rows if (x := integers(v, scale)) is not None]
    width = -(-max(len(x) for *_, x in kept) // 4) * 4
    kept = [(i, label, x + [0] * (width - len(x))) for i, label, x in kept]
    w = width // 4
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))[:entries]
    books = [[x[p * w : p * w + w] for *_, x in first] for p in range(4)]
    best = lambda x, p: min((square(x[p * w : p * w + w], c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        sums = {}
        for *_, x in kept:
            for p in range(4):
                sums.setdefault((p, best(x, p)[1]), []).append(x[p * w : p * w + w])
        for (p, k), xs in sums.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[best(x, p) for p in range(4)] for *_, x in kept]
    by_label = {}
    for (_, label, _), f in zip(kept, found, strict=True):
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label], sha) for (i, label, _), f in zip(kept, found, strict=True)], key=str)


@pytest.mark.parametrize(("entries", "dims"), [(256, 8), (12, 16), (5, 6)])
def test_codes_against_brute_force(spark, entries, dims):
    rows = made(4, 70, dims, 5) + odd_rows(dims)
    rows += [(3, 2, rows[9][2]), (3, 2, rows[9][2]), (None, None, rows[8][2]), (8000, 1, rows[2][2][:3]), (8001, 1, []), (8002, 1, [1e300] + [0.0] * (dims - 1))]
    got = vector_codes.encode(frame(spark, rows), entries=entries)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_codes(rows, entries)


def test_ties_go_to_the_lower_entry():
    at, d = vector_codes.nearest(np.array([[1, 0], [5, 5]]), np.array([[0, 0], [2, 0], [0, 0]]))
    assert at.tolist() == [0, 1] and d.tolist() == [1, 34]


def brute_clusters(rows, centroids, rounds=3, dims=64, scale=64):
    kept = [(i, x) for i, _, v in rows if v is not None and len(v) == dims and (x := integers(v, scale)) is not None]
    order = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0] or 0, np.array(r[1], "<i4").tobytes())
    means = [x for _, x in sorted(kept, key=order)[:centroids]]
    best = lambda x: min((square(x, c), k) for k, c in enumerate(means))
    for _ in range(rounds):
        inside = {}
        for _, x in kept:
            inside.setdefault(best(x)[1], []).append(x)
        for k, xs in inside.items():
            means[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [best(x) for _, x in kept]
    sums = {}
    for d, k in found:
        sums[k] = sums.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    return sorted([(i, k, d, sums[k], sum(sums.values()), sha[k]) for (i, _), (d, k) in zip(kept, found, strict=True)], key=str)


@pytest.mark.parametrize(("centroids", "rounds"), [(16, 3), (5, 7), (1, 2)])
def test_clusters_against_brute_force(spark, centroids, rounds):
    rows = made(5, 150, 64, 12) + odd_rows(64)
    rows += [(3, 2, rows[9][2]), (3, 2, rows[9][2]), (None, 1, rows[8][2]), (8000, 1, rows[2][2][:63]), (8001, 1, []), (8002, 1, [-1e300] + [0.0] * 63)]
    got = hamerly.cluster(frame(spark, rows), centroids=centroids, rounds=rounds).cache()
    assert sorted([tuple(r) for r in got.drop("scans").collect()], key=str) == brute_clusters(rows, centroids, rounds)
    if centroids > 1:
        assert got.where(f"scans < {rounds + 1}").count() > 10  # bounds spare scans


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x, c = rng.integers(-40, 40, (400, 64)), rng.integers(-20, 20, (16, 64))
    own, upper, lower = hamerly.scanned(x, c)
    for _ in range(5):
        after = c + rng.integers(-2, 3, c.shape)
        upper, lower = hamerly.loosened(own, upper, lower, np.sqrt(((after - c) ** 2).sum(1)))
        c = after
        d = np.sqrt(hamerly.distances(x, c).astype(float))
        assert (d[np.arange(400), own] <= upper).all()
        d[np.arange(400), own] = np.inf
        assert (d.min(1) >= lower).all()
