from __future__ import annotations

import math

import numpy as np
import pytest

from marginalia.llm import embedding_dedup as E


def brute(rows, threshold=0.98):
    unit = {}
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            unit[i] = None
        else:
            a = np.array(v, float)
            unit[i] = (label, len(v), a / np.linalg.norm(a))
    links = {i: {j for j, b in unit.items() if j != i and a and b and a[:2] == b[:2] and a[2] @ b[2] >= threshold} for i, a in unit.items()}
    out = {}
    for i in unit:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


@pytest.mark.parametrize("cell_rows", [2000, 20])
def test_same_links_as_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(E, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(300):
        v = base[rng.integers(40)] + rng.normal(size=8) * rng.choice([0, 0.03, 0.15, 0.4])
        rows.append((i, int(rng.integers(3)), [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)]))
    rows += [(900, None, rows[0][2]), (901, 0, None), (902, 0, [0.0] * 8), (903, 0, [1.0, None] + [0.0] * 6), (904, 0, [math.nan] * 8),
        (905, 0, [math.inf] * 8), (906, 0, []), (907, 0, rows[0][2][:7]), (908, 1, [1e-30] * 8), (909, 1, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS node", "2 AS cell", "3 AS kept").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}
    assert got == brute(rows)


def test_repeated_and_unnamed_rows(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(1, 0, v), (1, 0, v), (2, 0, v), (None, 0, v), (None, None, None)], "vec_id long, label int, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), str(r.kept)) for r in E.near_vectors(df).collect())
    assert got == [("1", 2, "1", "True"), ("1", 2, "1", "True"), ("2", 2, "1", "False"), ("None", 0, "None", "None"), ("None", 0, "None", "None")]
    assert E.near_vectors(df.limit(0)).count() == 0


def vectors(seed, n=500, dims=6):
    """Clusters of many sizes and tightness, and one dense cloud that holds a third of all."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, dims))
    rows = []
    for i in range(n):
        b = base[0] if i % 3 == 0 else base[rng.integers(60)]
        v = b + rng.normal(size=dims) * rng.choice([0, 0.02, 0.1, 0.3, 0.6])
        rows.append((i, "a" if i % 7 else "b", v.tolist()))
    return rows


@pytest.mark.parametrize(("fan", "shared_bytes"), [(4, 32 << 20), (4, 0), (16, 0)])
def test_levels_of_cells_lose_no_link(spark, monkeypatch, fan, shared_bytes):
    """Small cells and few of them a level, so groups are split several times; centroids shared or sent along."""
    monkeypatch.setattr(E, "CHUNK_ROWS", 40)
    monkeypatch.setattr(E, "BLOCK_ROWS", 16)
    rows = vectors(fan)
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(4)
    start = E._units(df.selectExpr("vec_id AS node", "label", "6 AS dim", "'' AS path", "0 AS depth", "true AS home", "1L AS copies", "embedding"),
        "node long, label string, dim int, path string, depth int, home boolean, copies long")
    placed = E.cells(start.select(*E._NAMES), 0.98, 12, fan, shared_bytes).collect()
    assert max(r.depth for r in placed) >= (2 if fan == 4 else 1)
    assert sorted(r.node for r in placed if r.home) == list(range(500))  # each lives in one cell
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df, cell_rows=12, fan=fan, shared_bytes=shared_bytes).collect()}
    assert got == brute(rows)


def test_a_dense_cloud_is_not_split():
    rng = np.random.default_rng(1)
    cloud = rng.normal(size=16) + rng.normal(size=(4000, 16)) * 0.01
    cloud /= np.linalg.norm(cloud, axis=1)[:, None]
    assert E.split(cloud, 64, math.sqrt(0.04)) is None
    apart = rng.normal(size=(4000, 16))
    apart /= np.linalg.norm(apart, axis=1)[:, None]
    assert E.split(apart, 64, math.sqrt(0.04)) is not None


@pytest.mark.parametrize("kind", ["string", "double", "date"])
def test_labels_of_any_type(spark, kind):
    label = {"string": ["x", "y z", None], "double": [0.5, 1.5, None], "date": ["2020-01-01", "2021-01-01", None]}[kind]
    rows = [(i, label[i % 3], [1.0, 2.0 + i * 0.001]) for i in range(9)]
    df = spark.createDataFrame(rows, f"vec_id long, label {'string' if kind == 'date' else kind}, embedding array<double>").withColumn("label",
        E.F.col("label").cast(kind))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}
    assert got == {i: (0, i, True) if i % 3 == 2 else (2, i % 3, i < 3) for i in range(9)}


@pytest.mark.parametrize("bits", [1, 4])
def test_vectors_that_share_a_hash_stay_apart(spark, bits):
    rows = vectors(9, 120)
    rows += [(1000 + i, label, v) for i, (_, label, v) in enumerate(rows[:30])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df, hash_bits=bits).collect()}
    assert got == brute(rows)


def test_ids_keep_their_bits_beside_nulls(spark):
    rows = [(2**53 + 1, "a", [1.0, 0.0]), (None, "a", [1.0, 0.0]), (2**53 + 3, "a", [1.0, 0.001])]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert {(r.vec_id, r.component_id) for r in got} == {(2**53 + 1, 2**53 + 1), (2**53 + 3, 2**53 + 1), (None, None)}
