from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from marginalia.llm import sharding as S


def test_matrix_margins():
    senders = [5, 0, 17, 1000, 3]
    m = S.communication_matrix(senders, 7, seed=3)
    assert m.sum(axis=1).tolist() == senders
    columns = m.sum(axis=0)
    assert columns.max() - columns.min() <= 1 and (m >= 0).all()


def test_matrix_is_unbiased():
    mean = np.mean([S.communication_matrix([30, 10], 2, seed=s) for s in range(400)], axis=0)
    assert abs(mean[0, 0] - 15) < 0.5 and abs(mean[1, 0] - 5) < 0.5


def _check(rows, shards):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shuffle(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 3)
    monkeypatch.setattr(S, "MAX_SENDERS", 2)
    df = documents([(i % 40, None if i % 9 == 0 else "t" * i) for i in range(101)]).repartition(5).select("doc_id", "text")
    rows = S.deal(df, shards=8).collect()
    assert len(rows) == 101
    _check(rows, 8)
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] != sorted(r.doc_id for r in rows)


def test_empty_and_few(spark, documents):
    assert S.deal(documents([]), shards=4).count() == 0
    _check(S.deal(documents([(1, "a"), (1, "a")]), shards=4).collect(), 4)


def test_query(spark):
    rows = S.query(spark, "/root/testdata/sf0.001").collect()
    _check(rows, 40)
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_large_draws_follow_the_law():
    good, rest, need = 7, 9, 6
    rng = np.random.default_rng(5)
    got = np.bincount([S.large_draw(rng, good, rest, need) for _ in range(20_000)], minlength=need + 1) / 20_000
    law = [math.comb(good, k) * math.comb(rest, need - k) / math.comb(good + rest, need) for k in range(need + 1)]
    assert np.abs(got - law).max() < 0.015
    big = [S.large_draw(rng, 2 * 10**9, 10**9, 3) for _ in range(5000)]
    assert abs(np.mean([b == 3 for b in big]) - 8 / 27) < 0.03 and abs(np.mean([b == 0 for b in big]) - 1 / 27) < 0.012
    assert S.large_draw(rng, 2 * 10**9, 0, 5) == 5 and S.large_draw(rng, 10**9, 2, 10**9 + 2) == 10**9


def test_log_probabilities_are_exact():
    for good, rest, need in ((50, 70, 33), (5, 400, 300), (30, 2, 31)):
        low, high = max(0, need - rest), min(good, need)
        law = [math.comb(good, k) * math.comb(rest, need - k) / math.comb(good + rest, need) for k in range(low, high + 1)]
        got = np.exp([S.log_probability(k, good, rest, need) for k in range(low, high + 1)])
        assert np.abs(got / got.sum() - law).max() < 1e-13
    # At 4e14 rows the ratio of neighbours is still right to the last digits.
    good, rest, need = 10**13, 39 * 10**13, 10**12
    k = need * good // (good + rest) + 10**5
    step = math.log1p(((good - k) * (need - k) - (k + 1) * (rest - need + k + 1)) / ((k + 1) * (rest - need + k + 1)))
    assert abs(S.log_probability(k + 1, good, rest, need) - S.log_probability(k, good, rest, need) - step) < 1e-13


def test_draws_at_a_trillion_rows():
    rng = np.random.default_rng(11)
    for good, rest, need in ((25 * 10**9, 975 * 10**9, 244 * 10**6), (10**12, 39 * 10**12, 10**10)):
        draws = np.array([S.large_draw(rng, good, rest, need) for _ in range(6000)], float)
        whole = good + rest
        mean, variance = need * good / whole, need * good / whole * rest / whole * (whole - need) / (whole - 1)
        assert abs(draws.mean() - mean) < 5 * (variance / 6000) ** 0.5 and abs(draws.var() / variance - 1) < 0.1
    assert {S.large_draw(rng, 10**15, 3, 10**15) for _ in range(50)} == {10**15 - 3}


def test_rows_go_by_the_matrix(spark, monkeypatch):
    """Brute force: count who gives what to whom, and hold it against the matrix drawn from the senders' sizes."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    df = spark.range(0, 237, 1, 6).selectExpr("id AS doc_id", "spark_partition_id() AS sender")
    rows = S.deal(df, shards=5, seed=9).collect()
    sizes = Counter(r.sender for r in rows)
    matrix = S.communication_matrix([sizes[s] for s in range(6)], 5, 9)
    sent = Counter((r.sender, r.shard) for r in rows)
    assert [[sent[s, t] for t in range(5)] for s in range(6)] == matrix.tolist() and sorted(r.doc_id for r in rows) == list(range(237))
    _check(rows, 5)


def test_places_are_uniform(spark, monkeypatch):
    """Over many deals every row comes to every shard and to every third of the slots about equally often, neighbours independently."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 4)
    df = spark.range(0, 12, 1, 3).withColumnRenamed("id", "doc_id")
    shard, slot, together = Counter(), Counter(), 0
    for seed in range(30):
        at = {r.doc_id: r for r in S.deal(df, shards=3, seed=seed).collect()}
        shard.update((r.doc_id, r.shard) for r in at.values())
        slot.update((r.doc_id, r.slot) for r in at.values())
        together += sum(at[i].shard == at[i + 1].shard for i in range(11))
    assert all(1 <= shard[i, s] <= 22 for i in range(12) for s in range(3))  # 10 expected, more than four standard deviations
    assert all(slot[i, s] <= 19 for i in range(12) for s in range(4))
    assert abs(together / (30 * 11) - 3 / 11) < 0.11


def test_clashing_columns(spark, documents):
    df = documents([(i, None) for i in range(9)]).selectExpr("*", "7 AS slot", "8 AS _row", "9 AS _k", "10 AS _first")
    got = S.deal(df, shards=2)
    assert got.columns == [*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot"]
    rows = got.collect()
    _check(rows, 2)
    assert {(r["_row"], r["_k"], r["_first"], r.score) for r in rows} == {(8, 9, 10, "x")}
