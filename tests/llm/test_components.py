from __future__ import annotations

from marginalia.llm.common import components


def test_estimated_size_does_not_grow_with_rounds(spark):
    """A long path in shuffled order takes many rounds; what the planner takes for the size of the result stays a number of few digits."""
    n = 300
    name = [(i * 179) % n for i in range(n)]  # 179 and 300 have no common factor
    edges = spark.createDataFrame(list(zip(name, name[1:])), "u long, v long").repartition(16)
    got = components(edges)
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(n)]


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).collect() == []
