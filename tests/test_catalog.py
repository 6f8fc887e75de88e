from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from marginalia.plans import catalog
from marginalia.sinks import files as sinks

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def oracle():
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        yield c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SMALL)
    expected = oracle.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    at = [expected.columns.index(c) for c in df.columns]
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    assert got and got == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"draw_commands"}))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_draw_commands_and_sinks(spark, tmp_path):
    commands = catalog.QUERIES["draw_commands"](spark, SMALL).where("book_id < '15'").cache()
    total = commands.count()
    assert total and {r.command for r in commands.select("command").distinct().collect()} <= {"highlight", "note", "bookmark"}
    counted = sinks.write_commands(commands, str(tmp_path / "commands"))
    assert sum(r.added for r in counted.collect()) == total == spark.read.parquet(str(tmp_path / "commands")).count()
    sinks.export_json(commands.limit(3), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "start"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
