from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from marginalia.llm import decontaminate, quality, registry, toxicity
from marginalia.llm.common import crc_mod

from .test_jaccard_join import groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    got = P.toxicity_stage(spark, docs, SF).cache()
    assert got.columns == docs.columns
    m = toxicity.train(docs, labels, crc_mod("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT)
    assert ids(got) == ids(toxicity.score(docs, m).where("score < 0.5"))

    after = P.quality_stage(spark, got, SF).cache()
    m = quality.train(got, labels, crc_mod("doc_id", quality.FOLDS) != quality.HELD_OUT)
    assert after.columns == docs.columns and ids(after) == ids(quality.score(got, m).where("score >= 0.5"))

    kept = P.near_duplicates_stage(spark, after, SF).cache()
    expected = groups([(r.doc_id, r.text) for r in after.collect()], 5, 80)
    assert kept.columns == docs.columns and ids(kept) == sorted({c for _, c in expected.values()})

    clean = P.decontamination_stage(spark, kept, SF).cache()
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items, decontaminate.ERROR_RATE)
    assert clean.columns == docs.columns and ids(clean) == sorted(r.doc_id for r in kept.collect() if not matcher.matches(decontaminate.normal(r.text)))

    tokens = P.tokens_stage(spark, clean, SF)
    assert ids(tokens) == ids(clean) and tokens.where("NOT restored").count() == 0
    assert ids(P.run(spark, SF)) == ids(clean)


def least_distances(item: str, text: np.ndarray, gap: int) -> np.ndarray:
    """For each place of a text (code points, ``gap`` between documents) the least edit distance of the item to what ends there."""
    at = np.arange(len(text) + 1, dtype=np.int32)
    before = np.zeros(len(text) + 1, np.int32)
    for i, c in enumerate(item, 1):
        row = np.empty_like(before)
        row[0] = i
        row[1:] = np.minimum(before[:-1] + (text != ord(c)), before[1:] + 1)
        before = np.minimum.accumulate(row - at) + at
    return before[1:]


def test_decontamination_against_whole_tables_of_edit_distances(spark):
    """Nothing of the operator is used: normal forms, budgets and distances of all items at all places of all documents are made here."""
    rows = {r.doc_id: " ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and r.text.strip()]
    gap = 1 + max(len(t) for t in items) // 10
    text = np.array([c for t in rows.values() for c in [*map(ord, t), *[0] * gap]], np.int32)
    starts = np.concatenate([[0], np.cumsum([len(t) + gap for t in rows.values()])[:-1]])
    held = np.zeros(len(rows), bool)
    for t in items:
        held |= np.minimum.reduceat(least_distances(t, text, gap), starts) <= int(0.08 * len(t))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in P.decontamination_stage(spark, docs, SF).select("doc_id").collect()}
    assert kept == {d for d, h in zip(rows, held, strict=True) if not h} and 0 < held.sum() < len(rows)


def test_classifier_stages_decide_as_the_labels_do(spark):
    """On labelled rows that were not learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    crc = lambda i, m: zlib.crc32(str(i).encode()) % m
    for stage, column, good, held in ((P.toxicity_stage, "toxic", 0, lambda i: crc(i, 5) == 0), (P.quality_stage, "quality", 1, lambda i: crc(i, 3) == 1)):
        kept = {r.doc_id for r in stage(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
        tried = [(i in kept, r[column] == good) for i, r in labels.items() if r[column] is not None and held(i)]
        assert len(tried) > 20 and sum(a == b for a, b in tried) >= 0.9 * len(tried), (column, len(tried), sum(a == b for a, b in tried))


def test_repeated_ids_and_empty_tables(spark, documents):
    docs = documents([(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text with that very id"), (2, "a b c d e f g"),
        (None, "no id at all here"), (3, None), (4, "")])
    kept = P.near_duplicates_stage(spark, docs, SF)
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("1", "a b c d e f g"),
        ("1", "quite another text with that very id"), ("None", "no id at all here"), ("3", ""), ("4", "")])
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_ids_with_a_copy_and_another_text(spark, documents):
    a, b = "a b c d e f g", "quite another text with that very id"
    kept = P.near_duplicates_stage(spark, documents([(1, a), (2, a), (2, b), (2, b), (3, a), (3, a), (3, None)]), SF)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, a), (2, b), (3, "")]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    with duckdb.connect() as c:
        for t in ("documents", "pages", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        expected = c.sql(registry.ORACLE_SQL[name])
        at = [expected.columns.index(k) for k in got.columns]
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in expected.fetchall())


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "tokens"]
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 14))
