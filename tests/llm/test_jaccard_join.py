from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from marginalia.llm import jaccard_join as J
from marginalia.llm.shingles import Shingler

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def groups(texts, width, num):
    sets = {i: shingles(t, width) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for g in s for j in lists[g])
        for g in s:
            lists[g].append(i)
        for j, k in common.items():
            if 100 * k >= num * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n=160):
    """Texts of many lengths with exact copies, near copies of all distances, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.5:
            w = rng.choice(out)[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 8, 12, 15, 20, 40, 120]))]
            if kind > 0.8:
                w += passage
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_hashed_sets_have_the_right_sizes():
    texts = [t for _, t in corpus(1)] + [None, "", "\x00 \x1f", "A b C", "é" * 300_000]
    for width in (1, 3, 5):
        assert [len(h) for h in Shingler(width).sets(texts)] == [len(shingles(t, width)) for t in texts]


def test_subset_sums():
    import numpy as np

    m = np.array([3, 5, 9, 2**63 + 1], np.uint64)
    assert sorted(J.subset_sums(m, 2).tolist()) == sorted(sum(p) % 2**64 for p in ((3, 5), (3, 9), (5, 9), (3, 2**63 + 1), (5, 2**63 + 1), (9, 2**63 + 1)))


@pytest.mark.parametrize(("width", "num", "seed"), [(3, 90, 1), (5, 80, 2), (1, 70, 3)])
def test_same_groups_as_brute_force(spark, documents, monkeypatch, width, num, seed):
    monkeypatch.setattr(J, "LEAST_COMMON", 3)
    monkeypatch.setattr(J, "BLOCK_SETS", 4)  # several blocks, and groups split once more
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_groups(documents(texts).repartition(3), width, num, 100).collect()}
    assert got == groups(texts, width, num)


def test_edge_rows(spark, documents):
    long = "word other third " * 20_000
    rows = [(5, long), (7, long + " end"), (1, None), (2, ""), (3, " \n"), (9, "a b c d"), (8, "A  B c D"), (8, "A  B c D"), (None, "a b c d"),
        (None, "alone here now x")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.near_groups(documents(rows), 3, 90, 100).collect())
    assert got == sorted([("5", 3, "5"), ("7", 4, "7"), ("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("9", 2, "8"), ("8", 2, "8"), ("8", 2, "8"),
        ("None", 2, "8"), ("None", 2, "None")])
    assert J.near_groups(documents([]), 3, 90, 100).count() == 0
    assert J.near_groups(documents([(1, ""), (2, None)]), 3, 90, 100).count() == 2


def test_a_large_group_of_copies(spark, documents):
    texts = [(i, "same words in every one of these documents " * 3) for i in range(500)] + [(1000 + i,
        f"its own text number {i} with nothing alike at {i * 7}") for i in range(50)]
    got = J.near_groups(documents(texts).repartition(4), 5, 80, 100).where("doc_id < 1000").select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]


@pytest.mark.parametrize("bits", [2, 5])
def test_sets_that_share_a_name_stay_apart(spark, documents, bits):
    """With names of a few bits nearly all sets share one; the groups are still those of brute force."""
    texts = corpus(4, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_groups(documents(texts).repartition(3), 3, 90, 100, name_bits=bits).collect()}
    assert got == groups(texts, 3, 90)


def test_the_threshold_is_decided_in_whole_numbers():
    import numpy as np

    t = J.Threshold(90, 100)
    assert not J.enough(np.array([720_017]), np.array([1_520_036]), t)[0] and J.enough(np.array([720_018]), np.array([1_520_036]), t)[0]
    half = 1_520_036 // 2
    for common, linked in ((720_017, False), (720_018, True)):
        a = np.arange(half, dtype=np.uint64)
        b = np.concatenate([a[:common], np.arange(10**9, 10**9 + half - common, dtype=np.uint64)])
        assert bool(J.compare(np.array([1, 2]), [a, b], t)) == linked


def test_chance_meetings_of_subset_hashes_do_not_link(spark, documents, monkeypatch):
    """Even if all subsets of small sets had one hash, only sets that are alike would link."""
    import numpy as np

    monkeypatch.setattr(J, "subset_sums", lambda m, k: np.zeros(1, np.uint64))
    texts = [(1, "a b c d e"), (2, "f g h i j"), (3, "a b c d e f"), (4, "k l m n o p")]
    edges, _ = J.scan_lists(np.zeros(3, np.int64), np.array([1, 2, 3]), np.array([3, 3, 3]), np.array([3, 3, 3]), J.Threshold(90, 100))
    assert edges == [(1, 2), (1, 3)]
    assert {r.component_id for r in J.near_groups(documents(texts), 3, 90, 100).collect()} == {1, 2, 3, 4}


def test_ids_keep_their_bits_beside_nulls(spark, documents):
    rows = [(2**53 + 1, "a b c d e"), (None, None), (None, "x y z u"), (2**53 + 3, "a b c d e")]
    assert {(r.doc_id, r.component_id) for r in J.near_groups(documents(rows), 3, 90, 100).collect()} == {(2**53 + 1, 2**53 + 1),
        (2**53 + 3, 2**53 + 1), (None, None)}


@pytest.mark.parametrize("num", [50, 80, 100])
def test_large_groups_are_parted_without_loss(spark, monkeypatch, num):
    """All pairs of sets whose sizes allow a link meet in some block, none in more than they must."""
    monkeypatch.setattr(J, "BLOCK_SETS", 3)
    rng = random.Random(num)
    sizes = {i: rng.choice([1, 2, 4, 8, 16, 5, 10, 20, 40, 64, 65, 100]) for i in range(60)}
    nodes = spark.createDataFrame([(i, i, n, 1 if i < 50 else 2 + i % 5) for i, n in sizes.items()], "fp long, rep long, n long, component long")
    t = J.Threshold(num, 100)
    met = defaultdict(set)
    for r in J._placed(nodes, t).collect():
        met[tuple(r[k] for k in J._MEETING)].add(r.fp)
    pairs = Counter((a, b) for ids in met.values() for a in ids for b in ids if a < b)
    group = lambda i: 1 if i < 50 else 2 + i % 5
    for a in sizes:
        for b in sizes:
            if a < b and group(a) == group(b):
                assert (a, b) in pairs or num * max(sizes[a], sizes[b]) > 100 * min(sizes[a], sizes[b]), (a, b)
            elif a < b:
                assert (a, b) not in pairs
