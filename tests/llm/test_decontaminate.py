from __future__ import annotations

import random
import re

from marginalia.llm import decontaminate as D


def _least(pattern: str, text: str) -> int:
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, c in enumerate(text, 1):
            row.append(min(before[j - 1] + (p != c), before[j] + 1, row[j - 1] + 1))
        before = row
    return min(before)


def test_myers_is_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, b))) for a, b in ((1, 90), (0, 120)))
        assert D.Myers(p).scan(t)[0] == _least(p, t)


def test_pieces_cover_the_item():
    for n in (1, 7, 95, 394):
        text = "x" * n
        k = D.budget(n, 0.08)
        assert "".join(p for _, p in D.pieces(text, k)) == text and len(D.pieces(text, k)) == k + 1


def test_every_occurrence_within_budget_is_found():
    rng = random.Random(5)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 160))).strip()) for i in range(20)]
    items = [(i, D.normal(t)) for i, t in items]
    m = D.Matcher(items, 0.08)
    for i, t in items:
        spoiled = list(t)
        for _ in range(D.budget(len(t), 0.08)):
            at = rng.randrange(len(spoiled))
            spoiled[at : at + 1] = rng.choice([["z"], [], [spoiled[at], "y"]])
        text = "q" * 50 + "".join(spoiled) + "q" * 50
        got = {g[0]: g for g in m.matches(text)}
        assert i in got and got[i][1] == _least(t, text)
        assert _least(t, text[got[i][2] : got[i][3]]) == got[i][1]


def test_tables(spark, documents, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    items = spark.createDataFrame([(1, item), (2, item.upper()), (3, None), (4, ""), (None, "another item that is quite long as well")],
        "item_id long, text string")
    docs = documents([(1, f"Start. The  quick brown fox\njumps over the lazy dog near the old river bank today."),
        (2, item.replace("lazy", "hazy") * 3), (3, None), (4, ""), (5, "clean text"), (2, "x"), (None, item), (7, "z" * 300_000)])
    expected = {(1, 1, 0), (1, 2, 0), (2, 1, 1), (2, 2, 1), (None, 1, 0), (None, 2, 0)}
    assert {(r.doc_id, r.item_id, r.distance) for r in D.contaminated(docs, items).collect()} == expected
    monkeypatch.setattr(D, "MAX_CHARS", 60)  # several automata
    assert {(r.doc_id, r.item_id, r.distance) for r in D.contaminated(docs, items).collect()} == expected
    clean = D.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5, 7]
    assert D.contaminated(docs.limit(0), items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0 and D.clean(docs,
        items.limit(0)).count() == 8


def test_same_matches_as_brute_force(spark):
    """Both directions: every pair of document and item within the budget is found with its least distance, and no other."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(2, 14)))) for i in range(25)]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.8:
            t = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 1 + len(t) // 8)):  # about the budget, often beyond it
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([["e"], [], [t[at], "e"]])
            body.insert(rng.randrange(len(body) + 1), "".join(t))
        docs.append((d, "  ".join(w.upper() if rng.random() < 0.3 else w for w in body) + rng.choice(["", "\n", " \t"])))
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = set()
    for d, text in docs:
        for i, item in items:
            least = _least(item, D.normal(text))
            if least <= D.budget(len(item)):
                expected.add((d, i, least))
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == expected and 40 < len(expected) < 1500
    text = dict(docs)
    for r in found:  # what the places cut out has that very distance
        assert _least(items[r.item_id][1], re.sub(r"\s+", " ", text[r.doc_id][r.start : r.end].lower())) == r.distance


def test_places_in_the_text_itself():
    for text in ("  A  b\tc ", "\u0130x  \u0130 y", "Stra\u00dfe \u03a9\u00c9", "\x1cA\x1fB"):
        normal = D.normal(text)
        spans = [(s, e) for s in range(len(normal)) for e in range(s + 1, len(normal) + 1) if normal[s] != " " != normal[e - 1]]
        for (s, e), (a, b) in zip(spans, D.places(text, spans), strict=True):
            assert normal[s:e] in D.normal(text[a:b]) and 0 <= a < b <= len(text)
    assert D.places("  A  b\tc ", [(0, 5)]) == [(2, 8)]
