"""Queries and operators without SQL, held against plain Python that states their rule, over whole tables or many random rows."""

from __future__ import annotations

import random
from difflib import SequenceMatcher
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions.bands import band_join
from marginalia.functions.containment import contained
from marginalia.functions.similarity import could_be_alike
from marginalia.operators import dedup, matching, reports
from marginalia.plans import catalog, inputs, pipeline
from marginalia.sinks import files as sinks
from marginalia.sources import pages

from . import plain
from .conftest import SMALL


def _anchored(clip: str, page: str):
    """Where a clipping stands between its first and last words, if that is nine tenths alike."""
    words = clip.split()
    if len(words) < 6:
        return None
    start = next((i for k in (5, 4, 3) if (i := page.find(" ".join(words[:k]))) >= 0), None)
    if start is None:
        return None
    n = len(clip)
    margin = max(50, int(n * 0.15))
    low, high = max(0, start + n - margin), min(len(page), start + n + margin)
    end = None
    for k in (5, 4, 3):
        tail = " ".join(words[-k:])
        if (i := page[low:high].find(tail)) >= 0:
            end = low + i + len(tail)
        elif (i := page[start:].find(tail)) >= 0:
            end = start + i + len(tail)
        if end is not None:
            break
    if end is None or end <= start:
        return None
    part = page[start:end]
    ratio = SequenceMatcher(None, part, clip).ratio()
    a, b = part.split(), words
    same = sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))
    return (start, end, round(ratio, 6), round(same, 6)) if ratio >= 0.9 else None


def test_anchored_fuzzy_match_over_whole_tables(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    docs = [(r.doc_id, " ".join(r.text.split())) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r.text]
    expected = set()
    for r in items:
        w = r.text.split()
        clip = " ".join([*w[:8], "zzz", *w[9:]])
        for doc, page in docs:
            if " ".join(clip.split()[:5]) in page and (hit := _anchored(clip, page)):
                expected.add((r.item_id, doc, *hit))
    got = {tuple(r) for r in catalog.QUERIES["anchored_fuzzy_match"](spark, SMALL).select("item_id", "doc_id", "start", "end", "ratio", "word_ratio").collect()}
    assert got == expected and got


def test_bounds_never_rule_out_what_is_alike(spark):
    rng = random.Random(12)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abcdeé 😀\n") for _ in range(rng.choice([0, 1, 3, 20, 60, 300])))
        b = "".join(c for c in a if rng.random() > rng.choice([0, 0.02, 0.1, 0.2, 0.5])) + "x" * rng.choice([0, 0, 3])
        pairs.append((a, b) if rng.random() < 0.7 else (a, "".join(rng.sample(list(a), len(a)))))
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    for least in (0.8, 0.9):
        got = {(r.a, r.b): r.ok for r in df.select("a", "b", could_be_alike("a", "b", least).alias("ok")).collect()}
        alike = {p: SequenceMatcher(None, *p).ratio() >= least for p in pairs}
        assert all(got[p] for p in pairs if alike[p]) and not got[None, "a"] and not got["a", None]
        assert sum(not x for x in got.values()) > 50


def test_few_candidates_reach_the_similarity(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(200):
        w = [word() for _ in range(40)]
        body = w[5:-5] if i % 4 == 0 else [word() for _ in range(30)]  # three quarters are alike in their anchors alone
        rows.append((i, " ".join(w), " ".join([*w[:5], *body, *w[-5:]])))
    joined = spark.createDataFrame(rows, "k int, search_norm string, page_norm string")
    assert sum(r.matched_text is not None for r in matching.anchors(joined).select("matched_text").collect()) == 200
    sent = {r.k for r in matching.anchor_candidates(joined, "k").select("k").collect()}
    found = {r.k for r in matching.anchored(joined, "k").collect()}
    assert found == {i for i in range(200) if i % 4 == 0} <= sent and len(sent) < 80
    plan = matching.anchored(joined, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_similar_texts_over_whole_tables(spark):
    turns = [(str(r.conv_id), r.turn, r.text or "") for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    spoil = str.maketrans("", "", "lm")
    by_book = {}
    for b, o, t in turns:
        by_book.setdefault(b, []).append((o, t))
    want = set()
    for b, o, t in turns:
        best = min((-SequenceMatcher(None, t.translate(spoil), x).ratio(), n) for n, x in by_book[b])
        if -best[0] >= 0.8:
            want.add((b, o, best[1], round(-best[0], 6)))
    assert {tuple(r) for r in catalog.QUERIES["similar_texts"](spark, SMALL).collect()} == want and want


def test_similar_texts(spark):
    c = spark.read.parquet(f"{SMALL}/conversations.parquet").selectExpr("cast(conv_id as string) book_id", "0 page", "turn ord", "text content").collect()
    rng = random.Random(4)
    spoil = lambda t: "".join(ch for ch in t or "" if rng.random() > 0.08)
    actual = [(r.book_id, 0, r.ord, r.content or "") for r in c]
    expected_rows = [(r.book_id, 0, r.ord * 10, spoil(r.content)) for r in c]
    schema = "book_id string, page int, {} long, content string"
    got = {(r.book_id, r.key): (r.actual_ord,
        round(r.ratio, 9)) for r in reports.similar_texts(spark.createDataFrame(expected_rows, schema.format("key")),
            spark.createDataFrame(actual, schema.format("ord")), "key").collect()}
    want = {}
    for b, _, key, text in expected_rows:
        best = min(((-SequenceMatcher(None, text, t).ratio(), o) for bb, _, o, t in actual if bb == b), default=None)
        if best and -best[0] >= 0.80:
            want[b, key] = (best[1], round(-best[0], 9))
    assert got == want and want


def _plain_fold(rows):
    near = lambda a, b, t: None not in (*a, *b) and abs(a[0] - b[0]) <= t and abs(a[1] - b[1]) <= t
    kept = []
    for row in rows:
        start, end, match = (row["pdf_x"], row["pdf_y"]), (row["pdf_x_end"], row["pdf_y_end"]), None
        for other in kept:
            same = other["type"] == row["type"]
            t = 0.1 if same else 5.0
            if not same and not (row if row["type"] == "note" else other)["content"].strip():
                continue
            o, oe = (other["pdf_x"], other["pdf_y"]), (other["pdf_x_end"], other["pdf_y_end"])
            if near(start, o, t) or near(oe, start, t) or near(end, o, t):
                match = other
                break
        if match is None:
            kept.append(row)
        elif match["type"] != row["type"]:
            note, highlight = (row, match) if row["type"] == "note" else (match, row)
            if highlight["content"] and not note["highlight_content"]:
                note["highlight_content"] = highlight["content"]
            if note is row:
                kept = [k for k in kept if k is not match] + [row]
    return kept


@pytest.mark.parametrize("seed", range(30))
def test_folding_by_a_grid_is_folding_all_with_all(seed):
    rng = random.Random(seed)
    place = lambda: rng.choice([None, *[rng.choice([0, 4.9, 5, 5.1, 10, 10.05, 10.1, 15, -3, -5.0])] * 9])

    def row(i):
        x, y = place(), place()
        y = None if x is None else y if y is not None else 0
        xe, ye = (None, None) if rng.random() < 0.3 else (rng.choice([0, 5, 10, 14.9]), rng.choice([0, 5, 10]))
        return {"id": i, "type": rng.choice(["note", "highlight"]), "pdf_x": x, "pdf_y": y, "pdf_x_end": xe, "pdf_y_end": ye,
            "content": rng.choice(["", " ", "a", "b"]), "highlight_content": None}

    rows = [row(i) for i in range(60)]
    assert dedup.fold_page([dict(r) for r in rows]) == _plain_fold([dict(r) for r in rows])


def test_contained_is_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    wholes = [(word(rng.randint(0, 25)),) for _ in range(120)] + [(None,), ("",)]
    parts = [(word(rng.randint(0, 12)),) for _ in range(80)] + [(w[0][3:14],) for w in wholes[:40] if w[0]] + [(None,), ("",)]
    got = [(r.whole, r.part) for r in contained(spark.createDataFrame(wholes, "whole string"), spark.createDataFrame(parts, "part string"), "whole",
        "part").collect()]
    assert sorted(got) == sorted({(w, p) for (w,) in wholes for (p,) in parts if w is not None and p is not None and p in w})


def test_containment_by_the_lengths_that_keys_have(spark, monkeypatch):
    from marginalia.functions import containment

    wholes = spark.createDataFrame([(f"a title of some length {i}",) for i in range(50)], "w string")
    for parts, shared in (([("of some length",), ("title of",)], 100), ([("of some length",), ("title of",)], 0), ([("",)], 100), ([("of",), ("length 7",), ("",)], 0), ([], 100)):
        monkeypatch.setattr(containment, "SHARED_ROWS", shared)
        p = spark.createDataFrame(parts, "p string")
        got = {(r.w, r.p) for r in contained(wholes, p, "w", "p").collect()}
        assert got == {(w.w, x) for w in wholes.collect() for (x,) in parts if x in w.w}
    keys = spark.createDataFrame([("of some length",), ("title of",)], "p string")
    plan = contained(wholes, keys, "w", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("shared", [50_000, 0])
def test_phrases_in_texts_of_all_lengths(spark, monkeypatch, shared):
    monkeypatch.setattr(matching, "PHRASES_SHARED", shared)
    rng = random.Random(7)
    word = lambda: rng.choice(["ab", "abc", "bc", "c", "cab", "é"])
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(90, None), (None, "ab abc")]
    phrases = [(i, " ".join(word() for _ in range(rng.randint(1, 7)))) for i in range(60)] + [(70, None), (71, ""), (None, "ab")]
    phrases += [(100 + i, t[3:-2].strip()) for i, t in texts[:30] if t and len(t) > 12]
    df = matching.join_containing(spark.createDataFrame(phrases, "p int, phrase string"), spark.createDataFrame(texts, "t int, text string"),
        "phrase", "text", "p", "t")
    got = sorted((r.p, r.t) for r in df.collect())
    assert got == sorted((p, t) for p, a in phrases for t, b in texts if p is not None and t is not None and a and b and a in b)


def test_resolved_highlights_lie_on_their_clippings(spark):
    """Over whole tables: the rects of a highlight that its clipping placed are line rects of that clipping's text in the page's characters, and bound the row."""
    pages_, w, clips = catalog._book_tables(spark, SMALL)
    rows = pipeline.resolve_annotations(inputs.sidecar_rows(spark, SMALL), clips, pages_, w).where("source IN ('text_based_matching', 'coordinate_text_extraction')")
    content = {r.book_id: r.content for r in clips.collect()}
    by_book = {}
    for r in w.collect():
        by_book.setdefault(r.book_id, []).append((r.ord, r.block, r.line, r.x0, r.y0, r.x1, r.y1, r.word))
    rounded = lambda r: tuple(round(v, 6) for v in r)
    seen = {}
    for r in rows.collect():
        kind = int(r.book_id) % 5
        rects = [tuple(q) for q in r.precise_rects]
        assert rounded((r.pdf_x, r.pdf_y, r.pdf_x + r.pdf_width, r.pdf_y + r.pdf_height)) == rounded((min(q[0] for q in rects), min(q[1] for q in rects),
            max(q[2] for q in rects), max(q[3] for q in rects)))
        seen[r.source, kind] = seen.get((r.source, kind), 0) + 1
        if r.source == "text_based_matching" and kind != 4:
            text, boxes = plain.page_with_boxes(by_book[r.book_id])
            c = content[r.book_id]
            places = [p for kind in ("exact", "normalised") for p in plain.match_places(text, kind, plain.normal_with_map(c)[0], [c, c.replace("fi", "ﬁ")])]
            allowed = {rounded(q) for s, e in places for q in plain.line_rects(text, boxes, s, e)}
            assert {rounded(q) for q in rects} <= allowed, (r.book_id, c)
    assert {k for source, k in seen if source == "text_based_matching"} == {0, 1, 2, 3, 4} and sum(seen.values()) > 200


def test_bands_lose_no_pair_and_meet_few(spark):
    """A page of very many boxes: all pairs that overlap, each once, and far fewer meetings than the page's square."""
    rng = random.Random(9)
    y = lambda: rng.choice([rng.uniform(-300, 3000), rng.uniform(0, 100), 24.0 * rng.randint(0, 5), 1e9, -1e9])

    def boxes(n):
        out = []
        for i in range(n):
            a = y()
            b = rng.choice([a + rng.uniform(0, 30), a, a - 20, y(), None])
            out.append(("b", 0, i, None if rng.random() < 0.02 else a, b))
        return out

    left, right = boxes(300), boxes(400)
    schema = "book_id string, page int, ord long, y0 double, y1 double"
    near = (F.least("a.y0", "a.y1") <= F.greatest("b.y0", "b.y1") + 5) & (F.greatest("a.y0", "a.y1") >= F.least("b.y0", "b.y1") - 5)
    ends = (F.col("y0"), F.col("y1"))
    df, other = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = [(r[0], r[1]) for r in band_join(df, other, ends, ends, near, reach=5.0).select("a.ord", "b.ord").collect()]
    span = lambda r: [v for v in r[3:] if v is not None]
    want = [(a[2], b[2]) for a in left for b in right if span(a) and span(b) and min(span(a)) <= max(span(b)) + 5 and max(span(a)) >= min(span(b)) - 5]
    assert sorted(got) == sorted(want) and want
    flat = [("b", 0, i, 12.0 * i, 12.0 * i + 10) for i in range(600)]
    lines = spark.createDataFrame(flat, schema)
    assert band_join(lines, lines, ends, ends, F.lit(True)).count() < 0.02 * 600**2


def test_marks_of_books_without_a_document_fail(spark):
    """No PDF library is needed to say so."""
    marks = spark.createDataFrame([("a", 0, 1, "note"), ("a", 0, 2, "note"), ("b", 0, 1, "bookmark")], "book_id string, page int, ord long, command string")
    none = spark.createDataFrame([], "book_id string, content binary")
    assert {tuple(r) for r in sinks.draw(marks, none, "/nowhere").collect()} == {("a", 0, 2), ("b", 0, 1)}
    lonely = spark.createDataFrame([("c", b"x")], "book_id string, content binary")
    assert sinks.draw(marks.limit(0), lonely, "/nowhere").count() == 0


class _Box(tuple):
    width, height = property(lambda b: b[2] - b[0]), property(lambda b: b[3] - b[1])


def test_rows_of_documents():
    """What is read of an open document, from one that only looks like a document."""
    whole = _Box((0, 0, 612, 792))
    page = lambda n, crop: SimpleNamespace(number=n, mediabox=whole, cropbox=crop,
        get_text=lambda kind="text": [(1, 2, 3, 4, "word", 0, 5, 0)] if kind == "words" else f"page {n}")

    class Doc(list):
        def get_page_labels(self):
            return [{"startpage": 0, "style": "r", "firstpagenum": 1, "prefix": ""}, {"startpage": 4, "style": "D", "prefix": "A-"}]

    doc = Doc([page(0, whole), page(1, _Box((40.5, 10, 612, 792)))])
    assert pages.word_rows("b", doc) == [("b", 0, 0, 0, 5, 1.0, 2.0, 3.0, 4.0, "word"), ("b", 1, 0, 0, 5, 1.0, 2.0, 3.0, 4.0, "word")]
    assert pages.page_rows("b", doc) == [("b", 0, "page 0", 612.0, 792.0, None),
        ("b", 1, "page 1", 612.0, 792.0, {"x0": 40.5, "y0": 10.0, "x1": 612.0, "y1": 792.0})]
    assert pages.label_rows("b", doc) == [("b", 0, 0, "r", 1, ""), ("b", 1, 4, "D", None, "A-")]
    assert len(pd.DataFrame(pages.page_rows("b", doc))) == 2
