from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import geometry as G
from marginalia.operators import adapter, assign, columns, dedup, matching, offset, quads, rects, reports, tokens
from marginalia.plans import pipeline
from marginalia.schemas import RECTS, WORD
from marginalia.sources import pages as page_source

from . import plain

ROW = "book_id string, page int, ord long, type string, pdf_x double, pdf_y double, pdf_x_end double, pdf_y_end double, content string, timestamp string, highlight_content string"


def row(ord, type, x, y, content="", end=(None, None), page=0, book="b", timestamp=""):
    return (book, page, ord, type, float(x), float(y), *end, content, timestamp, None)


def unified(spark, *rows):
    got = dedup.unify(spark.createDataFrame(rows, ROW)).orderBy("page", "place", "ord").collect()
    return [(r.type, r.content, r.highlight_content) for r in got]


@pytest.mark.parametrize(
    ("rows", "count"),
    [
        ([(100.04, "a", "highlight", ""), (100.01, "a", "highlight", ""), (100.03, "a", "highlight", "")], 1),
            ([(100.04, "a", "highlight", ""), (100.51, "a", "highlight", ""), (101.04, "a", "highlight", "")], 3),
        ([(1, "x" * 50 + "y", "highlight", ""), (1, " " + "x" * 50 + "z", "highlight", "")], 1),
            ([(1, "", "bookmark", "t1"), (1, "", "bookmark", "t2")], 2), ([(1, "", "bookmark", "t1"), (1, "", "bookmark", "t1")], 1),
    ],
)
def test_exact_duplicates(spark, rows, count):
    df = spark.createDataFrame([row(i, t, x, 50, c, timestamp=s) for i, (x, c, t, s) in enumerate(rows)], ROW)
    assert dedup.drop_exact(df).count() == count
    assert dedup.drop_exact(dedup.drop_exact(df)).count() == count


def test_unification(spark):
    mark = row(0, "highlight", 100, 100, "marked", (200.0, 140.0))
    assert unified(spark, mark, row(1, "note", 100, 100, "n")) == [("note", "n", "marked")]
    assert unified(spark, mark, row(1, "note", 200, 140, "n")) == [("note", "n", "marked")]
    assert unified(spark, mark, row(1, "note", 103, 102, "n")) == [("note", "n", "marked")]
    assert len(unified(spark, mark, row(1, "note", 150, 120, "n"))) == 2 and len(unified(spark, mark, row(1, "note", 107, 100, "n"))) == 2
    assert unified(spark, mark, row(1, "note", 100, 100, "n"), row(2, "bookmark", 100, 100)) == [("note", "n", "marked"), ("bookmark", "", None)]
    assert unified(spark, mark, row(1, "note", 100, 100, " ")) == [("highlight", "marked", None), ("note", " ", None)]  # nothing is lost to a blank note
    assert unified(spark, row(0, "note", 100, 100, "first"), row(1, "note", 100, 100, "second")) == [("note", "first", None)]
    assert len(unified(spark, mark, row(1, "note", 100, 100, "n", page=1), row(2, "note", 100, 100, "n", book="c"))) == 3
    assert dedup.unify(spark.createDataFrame([], ROW)).count() == 0


def test_fold_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [row(i, rng.choice(["note", "highlight", "bookmark"]), rng.randint(0, 12), rng.randint(0, 6), rng.choice(["a", "b", ""]),
        (float(rng.randint(0, 12)), float(rng.randint(0, 6))), page=rng.randint(0, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, ROW)
    one, many = (sorted(map(str, dedup.unify(df.repartition(n)).collect())) for n in (1, 7))
    assert one == many


RULE = "book_id string, ord long, startpage int, style string, firstpagenum int"


@pytest.mark.parametrize(
    ("rules", "out"), [([(10, "D", 1)], 10), ([(0, "r", 1), (5, "D", 1)], 5), ([(0, "D", 1), (2, "D", 3)], 0), ([(3, "D", 4), (7, "D", 2)], 6),
        ([(4, None, 1), (1, "r", 1)], None), ([(9, "D", None)], 9)]
)
def test_offset_by_labels(spark, rules, out):
    df = spark.createDataFrame([("b", i, *r) for i, r in enumerate(rules)], RULE)
    got = offset.from_labels(df).collect()
    assert [r.label_offset for r in got] == ([] if out is None else [out])


def test_offset_by_vote(spark):
    text = lambda i: f"This is the content of page number {i} of the book, and nothing else"
    pages = spark.createDataFrame([("b", i, text(i)) for i in range(60)] + [("c", i, "none") for i in range(3)], "book_id string, page int, text string")
    clip = "book_id string, ord long, pdf_page int, content string"
    clips = [("b", 0, 1, text(10).upper()), ("b", 1, 5, text(14)), ("b", 2, 9, text(9)), ("b", 3, 1, text(59)), ("b", 4, 3, "short"),
        ("c", 0, 1, "not to be found anywhere at all")]
    df = spark.createDataFrame(clips, clip)
    assert {r.book_id: r.offset for r in offset.detect(df, pages).collect()} == {"b": 10, "c": 0}
    moved = {(r.book_id, r.ord): (r.pdf_page, r.original_page) for r in offset.apply(df, offset.detect(df, pages)).collect()}
    assert moved["b", 0] == (11, 1) and moved["c", 0] == (1, 1)


def rects_of(*boxes):
    return [dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True)) for b in boxes]


def near(spark, boxes, length, x=0.0, y=0.0):
    df = spark.createDataFrame([(rects_of(*boxes), float(x), float(y), length)],
        "rects array<struct<x0:double,y0:double,x1:double,y1:double>>, x double, y double, length int")
    return [(r.x0, r.y0) for r in quads.filter_by_proximity(df).first().kept]


def test_quads_near_a_point(spark):
    spread = [(300, 300, 310, 312), (10, 10, 20, 22), (500, 10, 510, 22)]
    for n in (1, 3, 8):
        assert near(spark, spread, n, 12, 9) == [(10, 10)]
    stacked = [(50, 100, 300, 112), (40, 114, 300, 126), (40, 128, 200, 140)]
    assert near(spark, stacked, 20, 50, 100) == [(50, 100), (40, 114), (40, 128)]
    assert near(spark, [*stacked, (60, 600, 200, 612)], 20, 50, 100) == [(50, 100), (40, 114), (40, 128)]
    assert near(spark, [(50, 100, 90, 112), (250, 104, 300, 116)], 20, 50, 100) == [(50, 100), (250, 104)]  # same height and not far
    assert near(spark, [(50, 100, 90, 112), (450, 104, 500, 116)], 20, 50, 100) == [(50, 100)]
    assert near(spark, [], 20) == [] and near(spark, [(1, 2, 3, 4)], 2, 900, 900) == [(1, 2)]


def test_regions(spark):
    df = spark.createDataFrame([(1, rects_of((0, 0, 100, 12), (120, 0, 200, 12), (0, 20, 90, 32), (0, 400, 90, 412))),
        (2, rects_of((0, 0, 10, 10)))], "ann int, rects array<struct<x0:double,y0:double,x1:double,y1:double>>")
    regions = quads.regions(df, "ann")
    assert sorted((r.ann, r.n_rects) for r in regions.collect()) == [(1, 1), (1, 3), (2, 1)]
    flags = quads.disconnected(regions, "ann").collect()
    assert [(r.ann, r.all_far, r.some_far) for r in flags] == [(1, True, True)]
    q = reports.highlight_quality(df.select("ann"), regions, quads.disconnected(regions, "ann"), "ann").first()
    assert (q.highlights, q.with_regions, q.disconnected, q.error_rate) == (2, 1, 1, 0.5)


def test_columns(spark):
    def detect(lines):
        df = spark.createDataFrame([("b", 0, i, *map(float, b)) for i, b in enumerate(lines)],
            "book_id string, page int, ord long, x0 double, y0 double, x1 double, y1 double")
        page = spark.createDataFrame([("b", 0, 600.0, 800.0)], "book_id string, page int, width double, height double")
        return [(c.left, c.right, c.top, c.bottom) for c in columns.detect(df, page).first().columns]

    left = [(50 + i % 3, 100 + 15 * i, 295, 112 + 15 * i) for i in range(14)]
    right = [(320, 100 + 15 * i, 540, 112 + 15 * i) for i in range(12)]
    assert detect(left + right) == [(50, 295, 100, 307), (320, 540, 100, 277)]
    assert detect([(a, b, 400, d) for a, b, _, d in left] + right)[0] == (50, 310, 100, 307)  # held back from the other column
    assert detect(left + right[:9]) == [(50, 540, 100, 307)] and detect(left[:5]) == [(50, 295, 50, 750)] and detect([]) == [(50, 550, 50, 750)]


def test_first_fit_is_brute_force(spark):
    rng = random.Random(8)
    for _ in range(6):
        xs = [float(rng.randint(0, 120)) for _ in range(25)]
        groups: list[list[float]] = []
        for x in xs:
            hit = next((g for g in groups if abs(x - g[0]) <= 15), None)
            hit.append(x) if hit else groups.append([x])
        got = spark.createDataFrame([(xs,)], "xs array<double>").select(columns.first_fit_lefts(F.col("xs")).alias("g")).first().g
        assert [(g.pos, g.n) for g in got] == [(g[0], len(g)) for g in groups]


def test_snake(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    got = spark.range(1).select(rects.snake(*lit(120, 50, 200, 130, 40, 360)).alias("r")).first().r
    assert [(r.x0, r.x1) for r in got] == [(120, 360), *[(40, 360)] * 4, (40, 200)] and len(got) == 6
    assert len(spark.range(1).select(rects.snake(*lit(10, 50, 90, 52, 0, 99)).alias("r")).first().r) == 1
    assert spark.range(1).select(rects.snake(*lit(90, 50, 10, 50, 0, 99)).alias("r")).first().r == []


def test_rects_from_lines_and_choice(spark):
    lines = spark.createDataFrame([("b", 0, i, 50.0, 16.0 * i, 300.0, 16.0 * i + 12) for i in range(8)],
        "book_id string, page int, ord long, x0 double, y0 double, x1 double, y1 double")
    pos = lambda x, y: f"0 0 0 1 {x} {y} 1 1"
    rows = spark.createDataFrame([("b", 0, 1, pos(100, 50), pos(200, 90)), ("b", 0, 2, pos(100, 50), pos(130, 52)), ("b", 0, 3, "x", pos(1, 1))],
        "book_id string, page int, ord long, start_position string, end_position string")
    got = {r.ord: [(q.x0, q.x1) for q in r.rects] for r in rects.from_lines(rows, lines, "ord").collect()}
    assert got == {1: [(72, 300), (50, 300), (50, pytest.approx(144))], 2: [(72, pytest.approx(93.6))]}
    empty = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    one = F.array(G.rect(*[F.lit(float(v)) for v in (1, 2, 3, 4)]))
    df = spark.createDataFrame([(0.0, 0.0, 5.0, 5.0)], "pdf_width double, pdf_height double, pdf_x double, pdf_y double")
    assert df.select(rects.choose(empty, one, empty, empty).alias("r")).first().r[0].x1 == 3 and df.select(rects.choose(empty, empty, empty,
        empty).alias("r")).first().r is None
    sized = df.withColumn("pdf_width", F.lit(9.0)).withColumn("pdf_height", F.lit(2.0))
    assert sized.select(rects.choose(empty, one, one, one).alias("r")).first().r[0].x1 == 14


def test_assignment(spark):
    h = spark.createDataFrame([("b", 0, i, float(x), float(y)) for i, x, y in ((0, 0, 30), (1, 0, 10), (2, 0, 20))],
        "book_id string, page int, ord long, x double, y double")
    c = spark.createDataFrame([("b", 0, i, f"t{i}") for i in range(2)], "book_id string, page int, ord long, content string")
    assert sorted((r.highlight_ord, r.clip_ord) for r in assign.positional(h, c).collect()) == [(1, 0), (2, 1)]
    assert plain.take_nearest([0, 0], [0, 10], [0, 0], [9, 1]) == [1, 0] and plain.take_nearest([0], [0], [], []) == [None]
    words = spark.createDataFrame([("b", 0, 0, 0, 0, 0.0, 31.0, 9.0, 40.0, "t0"), ("b", 0, 1, 0, 1, 0.0, 11.0, 9.0, 20.0, "t1")],
        "book_id string, page int, ord long, block int, line int, x0 double, y0 double, x1 double, y1 double, word string")
    two = h.where("ord < 2")
    assert sorted((r.highlight_ord, r.clip_ord) for r in assign.assign(two, c, words).collect()) == [(0, 0), (1, 1)]
    assert sorted((r.highlight_ord, r.clip_ord) for r in assign.assign(h, c, words).collect()) == [(1, 0), (2, 1)]


PAGE = "The fixation of be-\nlief is a ﬁne paper about how people settle their opinions, and it says that doubt is an uneasy state from which we struggle to free ourselves."


@pytest.mark.parametrize(
    ("content", "strategy"),
    [
        ("settle their opinions", "exact"), ("The fixation of belief is a", "normalised"), ("ﬁne paper", "exact"),
            ("settle their opinions, and it says thatt doubt is an uneasy state from which we", "anchored"),
        ("settle their opinions, and it then goes astray in quite another way", "prefix"), ("nothing of the kind", None),
    ],
)
def test_strategies(spark, content, strategy):
    pages = spark.createDataFrame([("b", 0, PAGE)], "book_id string, page int, text string")
    clips = spark.createDataFrame([("b", 0, 1, content)], "book_id string, page int, ord long, content string")
    got = matching.match(clips, pages, "book_id", "page", "ord")
    assert [r.strategy for r in got.collect()] == [strategy]
    missing = matching.unmatched(clips, pages, got, "book_id", "page", "ord").collect()
    assert len(missing) == (strategy is None)


def test_phrases_in_texts(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "b", "ab", "ba", "c"])
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(99, None)]
    phrases = [(i, " ".join(word() for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(98, None)]
    p, t = spark.createDataFrame(phrases, "pid int, phrase string"), spark.createDataFrame(texts, "tid int, body string")
    got = sorted((r.pid, r.tid) for r in matching.join_containing(p, t, "phrase", "body", "pid", "tid").collect())
    assert got == sorted((i, j) for i, s in phrases for j, b in texts if s is not None and b is not None and s in b)


def test_titles(spark):
    clips = spark.createDataFrame([("My-Book_One",), ("Else",)], "title string")
    books = spark.createDataFrame([("x", "my book", 1), ("y", "My Book One (2nd)", 0)], "book_id string, title string, ord long")
    assert [(r.title, r.book_id) for r in matching.first_title(clips, books).collect()] == [("My-Book_One", "y")]


def test_lines_of_characters(spark):
    box = lambda x, y: dict(x0=float(x), y0=float(y), x1=float(x + 5), y1=float(y + 10))
    chars = [dict(ch="a", box=box(0, 0)), dict(ch="b", box=box(5, 3)), dict(ch="c", box=box(0, 6)), dict(ch="\n", box=None),
        dict(ch="d", box=box(9, 7)), dict(ch="e", box=None)]
    df = spark.createDataFrame([(chars,), ([],)], "chars array<struct<ch:string,box:struct<x0:double,y0:double,x1:double,y1:double>>>")
    got = [[(r.x0, r.y0, r.x1, r.y1) for r in x.r] for x in df.select(page_source.boxes_to_lines(F.col("chars")).alias("r")).collect()]
    assert got == [[(0, 0, 10, 13), (0, 6, 5, 16), (9, 7, 14, 17)], []]


def test_tokens(spark):
    pages = spark.createDataFrame([("b", 0, "One two three four five, six seven eight nine ten eleven")], "book_id string, page int, text string")
    find = lambda t: [(r.start, r.size) for r in tokens.token_windows(spark.createDataFrame([("b", 0, t)],
        "book_id string, page int, content string"), pages).collect()]
    assert find("three four five") == [(2, 3)] and find("two three XXX five , six") == [(1, 6)] and find("aa bb cc") == []
    spans = tokens.content_spans(spark.createDataFrame([("b", 0, "FOUR fi-ve six!"), ("b", 0, "...")], "book_id string, page int, content string"),
        pages).collect()
    assert [(r.at, r.length) for r in spans] == [(15, 13)]
    words = spark.createDataFrame([("b", 0, i, w) for i, w in enumerate(["an", "in-ter-", "Est-", "ing", "Tale-"])],
        "book_id string, page int, ord long, word string")
    assert tokens.hyphen_merged(words).first().text == "an in-teresting tale"
    found = tokens.word_sequences(spark.createDataFrame([("b", 0, "inter- esting tale")], "book_id string, page int, content string"),
        spark.createDataFrame([("b", 0, i, w) for i, w in enumerate(["an", "interest", "esting", "tale."])], "book_id string, page int, ord long, word string"))
    assert [(r.start, r.last) for r in found.collect()] == [(1, 3)]


def test_adapter_and_commands(spark):
    base = "book_id string, page int, ord long, type string, pdf_x double, pdf_y double, pdf_width double, pdf_height double, unit_width int, unit_height int, page_width double, page_height double, start_position string, end_position string, content string, highlight_content string, timestamp string"
    pos = lambda y: f"0 0 0 1 100 {y} 50 20"
    rows = [
        ("b", 0, 1, "highlight", 72.0, 72.0, 36.0, 14.4, 50, 20, 612.0, 792.0, pos(100), pos(130), "", None, ""),
            ("b", 0, 2, "highlight", 72.0, 72.0, 0.0, 0.0, 0, 0, 612.0, 792.0, pos(100), pos(105), "", None, ""),
        ("b", 0, 3, "note", 10.0, 20.0, 0.0, 0.0, 0, 0, 612.0, 792.0, pos(1), pos(1), " ", None, ""),
            ("b", 0, 4, "note", 10.0, 20.0, 9.0, 9.0, 0, 0, 612.0, 792.0, pos(1), pos(1), "n", "marked", ""),
        ("b", 0, 5, "bookmark", 10.0, 20.0, 0.0, 0.0, 0, 0, 612.0, 792.0, pos(1), pos(1), "", None, "2024-01-02T03:04:05"),
            ("b", 9, 6, "note", 1.0, 1.0, 0.0, 0.0, 0, 0, 612.0, 792.0, pos(1), pos(1), "off the book", None, ""),
    ]
    a = adapter.adapt(spark.createDataFrame(rows, base))
    got = {r.ord: ([round(v, 2) for v in r.coordinates], r.is_multi_line, r.segment_rects and len(r.segment_rects)) for r in a.collect()}
    assert got == {1: ([72, 72, 108, 108], True, 2), 2: ([72, 72, 77, 84], False, None), 4: ([10, 20, 30, 40], False, None),
        5: ([10, 20, 28, 38], False, None), 6: ([1, 1, 21, 21], False, None)}
    pages = spark.createDataFrame([("b", 0)], "book_id string, page int")
    drawn = adapter.drawable(a, pages).withColumn("rects", F.when(F.col("ord") != 2, F.array(G.rect(*[F.lit(0.0)] * 4))))
    commands = {r.ord: (r.command, r.title, r.content, r.outline_page) for r in adapter.commands(drawn).collect()}
    assert commands == {1: ("highlight", "Kindle Highlight", "", None), 4: ("highlight", "Kindle Note", "n", None),
        5: ("bookmark", "Kindle Bookmark (2024-01-02 03:04)", "", 1)}


def test_measures(spark):
    pts = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 5.0), ("b", 1.0, 1.0)], "k string, x double, y double")
    assert [(r.k, r.slope, r.intercept) for r in reports.linear_fit(pts, "x", "y", "k").collect()] == [("a", 2.0, 1.0)]
    text = "book_id string, page int, ord long, content string"
    e, a = spark.createDataFrame([("b", 0, 1, "some words here"), ("b", 0, 2, "zzz")],
        text), spark.createDataFrame([("b", 0, 5, "some word here"), ("b", 0, 6, "some words here")], text)
    m = reports.similar_texts(e.withColumnRenamed("ord", "e"), a, "e")
    assert [(r.e, r.actual_ord, r.ratio) for r in m.collect()] == [(1, 6, 1.0)]
    c = reports.coverage(e, m).first()
    assert (c.expected, c.matched, c.coverage) == (2, 1, 0.5) and reports.coverage(e.limit(0), m.limit(0)).first().coverage == 1.0
    w = spark.createDataFrame([(0.0, 10.0), (0.0, 11.0)], "x0 double, x1 double")
    assert reports.width_spread(w).first().even and reports.sample_pages(e).count() == 1


def test_rects_of_matches(spark):
    """Characters are ten points wide, lines 20 apart."""
    expected = {
        "of belief is": [(80, 0, 140, 10), (0, 20, 70, 30)], "fnd it": [(80, 20, 140, 30)], "find it": [(80, 20, 140, 30)],
            "quite soon": [(150, 20, 200, 30), (0, 40, 40, 50)],
        "The fix of belief iss fnd it quite soon": [(0, 0, 140, 10), (0, 20, 200, 30), (0, 40, 40, 50)], "elie": [(120, 0, 140, 10), (0, 20, 30, 30)],
    }
    rows = []
    for line, text in enumerate(["The fix of be-", "lief is ﬁnd it quite", "soon."]):
        x = 0
        for word in text.split(" "):
            rows.append(("b", 0, len(rows), 0, line, float(x), line * 20.0, x + 10.0 * len(word), line * 20.0 + 10, word))
            x += 10 * (len(word) + 1)
    words = spark.createDataFrame(rows, WORD)
    texts = [*expected, "nowhere"]
    clips = spark.createDataFrame([("b", 0, i, t) for i, t in enumerate(texts)], "book_id string, page int, ord long, content string")
    got = pipeline.clipping_rects(clips, page_source.page_text(words), words, "ord").collect()
    assert {texts[r.ord]: [(q.x0, q.y0, q.x1, q.y1) for q in r.rects] for r in got} == expected


def test_folds_are_those_of_the_rule(spark):
    rng = random.Random(8)
    rect = lambda: (x := rng.choice([0, 3, 50, 90, 200, 400]), y := rng.choice([0, 2, 12, 20, 40, 300]), x + rng.choice([10, 40, 90]), y + rng.choice([10, 12]))
    rows = [([tuple(map(float, rect())) for _ in range(rng.randint(0, 12))], float(rng.choice([0, 60, 210])), float(rng.choice([0, 15, 250])),
        [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))], [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))])
        for _ in range(400)]
    point = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame(rows, f"rects {RECTS}, x double, y double, h {point}, c {point}")
    got = df.select("*", quads.near_rects(F.col("rects"), F.col("x"), F.col("y")).alias("near"), quads.connectivity(F.col("rects")).alias("of"),
        assign.greedy_nearest(F.col("h"), F.col("c")).alias("taken")).collect()
    for r in got:
        boxes = [tuple(q) for q in r.rects]
        if boxes:
            assert [tuple(q) for q in r.near] == [boxes[i] for i in plain.near_place(boxes, r.x, r.y)]
        of = [0] * len(boxes)
        for k, g in enumerate(plain.first_fit(boxes, plain.connected, grows=False)):
            for i in g:
                of[i] = k
        assert r.of == of
        assert r.taken == plain.take_nearest([p.x for p in r.h], [p.y for p in r.h], [p.x for p in r.c], [p.y for p in r.c])
    assert "Python" not in df.select(quads.near_rects(F.col("rects"), F.col("x"), F.col("y")))._jdf.queryExecution().executedPlan().toString()
