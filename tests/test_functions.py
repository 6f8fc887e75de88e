from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.functions import geometry as G
from marginalia.functions import location as L
from marginalia.functions import maps
from marginalia.functions import similarity as S
from marginalia.functions import text as T

from . import plain


def value(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0)])
    return df.select(column.alias("out")).first().out


@pytest.mark.parametrize(("text", "out"),
    [("ﬁnite", "fnite"), ("ﬂow", "fow"), ("oﬀer", "ofer"), ("traﬃc", "trafc"), ("stand-\nard", "standard"), ("so­ft  a b\n", "soft a b"), ("", "")])
def test_search_form(spark, text, out):
    assert value(spark, T.normalize_for_search("t"), t=text) == out == plain.normal_with_map(text)[0]


def test_page_form_keeps_a_hyphen_before_a_soft_hyphen(spark):
    text = "  well-­\nknown  co-\noperate ﬆone "
    assert value(spark, T.normalize_page("t"), t=text) == "well-known cooperate sone" == plain.normal_with_map(text)[0]
    normal, at = plain.normal_with_map(text)
    assert len(normal) == len(at) and [text[i] for i in at if text[i].isalpha()] == list("wellknowncooperateﬆone")
    assert value(spark, maps.index_map("t"), t=text) == at


@pytest.mark.parametrize(("text", "out"), [("see ch.4 now", "see ch. 4 now"), ("end.Start", "end. Start"), ("a  b\nc", "a b c"), ("v.x", "v.x")])
def test_repaired_spacing(spark, text, out):
    assert value(spark, T.repair_spacing("t"), t=text) == out


def test_names_and_lines(spark):
    assert value(spark, T.title_author("t"), t="A Book (With) (Some One)").asDict() == {"title": "A Book (With)", "author": "Some One"}
    assert value(spark, T.title_author("t"), t="Plain").asDict() == {"title": "Plain", "author": ""}
    m = value(spark, T.meta_line("t"), t="- Your Highlight on Location 12-15 | Added on Monday, March 4, 2024 1:02:03 PM")
    assert (m.type, m.location, m.page, m.added) == ("highlight", "12-15", "", "Monday, March 4, 2024 1:02:03 PM")
    assert value(spark, T.meta_line("t"), t="- Your highlight on page 3").type == "unknown"
    m = value(spark, T.meta_line("t"), t="- Your Note on Page 9 | Location 4 | Added on X")
    assert (m.type, m.page, m.added) == ("note", "9", None)
    assert value(spark, T.clean_filename("t"), t=' a<b>:"/\\|?*. ') == "a_b________"
    assert len(value(spark, T.clean_filename("t"), t="x" * 300)) == 200
    assert value(spark, T.book_from_path("t"), t="/x/My Book-cdeKey_AB.pds") == "My Book" and value(spark, T.book_from_path("t"),
        t="/x/My.Book.pds") == "My.Book"
    assert value(spark, T.spell_ligatures("t"), t="eﬃcient ﬁsh") == "efficient fish"
    assert value(spark, T.tokenize("t"), t="Don't stop, É!") == ["don't", "stop", ",", "é", "!"]
    assert value(spark, T.first_int("t"), t="loc 12-13") == 12 and value(spark, T.first_int("t"), t="none") == 0
    assert value(spark, T.range_start("t"), t="3-5") == 3 and value(spark, T.book_key("t"), t="a.pdf.pdf") == "a"


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("Monday, March 4, 2024 1:02:03 PM", "2024-03-04T13:02:03"), ("Friday, January 5, 2024 at 11:00:00 AM", "2024-01-05T11:00:00"),
            ("1/2/2024 3:04:05 AM", "2024-01-02T03:04:05"),
        ("2024-05-06 07:08:09", "2024-05-06T07:08:09"), ("long ago", "long ago"),
    ],
)
def test_dates(spark, text, out):
    assert value(spark, T.added_date("t"), t=text) == out


def test_times(spark):
    assert value(spark, T.from_epoch_ms("t"), t=1_700_000_000_000) == datetime(2023, 11, 14, 22, 13, 20)
    assert value(spark, T.from_epoch_ms("t"), t=-1) is None
    assert value(spark, T.bookmark_title("t"), t="2024-03-04T13:02:03Z") == "Kindle Bookmark (2024-03-04 13:02)" and value(spark,
        T.bookmark_title("t"), t="x") == "Kindle Bookmark"


def test_word_measures(spark):
    assert value(spark, T.word_similarity("a", "b"), a="x y z", b="x q z w") == 0.5 and value(spark, T.word_similarity("a", "b"), a="", b=" ") == 0.0
    assert value(spark, S.sequence_ratio("a", "b"), a="abcd", b="bcde") == 0.75 and value(spark, S.sequence_ratio("a", F.lit(None).cast("string")),
        a="abcd") is None
    words = "a b c d e f g h i j k"
    assert [value(spark, c, t=words) for c in T.first_words(T.words("t"))] == ["a b c d e f g h i j", "a b c d e f g", "a b c d e"]
    assert [value(spark, c, t="a b c d e") for c in T.last_words(T.words("t"))] == ["b c d e", "c d e", None]


def test_bytes(spark):
    assert value(spark, S.decode_with_fallback("b"), b=bytearray("é".encode())) == "é" and value(spark, S.decode_with_fallback("b"),
        b=bytearray(b"\xe9")) == "é"
    assert [S.guess_encoding(b) for b in (b"abc", "é".encode(), b"\xe9", b"\xef\xbb\xbfx", None)] == ["ascii", "utf-8", "iso-8859-1", "utf-8-sig", "ascii"]


def test_positions(spark):
    p = value(spark, G.position("t"), t="15 0 1020 1 377 517 44 14")
    assert (p.page, p.x, p.y, p.width, p.height, p.valid) == (15, 377, 517, 44, 14, True)
    assert value(spark, G.position_rect(G.position("t")), t="15 0 1020 1 377 517 44 14") == [377, 517, 421, 531]
    for bad in ("invalid", "", "1 2 3", "1 2 x 4"):
        p = value(spark, G.position("t"), t=bad)
        assert not p.valid and p.x == p.page == 0 and p.raw == bad
    short = value(spark, G.position("t"), t="3 0 5 1 9 9")
    assert short.valid and (short.page, short.char_pos, short.x) == (3, 5, 0)
    assert value(spark, G.position(F.lit(None).cast("string"))).valid is False


@pytest.mark.parametrize(
    ("x", "y", "box", "out"),
    [
        (500, 300, (40.1, 10, 612, 792), (319.9, 206.0)), (100, 100, (40.1, 0, 612, 792), (31.9, 72)), (400, 500, (40.1, 0, 612, 792), (247.9, 360)),
            (700, 800, (40.1, 0, 612, 792), (463.9, 576)),
        (0, 0, (40.1, 0, 612, 792), (0, 0)), (10000, 12000, (40.1, 0, 612, 792), (571.9, 792)), (100, 100, None, (72, 72)), (9999, 9999, None, (612, 792)),
    ],
)
def test_points(spark, x, y, box, out):
    crop = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>") if box is None else G.rect(*[F.lit(float(v)) for v in box])
    got = value(spark, G.point(F.lit(float(x)), F.lit(float(y)), F.lit(612.0), F.lit(792.0), crop))
    assert (got.x, got.y) == pytest.approx(out)


def test_lengths_and_rects(spark):
    assert value(spark, G.length_to_points(F.lit(-5.0), F.lit(100.0))) == 0 and value(spark, G.length_to_points(F.lit(100.0), F.lit(100.0), F.lit(60.0))) == 40
    assert value(spark, G.length_to_points(F.lit(100.0), None)) == 72 and value(spark, G.line_count(F.lit(24.0))) == 3 and value(spark,
        G.line_count(F.lit(0.0))) == 1
    a, b = (G.rect(*[F.lit(float(v)) for v in r]) for r in ((0, 0, 10, 10), (5, 5, 20, 8)))
    assert value(spark, G.intersection_area(a, b)) == 15 and value(spark, G.union(a, b)).x1 == 20 and value(spark, G.area(a)) == 100
    assert len(value(spark, G.char_boxes(a, F.lit(4)))) == 4 and value(spark, G.char_boxes(a, F.lit(0))) == []
    assert value(spark, G.position_point("t"), t="1 0 1 1 100 200 1 1").asDict() == pytest.approx({"x": 72, "y": 144}) and value(spark,
        G.position_point("t"), t="x") is None


def test_columns(spark):
    two = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("left", "right", "top", "bottom"), c, strict=True)]) for c in ((50, 250, 60,
        700), (300, 540, 60, 700))])
    at = lambda x, y: value(spark, G.column_of(two, F.lit(float(x)), F.lit(float(y)))).left
    assert (at(100, 100), at(310, 100), at(260, 10), at(290, 10)) == (50, 300, 50, 300)
    assert value(spark, G.column_gap(two)) == 50 and value(spark, G.is_multi_column(two)) and value(spark,
        G.constrain_width(F.lit(500.0), F.lit(200.0), two[0])) == 50
    assert value(spark, G.constrain_width(F.lit(500.0), F.lit(249.0), two[0])) == 10
    clipped = value(spark, G.clip_to_columns(F.array(G.rect(F.lit(10.0), F.lit(70.0), F.lit(240.0), F.lit(80.0)),
        G.rect(F.lit(0.0), F.lit(70.0), F.lit(52.0), F.lit(80.0))), two))
    assert [(r.x0, r.x1) for r in clipped] == [(50, 240)]


def test_locations(spark):
    d = value(spark, L.decode("t"), t="100-103")
    assert (d.type, d.start_location, d.end_location, d.span, d.estimated_words, d.estimated_page) == ("range", 100, 103, 4, 600, 10)
    assert value(spark, L.decode("t"), t="7").estimated_page == 1 and value(spark, L.decode("t"), t="loc 52").type == "extracted"
    assert value(spark, L.decode("t"), t="").error and value(spark, L.decode("t"), t="none").type == "error"
    c = value(spark, L.compare(F.lit("100"), F.lit("125-130")))
    assert (c.difference, c.first_is_earlier, c.pages_apart, c.error) == (25, True, 2, None) and value(spark, L.compare(F.lit("x"), F.lit("1"))).error
    assert value(spark, L.percentage(F.lit(50), F.lit(200))) == 0.25 and value(spark, L.percentage(F.lit(50), F.lit(0))) is None
    assert value(spark, L.location_to_page(F.lit(5000), F.lit(100))).page == 99 and value(spark, L.location_to_page(F.lit(0), F.lit(0))).confidence == 0
    assert value(spark, L.page_to_location(F.lit(50), F.lit(100))).location == 500 and value(spark, L.page_to_location(F.lit(100), F.lit(100))).confidence == 0
