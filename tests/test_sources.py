from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from marginalia.functions import geometry as G
from marginalia.plans import batches
from marginalia.sources import clippings, files, pages, sidecar
from marginalia.streaming import clippings as stream

LOG = """First Book (An Author)
- Your Highlight on Location 20-21 | Added on Monday, March 4, 2024 1:02:03 PM

later words
==========
First Book (An Author)
- Your Note on Location 5 | Added on Monday, March 4, 2024 1:02:04 PM

a note
over two lines
==========
Second Book (Other)
- Your Highlight on Page 12 | Added on nonsense

text
==========
Second Book (Other)
- Your Bookmark on Page 3 | Added on 2024-05-06 07:08:09
==========
Third
- your highlight on page 7-9 | Added on x

lower case
==========
lonely line
==========
"""


def test_generic_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LOG, encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("Caf\xe9\n- Your Note on Page 1\n\nx\n==========\n".encode("latin-1"))
    got = clippings.parse(clippings.read_log(spark, str(tmp_path)))
    rows = [r for r in got.orderBy("ord").collect() if r.source_file.endswith("a.txt")]
    assert [(r.title, r.type, r.location, r.page) for r in rows] == [
        ("First Book", "highlight", "20-21", ""), ("First Book", "note", "5", ""), ("Second Book", "highlight", "", "12"),
            ("Second Book", "bookmark", "", "3"), ("Third", "unknown", "", ""),
    ]
    assert rows[0].date_added == "2024-03-04T13:02:03" and rows[2].date_added == "nonsense" and rows[1].content == "a note\nover two lines" and rows[3].content == ""
    assert [r.title for r in got.collect() if r.source_file.endswith("b.txt")] == ["Café"]
    one = got.where("source_file LIKE '%a.txt'")
    books = {r.title: (r.author, r.n_clippings, [c.ord for c in r.clippings]) for r in clippings.by_book(one).collect()}
    assert books == {"First Book": ("An Author", 2, [1, 0]), "Second Book": ("Other", 2, [3, 2]), "Third": ("", 1, [4])}
    total = clippings.totals(one).first()
    assert (total.total_clippings, total.total_books) == (5, 3)
    assert {r.ord: r.place for r in clippings.in_book_order(one).collect()} == {0: 2, 1: 1, 2: 2, 3: 1, 4: 1}


def test_byte_order_mark_makes_another_title(spark):
    df = spark.createDataFrame([("﻿" + LOG[: LOG.index("First Book", 5)] + LOG[LOG.index("First Book", 5) :],)], "text string")
    assert clippings.totals(clippings.parse(df)).first().total_books == 4 and clippings.totals(clippings.parse(df, strip_bom=True)).first().total_books == 3


def test_log_of_one_book(spark):
    logs = spark.createDataFrame([(LOG,)], "text string")
    books = spark.createDataFrame([("a", "second book.pdf"), ("b", "THIRD.pdf.pdf"), ("c", "First Book")], "book_id string, name string")
    rows = {(r.book_id, r.ord): (r.type, r.pdf_page, r.content, r.timestamp) for r in clippings.parse_for_books(logs, books).collect()}
    assert rows == {("a", 2): ("highlight", 12, "text", "nonsense"), ("a", 3): ("highlight", 3, "", "2024-05-06 07:08:09"),
        ("b", 4): ("highlight", 7, "lower case", "x")}


def utf(s: str) -> bytes:
    return struct.pack(">bb", 3, 0) + struct.pack(">H", len(s.encode())) + s.encode()


def number(n: int) -> bytes:
    return struct.pack(">bi", 1, n)


def thing(name: str, *values: bytes) -> bytes:
    return struct.pack(">b", -2) + utf(name)[1:] + b"".join(values) + struct.pack(">b", -1)


def annotation(kind: str, start: str, ms: int, *more: bytes) -> bytes:
    t = struct.pack(">bq", 2, ms)
    return thing(f"annotation.personal.{kind}", utf(start), utf(start), t, t, utf("0"), *more)


def store(*values: bytes) -> bytes:
    return sidecar.SIGNATURE + number(1) + number(len(values)) + b"".join(values)


def test_sidecar_store(spark):
    tree = lambda *a: thing("saved.avl.interval.tree", number(len(a)), *a)
    cache = thing(
        "annotation.cache.object", number(4), number(1), tree(annotation("highlight", "1 0 5 1 10 20 30 14", 1000)), number(99),
            tree(annotation("highlight", "lost", 1)), number(2),
                tree(annotation("note", "2 0 5 1", 2000, utf("my note")), annotation("note", "3 0 5 1", -1, utf("n2"))), number(0), tree(),
    )
    good = store(thing("lpr", utf("1 2 3 4")), thing("font.prefs", utf("x")), thing("dictionary", utf("d")), thing("timer.model", number(3)), cache)
    files_ = spark.createDataFrame([("g", bytearray(good)), ("bad", bytearray(b"12345678")), ("cut", bytearray(good[:60])),
        ("empty", bytearray(b"")), ("none", None)], "path string, content binary")
    rows = sidecar.decode_annotations(files_).collect()
    found = [(r.ord, r.annotation_type, r.start_position, r.note_text) for r in rows if r.book_id == "g"]
    assert found == [(0, "annotation.personal.highlight", "1 0 5 1 10 20 30 14", None), (1, "annotation.personal.note", "2 0 5 1", "my note"),
        (2, "annotation.personal.note", "3 0 5 1", "n2")]
    assert [r.creation_time is None for r in rows if r.book_id == "g"] == [False, False, True]
    assert {r.book_id for r in rows if r.error} == {"bad", "cut", "empty", "none"}
    assert spark.createDataFrame([("annotation.personal.note",), ("other",)],
        "t string").select(sidecar.categories(F.col("t")).alias("c")).collect()[1].c == "other"


def test_scalar_values():
    c = sidecar.Cursor(struct.pack(">bb", 0, 1) + struct.pack(">bd", 4, 1.5) + struct.pack(">bh", 5, -2) + struct.pack(">bf", 6,
        0.5) + struct.pack(">bb", 7, -3) + b"\x09A" + struct.pack(">bb", 3, 1))
    assert [c.value() for _ in range(7)] == [True, 1.5, -2, 0.5, -3, "A", ""]
    for bad in (b"\x00\x07", b"\x63", b"\x01\x00"):
        try:
            sidecar.Cursor(bad).value()
        except sidecar.Malformed:
            continue
        raise AssertionError(bad)


def test_sections(spark):
    part = lambda kind, text: struct.pack(">II", kind, len(text)) + text
    data = b"\0" * 16 + part(1, b" one ") + part(9, b"skip") + part(2, b"meta") + part(1, b"  ") + struct.pack(">II", 1, 99) + b"cut"
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"short"))], "path string, content binary")
    got = sorted((r.path, r.section_type, r.text, bool(r.error)) for r in sidecar.decode_sections(df).na.fill(0).collect())
    assert got == [("a", 1, "one", False), ("a", 2, "meta", False), ("b", 0, None, True)]


def test_json_form(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"annotation.cache.object": {"annotation.personal.note": [{"text": "t", "startPosition": "1 2 3 4",
        "creationTime": "c"}]}}))
    r = sidecar.read_annotations_json(spark, str(tmp_path / "a.json")).first()
    assert (r.annotation_type, r.start_position, r.end_position, r.note_text) == ("annotation.personal.note", "1 2 3 4", "1 2 3 4", "t")


def test_file_choices(spark, tmp_path):
    for p in ("My Book.pdf", "Other.pdf", "._My Book.pdf", "My Book.sdr/a.pds", "My Book.sdr/b.pdt", "my_book.sdr/c.pds", "Loose.pds",
        "documents/My Clippings.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    every = files.listing(spark, str(tmp_path), recursive=True)
    names = lambda df: sorted(r.path.split("/")[-1] for r in df.collect())
    assert names(files.list_documents(every)) == ["My Book.pdf", "Other.pdf"]  # Spark's listings leave hidden files out
    assert names(files.select_sidecar(every, "Loose")) == ["Loose.pds"] and files.select_sidecar(every, "zzz").count() == 1
    assert {"a.pds", "b.pdt"} <= set(names(files.find_sidecars(every, "Book")))
    assert every.where("size = 1").count() == every.count()


def test_pages_and_search(spark):
    text = ["The quick", "brown fox the", "quick brown"]
    rows, n = [], 0
    for line, t in enumerate(text):
        for k, w in enumerate(t.split()):
            rows.append(("b", 0, n, 0, line, 40.0 * k, 16.0 * line, 40.0 * k + 30, 16.0 * line + 12, w))
            n += 1
    words = spark.createDataFrame(rows, "book_id string, page int, ord long, block int, line int, x0 double, y0 double, x1 double, y1 double, word string")
    assert pages.page_text(words).first().text == "\n".join(text)
    phrases = spark.createDataFrame([("b", 0, 1, "the QUICK  brown"), ("b", 0, 2, "fox"), ("b", 0, 3, "absent"), ("b", 1, 4, "fox"),
        ("b", 0, 5, "")], "book_id string, page int, key int, phrase string")
    got = {(r.key, r.hit): [(q.x0, q.y0, q.x1) for q in r.rects] for r in pages.search(phrases, words, "key").collect()}
    assert got == {(1, 0): [(0, 0, 70), (0, 16, 30)], (1, 4): [(80, 16, 110), (0, 32, 70)], (2, 3): [(40, 16, 70)]}
    m = pages.text_margins(words, F.lit(400.0)).first()
    assert (m.left, m.right, m.top, m.bottom) == (0, 380, 0, 44)
    under = words.limit(1).select("book_id", "page", F.lit(9).alias("key"), G.rect(F.lit(35.0), F.lit(10.0), F.lit(200.0), F.lit(20.0)).alias("rect"))
    assert pages.text_in_rect(words, under, "key").first().text == "quick fox the"


def test_stream_of_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.txt").write_text(LOG)
    out: list = []
    rows = stream.first_copies(stream.stream_clippings(spark, str(logs)))
    for name in ("first", "second"):
        q = stream.write_stream(rows, lambda df, _: out.extend(df.select("title", "content").collect()), str(tmp_path / "checkpoint"))
        q.awaitTermination()
        assert len(out) == 5, name
        (logs / "b.txt").write_text(LOG)  # the same clippings once more


@pytest.mark.parametrize("size", ["1g", "700", "64"])
def test_logs_in_splits_are_numbered_as_whole_ones(spark, tmp_path, size):
    record = lambda i, end="\n": end.join([f"Book {i % 7} é (Someone)", f"- Your Highlight on Page {i} | Added on Monday, March 4, 2024 1:02:03 PM", "", f"text {i}", "==========", ""])
    texts = {"plain.txt": "".join(map(record, range(90))), "marked.txt": "\ufeff" + "".join(map(record, range(40))), "open.txt": "\ufeff" + record(1) + record(2)[:-12],
        "dos.txt": "".join(record(i, "\r\n") for i in range(50)), "holes.txt": record(1) + "==========\n" * 3 + record(2) + "\n\n", "empty.txt": "", "short.txt": "one line"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "latin.txt").write_bytes("".join(map(record, range(30))).encode("latin-1"))
    (tmp_path / "odd.txt").write_bytes(b"\xef\xbb\xbf" + "".join(map(record, range(5))).encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = clippings.read_records(spark, str(tmp_path))
        rows = sorted((r.source_file.split("/")[-1], r.ord, r.lines) for r in got.collect())
        parts = got.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = clippings.records(clippings.read_log(spark, str(tmp_path)))
    assert rows == sorted((r.source_file.split("/")[-1], r.ord, r.lines) for r in whole.collect()) and len(rows) > 200
    assert size == "1g" or parts > 20
    fields = ("title", "author", "type", "page", "content", "ord")
    parsed = lambda df: sorted(tuple(r[c] for c in fields) for r in clippings.parse(df).collect())
    assert parsed(got) == parsed(clippings.read_log(spark, str(tmp_path)))


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    at = str(tmp_path / "out")
    listed = lambda **sizes: batches.states(spark.createDataFrame([(b, f"/{b}/{i}", s, 0) for b, s in sizes.items() for i in range(2)],
        "book_id string, path string, size long, modified long"))
    asked: list = []

    def compute(books, fails=()):
        names = sorted(r.book_id for r in books.collect())
        asked.extend(names)
        if set(names) & set(fails):
            raise RuntimeError("broken")
        return books.where("book_id <> 'empty'").selectExpr("book_id", "state AS made_of")

    rows = lambda: sorted(r.book_id for r in batches.read(spark, at).collect())
    partitions = lambda: {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "out" / "rows").glob("book_id=*")}
    first = listed(**{k: 1 for k in ("a", "b", "c", "d", "empty")})
    with pytest.raises(RuntimeError):
        batches.run(first, lambda books: compute(books, ("d",)), at, 16)
    finished = {r.book_id for r in batches.done(spark, at).collect()}
    assert "d" not in finished
    asked.clear()
    assert batches.run(first, compute, at, 16) == 5 - len(finished) and set(asked) == {"a", "b", "c", "d", "empty"} - finished
    assert rows() == ["a", "b", "c", "d"] and batches.done(spark, at).where("added = 0").count() == 1
    before = partitions()
    asked.clear()
    assert batches.run(first, compute, at) == 0 and asked == []
    assert batches.run(listed(a=1, b=2, c=1, d=1, empty=1), compute, at) == 1 and asked == ["b"]
    after = partitions()
    assert {k for k in after if after[k] != before[k]} == {"book_id=b"} and rows() == ["a", "b", "c", "d"]
    with pytest.raises(RuntimeError):
        batches.run(listed(a=2), lambda books: compute(books, ("a",)), at)
    assert rows() == ["a", "b", "c", "d"]
