"""That work grows with the input: what is computed once a row, and what meets in a join."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import session
from marginalia.functions import geometry as G
from marginalia.functions import maps
from marginalia.functions.containment import contained
from marginalia.functions.similarity import could_be_alike
from marginalia.operators import adapter, annotations, matching, rects, tokens
from marginalia.plans import catalog
from marginalia.sources import pages


def test_positions_are_parsed_once_a_row(spark):
    rows = spark.sql("SELECT 'b' AS book_id, 0 AS page, concat('0 0 1 1 5 5 9 ', id) AS start_position, concat('0 0 1 1 800 40 9 ', id) AS end_position, 10D AS pdf_x, 20D AS pdf_y, "
        "0D AS pdf_width, 0D AS pdf_height, CAST(NULL AS array<double>) AS coordinates FROM range(3)")
    margins = spark.sql("SELECT 'b' AS book_id, 0 AS page, 30D AS left, 380D AS right, 0D AS top, 700D AS bottom FROM range(1)")
    made = rects.from_margins(rows, margins).select(F.explode("margin_rects").alias("r"))
    splits = made._jdf.queryExecution().optimizedPlan().toJSON().count("expressions.StringSplit\"")
    assert splits == 2
    assert sorted(map(tuple, made.select("r.*").distinct().collect())) == [(10.0, 20.0, 380.0, 36.0), (30.0, 36.0, 576.0, 52.0)]


def test_titles_that_begin_alike_do_not_all_meet(spark, monkeypatch):
    compared = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counting(whole, part):
        compared.add(1)
        return part in whole

    monkeypatch.setattr(F, "contains", counting)
    wholes = spark.range(300).select(F.concat(F.lit("supplier"), F.col("id").cast("string"), F.lit("extra")).alias("x"))
    parts = spark.range(300).select(F.concat(F.lit("supplier"), F.col("id").cast("string")).alias("y"))
    got = contained(wholes, parts, "x", "y").collect()
    assert sorted(map(tuple, got)) == sorted((f"supplier{i}extra", f"supplier{str(i)[:k]}") for i in range(300) for k in range(1, len(str(i)) + 1))
    assert 0 < compared.value < 10 * 300


def test_many_titles_are_matched_without_the_driver(spark, monkeypatch):
    from marginalia.functions import containment

    monkeypatch.setattr(containment, "SHARED_ROWS", 2)
    books = spark.range(6).select(F.concat(F.lit("b"), F.col("id")).alias("book_id"), F.concat(F.lit("My Book_"), F.col("id")).alias("title"), F.col("id").alias("ord"))
    clips = spark.range(6).select("id", F.concat(F.lit("my-book "), F.col("id"), F.lit(" extra")).alias("title"))
    made = matching.first_title(clips, books)
    assert sorted((r.id, r.book_id) for r in made.collect()) == [(i, f"b{i}") for i in range(6)]
    assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_take_less_disk_than_a_checkpoint_and_go(spark):
    import subprocess

    folder = lambda: spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    size = lambda: int(subprocess.run(["du", "-sk", folder()], capture_output=True, text=True).stdout.split()[0])
    rows = spark.range(20000).select("id", *[F.concat(F.lit(f"{i} 0 1 1 5 5 9 "), F.col("id") % 50).alias(f"c{i}") for i in range(12)])
    session.prepare(spark)
    at = size()
    kept = session.cut(rows)
    checkpoint = size() - at
    got, path = session.stored(rows)
    assert size() - at - checkpoint < checkpoint / 3
    assert got.dtypes == rows.dtypes and got.exceptAll(kept).isEmpty() and got.count() == 20000
    session.discard(spark, path)
    assert size() - at <= checkpoint + 8


def shuffle_files(spark) -> int:
    from pathlib import Path

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(1 for folder in manager.localDirsString() for _ in Path(folder).rglob("shuffle_*.data"))


def test_what_is_cut_leaves_no_shuffle_files(spark):
    import time

    rows = lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    session.prepare(spark)
    before = shuffle_files(spark)
    kept, (got, path) = session.cut(rows()), session.stored(rows())
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, got.collect())) == sorted(map(tuple, rows().collect()))
    session.discard(spark, path)


def test_rows_to_unify_are_shuffled_once(spark):
    from marginalia.operators import dedup

    got, folder = session.stored(resolved_rows(spark))
    plan = dedup.unify(got)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan
    session.discard(spark, folder)


def test_words_of_a_page_are_sorted_in_its_array_alone(spark):
    """A window over words sorts them once more, and holds all of a task's rows each time."""
    w = spark.sql("SELECT concat('b', id % 2) AS book_id, 0 AS page, CAST(9 - id AS int) AS ord, 0 AS block, CAST(id % 2 + (id DIV 4) AS int) AS line, concat('w', id) AS word, "
        "CAST(id AS double) AS x0, 1D AS y0, 5D AS x1, 6D AS y1 FROM range(8)")
    made = pages.page_words(w)
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["book_id"]: [(x["start"], x["ord"], x["piece"]) for x in r["words"]] for r in made.collect()}
    assert got == {"b0": [(0, 3, "\nw6"), (3, 5, " w4"), (6, 7, "\nw2"), (9, 9, " w0")], "b1": [(0, 2, "\nw7"), (3, 4, " w5"), (6, 6, "\nw3"), (9, 8, " w1")]}


def test_store_files_are_written_by_all_tasks_and_listed_as_a_folder(spark):
    got = catalog.QUERIES["store_files"](spark, "/root/testdata/sf0.01")
    files = got.inputFiles()
    assert len(files) == spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    assert len({f.rsplit("/part-", 1)[1][:5] for f in files}) > 1


def longest_method(df) -> int:
    """Bytes of the longest method that is generated for ``df``; the JVM compiles none of more than 8000 and interprets it row by row."""
    df.collect()  # the adaptive plan is known then
    made = df._jdf.queryExecution().debug().codegenToSeq()
    return max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.length()))


def cuts(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toJSON().count("expressions.StringSplit\"")


def resolved_rows(spark):
    rows = spark.sql("SELECT 'b' AS book_id, id AS ord, 'annotation.personal.highlight' AS annotation_type, concat(id % 5, ' 0 1 1 100 50 9 14') AS start_position, "
        "concat(id % 5, ' 0 1 1 300 ', 40 + 10 * id, if(id = 6, ' 9', ' 9 14')) AS end_position, CAST(NULL AS timestamp) AS creation_time, CAST(NULL AS string) AS note_text FROM range(7)")
    box = "named_struct('x0', {0}D, 'y0', 0D, 'x1', 200D, 'y1', 700D)"
    pages = spark.sql(f"SELECT 'b' AS book_id, page, 612D AS width, 792D AS height, cropbox FROM VALUES (0, {box.format(10)}), (1, {box.format(20)}), (1, {box.format(30)}), (3, {box.format(40)}) AS p(page, cropbox)")
    return annotations.resolve(annotations.with_positions(rows), pages)


def test_resolved_positions_are_cut_once_in_compiled_code(spark):
    made = resolved_rows(spark)
    assert cuts(made) == 2 and longest_method(made) < 8000
    got = {r.ord: r for r in made.collect()}
    assert [round(got[i].pdf_x) for i in range(7)] == [62, 42, 72, 32, 72, 62, 42]  # page 1 is there twice, pages 2 and 4 are not
    assert got[6].pdf_y_end == 72.0


def test_parts_of_odd_texts(spark):
    import re

    texts = ["1 0 2 3", " 1  2\t3 ", "", "  ", "1", "\x1c1 2\x1f", "1\x1c 2", "1 2 3", "aé b", "1 2 ", " \x1d 1 2", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", G.parts("t").alias("p"))
    want = [None if t is None else re.split(r"[^\S\x1c-\x1f]+", re.sub(r"\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\Z", "", t)) for t in texts]
    assert [r.p for r in rows.orderBy("i").collect()] == want


def test_adapted_positions_are_cut_once_in_compiled_code(spark):
    made = adapter.adapt(resolved_rows(spark))
    assert cuts(made) == 4 and longest_method(made) < 8000
    got = {r.ord: r for r in made.collect()}
    assert [got[i].is_multi_line for i in range(7)] == [False, False, False, True, True, True, False]
    assert [round(x, 2) for x in got[3].coordinates] == [32.0, 36.0, 222.48, 60.48]


def test_draw_commands_remove_what_their_rows_were_read_from(spark):
    from pathlib import Path

    from marginalia.plans import pipeline

    session.prepare(spark)
    rows = resolved_rows(spark).withColumn("precise_rects", F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    got, folder = session.stored(rows)
    sheets = spark.sql("SELECT 'b' AS book_id, CAST(id AS int) AS page, 612D AS width, 792D AS height FROM range(5)")
    words = spark.sql("SELECT 'b' AS book_id, 0 AS page, id AS ord, 0 AS block, 0 AS line, 'w' AS word, 10D AS x0, 36D AS y0, 90D AS x1, 48D AS y1 FROM range(2)")
    made = pipeline.draw_commands(got, sheets, words, [folder])
    assert not Path(folder.removeprefix("file:")).exists()
    assert {(r.ord, r.command) for r in made.collect()} == {(i, "highlight") for i in range(7)}


def test_token_windows_are_looked_for_once(spark):
    pages_ = spark.sql("SELECT concat('b', id) AS book_id, 0 AS page, concat('x', id, ' a b c d e f') AS text FROM range(3)")
    targets = spark.sql("SELECT concat('b', id) AS book_id, 0 AS page, if(id = 1, 'q r s t u', 'b c d e zz') AS content FROM range(3)")
    made = tokens.token_windows(targets, pages_)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("zip_with(") == 3  # one for each size
    assert sorted(map(tuple, made.collect())) == [("b0", 0, 5, 2, 0.8), ("b2", 0, 5, 2, 0.8)]


def test_characters_in_a_row_are_listed_once_a_text(spark):
    rows = spark.sql("SELECT concat('abcdefghij', id) AS a, concat('abcdexfghij', id * 11) AS b FROM range(3)")
    made = rows.select(could_be_alike("a", "b", 0.8).alias("c"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2
    assert [r.c for r in made.collect()] == [True, True, True]


def test_positions_between_lines_are_parsed_once_a_row(spark):
    words = spark.sql("SELECT concat('b', id % 2) AS book_id, 0 AS page, id AS ord, 0 AS block, CAST(id DIV 2 AS int) AS line, 10D AS x0, CAST(16 * (id DIV 2) AS double) AS y0, 90D AS x1, "
        "CAST(16 * (id DIV 2) + 12 AS double) AS y1 FROM range(8)")
    place = lambda x, y: F.concat(F.lit(f"0 0 1 1 {x} "), F.lit(y) + F.length("book_id"), F.lit(" 9 9"))
    rows = words.select("book_id", "page").distinct().withColumns({"start_position": place(50, 10), "end_position": place(100, 40)})
    made = rects.from_lines(rows, pages.lines(words))
    assert cuts(made) == 2
    got = {r.book_id: [(x.x0, x.y0, x.x1) for x in r.rects] for r in made.collect()}
    assert got == {b: [(36.0, 0.0, 90.0), (10.0, 16.0, 72.0)] for b in ("b0", "b1")}


def test_index_maps_are_made_once(spark):
    made = catalog.QUERIES["index_map"](spark, "/root/testdata/sf0.001")
    once = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(maps.index_map("text").alias("m"))
    listed = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")
    assert listed(made) == listed(once) > 0


def test_clippings_are_repaired_once_and_matched_in_compiled_code(spark):
    page = "The fixation of be-\nlief is a ﬁne paper about how people settle their opinions, and it says that doubt is an uneasy state from which we struggle."
    contents = ["settle their opinions", "The fixation of belief is a", "fine paper", "settle their opinions, and it says thatt doubt is an uneasy state from which we",
        "settle their opinions, and it then goes astray in quite another way", "nothing of the kind", "  ", None]
    sheets = spark.createDataFrame([(f"b{i}", 0, page if i != 9 else None) for i in range(10)], "book_id string, page int, text string")
    clips = spark.createDataFrame([(f"b{i}", 0, i, c) for i, c in enumerate([*contents, "x", "y"])], "book_id string, page int, ord long, content string")
    made = matching.match(clips, sheets, "book_id", "ord")
    assert made._jdf.queryExecution().optimizedPlan().toString().count(r"\.([A-Z])") == 1
    assert longest_method(made) < 8000
    got = {r.ord: (r.strategy, r.start) for r in made.collect()}
    flat, form = (x.index("settle") + 1 for x in (page.replace("\n", " "), page.replace("-\n", "")))
    assert got == {0: ("exact", flat), 1: ("normalised", 1), 2: ("exact", page.index("ﬁ") + 1), 3: ("anchored", form), 4: ("prefix", form), 5: (None, None),
        8: ("exact", page.index("x") + 1), 9: (None, None)}


def test_page_texts_shuffle_no_boxes(spark):
    w = spark.sql("SELECT concat('b', id % 2) AS book_id, 0 AS page, CAST(9 - id AS int) AS ord, 0 AS block, CAST(id % 2 + (id DIV 4) AS int) AS line, concat('w', id) AS word, "
        "CAST(id AS double) AS x0, 1D AS y0, 5D AS x1, 6D AS y1 FROM range(8)")
    made = pages.page_text(w)
    assert "x0" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.book_id: r.text for r in made.collect()} == {"b0": "w6 w4\nw2 w0", "b1": "w7 w5\nw3 w1"}
