from __future__ import annotations

import pytest

from marginalia import cli

from .test_sources import LOG, annotation, number, store, thing, utf


def test_command_line(spark, tmp_path):
    words, n = [], 0
    for line, text in enumerate(("The book begins", "with some text of", "its own and ends")):
        for k, w in enumerate(text.split()):
            words.append(("Second Book.pdf", 0, n, 0, line, 50.0 + 60 * k, 100.0 + 16 * line, 100.0 + 60 * k, 112.0 + 16 * line, w))
            n += 1
    spark.createDataFrame(words, "book_id string, page int, ord long, block int, line int, x0 double, y0 double, x1 double, y1 double, "
        "word string").write.parquet(str(tmp_path / "words"))
    page = [("Second Book.pdf", 0, "The book begins\nwith some text of\nits own and ends", 612.0, 792.0, None)]
    spark.createDataFrame(page, "book_id string, page int, text string, width double, height double, "
        "cropbox struct<x0:double,y0:double,x1:double,y1:double>").write.parquet(str(tmp_path / "pages"))
    tree = lambda *a: thing("saved.avl.interval.tree", number(len(a)), *a)
    kinds = (1, annotation("highlight", "0 0 5 1 150 160 90 16", 1000)), (2, annotation("note", "0 0 5 1 400 600 10 10", 2000, utf("a note"))), (0,
        annotation("bookmark", "0 0 5 1", 3000))
    (tmp_path / "reader/Second Book.sdr").mkdir(parents=True)
    (tmp_path / "reader/Second Book.sdr/x.pds").write_bytes(store(thing("annotation.cache.object", number(3),
        *[x for k, a in kinds for x in (number(k), tree(a))])))
    (tmp_path / "reader/Else.pds").write_bytes(b"not a store")
    (tmp_path / "log.txt").write_text(LOG.replace("on Page 12", "on Page 1").replace("\n\ntext\n", "\n\nsome text of\n"))
    args = ["--sidecars", f"{tmp_path}/reader", "--pages", f"{tmp_path}/pages", "--words", f"{tmp_path}/words", "--output", f"{tmp_path}/out"]
    a = cli.arguments([*args, "--clippings", f"{tmp_path}/log.txt", "--export-json", f"{tmp_path}/json", "--learn-output", f"{tmp_path}/learn", "--verbose"])
    assert cli.run(spark, a) == 3
    rows = {r.type: r for r in spark.read.json(f"{tmp_path}/json").collect()}
    mark = rows["highlight"]
    assert mark.content == "some text of" and mark.source == "text_based_matching" and [(q.x0, q.y0, q.x1) for q in mark.precise_rects] == [(110, 116, 280)]
    commands = {r.command: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [(q.x0, q.x1) for q in commands["highlight"].rects] == [(110,
        280)] and commands["note"].content == "a note" and commands["bookmark"].title == "Kindle Bookmark (1970-01-01 00:00)"
    (tmp_path / "plain").mkdir()
    b = cli.arguments([*args[:-1], f"{tmp_path}/plain/out"])
    assert cli.run(spark, b) == 3


def test_inputs_that_are_not_there(spark, tmp_path):
    a = cli.arguments(["--sidecars", str(tmp_path), "--pages", f"{tmp_path}/no-pages", "--words", f"{tmp_path}/no-words", "--output", f"{tmp_path}/out"])
    with pytest.raises(SystemExit, match="no-pages.*no-words"):
        cli.run(spark, a)
    assert not (tmp_path / "out").exists()
