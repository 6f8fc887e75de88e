"""Document pages as tables: text, words and lines with their boxes, label rules; and phrase search over words.

Reading PDF files needs a PDF library, which is used only where one is installed (:func:`read_documents`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import maps
from ..functions import text as T
from ..functions.bands import band_join
from ..functions.geometry import rect
from ..schemas import CHARS, RECT, RECTS, WORD


def word_rows(path: str, doc) -> list[tuple]:
    """Rows of ``WORD`` of an open document: words in reading order, with block and line."""
    return [(path, page.number, i, w[5], w[6], *map(float, w[:4]), w[4]) for page in doc for i, w in enumerate(page.get_text("words"))]


def page_rows(path: str, doc) -> list[tuple]:
    """Rows of ``PAGE``: text, size of the uncropped page, and the crop box where it is smaller than the page."""
    out = []
    for page in doc:
        whole, crop = page.mediabox, page.cropbox
        box = None if tuple(crop) == tuple(whole) else dict(zip(("x0", "y0", "x1", "y1"), map(float, crop), strict=True))
        out.append((path, page.number, page.get_text(), float(whole.width), float(whole.height), box))
    return out


def label_rows(path: str, doc) -> list[tuple]:
    """Rows of ``LABEL_RULE``: a document's page label rules in their order; a missing first number counts from 1."""
    return [(path, i, r["startpage"], r.get("style") or None, r.get("firstpagenum"), r.get("prefix") or "") for i, r in enumerate(doc.get_page_labels())]


def read_documents(spark: SparkSession, path: str, rows: Callable[[str, object], list[tuple]] = word_rows, schema: str = WORD) -> DataFrame:
    """``rows`` of PDF files in the executors (needs PyMuPDF there): :func:`word_rows`,
     :func:`page_rows` with ``PAGE`` or :func:`label_rows` with ``LABEL_RULE``."""
    kind = StructType.fromDDL(schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                with fitz.open(stream=data, filetype="pdf") as doc:
                    yield pd.DataFrame(rows(p, doc), columns=kind.names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(run, kind)


def ordered_words(words: DataFrame, boxes: bool = True) -> DataFrame:
    """(book_id, page, words): each page's words in reading order, struct<ord, piece, box>.

    Lines come in the order of their first words. ``piece`` is the word behind what parts it from the one before: a line break
    where a line begins, else a space. Words are shuffled once, by page; null words are left out. Without ``boxes`` there is
    no box, and none is shuffled; the order of pieces is the same.
    """
    sides = ("x0", "y0", "x1", "y1") if boxes else ()
    fields = ("block", "line", F.col("ord").cast("long").alias("ord"), "word", *sides)
    w = words.where("word IS NOT NULL").select("book_id", "page", F.struct(*fields).alias("_w"))
    # One sort brings a page's words together; what windows told row by row, each with a sort of its own, is told inside the page's array.
    p = w.groupBy("book_id", "page").agg(F.sort_array(F.collect_list("_w")).alias("_ws"))
    # Each step is held by a lambda's variable: as columns they would be put into each other, and be computed again for every word.
    def starts(ws: Column) -> Column:
        differs = lambda x, y: ~x.getField("block").eqNullSafe(y.getField("block")) | ~x.getField("line").eqNullSafe(y.getField("line"))
        return F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | differs(F.get(ws, i), F.get(ws, i - 1)))

    def line_order(ws: Column, at: Column) -> Column:
        ords = F.transform(at, lambda i: F.get(ws, i).getField("ord"))
        known = lambda os, k: F.get(F.filter(F.reverse(F.slice(os, F.lit(1), k)), lambda o: o.isNotNull()), F.lit(0))
        return T.let(ords, lambda os: F.sort_array(F.transform(os, lambda o, k: F.struct(F.coalesce(o, known(os, k)).alias("first"), k.alias("k")))))

    def in_order(ws: Column, at: Column) -> Column:
        item = lambda x, j: F.struct(x.getField("ord").alias("ord"), F.concat(F.when(j == 0, "\n").otherwise(" "), x.getField("word")).alias("piece"),
            *([rect(*[x.getField(n) for n in sides]).alias("box")] if boxes else []))
        line = lambda k: F.slice(ws, F.get(at, k) + 1, F.coalesce(F.get(at, k + 1), F.size(ws)) - F.get(at, k))
        return F.flatten(F.transform(line_order(ws, at), lambda o: F.transform(line(o.getField("k")), item)))

    made = T.let(F.col("_ws"), lambda ws: T.let(starts(ws), lambda at: in_order(ws, at)))
    return p.select("book_id", "page", F.explode(F.array(made)).alias("words"))


def page_words(words: DataFrame) -> DataFrame:
    """Rows of :func:`ordered_words` whose words also have ``start``, where the word begins in the page's text: struct<start, ord, piece, box>."""
    begins = lambda ws: maps.running_sums(F.transform(ws, lambda w: F.length(w.getField("piece"))))
    item = lambda w, start: F.struct(start.alias("start"), *[w.getField(n).alias(n) for n in ("ord", "piece", "box")])
    placed = T.let(F.col("words"), lambda ws: F.zip_with(ws, begins(ws), item))
    return ordered_words(words).select("book_id", "page", F.explode(F.array(placed)).alias("words"))


def text_of(words: str) -> Column:
    """The text of a page's words."""
    joined = F.array_join(F.col(words).getField("piece"), "")
    return F.substring(joined, F.lit(2), F.length(joined))


def page_text(words: DataFrame) -> DataFrame:
    """Each page's text: words by their order, lines ended by line breaks."""
    return ordered_words(words, boxes=False).select("book_id", "page", text_of("words").alias("text"))


def side(w: Column, k: Column) -> Column:
    """x of the right edge of a word's k-th character, its box dealt evenly."""
    n, x0, x1 = F.length(w.getField("piece")) - 1, w.getField("box").getField("x0"), w.getField("box").getField("x1")
    return F.when(k == n, x1).otherwise(x0 + k * (x1 - x0) / n)


def page_chars(words: DataFrame) -> DataFrame:
    """Each page's text as :func:`page_text` makes it, with its characters: struct<ch, ord, box>, a word's box dealt evenly, no word or box for white space."""

    def spelled(w: Column, i: Column) -> Column:
        def one(k: Column) -> Column:
            box = rect(side(w, k - 1), w.getField("box").getField("y0"), side(w, k), w.getField("box").getField("y1"))
            return F.struct(F.substring(w.getField("piece"), k + 1, F.lit(1)).alias("ch"), F.when(k > 0, w.getField("ord")).alias("ord"), F.when(k > 0, box).alias("box"))

        n = F.length(w.getField("piece")) - 1
        first = F.when(i == 0, 1).otherwise(0)
        return F.when(first <= n, F.transform(F.sequence(first, n), one)).otherwise(F.array().cast(CHARS))

    return ordered_words(words).select("book_id", "page", text_of("words").alias("text"), F.flatten(F.transform("words", spelled)).cast(CHARS).alias("chars"))


def lines(words: DataFrame) -> DataFrame:
    """Boxes of lines."""
    return words.groupBy("book_id", "page", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"),
        F.max("y1").alias("y1"), F.min("ord").alias("ord"))


def text_margins(words: DataFrame, page_width: Column) -> DataFrame:
    """left, right, top and bottom of each page's text; right is where highlights end, 95 % of the way to the edge."""
    return words.groupBy("book_id", "page").agg(F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("y1").alias("bottom"),
        F.max(page_width).alias("_w")).select(
        "book_id", "page", "left", F.least(F.col("left") + (F.col("_w") - F.col("left")) * 0.95, F.col("_w") - 3).alias("right"), "top", "bottom"
    )


def text_in_rect(words: DataFrame, rects: DataFrame, *keys: str) -> DataFrame:
    """Text of the words that overlap each rect (a table with book_id, page, rect and ``keys``)."""
    inside = (F.col("w.x0") < F.col("r.rect.x1")) & (F.col("w.x1") > F.col("r.rect.x0")) & (F.col("w.y0") < F.col("r.rect.y1")) & (F.col("w.y1") > F.col("r.rect.y0"))
    hit = band_join(rects, words, (F.col("rect.y0"), F.col("rect.y1")), (F.col("y0"), F.col("y1")), inside, ("r", "w"))
    return hit.groupBy(*[F.col(f"r.{k}") for k in ("book_id", "page", *keys)]).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w.ord", "w.word"))), lambda x: x.getField("word")), " ").alias("text")
    )


def word_rects(words: Column, start: Column, end: Column) -> Column:
    """One rect for each line of the characters from ``start`` to ``end`` of a page's text, from its words."""
    first, last = maps.last_at_most(words, "start", start), maps.last_at_most(words, "start", end - 1)
    length = lambda w: F.length(w.getField("piece")) - 1
    met = lambda w: (w.getField("start") < end) & (w.getField("start") + length(w) > start)

    def boxes(w: Column) -> Column:
        a, b, box = F.greatest(start - w.getField("start"), F.lit(0)), F.least(end - w.getField("start"), length(w)), w.getField("box")
        own = rect(F.least(side(w, a), side(w, b - 1)), box.getField("y0"), F.greatest(side(w, a + 1), side(w, b)), box.getField("y1"))
        item = lambda ch, r: F.struct(F.lit(ch).alias("ch"), r.cast(RECT).alias("box"))
        return F.when(F.startswith(w.getField("piece"), F.lit("\n")), F.array(item("\n", F.lit(None)), item("", own))).otherwise(F.array(item("", own)))

    near = T.let(first, lambda i: F.slice(words, i + 1, last - i + 1))
    return boxes_to_lines(F.flatten(F.transform(F.filter(near, met), boxes)))


def pages_of(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(book_id, page, words, text) of the pages that have a row in ``phrases``; words are shuffled once, and where these pages are few no others."""
    # Few pages that are sought go before the words are brought together (Spark moves the join there), many meet whole pages, not their words.
    sought = page_words(words).join(phrases.select("book_id", "page").distinct(), ["book_id", "page"], "left_semi")
    return sought.withColumn("text", text_of("words"))


def search(phrases: DataFrame, words: DataFrame, *keys: str, phrase: str = "phrase") -> DataFrame:
    """Every occurrence of each phrase on its page: hit (the ord of the word it begins in) and rects, one for each line.

    Phrase and page are compared in normal form, case apart: ligatures folded, words joined over hyphens at line ends, white
    space collapsed; marks at the edges of words don't hinder. Occurrences that begin and end with whole words go first;
    only where there is none do parts of words count. All is native: places are found in the page's normal form, mapped back
    to its text by runs, and cut out of the words' boxes; words hold no line breaks. ``phrases`` are read twice.
    """
    p = phrases.select("book_id", "page", *keys, maps.lower_in_place(T.normalize_page(phrase)).alias("_phrase")).where(F.length("_phrase") > 0)
    c = pages_of(p, words)
    c = c.select("book_id", "page", "words", maps.lower_in_place(T.normalize_page("text")).alias("_low"), maps.page_runs("text").alias("_runs"))
    met = p.join(c, ["book_id", "page"]).where(F.contains("_low", F.col("_phrase")))
    at = met.select("book_id", "page", *keys, "words", F.explode(maps.phrase_places(F.col("_low"), F.col("_runs"), F.col("_phrase"))).alias("_p"))
    hit = F.get("words", maps.last_at_most(F.col("words"), "start", F.col("_p.start"))).getField("ord")
    return at.select("book_id", "page", *keys, hit.alias("hit"), word_rects(F.col("words"), F.col("_p.start"), F.col("_p.end")).cast(RECTS).alias("rects"))


def boxes_to_lines(chars: Column, tolerance: float = 5.0) -> Column:
    """One rect for each line of an array of struct<ch, box>: a line ends at a line break or where y moves ``tolerance`` from its first character."""
    state = f"struct<done:array<{RECT}>,now:{RECT},y:double>"
    start = F.struct(F.array().cast(f"array<{RECT}>").alias("done"), F.lit(None).cast(RECT).alias("now"), F.lit(None).cast("double").alias("y")).cast(state)

    def closed(s: Column) -> Column:
        return F.when(s.getField("now").isNull(), s.getField("done")).otherwise(F.concat(s.getField("done"), F.array(s.getField("now"))))

    def step(s: Column, c: Column) -> Column:
        b, now = c.getField("box"), s.getField("now")
        fresh = rect(b.getField("x0"), b.getField("y0"), b.getField("x1"), b.getField("y1"))
        joined = rect(F.least(now.getField("x0"), b.getField("x0")), F.least(now.getField("y0"), b.getField("y0")),
            F.greatest(now.getField("x1"), b.getField("x1")), F.greatest(now.getField("y1"), b.getField("y1")))
        new_line = c.getField("ch").isin("\n", "\r")
        same = s.getField("y").isNull() | (F.abs(b.getField("y0") - s.getField("y")) < tolerance)
        return (
            F.when(new_line, F.struct(closed(s).alias("done"), F.lit(None).cast(RECT).alias("now"), F.lit(None).cast("double").alias("y")))
            .when(b.isNull(), s)
            .when(now.isNull(), F.struct(s.getField("done").alias("done"), fresh.alias("now"), b.getField("y0").alias("y")))
            .when(same, F.struct(s.getField("done").alias("done"), joined.alias("now"), s.getField("y").alias("y")))
            .otherwise(F.struct(closed(s).alias("done"), fresh.alias("now"), b.getField("y0").alias("y")))
            .cast(state)
        )

    return F.aggregate(chars, start, step, closed)
