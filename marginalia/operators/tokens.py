"""Matching by tokens and by characters: windows that agree in most tokens, word sequences, and normalised character streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import maps
from ..functions import text as T
from ..functions.geometry import rect
from ..sources.pages import pages_of, side


def best_window(tokens: Column, target: Column, least: float = 0.8) -> Column:
    """struct<size, start, score>: the first window of n, n-1 or n-2 tokens that agrees with the target in ``least`` of its n tokens; null if none does."""
    n = F.size(target)

    def of_size(size: Column) -> Column:
        starts = F.when((size > 0) & (F.size(tokens) >= size), F.sequence(F.lit(0), F.size(tokens) - size)).otherwise(F.array().cast("array<int>"))
        agree = lambda s: F.size(F.filter(F.zip_with(F.slice(tokens, s + 1, size), target, lambda p, q: p == q), lambda e: e))
        scored = F.transform(starts, lambda s: F.struct(size.alias("size"), s.alias("start"), (agree(s) / n).alias("score")))
        return F.get(F.filter(scored, lambda x: x.getField("score") >= least), F.lit(0))

    return F.when(n > 0, F.coalesce(*[of_size(n - k) for k in range(3)]))


def token_windows(targets: DataFrame, pages: DataFrame, *keys: str, target: str = "content") -> DataFrame:
    """(book_id, page, keys, size, start, score) of targets found in their page's tokens."""
    p = pages.select("book_id", "page", T.tokenize("text").alias("_tokens"))
    j = targets.select("book_id", "page", *keys, T.tokenize(target).alias("_target")).join(p, ["book_id", "page"])
    # Unpacked from an array: a filter on the window would be pushed into the join, and every window be looked for twice.
    found = F.filter(F.array(best_window(F.col("_tokens"), F.col("_target"))), lambda m: m.isNotNull())
    return j.select("book_id", "page", *keys, F.explode(found).alias("m")).select("book_id", "page", *keys, "m.size", "m.start", "m.score")


def token_rect(windows: DataFrame, words: DataFrame, *keys: str) -> DataFrame:
    """Union of the boxes of a window's first and last word (start and size in words)."""
    w = words.select("book_id", "page", F.row_number().over(Window.partitionBy("book_id", "page").orderBy("ord")).alias("_i"), "x0", "y0", "x1", "y1")
    j = windows.join(w, ["book_id", "page"]).where((F.col("_i") == F.col("start") + 1) | (F.col("_i") == F.col("start") + F.col("size")))
    return j.groupBy("book_id", "page", *keys).agg(rect(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("r"))


def word_sequences(contents: DataFrame, words: DataFrame, *keys: str, content: str = "content", probe: int = 5, least: int = 3) -> DataFrame:
    """(book_id, page, keys, start, last): where the first five words of a content begin among a page's words, and its estimated last word.

    Words agree if their letters and digits are equal or one holds the other; three of five must agree, the first place wins.
    """
    c = contents.select("book_id", "page", *keys, F.filter(F.transform(T.words(content), T.token_norm), lambda x: x != "").alias("_all"))
    c = c.where(F.size("_all") > 0).select("book_id", "page", *keys, F.size("_all").alias("_n"), F.slice("_all", 1, probe).alias("_probe"))
    w = words.select("book_id", "page", (F.row_number().over(Window.partitionBy("book_id", "page").orderBy("ord")) - 1).alias("_i"),
        T.token_norm("word").alias("_w"))
    page = w.groupBy("book_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_w"))), lambda x: x.getField("_w")).alias("_ws"))
    j = c.join(page, ["book_id", "page"])
    agrees = lambda a, b: ((a == b) | ((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)))).cast("int")
    score = lambda s: F.aggregate(F.zip_with(F.slice("_ws", s + 1, F.size("_probe")), F.col("_probe"),
        lambda a, b: F.coalesce(agrees(a, b), F.lit(0))), F.lit(0), lambda x, v: x + v)
    starts = F.filter(F.sequence(F.lit(0), F.size("_ws") - 1), lambda s: score(s) >= F.least(F.lit(least), F.size("_probe")))
    return j.withColumn("start", F.get(starts, F.lit(0))).where("start IS NOT NULL").select("book_id", "page", *keys, "start",
        F.least(F.col("start") + F.col("_n") - 1, F.size("_ws") - 1).alias("last"))


def content_spans(contents: DataFrame, pages: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """(book_id, page, keys, at, length): contents found in their page when only letters and digits count (1-based, in the normal form)."""
    p = pages.select("book_id", "page", T.content_norm("text").alias("_page"))
    j = contents.select("book_id", "page", *keys, T.content_norm(content).alias("_c")).where("_c <> ''").join(p, ["book_id", "page"])
    return j.withColumn("at", F.call_function("instr", F.col("_page"), F.col("_c"))).where("at > 0").select("book_id", "page", *keys, "at",
        F.length("_c").alias("length"))


def content_span_words(contents: DataFrame, words: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """(book_id, page, keys, ord, x0, x1): the words of each content's first place in its page when only letters and digits count.

    x0 and x1 are the sides of the letters and digits that belong to it, so marks at a word's edges and hyphens at line ends
    stay out. ``contents`` are read twice; what :func:`marginalia.operators.rects.from_words` makes of the rows are the rects by line.
    """
    c = contents.select("book_id", "page", *keys, T.content_norm(content).alias("_c")).where("_c <> ''")
    p = pages_of(c, words).select("book_id", "page", "words", maps.letter_form("text").alias("_form"), maps.letter_runs("text").alias("_runs"))
    at = F.call_function("instr", F.col("_form"), F.col("_c"))
    j = c.join(p, ["book_id", "page"]).where(F.contains("_form", F.col("_c"))).withColumn("_at", at - 1)
    j = j.select("book_id", "page", *keys, "words", maps.original(F.col("_runs"), F.col("_at")).alias("_s"),
        (maps.original(F.col("_runs"), F.col("_at") + F.length("_c") - 1) + 1).alias("_e"))
    first, last = maps.last_at_most(F.col("words"), "start", F.col("_s")), maps.last_at_most(F.col("words"), "start", F.col("_e") - 1)
    each = j.select("book_id", "page", *keys, "_s", "_e", F.explode(T.let(first, lambda i: F.slice("words", i + 1, last - i + 1))).alias("_w"))
    word, mark = F.substring("_w.piece", F.lit(2), F.length("_w.piece")), r"[^\p{L}\p{N}]*"
    low = F.greatest(F.col("_s") - F.col("_w.start"), F.length(F.regexp_extract(word, rf"\A{mark}", 0)))
    high = F.least(F.col("_e") - F.col("_w.start"), F.length(word) - F.length(F.regexp_extract(word, rf"{mark}\z", 0)))
    return each.withColumn("_a", low).withColumn("_b", high).where("_b > _a").select("book_id", "page", *keys, F.col("_w.ord").alias("ord"),
        side(F.col("_w"), F.col("_a")).alias("x0"), side(F.col("_w"), F.col("_b")).alias("x1"))


def hyphen_merged(words: DataFrame) -> DataFrame:
    """(book_id, page, text): words in order, one that ends in a hyphen joined with the next, in lower case."""
    w = Window.partitionBy("book_id", "page").orderBy("ord")
    before = F.lag("word").over(w)
    joined = F.coalesce(F.endswith(before, F.lit("-")), F.lit(False))
    marked = words.select("book_id", "page", "ord", F.concat(F.when(joined, "").otherwise(" "), F.regexp_replace("word", r"-\z", "")).alias("_part"))
    # A hyphen that ends the page's last word joins nothing, and is dropped with the others.
    return marked.groupBy("book_id", "page").agg(T.collapse(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_part"))),
        lambda x: x.getField("_part")), ""))).alias("text"))
