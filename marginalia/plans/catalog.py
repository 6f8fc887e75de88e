"""Queries over the driver's tables and the SQL they are checked against.

The three queries without SQL rest on a sequence similarity that SQL doesn't have: the tests hold ``anchored_fuzzy_match`` against a
plain-Python statement of its rule over whole tables, and every stage of the two pipelines has queries with SQL of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import location as L
from ..functions import text as T
from ..operators import adapter, annotations, assign, dedup, matching, offset, quads, rects, reports, tokens
from ..operators import columns as column_ops
from ..sources import clippings as clipping_source
from ..sources import pages as page_source
from ..sources import sidecar
from . import inputs as I
from . import pipeline
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

def _rect_columns(c: str) -> list:
    return [F.col(f"{c}.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")]


# --- clippings -------------------------------------------------------------------------------------------------------


@query(
    f"""WITH l AS ({I.LOGS_SQL})
SELECT conv_id, turn, 'Book ' || conv_id AS title, regexp_extract(title_line, '\\(([^)]+)\\)$', 1) AS author, lower(kind) AS type,
 CAST(page_no AS VARCHAR) AS page,
 '2024-03-04T13:02:0' || (turn % 10) AS date_added FROM l"""
)
def clippings_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipping_source.parse(I.logs(spark, sf_dir)).select("conv_id", "turn", "title", "author", "type", "page", "date_added")


@query(
    f"""WITH l AS ({I.LOGS_SQL})
SELECT 'Book ' || conv_id AS title, arg_min(regexp_extract(title_line, '\\(([^)]+)\\)$', 1), turn) AS author, count(*) AS n_clippings,
 string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no, turn) AS pages FROM l GROUP BY conv_id"""
)
def clippings_group_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = clipping_source.parse(I.logs(spark, sf_dir)).withColumn("ord", F.col("turn"))
    return clipping_source.by_book(parsed).select("title", "author", "n_clippings",
        F.array_join(F.transform("clippings", lambda c: c.getField("page")), ",").alias("pages"))


@query("SELECT count(*) AS total_clippings, count(DISTINCT conv_id) AS total_books FROM conversations")
def clippings_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipping_source.totals(clipping_source.parse(I.logs(spark, sf_dir)))


@query(
    f"""WITH l AS ({I.LOGS_SQL}), b AS (SELECT DISTINCT conv_id AS book FROM conversations)
SELECT 'Book ' || b.book || '.pdf' AS book_id, CASE WHEN kind = 'Note' THEN 'note' ELSE 'highlight' END AS type, page_no AS pdf_page,
 'Monday, March 4, 2024 1:02:0' || (turn % 10) || ' PM' AS timestamp, count(*) AS n FROM l JOIN b ON contains(lower(title_line), 'book ' || b.book)
  GROUP BY ALL"""
)
def book_scoped_clippings(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = I.table(spark, sf_dir, "conversations").select(F.concat(F.lit("Book "), F.col("conv_id").cast("string"),
        F.lit(".pdf")).alias("book_id")).distinct().withColumn("name", F.col("book_id"))
    got = clipping_source.parse_for_books(I.logs(spark, sf_dir), books)
    return got.groupBy("book_id", "type", F.col("pdf_page").cast("long").alias("pdf_page"), "timestamp").agg(F.count("*").alias("n"))


# --- positions and points --------------------------------------------------------------------------------------------


@query(
    f"""WITH p AS ({I.POSITIONS_SQL})
SELECT l_orderkey, l_linenumber, l_linenumber AS page, CAST(l_partkey AS INT) AS char_pos, CAST(CASE WHEN long_form THEN ux ELSE 0 END AS INT) AS x,
 CAST(CASE WHEN long_form THEN uy ELSE 0 END AS INT) AS y,
 CASE WHEN long_form THEN uw ELSE 0 END AS width, CASE WHEN long_form THEN uh ELSE 0 END AS height, true AS valid, CAST(CASE
  WHEN long_form THEN ux + uw ELSE 0 END AS DOUBLE) AS right_edge,
 CAST(CASE WHEN long_form THEN ux END AS DOUBLE) AS end_x FROM p"""
)
def position_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.position_strings(spark, sf_dir).withColumn("p", G.position("pos"))
    return p.select("l_orderkey", "l_linenumber", *[F.col(f"p.{n}").alias(n) for n in ("page", "char_pos", "x", "y", "width", "height", "valid")],
        F.get(G.position_rect(F.col("p")), F.lit(2)).alias("right_edge"), G.end_point("pos").getField("x").alias("end_x"))


@query(
    f"""WITH p AS ({I.POSITIONS_SQL})
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(ux * 0.72e0, 500.0e0)), 6) AS pdf_x, round(greatest(0.0, least(uy * 0.72e0, 700.0)), 6) AS pdf_y,
 round(CASE WHEN uw > 0 THEN greatest(0.0, least(uw * 0.72e0, greatest(0.0, 500.0 - greatest(0.0, least(ux * 0.72e0, 500.0e0))))) ELSE 0.0 END,
  6) AS pdf_width, round(CASE WHEN uh > 0 THEN uh * 0.72e0 ELSE 0.0 END, 6) AS pdf_height FROM p"""
)
def coord_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.position_strings(spark, sf_dir)
    at = G.point((F.col("l_partkey") % 800).cast("double"), (F.col("l_suppkey") % 1000).cast("double"), F.lit(500.0), F.lit(700.0),
        F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    p = p.withColumn("at", at)
    return p.select(
        "l_orderkey", "l_linenumber", F.round("at.x", 6).alias("pdf_x"), F.round("at.y", 6).alias("pdf_y"),
            F.round(G.length_to_points(F.col("l_quantity").cast("int").cast("double"), F.lit(500.0), F.col("at.x")), 6).alias("pdf_width"),
        F.round(G.length_to_points((F.col("l_linenumber") * 7).cast("double"), None), 6).alias("pdf_height"),
    )


@query(
    f"""WITH p AS ({I.POSITIONS_SQL})
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(ux * 0.72e0 - 40.5e0, 612.0 - 40.5e0)), 6) AS pdf_x, round(greatest(0.0,
 least(uy * 0.72e0 - 10.0e0, 782.0)), 6) AS pdf_y FROM p"""
)
def coord_convert_cropbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.position_strings(spark, sf_dir)
    at = G.point((F.col("l_partkey") % 800).cast("double"), (F.col("l_suppkey") % 1000).cast("double"), F.lit(500.0), F.lit(700.0),
        G.rect(F.lit(40.5), F.lit(10.0), F.lit(612.0), F.lit(792.0)))
    return p.select("l_orderkey", "l_linenumber", F.round(at.getField("x"), 6).alias("pdf_x"), F.round(at.getField("y"), 6).alias("pdf_y"))


RESOLVED_SQL = """SELECT l_orderkey AS book, l_linenumber * 10000000 + l_partkey AS n, CASE l_returnflag WHEN 'R' THEN 'note'
 WHEN 'A' THEN 'bookmark' ELSE 'highlight' END AS type, CAST(l_linenumber % 3 AS INT) AS page,
 CASE WHEN l_orderkey % 2 = 1 AND l_linenumber % 3 < 2 THEN greatest(0.0, least((l_partkey % 800) * 0.72e0 - 40.5e0, 571.5)) ELSE greatest(0.0,
  least((l_partkey % 800) * 0.72e0, 612.0)) END AS x,
 CASE WHEN l_orderkey % 2 = 1 AND l_linenumber % 3 < 2 THEN greatest(0.0, least((l_suppkey % 1000) * 0.72e0 - 10.0e0, 782.0)) ELSE greatest(0.0,
  least((l_suppkey % 1000) * 0.72e0, 792.0)) END AS y,
 greatest(0.0, least(l_quantity * 0.72e0, 612.0)) AS w, l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem"""


@query(
    f"""WITH r AS ({RESOLVED_SQL})
SELECT CAST(book AS VARCHAR) AS book_id, CASE type WHEN 'highlight' THEN 0 WHEN 'note' THEN 1 ELSE 2 END * 1099511627776 + n AS ord, type, page,
 round(x, 6) AS pdf_x, round(y, 6) AS pdf_y,
 CASE WHEN type = 'highlight' THEN 'kindle_highlight' ELSE 'kindle_note' END AS source, CASE WHEN type = 'note' THEN 'note ' || l_partkey
  ELSE '' END AS content, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM r"""
)
def resolve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotations.resolve(annotations.with_positions(I.sidecar_rows(spark, sf_dir)), I.book_pages(spark, sf_dir))
    return rows.select("book_id", "ord", "type", "page", F.round("pdf_x", 6).alias("pdf_x"), F.round("pdf_y", 6).alias("pdf_y"), "source", "content",
        "timestamp")


@query("SELECT CAST(count_if(event_type LIKE '%i%') AS BIGINT) AS highlights, "
    "CAST(count_if(event_type NOT LIKE '%i%' AND event_type LIKE '%a%') AS BIGINT) AS notes, "
    "CAST(count_if(event_type NOT LIKE '%i%' AND event_type NOT LIKE '%a%') AS BIGINT) AS bookmarks FROM events")
def type_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    named = F.when(F.contains("event_type", F.lit("i")), "annotation.personal.highlight").when(F.contains("event_type", F.lit("a")),
        "annotation.personal.note").otherwise("annotation.personal.bookmark")
    return reports.by_type(e.select(annotations.type_of(named).alias("type")))


@query(
    f"""WITH r AS ({RESOLVED_SQL})
SELECT CAST(book AS VARCHAR) AS book_id, n, row_number() OVER (PARTITION BY book ORDER BY page, y, CASE type WHEN 'highlight' THEN 0
 WHEN 'note' THEN 1 ELSE 2 END, n) AS place FROM r"""
)
def final_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotations.resolve(annotations.with_positions(I.sidecar_rows(spark, sf_dir)), I.book_pages(spark, sf_dir))
    return rows.select("book_id", (F.col("ord") % annotations.TYPE_RANK_STEP).alias("n"),
        F.row_number().over(Window.partitionBy("book_id").orderBy("page", "pdf_y", "ord")).cast("long").alias("place"))


# --- text ------------------------------------------------------------------------------------------------------------

_SPOILED = "replace(replace(replace(text, 'fi', 'ﬁ'), 'e t', 'e' || chr(173) || ' t'), 'an ', 'a-' || chr(10) || 'n ')"
_COLLAPSE = "trim(regexp_replace({}, '[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f]+', ' ', 'g'))"


def _spoiled():
    c = F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("e t"), F.lit("e­ t"))
    return F.replace(c, F.lit("an "), F.lit("a-\nn "))


@query(f"SELECT doc_id, md5({_COLLAPSE.format('replace(replace(translate(' + _SPOILED + ", 'ﬁﬂﬀﬃﬄﬆﬅ', 'fffffss'), '-' || chr(10), ''), chr(173), '')")}) AS digest FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_for_search(_spoiled()).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({_COLLAPSE.format('replace(replace(replace(translate(' + _SPOILED + ", 'ﬁﬂﬀﬃﬄﬆﬅ', 'fffffss'), '-' || chr(173) || chr(10), '-'), chr(173), ''), '-' || chr(10), '')")}) AS digest FROM documents")
def normalize_text_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_page(_spoiled()).cast("binary")).alias("digest"))


@query(
    f"""WITH c AS (SELECT item_id, {_COLLAPSE.format('text')} AS s FROM benchmark), d AS (SELECT doc_id, {_COLLAPSE.format('text')} AS t FROM documents)
SELECT item_id, doc_id, strpos(lower(t), lower(s)) AS start FROM c JOIN d ON contains(lower(t), lower(s)) WHERE s <> ''"""
)
def text_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clippings on pages: whole phrases, with the place where each begins."""
    c = I.table(spark, sf_dir, "benchmark").select("item_id", F.lower(T.collapse("text")).alias("s")).where("s <> ''")
    d = I.table(spark, sf_dir, "documents").select("doc_id", F.lower(T.collapse("text")).alias("t"))
    found = matching.join_containing(c, d, "s", "t", "item_id", "doc_id")
    return found.select("item_id", "doc_id", matching.instr(F.col("t"), F.col("s")).cast("long").alias("start"))


_WORDS = "string_split(s, ' ')"
_PASSAGES = f"SELECT item_id, {_COLLAPSE.format('CASE WHEN item_id % 4 = 3 THEN text || ' + repr(' Zq zq zq zq.') + ' ELSE text END')} AS s FROM benchmark"


def _first(n: int) -> str:
    return f"array_to_string(list_slice({_WORDS}, 1, {n}), ' ')"


def _last(r: float) -> str:
    return f"array_to_string(list_slice({_WORDS}, len({_WORDS}) - CAST(floor(len({_WORDS}) * {r}) AS INT) + 1, len({_WORDS})), ' ')"


@query(
    f"""WITH c AS ({_PASSAGES}), d AS (SELECT doc_id, {_COLLAPSE.format('text')} AS t FROM documents),
m AS (SELECT item_id, doc_id, coalesce({', '.join(f"CASE WHEN len({_WORDS}) > {n} AND contains(t, {_first(n)}) THEN {n} END" for n in (10, 7, 5))})
 AS n_words FROM c CROSS JOIN d)
SELECT item_id, doc_id, CAST(n_words AS BIGINT) AS n_words FROM m WHERE n_words IS NOT NULL"""
)
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.passages(spark, sf_dir).select("item_id", T.collapse("content").alias("s"))
    d = I.table(spark, sf_dir, "documents").select("doc_id", T.collapse("text").alias("t"))
    # Whatever has more words in common has the first five: one condition for the join, the rest for what is left.
    c = c.withColumn("five", T.first_words(T.words("s"))[-1])
    j = matching.join_containing(c, d, "five", "t", "item_id", "doc_id")
    return j.select("item_id", "doc_id", F.size(T.words(matching.prefix_match(F.col("s"), F.col("t")))).cast("long").alias("n_words"))


@query(
    f"""WITH c AS ({_PASSAGES}), d AS (SELECT doc_id, {_COLLAPSE.format('text')} AS t FROM documents),
m AS (SELECT item_id, doc_id, coalesce({', '.join(f"CASE WHEN {' AND '.join(f'floor(len({_WORDS}) * {q}) >= 3' for q in (0.8, 0.6, 0.4) if q >= r)} AND contains(t, {_last(r)}) THEN CAST(floor(len({_WORDS}) * {r}) AS BIGINT) END" for r in (0.8, 0.6, 0.4))}) AS n_words FROM c CROSS JOIN d)
SELECT item_id, doc_id, n_words FROM m WHERE n_words IS NOT NULL"""
)
def reverse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.passages(spark, sf_dir).select("item_id", T.collapse("content").alias("s"))
    d = I.table(spark, sf_dir, "documents").select("doc_id", T.collapse("text").alias("t"))
    # Every longer ending ends in the shortest one.
    c = c.withColumn("least", F.coalesce(*reversed(T.last_words(T.words("s")))))
    j = matching.join_containing(c, d, "least", "t", "item_id", "doc_id")
    return j.select("item_id", "doc_id", F.size(T.words(matching.reverse_match(F.col("s"), F.col("t")))).cast("long").alias("n_words"))


@query(
    f"""WITH c AS ({_PASSAGES}), d AS (SELECT {_COLLAPSE.format('text')} AS t FROM documents)
SELECT item_id FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE contains(t, s))"""
)
def unmatched_clippings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.passages(spark, sf_dir).select("item_id", T.collapse("content").alias("s"))
    d = I.table(spark, sf_dir, "documents").select("doc_id", T.collapse("text").alias("t"))
    found = matching.join_containing(c, d, "s", "t", "item_id", "doc_id").select("item_id").distinct()
    return c.join(found, "item_id", "left_anti").select("item_id")


@query()
def anchored_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clippings with a word changed, on the pages that hold their first five words."""
    b = I.table(spark, sf_dir, "benchmark").select(F.col("item_id"), T.collapse("text").alias("content"))
    w = T.words("content")
    spoiled = b.withColumn("content", F.array_join(F.concat(F.slice(w, 1, 8), F.array(F.lit("zzz")), F.slice(w, F.lit(10), F.size(w))), " "))
    d = I.table(spark, sf_dir, "documents").select("doc_id", T.normalize_page("text").alias("page_norm"))
    c = spoiled.withColumn("search_norm", T.normalize_page("content")).withColumn("five", F.array_join(F.slice(T.words("search_norm"), 1, 5), " "))
    j = matching.join_containing(c, d, "five", "page_norm", "item_id", "doc_id")
    return matching.anchored(j, "item_id", "doc_id").select("item_id", "doc_id", "start", "end", F.round("ratio", 6).alias("ratio"), F.round("word_ratio", 6).alias("word_ratio"))


@query()
def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn without some of its letters, and the turn of its conversation that is most like it."""
    c = I.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.lit(0).alias("page"), F.col("turn").alias("ord"),
        F.coalesce("text", F.lit("")).alias("content"))
    spoiled = c.select("book_id", "page", F.col("ord").alias("turn"), F.translate("content", "lm", "").alias("content"))
    return reports.similar_texts(spoiled, c, "turn").select("book_id", "turn", "actual_ord", F.round("ratio", 6).alias("ratio"))


_TOKEN = "[\\p{L}\\p{M}\\p{N}\\p{Pc}'']+|[^\\p{L}\\p{M}\\p{N}\\p{Pc}'' \\t\\n\\r\\x0b\\x0c]"


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{_TOKEN}')) AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), "
    f"'{_TOKEN}'), '|')) AS digest FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokenize("text")
    return I.table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"),
        F.md5(F.array_join(t, "|").cast("binary")).alias("digest"))


@query(
    f"""WITH d AS (SELECT doc_id, string_split({_COLLAPSE.format('text')}, ' ') AS w FROM documents), p AS (SELECT a.doc_id, a.w AS x, b.w AS y
     FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i])) / greatest(len(x), len(y)), 9) AS similarity FROM p"""
)
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return d.join(after, "doc_id").select("doc_id", F.round(T.word_similarity("text", "next_text"), 9).alias("similarity"))


@query(
    f"""WITH w AS ({I.WORDS_SQL}), m AS (SELECT book_id, ord, word, coalesce(ends_with(lag(word) OVER (PARTITION BY book_id ORDER BY ord), '-'),
     false) AS joined FROM w)
SELECT book_id, trim(lower(string_agg((CASE WHEN joined THEN '' ELSE ' ' END) || regexp_replace(word, '-$', ''), '' ORDER BY ord))) AS text FROM m
 GROUP BY book_id"""
)
def hyphen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.hyphen_merged(I.words(spark, sf_dir)).select("book_id", "text")


# --- page offsets ----------------------------------------------------------------------------------------------------

_RULES = "SELECT o_custkey AS book, o_orderkey AS ord, CAST(o_orderkey % 13 AS INT) AS startpage, CASE WHEN o_orderkey % 3 = 0 THEN 'r' ELSE 'D' END AS style, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS firstpagenum FROM orders"


@query(
    f"""WITH r AS ({_RULES}), d AS (SELECT *, startpage + 1 - coalesce(firstpagenum, 1) AS off FROM r WHERE style = 'D'),
m AS (SELECT book, arg_min(off, ord) FILTER (WHERE coalesce(firstpagenum, 1) = 1) AS a, arg_max(off, ord) AS b FROM d GROUP BY book)
SELECT CAST(book AS VARCHAR) AS book_id, CAST(coalesce(a, b) AS INT) AS label_offset FROM m"""
)
def page_offset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    rules = o.select(
        F.col("o_custkey").cast("string").alias("book_id"), F.col("o_orderkey").alias("ord"),
            (F.col("o_orderkey") % 13).cast("int").alias("startpage"), F.when(F.col("o_orderkey") % 3 == 0, "r").otherwise("D").alias("style"),
        F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 4).cast("int")).alias("firstpagenum"),
    )
    return offset.from_labels(rules)


@query(
    """WITH p AS (SELECT conv_id, CAST(turn AS INT) AS page, lower(text) AS t FROM conversations),
c AS (SELECT conv_id, turn AS ord, CAST(turn + 1 + conv_id % 3 AS INT) AS claimed, lower(substr(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')),
 1, 50)) AS probe, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE length(regexp_replace(text, '^\\s+|\\s+$',
  '', 'g')) > 20),
f AS (SELECT c.conv_id, c.ord, min(p.page) + 1 - c.claimed AS off FROM c JOIN p ON p.conv_id = c.conv_id AND p.page >= greatest(0, claimed - 20)
 AND p.page < claimed + 20 AND contains(p.t, c.probe) WHERE n <= 10 GROUP BY c.conv_id, c.ord, c.claimed),
v AS (SELECT conv_id, off, count(*) AS k, min(ord) AS o FROM f GROUP BY conv_id, off), b AS (SELECT DISTINCT conv_id FROM conversations)
SELECT CAST(b.conv_id AS VARCHAR) AS book_id, CAST(coalesce((SELECT off FROM v WHERE v.conv_id = b.conv_id ORDER BY k DESC, o LIMIT 1),
 0) AS INT) AS "offset" FROM b"""
)
def page_offset_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "conversations").withColumn("book_id", F.col("conv_id").cast("string"))
    pages = c.select("book_id", F.col("turn").cast("int").alias("page"), "text")
    clips = c.select("book_id", F.col("turn").alias("ord"), (F.col("turn") + 1 + F.col("conv_id") % 3).cast("int").alias("pdf_page"),
        F.col("text").alias("content"))
    return offset.detect(clips, pages)


# --- assignment ------------------------------------------------------------------------------------------------------

_PAIRS = """WITH h AS (SELECT l_suppkey AS b, l_orderkey * 10 + l_linenumber AS ord, CAST(l_partkey % 500 AS DOUBLE) AS y FROM lineitem
 WHERE l_returnflag <> 'R'),
c AS (SELECT l_suppkey AS b, l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_returnflag = 'R')"""


def _highlights_and_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = I.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("book_id"), F.lit(0).alias("page"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_suppkey") % 500).cast("double").alias("x"),
            (F.col("l_partkey") % 500).cast("double").alias("y"), "l_returnflag")
    return li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'")


@query(
    f"""{_PAIRS}, hn AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY y, ord) AS n FROM h), cn AS (SELECT *,
     row_number() OVER (PARTITION BY b ORDER BY ord) AS n FROM c)
SELECT CAST(hn.b AS VARCHAR) AS book_id, hn.ord AS highlight_ord, cn.ord AS clip_ord FROM hn JOIN cn ON hn.b = cn.b AND hn.n = cn.n"""
)
def positional_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, c = _highlights_and_clips(spark, sf_dir)
    return assign.positional(h, c).select("book_id", "highlight_ord", "clip_ord")


@query()
def greedy_nearest_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one order, half of them highlights and half clippings: each highlight takes the nearest clipping left."""
    li = I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("book_id"), F.lit(0).alias("page"),
        F.col("l_linenumber").cast("long").alias("ord"), (F.col("l_partkey") % 500).cast("double").alias("x"),
            (F.col("l_suppkey") % 500).cast("double").alias("y"))
    return assign.nearest(li.where("ord % 2 = 1"), li.where("ord % 2 = 0"))


# --- duplicates ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH p AS ({I.POINTS_SQL})
SELECT book_id, page, min(ord) AS ord, type FROM p GROUP BY book_id, page, type, round_even(CAST(pdf_x AS DECIMAL(18, 4)), 1),
 round_even(CAST(pdf_y AS DECIMAL(18, 4)), 1), substr(trim(content), 1, 50), CASE WHEN type = 'bookmark' THEN timestamp ELSE '' END"""
)
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_exact(I.point_rows(spark, sf_dir)).select("book_id", "page", "ord", "type")


@query()
def dedup_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unify(I.point_rows(spark, sf_dir)).select("book_id", "page", "ord", "type", "content", "highlight_content", "place")


@query(
    f"""WITH p AS ({I.POINTS_SQL}), n AS (SELECT * FROM p WHERE type = 'note'), h AS (SELECT * FROM p WHERE type = 'highlight')
SELECT n.book_id, n.page, n.ord AS note_ord, h.ord AS highlight_ord FROM n JOIN h ON n.book_id = h.book_id AND n.page = h.page AND (
 (abs(n.pdf_x - h.pdf_x) <= 5 AND abs(n.pdf_y - h.pdf_y) <= 5) OR (abs(h.pdf_x_end - n.pdf_x) <= 5 AND abs(h.pdf_y_end - n.pdf_y) <= 5)
  OR (abs(n.pdf_x_end - h.pdf_x) <= 5 AND abs(n.pdf_y_end - h.pdf_y) <= 5))"""
)
def note_highlight_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.candidates(I.point_rows(spark, sf_dir))


@query(f"WITH p AS ({I.POINTS_SQL}) SELECT book_id, page, round(pdf_x, 1) AS x, round(pdf_y, 1) AS y, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_report(I.point_rows(spark, sf_dir))


# --- words, lines and columns ----------------------------------------------------------------------------------------


@query(f"WITH w AS ({I.WORDS_SQL}) SELECT book_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM w GROUP BY book_id")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = I.words(spark, sf_dir).groupBy("book_id").agg(F.collect_list(G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("rs"))
    return w.select("book_id", G.bounding_box(F.col("rs")).alias("r")).select("book_id", *_rect_columns("r"))


@query(f"WITH w AS ({I.WORDS_SQL}) SELECT book_id, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM w GROUP BY book_id, line")
def line_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source.lines(I.words(spark, sf_dir)).select("book_id", "line", "x0", "y0", "x1", "y1")


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), "
    "2) AS intercept FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 2")
def ols_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.linear_fit(I.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_suppkey").select("l_suppkey",
        F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(f'WITH w AS ({I.WORDS_SQL}) SELECT book_id, min(x0) AS "left", round(least(min(x0) + (400.0 - min(x0)) * 0.95, 397.0), 6) AS "right", '
    f'min(y0) AS top, max(y1) AS bottom FROM w GROUP BY book_id')
def text_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source.text_margins(I.words(spark, sf_dir), F.lit(400.0)).select("book_id", "left", F.round("right", 6).alias("right"), "top", "bottom")


def _supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = I.table(spark, sf_dir, "lineitem")
    x0 = F.when(F.col("l_linenumber") % 2 == 0, 300.0).otherwise(50.0) + (F.col("l_partkey") % 9)
    y0 = (F.col("l_orderkey") % 700).cast("double")
    return li.select(F.col("l_suppkey").cast("string").alias("book_id"), F.lit(0).alias("page"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 4).alias("x1"),
            (y0 + 12).alias("y1"))


@query()
def column_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _supplier_lines(spark, sf_dir)
    pages = lines.select("book_id", "page").distinct().withColumns({"width": F.lit(595.3), "height": F.lit(841.9)})
    found = column_ops.detect(lines, pages)
    side = lambda i, n: F.round(F.element_at("columns", i).getField(n), 6)
    return found.select("book_id", "page", F.size("columns").alias("n_columns"),
        *[side(1, n).alias(f"first_{n}") for n in ("left", "right", "top", "bottom")], *[side(-1, n).alias(f"last_{n}") for n in ("left", "right")])


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 600 AS DOUBLE) AS x, CAST(l_suppkey % 800 AS DOUBLE) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN x BETWEEN 50 AND 280 AND y BETWEEN 60 AND 700 THEN 50e0 WHEN x BETWEEN 300 AND 540 AND y BETWEEN 60
 AND 700 THEN 300e0 WHEN abs(x - 165) <= abs(x - 420) THEN 50e0 ELSE 300e0 END AS column_left FROM l"""
)
def column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = F.array(*[column_ops.column(*[F.lit(float(v)) for v in c]) for c in ((50, 280, 60, 700), (300, 540, 60, 700))])
    li = I.table(spark, sf_dir, "lineitem")
    c = G.column_of(cols, (F.col("l_partkey") % 600).cast("double"), (F.col("l_suppkey") % 800).cast("double"))
    return li.select("l_orderkey", "l_linenumber", c.getField("left").alias("column_left"))


@query(
    """WITH l AS (SELECT l_suppkey AS b, CASE WHEN l_linenumber % 2 = 0 THEN 300e0 ELSE 50e0 END + l_partkey % 9 AS x0,
     CAST(l_orderkey % 700 AS DOUBLE) AS y0, l_quantity * 4 AS w FROM lineitem),
g AS (SELECT p.b, p.x0 AS pos, count(*) AS n, min(l.x0) AS "left", max(l.x0 + l.w) AS "right", min(l.y0) AS top, max(l.y0 + 12) AS bottom
 FROM (SELECT DISTINCT b, x0 FROM l) p JOIN l ON p.b = l.b AND abs(l.x0 - p.x0) <= 20 GROUP BY p.b, p.x0 HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY pos) AS place FROM g), t AS (SELECT b FROM r WHERE place <= 2
 GROUP BY b HAVING max(pos) - min(pos) > 50),
w AS (SELECT b, count(*) AS k, min(x0) AS "left", max(x0 + w) AS "right", min(y0) AS top, max(y0 + 12) AS bottom FROM l GROUP BY b), two AS (SELECT b
 FROM t JOIN w USING (b) WHERE k >= 10)
SELECT CAST(b AS VARCHAR) AS book_id, CAST(place AS INT) AS place, "left", "right", top, bottom FROM r WHERE place <= 2 AND b IN (SELECT b FROM two)
UNION ALL SELECT CAST(b AS VARCHAR), 1, "left", "right", top, bottom FROM w WHERE b NOT IN (SELECT b FROM two)"""
)
def margin_cluster_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_ops.detect_by_range(_supplier_lines(spark, sf_dir)).select("book_id", F.col("place").cast("int").alias("place"), "left", "right",
        "top", "bottom")


# --- rects -----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH w AS ({I.WORDS_SQL}), s AS (SELECT *, sqrt((x0 - 150) * (x0 - 150) + (y0 - 20) * (y0 - 20)) AS d FROM w)
SELECT book_id, arg_min(x0, struct_pack(d := d, o := ord)) AS x0, arg_min(y0, struct_pack(d := d, o := ord)) AS y0, arg_min(x1, struct_pack(d := d,
 o := ord)) AS x1 FROM s GROUP BY book_id"""
)
def quad_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = I.words(spark, sf_dir).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord",
        G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r")))).alias("q"))
    r = quads.nearest_rect(F.transform("q", lambda x: x.getField("r")), F.lit(150.0), F.lit(20.0))
    return w.select("book_id", r.alias("r")).select("book_id", *[F.col(f"r.{n}").alias(n) for n in ("x0", "y0", "x1")])


def _order_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = I.words(spark, sf_dir).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord",
        G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r")))).alias("q"))
    return w.select("book_id", F.transform("q", lambda x: x.getField("r")).alias("rects"))


@query()
def quad_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rects near a point, as for texts of more than eight characters."""
    near = quads.filter_by_proximity(_order_rects(spark, sf_dir).withColumns({"x": F.lit(150.0), "y": F.lit(20.0), "length": F.lit(40)}))
    return near.select("book_id", F.size("kept").alias("n_kept"), G.bounding_box(F.col("kept")).alias("r")).select("book_id", "n_kept", *_rect_columns("r"))


@query(
    f"""WITH w AS ({I.WORDS_SQL}), b AS (SELECT book_id, ord AS region, x0, y0, x1, y1 FROM w),
p AS (SELECT a.book_id, sqrt(pow((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + pow((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2, 2)) AS d FROM b a
 JOIN b ON a.book_id = b.book_id AND a.region < b.region)
SELECT book_id, round(min(d), 6) AS least, round(max(d), 6) AS largest, min(d) > 100 AS all_far, max(d) > 100 AS some_far FROM p GROUP BY book_id"""
)
def disconnected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = I.words(spark, sf_dir).select("book_id", F.col("ord").alias("region"), "x0", "y0", "x1", "y1",
        ((F.col("x0") + F.col("x1")) / 2).alias("mean_x"), ((F.col("y0") + F.col("y1")) / 2).alias("mean_y"))
    return quads.disconnected(boxes, "book_id").select("book_id", F.round("least", 6).alias("least"), F.round("largest", 6).alias("largest"),
        "all_far", "some_far")


@query()
def quad_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads.regions(_order_rects(spark, sf_dir), "book_id").select("book_id", "region", "n_rects", "x0", "y0", "x1", "y1")


@query(
    """WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 300 AS DOUBLE) AS sx, CAST(o_custkey % 700 AS DOUBLE) AS sy,
     CAST(o_custkey % 500 AS DOUBLE) AS ex, CAST(o_custkey % 700 + o_orderkey % 90 AS DOUBLE) AS ey FROM orders),
n AS (SELECT *, greatest(1, CAST(round_even(CAST((ey - sy) / 16 AS DECIMAL(18, 6)), 0) AS INT) + 1) AS k FROM s), l AS (SELECT *, unnest(range(0,
 k)) AS i FROM n),
r AS (SELECT o_orderkey, i, CASE WHEN i = 0 THEN sx ELSE 40.0 END AS x0, sy + i * 16 AS y0, CASE WHEN i = k - 1 THEN ex ELSE 550.0 END AS x1 FROM l)
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1 AS i, x0, y0, x1, y0 + 16 AS y1 FROM r WHERE x1 > x0"""
)
def snake_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    d = lambda c: c.cast("double")
    sy = F.col("o_custkey") % 700
    made = rects.snake(d(F.col("o_orderkey") % 300), d(sy), d(F.col("o_custkey") % 500), d(sy + F.col("o_orderkey") % 90), F.lit(40.0), F.lit(550.0))
    return o.select("o_orderkey", F.posexplode(made).alias("i", "r")).select("o_orderkey", F.col("i").cast("long").alias("i"), *_rect_columns("r"))


@query(
    f"""WITH w AS ({I.WORDS_SQL}), l AS (SELECT book_id, line, min(y0) AS y0, max(y1) AS y1 FROM w GROUP BY book_id, line),
     s AS (SELECT DISTINCT book_id, CAST(CAST(book_id AS BIGINT) % 60 AS DOUBLE) AS top FROM w),
j AS (SELECT s.book_id, line, NOT (l.y1 < top OR l.y0 > top + 3) AS touches, (l.y0 + l.y1) / 2 BETWEEN top - 0.5 AND top + 3.5 AS middle FROM s
 JOIN l USING (book_id)), a AS (SELECT book_id, max(touches) AS any_touch FROM j WHERE touches OR middle GROUP BY book_id)
SELECT j.book_id, count(*) AS n FROM j JOIN a USING (book_id) WHERE (touches OR middle) AND touches = any_touch GROUP BY j.book_id"""
)
def line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = I.words(spark, sf_dir)
    spans = w.select("book_id", "page").distinct().withColumn("top", (F.col("book_id").cast("long") % 60).cast("double")).withColumn("bottom", F.col("top") + 3)
    return rects.select_lines(spans, page_source.lines(w), "top").groupBy("book_id").agg(F.count("*").alias("n"))


_ADAPT = f"""WITH r AS ({RESOLVED_SQL}), e AS (SELECT *, (l_partkey % 800) AS ux FROM r)"""


@query(
    f"""{_ADAPT}, p AS (SELECT CAST(book AS VARCHAR) AS book_id, n, type, x, y, greatest(0.0, least((l_partkey % 800 + 90) * 0.72e0, 612.0)) AS ex,
     greatest(0.0, least((l_suppkey % 1000 + 20) * 0.72e0, 792.0)) AS ey,
 greatest(0.0, least(CAST(l_quantity AS INT) * 0.72e0, greatest(0.0, 612.0 - x))) AS w0, greatest(0.0, least(14 * 0.72e0, greatest(0.0,
  792.0 - y))) AS h0, greatest(0.0, least(CAST(l_quantity AS INT) * 0.72e0, 612.0)) AS ew FROM r),
q AS (SELECT *, CASE WHEN w0 < 0.01 OR h0 < 0.01 THEN ew ELSE w0 END AS w, CASE WHEN w0 < 0.01 OR h0 < 0.01 THEN 14 * 0.72e0 ELSE h0 END AS h FROM p),
z AS (SELECT *, least(y, ey) AS top, greatest(x + w, ex + ew) AS rt, greatest(y + h, ey + 14 * 0.72e0) AS bt FROM q)
SELECT book_id, n, type, round(CASE type WHEN 'highlight' THEN CASE WHEN rt <= x THEN x + 5 ELSE rt END WHEN 'note' THEN x + 20 ELSE x + 18 END,
 6) AS right_edge, round(CASE type WHEN 'highlight' THEN CASE WHEN bt <= top THEN top + 12 ELSE bt END WHEN 'note' THEN y + 20 ELSE y + 18 END,
  6) AS bottom_edge,
 round(CASE WHEN type = 'highlight' THEN top ELSE y END, 6) AS top_edge FROM z"""
)
def adapter_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotations.resolve(annotations.with_positions(I.sidecar_rows(spark, sf_dir)), I.book_pages(spark, sf_dir))
    a = adapter.adapt(rows)
    at = lambda i: F.round(F.get("coordinates", F.lit(i)), 6)
    return a.select("book_id", (F.col("ord") % annotations.TYPE_RANK_STEP).alias("n"), "type", at(2).alias("right_edge"), at(3).alias("bottom_edge"),
        at(1).alias("top_edge"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Kindle Bookmark' ELSE 'Kindle Bookmark (' || strftime(o_orderdate, "
    "'%Y-%m-%d %H:%M') || ')' END AS title FROM orders")
def bookmark_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.bookmark_title(F.when(F.col("o_orderkey") % 7 == 0,
        "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("title"))


# --- locations -------------------------------------------------------------------------------------------------------

_LOCATIONS = "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS INT) AS a, CAST(l_partkey + l_quantity AS INT) AS b, l_linenumber % 4 AS k FROM lineitem"


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey").cast("string"), (F.col("l_partkey") + F.col("l_quantity")).cast("int").cast("string")
    k = F.col("l_linenumber") % 4
    return I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
        F.when(k == 0, F.concat_ws("-", a, b)).when(k == 1, a).when(k == 2, F.concat(F.lit("loc. "), a)).otherwise("none").alias("loc"), a.alias("single"))


@query(
    f"""WITH l AS ({_LOCATIONS}) SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 'range' WHEN 1 THEN 'single' WHEN 2 THEN 'extracted'
     ELSE 'error' END AS kind, CASE WHEN k < 3 THEN a END AS start_location,
 CASE WHEN k = 0 THEN b WHEN k < 3 THEN a END AS end_location, CASE WHEN k = 0 THEN b - a + 1 END AS span, CASE k WHEN 0 THEN (b - a + 1) * 150
  WHEN 1 THEN 150 END AS estimated_words, CASE WHEN k < 3 THEN greatest(1, a // 10) END AS estimated_page,
 CASE k WHEN 0 THEN a || '-' || b WHEN 3 THEN 'none' ELSE CAST(a AS VARCHAR) END AS normal FROM l"""
)
def location_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _locations(spark, sf_dir).withColumn("d", L.decode("loc"))
    return d.select("l_orderkey", "l_linenumber", F.col("d.type").alias("kind"),
        *[F.col(f"d.{n}").alias(n) for n in ("start_location", "end_location", "span", "estimated_words", "estimated_page")],
            L.normalize("loc").alias("normal"))


@query(f"WITH l AS ({_LOCATIONS}) SELECT l_orderkey, l_linenumber, CASE WHEN k < 3 THEN abs(a - 1000) END AS difference, "
    f"CASE WHEN k < 3 THEN a < 1000 END AS first_is_earlier, CASE WHEN k < 3 THEN abs(a - 1000) // 10 END AS pages_apart FROM l")
def location_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _locations(spark, sf_dir).withColumn("c", L.compare(F.col("loc"), F.lit("1000")))
    return d.select("l_orderkey", "l_linenumber", *[F.col(f"c.{n}").alias(n) for n in ("difference", "first_is_earlier", "pages_apart")])


@query(
    f"""WITH l AS ({_LOCATIONS}) SELECT l_orderkey, l_linenumber, CAST(least(299, greatest(0, trunc(a / 3000.0::DOUBLE * 300))) AS INT) AS page,
     round(least(1.0, a / 3000.0::DOUBLE), 9) AS share, a * 150 AS word_position, greatest(0, CAST(floor((3000 - a) / 10.0) AS INT)) AS pages_remaining,
 CASE WHEN a % 400 < 300 THEN CAST(trunc((a % 400) / 300.0::DOUBLE * 3000) AS INT) ELSE 0 END AS back FROM l"""
)
def location_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _locations(spark, sf_dir).withColumn("a", F.col("single").cast("int"))
    est = L.reading_estimate(F.col("a"), F.lit(3000))
    return d.select(
        "l_orderkey", "l_linenumber", L.location_to_page(F.col("a"), F.lit(300)).getField("page").alias("page"),
            F.round(est.getField("percentage"), 9).alias("share"), est.getField("word_position").alias("word_position"),
                est.getField("pages_remaining").alias("pages_remaining"),
        L.page_to_location((F.col("a") % 400), F.lit(300)).getField("location").alias("back"),
    )


# --- pages and counts ------------------------------------------------------------------------------------------------


@query("SELECT l_linenumber AS page, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def page_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_page(I.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("page")))


def _page_sets(spark: SparkSession, sf_dir: str, column: str = "l_partkey") -> tuple[DataFrame, DataFrame]:
    o, li = I.table(spark, sf_dir, "orders"), I.table(spark, sf_dir, "lineitem")
    return o.select((F.col("o_custkey") + 1).alias("page")), li.select(F.col(column).alias("page"))


@query("SELECT o_custkey + 1 AS page FROM orders INTERSECT SELECT l_partkey FROM lineitem")
def pages_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shared_pages(*_page_sets(spark, sf_dir))


@query("SELECT o_custkey + 1 AS page FROM orders EXCEPT SELECT l_suppkey FROM lineitem")
def pages_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pages_only_in(*_page_sets(spark, sf_dir, "l_suppkey"))


@query(
    f"""WITH w AS ({I.WORDS_SQL}), m AS (SELECT a.book_id, a.ord, b.ord AS actual_ord, greatest(0, least(a.x1, b.x1 + 3) - greatest(a.x0,
     b.x0 + 3)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS ratio FROM w a JOIN w b ON a.book_id = b.book_id)
SELECT book_id, ord, arg_min(actual_ord, struct_pack(r := -ratio, o := actual_ord)) AS actual_ord, round(max(ratio), 6) AS ratio FROM m
 WHERE ratio >= 0.8 GROUP BY book_id, ord"""
)
def overlap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = I.words(spark, sf_dir)
    expected = w.select("book_id", "page", "ord", G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r"))
    actual = w.select("book_id", "page", "ord", G.rect(F.col("x0") + 3, F.col("y0"), F.col("x1") + 3, F.col("y1")).alias("r"))
    return reports.overlap_matches(expected, actual, "ord").select("book_id", "ord", "actual_ord", F.round("ratio", 6).alias("ratio"))


@query(
    """SELECT event_id, regexp_replace(translate('ev:' || event_type || '/' || user_id || '?*. ', '<>:"/\\|?*', '_________'), '^[ .]+|[ .]+$', '',
     'g') AS file_name, event_type || '-x' AS book FROM events"""
)
def clean_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    raw = F.concat(F.lit("ev:"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"), F.lit("?*. "))
    return e.select("event_id", T.clean_filename(raw).alias("file_name"),
        T.book_from_path(F.concat(F.lit("/a/"), F.col("event_type"), F.lit("-x-cdeKey_123.pds"))).alias("book"))


# --- byte sources and the whole pipeline -----------------------------------------------------------------------------


def section_bytes(text):
    """An older section file with one annotation section."""
    body = text.cast("binary")
    size = F.unhex(F.lpad(F.hex(F.length(body)), 8, "0"))
    return F.concat(F.unhex(F.lit("00000001000100000000000000000000")), F.unhex(F.lit("00000001")), size, body)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, 1 AS section_type, 'order ' || o_orderkey || ' of ' || o_orderpriority AS text FROM orders")
def section_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("o_orderpriority"))
    files = o.select(F.col("o_orderkey").cast("string").alias("path"), section_bytes(text).alias("content"))
    return sidecar.decode_sections(files).select("path", "section_type", "text")


def _utf(c):
    body = c.cast("binary")
    return F.concat(F.unhex(F.lit("0300")), F.unhex(F.lpad(F.hex(F.length(body)), 4, "0")), body)


def _name(s: str):
    return F.lit(f"FE00{len(s):04X}" + s.encode().hex())


def store_bytes(position, created_ms, note):
    """A side-car store with one note, as native byte expressions."""
    int_of = lambda n: F.lit(f"01{n:08X}")
    time = F.concat(F.unhex(F.lit("02")), F.unhex(F.lpad(F.hex(created_ms), 16, "0")))
    inner = F.concat(F.unhex(_name("annotation.personal.note")), _utf(position), _utf(position), time, time, _utf(F.lit("0")), _utf(note), F.unhex(F.lit("FF")))
    tree = F.concat(F.unhex(_name("saved.avl.interval.tree")), F.unhex(int_of(1)), inner, F.unhex(F.lit("FF")))
    cache = F.concat(F.unhex(_name("annotation.cache.object")), F.unhex(int_of(1)), F.unhex(int_of(2)), tree, F.unhex(F.lit("FF")))
    return F.concat(F.lit(sidecar.SIGNATURE), F.unhex(int_of(1)), F.unhex(int_of(1)), cache)


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS book_id, 0::BIGINT AS ord, 'annotation.personal.note' AS annotation_type,
     '1 0 ' || o_custkey || ' 1 100 200 30 14' AS start_position, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created,
      'n' || o_orderkey AS note_text FROM orders"""
)
def krds_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    pos = F.concat(F.lit("1 0 "), F.col("o_custkey").cast("string"), F.lit(" 1 100 200 30 14"))
    files = o.select(F.col("o_orderkey").cast("string").alias("path"),
        store_bytes(pos, F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))).alias("content"))
    return sidecar.decode_annotations(files).select("book_id", "ord", "annotation_type", "start_position",
        F.date_format("creation_time", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), "note_text")


def _book_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as one-page books with the words of their lines, one clipping each.

    Every fourth word has a ligature, and in a fifth of the books the second ends its line with a hyphen. By the book's
    number a clipping quotes the first two words, a word over the line break, a ligature spelled out or folded, or seven
    words with a slip of spelling; the first two where a book is too short for that.
    """
    w = I.words(spark, sf_dir)
    kind, n = F.col("book_id").cast("long") % 5, F.col("ord")
    w = w.withColumn("word", F.when(n % 4 == 0, F.replace("word", F.lit("W"), F.lit("Wﬁ"))).when((kind == 1) & (n == 2),
        F.concat("word", F.lit("-"))).otherwise(F.col("word")))
    pages = page_source.page_text(w).join(I.book_pages(spark, sf_dir).where("page = 0").drop("text"), ["book_id", "page"])
    quoted = w.where("ord <= 7").groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))),
        lambda x: x.getField("word")).alias("_w"))
    part = lambda a, k: F.array_join(F.slice("_w", a, k), " ")
    size = F.size("_w")
    content = (
        F.when((kind == 1) & (size >= 3), F.replace(part(1, 3), F.concat(F.get("_w", F.lit(1)), F.lit(" ")), F.regexp_replace(F.get("_w", F.lit(1)), "-$", "")))
        .when((kind == 2) & (size >= 4), T.spell_ligatures(part(3, 2)))
        .when((kind == 3) & (size >= 4), T.fold_ligatures(part(3, 2)))
        .when((kind == 4) & (size >= 7), F.replace(part(1, 7), F.lit("ﬁ"), F.lit("fx")))
        .otherwise(part(1, 2))
    )
    clips = quoted.select("book_id", F.lit(0).cast("long").alias("ord"), F.lit("highlight").alias("type"), F.lit(1).alias("pdf_page"),
        content.alias("content"), F.lit("").alias("timestamp"), F.lit("").alias("raw_meta"), F.lit("1").alias("page_str"))
    return pages, w, clips


@query()
def resolve_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, w, clips = _book_tables(spark, sf_dir)
    got = pipeline.resolve_annotations(I.sidecar_rows(spark, sf_dir), clips, pages, w)
    return got.select("book_id", "ord", "type", "page", F.round("pdf_x", 4).alias("pdf_x"), F.round("pdf_y", 4).alias("pdf_y"), "content",
        "highlight_content", "source", F.size("precise_rects").alias("n_rects"))


@query()
def draw_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, w, clips = _book_tables(spark, sf_dir)
    scratch: list[str] = []
    got = pipeline.resolve_annotations(I.sidecar_rows(spark, sf_dir), clips, pages, w, scratch=scratch)
    return pipeline.draw_commands(got, pages, w, scratch).select("book_id", "page", "ord", "command", "title", "content", F.size("rects").alias("n_rects"),
        "outline_page")


# The other parts of the catalogue register themselves.
from . import catalog_files, catalog_folds, catalog_places, catalog_text  # noqa: E402, F401
