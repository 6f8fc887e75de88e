"""Queries of text functions, page text, phrase search and matching, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import maps, similarity, text as T
from ..operators import matching, rects, tokens
from ..session import cut, stored
from ..sources import pages as page_source
from . import inputs as I
from .registry import query

_COLLAPSE = "trim(regexp_replace({}, '[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f]+', ' ', 'g'))"
_SPOILED = "replace(replace(replace(text, 'fi', 'ﬁ'), 'e t', 'e' || chr(173) || ' t'), 'an ', 'a-' || chr(10) || 'n ')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", "text")


def _spoiled():
    c = F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("e t"), F.lit("e­ t"))
    return F.replace(c, F.lit("an "), F.lit("a-\nn "))


def _digest(c):
    return F.md5(c.cast("binary")).alias("digest")


# --- functions of one text -------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS digest FROM documents")
def token_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", _digest(T.token_norm("text")))


@query("SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), '-', ''), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def content_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", _digest(T.content_norm("text")))


@query("SELECT doc_id, md5(replace(replace(replace(text, 'st', 'ﬆ'), 'ﬆ', 'st'), 'ﬁ', 'fi')) AS digest, length(replace(replace(text, 'ff', 'ﬀ'), 'ﬀ', "
    "'ff')) AS n_chars FROM documents")
def ligature_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligatures that stand for several letters, read as these."""
    d = _documents(spark, sf_dir)
    st, ff = F.replace("text", F.lit("st"), F.lit("ﬆ")), F.replace("text", F.lit("ff"), F.lit("ﬀ"))
    return d.select("doc_id", _digest(T.spell_ligatures(st)), F.length(T.spell_ligatures(ff)).cast("long").alias("n_chars"))


@query(
    f"""WITH d AS (SELECT doc_id, {_COLLAPSE.format("replace(replace(text, '. ', '.'), ' w', chr(10) || ' 7.5w')")} AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '([\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}])\\.(\\p{{Nd}})', '\\1. \\2', 'g')) AS digest FROM d"""
)
def expanded_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that results are checked in: ligatures read as their letters, full stops parted from digits."""
    c = F.replace(F.replace("text", F.lit(". "), F.lit(".")), F.lit(" w"), F.lit("\n 7.5w"))
    for letters, ligature in (("ffi", "ﬃ"), ("ffl", "ﬄ"), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ")):
        c = F.replace(c, F.lit(letters), F.lit(ligature))
    return _documents(spark, sf_dir).select("doc_id", _digest(T.expanded(c)))


@query(
    f"""WITH d AS (SELECT doc_id, {_COLLAPSE.format("replace(replace(text, '. ', '.'), ' w', chr(10) || ' 7.5w')")} AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '([\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}])\\.(\\p{{Nd}})', '\\1. \\2', 'g'), '\\.([A-Z])', '. \\1',
 'g')) AS digest FROM d"""
)
def spacing_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.replace(F.replace("text", F.lit(". "), F.lit(".")), F.lit(" w"), F.lit("\n 7.5w"))
    return _documents(spark, sf_dir).select("doc_id", _digest(T.repair_spacing(c)))


@query(
    """WITH d AS (SELECT doc_id, replace(text, ' ', '-') AS t FROM documents)
SELECT doc_id, md5(t || '|' || replace(replace(t, 'fi', 'ﬁ'), 'fl', 'ﬂ') || '|' || replace(t, '-', chr(173)) || '|' || replace(replace(replace(t,
 '-', chr(173)), 'fi', 'ﬁ'), 'fl', 'ﬂ')) AS digest FROM d"""
)
def search_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four spellings that the prefix search tries."""
    d = _documents(spark, sf_dir).withColumn("t", F.replace("text", F.lit(" "), F.lit("-")))
    return d.select("doc_id", _digest(F.concat_ws("|", *T.search_variants("t"))))


@query("SELECT doc_id, substr(text, greatest(1, p - 40), p + 7 + 40 - greatest(1, p - 40)) AS snippet FROM (SELECT doc_id, text, "
    "CAST(1 + doc_id % 97 AS INT) AS p FROM documents)")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return d.select("doc_id", T.snippet("text", (1 + F.col("doc_id") % 97).cast("int"), F.lit(7)).alias("snippet"))


@query(
    f"""WITH d AS (SELECT doc_id, text, {_COLLAPSE.format('text')} AS n FROM documents), s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'not there'
     ELSE substr(n, 300, 80) END AS sought FROM d)
SELECT doc_id, md5(substr(text, CASE WHEN strpos(n, substr(sought, 1, 50)) > 0 THEN greatest(1, strpos(n, substr(sought, 1, 50)) - 250) ELSE 1 END,
 500)) AS digest FROM s"""
)
def learning_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands on the page around a text that no strategy found."""
    d = _documents(spark, sf_dir).withColumn("n", T.collapse("text"))
    sought = F.when(F.col("doc_id") % 3 == 0, "not there").otherwise(F.substring("n", 300, 80))
    return d.withColumn("sought", sought).select("doc_id", _digest(T.learning_context("text", "n", "sought")))


@query(
    f"""WITH d AS (SELECT doc_id, {_SPOILED} AS t FROM documents), c AS (SELECT doc_id, unnest(range(0, length(t))) AS i, unnest(string_split(t,
     '')) AS c FROM d),
n AS (SELECT *, lag(c) OVER w AS before, lead(c) OVER w AS after FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, regexp_matches(c, '[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f]') AS blank FROM n WHERE c <> chr(173) AND NOT (c = '-'
 AND coalesce(after = chr(10), false)) AND NOT (c = chr(10) AND coalesce(before = '-', false))),
r AS (SELECT *, coalesce(lag(blank) OVER w, true) AS blank_before, count_if(NOT blank) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING
 AND UNBOUNDED FOLLOWING) AS later FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM r WHERE NOT blank OR (NOT blank_before AND later > 0) GROUP BY doc_id"""
)
def index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each character of a page's normal form its place in the page: how many there are, and their sum."""
    # Unpacked from an array of one: a filter on the map would be pushed down, and every map be made twice.
    m = _documents(spark, sf_dir).select("doc_id", F.explode(F.array(maps.index_map(_spoiled()))).alias("m")).where(F.size("m") > 0)
    return m.select("doc_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x).alias("places"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'iso-8859-1' ELSE 'ascii' END AS encoding,
 CASE c_custkey % 4 WHEN 0 THEN chr(65279) || 'é ' || c_name WHEN 1 THEN 'é ' || c_name WHEN 2 THEN 'é ' || c_name ELSE 'e ' || c_name END AS text
  FROM customer"""
)
def byte_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes with a mark, in UTF-8, Latin-1 and ASCII: the encoding told, and the text read with a fallback."""
    k, name = F.col("c_custkey") % 4, F.col("c_name").cast("binary")
    data = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.unhex(F.lit("C3A920")), name)).when(k == 1,
        F.concat(F.unhex(F.lit("C3A920")), name)).when(k == 2, F.concat(F.unhex(F.lit("E920")), name)).otherwise(F.concat(F.unhex(F.lit("6520")), name))
    return I.table(spark, sf_dir, "customer").select("c_custkey", similarity.detect_encoding(data).alias("encoding"),
        similarity.decode_with_fallback(data).alias("text"))


# --- pages of words --------------------------------------------------------------------------------------------------


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as they are printed: the first of a line may end in a comma, its second in a hyphen, and every fourth has a ligature."""
    n = F.col("ord") % 4
    w = I.words(spark, sf_dir).withColumn("_k", F.substring("word", 2, 1))
    return w.withColumn("word", F.when(n == 1, F.concat(F.lit("W"), "_k", F.lit(","))).when(n == 2,
        F.concat(F.lit("W"), "_k", F.lit("-"))).when(n == 0, F.concat(F.lit("Wﬁ"), "_k")).otherwise(F.concat(F.lit("W"), "_k"))).drop("_k")


PRINTED_SQL = f"""SELECT * EXCLUDE (word), substr(word, 2, 1) AS k, 'W' || CASE WHEN ord % 4 = 0 THEN 'ﬁ' ELSE '' END || substr(word, 2, 1) ||
 CASE ord % 4 WHEN 1 THEN ',' WHEN 2 THEN '-' ELSE '' END AS word,
 count(*) OVER (PARTITION BY book_id) AS n_words FROM ({I.WORDS_SQL})"""


@query(f"WITH w AS ({PRINTED_SQL}), l AS (SELECT book_id, line, string_agg(word, ' ' ORDER BY ord) AS t FROM w GROUP BY book_id, "
    f"line) SELECT book_id, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY book_id")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source.page_text(printed(spark, sf_dir)).select("book_id", "text")


@query(
    f"""WITH w AS ({PRINTED_SQL}), c AS (SELECT book_id, ord, x0, x1, y0, length(word) AS n, unnest(range(0, length(word))) AS i FROM w)
SELECT book_id, count(*) AS n_chars, round(sum(x0 + i * (x1 - x0) / n), 4) AS lefts, round(sum(CASE WHEN i + 1 = n THEN x1
 ELSE x0 + (i + 1) * (x1 - x0) / n END), 4) AS rights, sum(y0) AS tops FROM c GROUP BY book_id"""
)
def page_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters with boxes of their own; white space has none."""
    c = page_source.page_chars(printed(spark, sf_dir)).select("book_id", F.explode("chars").alias("c")).where("c.box IS NOT NULL")
    return c.groupBy("book_id").agg(F.count("*").alias("n_chars"), F.round(F.sum("c.box.x0"), 4).alias("lefts"),
        F.round(F.sum("c.box.x1"), 4).alias("rights"), F.sum("c.box.y0").alias("tops"))


@query(f"WITH w AS ({PRINTED_SQL}) SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY line) - 1 AS INT) AS i, round(min(x0), "
    f"6) AS x0, min(y0) AS y0, round(max(x1), 6) AS x1, max(y1) AS y1 FROM w GROUP BY book_id, line")
def lines_of_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's characters, broken into lines again."""
    c = page_source.page_chars(printed(spark, sf_dir)).select("book_id", F.posexplode(page_source.boxes_to_lines(F.col("chars"))).alias("i", "r"))
    return c.select("book_id", "i", F.round("r.x0", 6).alias("x0"), "r.y0", F.round("r.x1", 6).alias("x1"), "r.y1")


@query("SELECT l_orderkey, l_linenumber, unnest(range(0, l_linenumber)) AS i, round(l_quantity + unnest(range(0, "
    "l_linenumber)) * 30e0 / l_linenumber, 6) AS x0, round(l_quantity + (unnest(range(0, l_linenumber)) + 1) * 30e0 / l_linenumber, 6) AS x1 FROM lineitem")
def span_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span's box cut into boxes of equal width."""
    r = G.rect(F.col("l_quantity"), F.lit(0), F.col("l_quantity") + 30, F.lit(10))
    c = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(G.char_boxes(r, F.col("l_linenumber"))).alias("i", "r"))
    return c.select("l_orderkey", "l_linenumber", F.col("i").cast("long").alias("i"), F.round("r.x0", 6).alias("x0"), F.round("r.x1", 6).alias("x1"))


@query(
    f"""WITH w AS ({PRINTED_SQL}) SELECT book_id, string_agg(word, ' ' ORDER BY ord) AS text FROM w
WHERE x0 < 160 AND x1 > 40 AND y0 < 30 AND y1 > 5 GROUP BY book_id"""
)
def text_in_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = printed(spark, sf_dir)
    rects = w.select("book_id", "page").distinct().withColumn("rect", G.rect(F.lit(40), F.lit(5), F.lit(160), F.lit(30)))
    return page_source.text_in_rect(w, rects).select("book_id", "text")


@query(
    f"""WITH w AS ({PRINTED_SQL}), f AS (SELECT book_id, arg_min(k, ord) AS k FROM w GROUP BY book_id),
hit AS (SELECT w.book_id, ord, (x1 - x0) * CASE WHEN ord % 4 IN (1, 2) THEN 2e0 / 3 ELSE 1 END AS width FROM w JOIN f USING (book_id) WHERE w.k = f.k
 AND (ord % 4 = 1 OR (ord % 4 = 2 AND ord = n_words)))
SELECT book_id, count(*) AS n_hits, min(ord) AS first_hit, round(sum(width), 4) AS width FROM hit GROUP BY book_id"""
)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's first word without its comma: whole words only, whatever mark follows; a word that goes on in the next line is another one."""
    w = printed(spark, sf_dir)
    phrases = w.groupBy("book_id", "page").agg(F.lower(F.substring(F.min_by("word", "ord"), 1, 2)).alias("phrase"))
    hits = page_source.search(phrases, w)
    width = F.aggregate(F.transform("rects", lambda r: r.getField("x1") - r.getField("x0")), F.lit(0.0), lambda s, x: s + x)
    return hits.groupBy("book_id").agg(F.count("*").alias("n_hits"), F.min("hit").alias("first_hit"), F.round(F.sum(width), 4).alias("width"))


@query(
    f"""WITH w AS ({PRINTED_SQL}), j AS (SELECT a.book_id, a.ord, a.k || 'W' || b.k AS joined, a.x0, a.y0, a.x1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1
 FROM w a JOIN w b ON a.book_id = b.book_id AND b.ord = a.ord + 1 WHERE a.ord % 4 = 2), f AS (SELECT book_id, arg_min(joined, ord) AS joined FROM j
  GROUP BY book_id)
SELECT j.book_id, ord AS hit, round(x0, 4) AS x0, y0, round(x1, 4) AS x1, round(bx0, 4) AS below_x0, by0 AS below_y0, round(bx1, 4) AS below_x1
 FROM j JOIN f USING (book_id, joined)"""
)
def phrase_over_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that a hyphen parts at a line's end, sought whole: one rect on each line."""
    w = printed(spark, sf_dir)
    first = w.where("ord = 2").select("book_id", "page",
        F.regexp_replace("word", "-$", "").alias("a")).join(w.where("ord = 3").select("book_id", "page", F.col("word").alias("b")), ["book_id", "page"])
    hits = page_source.search(first.select("book_id", "page", F.concat("a", "b").alias("phrase")), w)
    at = lambda i, n: F.get("rects", F.lit(i)).getField(n)
    return hits.select("book_id", "hit", F.round(at(0, "x0"), 4).alias("x0"), at(0, "y0").alias("y0"), F.round(at(0, "x1"), 4).alias("x1"),
        F.round(at(1, "x0"), 4).alias("below_x0"), at(1, "y0").alias("below_y0"), F.round(at(1, "x1"), 4).alias("below_x1"))


@query(
    f"""WITH w AS ({PRINTED_SQL}), t AS (SELECT book_id, min(k) AS k, min(ord % 4) AS kind, count(*) AS n FROM w
 WHERE x0 < 160 AND x1 > 40 AND y0 < 30 AND y1 > 5 GROUP BY book_id), h AS (SELECT w.book_id, x0, x1, y0 FROM w JOIN t USING (book_id)
 WHERE t.n = 1 AND t.kind IN (0, 1) AND w.ord % 4 = t.kind AND w.k = t.k)
SELECT book_id, count(*) AS n_rects, round(sum(x1 - x0), 4) AS width, min(y0) AS top FROM h GROUP BY book_id"""
)
def text_under_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rect's text sought on its own page: rects that hold a single word with a comma or a ligature, and where else that stands."""
    w = printed(spark, sf_dir)
    rects = w.select("book_id", "page").distinct().withColumn("rect", G.rect(F.lit(40), F.lit(5), F.lit(160), F.lit(30)))
    under = page_source.text_in_rect(w, rects).where("text NOT LIKE '% %' AND (text LIKE '%,' OR text LIKE '%ﬁ%')")
    r = page_source.search(under, w, phrase="text").select("book_id", F.explode("rects").alias("r"))
    return r.groupBy("book_id").agg(F.count("*").alias("n_rects"), F.round(F.sum(F.col("r.x1") - F.col("r.x0")), 4).alias("width"), F.min("r.y0").alias("top"))


# --- clippings on pages ----------------------------------------------------------------------------------------------


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clipping a page, by the order's number: words as printed, a word over a line's end, a ligature spelled out, one folded,
     or five words with rubbish after them."""
    w = printed(spark, sf_dir).where("ord <= 5").groupBy("book_id",
        "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x.getField("word")).alias("w"))
    kind, word = F.col("book_id").cast("long") % 5, lambda i: F.get("w", F.lit(i))
    content = (
        F.when(kind == 0, F.concat_ws(" ", word(0), word(1)))
        .when((kind == 1) & (F.size("w") >= 3), F.concat(F.regexp_replace(word(1), "-$", ""), word(2)))
        .when((kind == 2) & (F.size("w") >= 4), F.replace(word(3), F.lit("ﬁ"), F.lit("fi")))
        .when((kind == 3) & (F.size("w") >= 4), F.replace(word(3), F.lit("ﬁ"), F.lit("f")))
        .when((kind == 4) & (F.size("w") >= 5), F.concat(F.regexp_replace(F.array_join("w", " "), "- ", ""), F.lit(" zq zq zq zq zq")))
        .otherwise("nowhere to be found")
    )
    return w.select("book_id", "page", F.lit(1).cast("long").alias("ord"), content.alias("content"))


QUOTED_SQL = f"""w AS ({PRINTED_SQL}), l AS (SELECT book_id, line, string_agg(word, ' ' ORDER BY ord) AS t FROM w GROUP BY book_id, line),
 p AS (SELECT book_id, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY book_id),
v AS (SELECT book_id, CAST(book_id AS BIGINT) % 5 AS kind, list(word ORDER BY ord) AS w FROM w WHERE ord <= 5 GROUP BY book_id),
q AS (SELECT book_id, kind, CASE WHEN kind = 0 THEN CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[2] ELSE w[1] END WHEN kind = 1
 AND len(w) >= 3 THEN regexp_replace(w[2], '-$', '') || w[3] WHEN kind = 2 AND len(w) >= 4 THEN replace(w[4], 'ﬁ', 'fi')
 WHEN kind = 3 AND len(w) >= 4 THEN replace(w[4], 'ﬁ', 'f') WHEN kind = 4 AND len(w) >= 5 THEN replace(array_to_string(w, ' '), '- ',
  '') || ' zq zq zq zq zq' ELSE 'nowhere to be found' END AS content FROM v),
n AS (SELECT book_id, kind, content, lower({_COLLAPSE.format('text')}) AS flat,
 {_COLLAPSE.format("replace(translate(text, 'ﬁ', 'f'), '-' || chr(10), '')")} AS norm, translate(content, 'ﬁ', 'f') AS wanted FROM q JOIN p USING (book_id)),
e AS (SELECT *, CASE WHEN strpos(flat, lower(content)) > 0 THEN strpos(flat, lower(content)) ELSE strpos(flat, lower(replace(replace(content, 'fi',
 'ﬁ'), 'fl', 'ﬂ'))) END AS e, strpos(norm, wanted) AS n, string_split(wanted, ' ') AS ws FROM n),
m AS (SELECT *, CASE WHEN e > 0 OR n > 0 THEN NULL WHEN len(ws) > 7 AND contains(norm, array_to_string(ws[:7], ' ')) THEN array_to_string(ws[:7],
 ' ') WHEN len(ws) > 5 AND contains(norm, array_to_string(ws[:5], ' ')) THEN array_to_string(ws[:5], ' ') END AS five FROM e)"""


@query(
    f"""WITH {QUOTED_SQL} SELECT book_id, CASE WHEN e > 0 THEN 'exact' WHEN n > 0 THEN 'normalised' WHEN five IS NOT NULL THEN 'prefix' END AS strategy,
 CASE WHEN e > 0 THEN content WHEN n > 0 THEN wanted ELSE five END AS matched_text, CAST(CASE WHEN e > 0 THEN e WHEN n > 0 THEN n
  WHEN five IS NOT NULL THEN strpos(norm, five) END AS INT) AS start FROM m"""
)
def match_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which strategy finds each clipping on its page, and where."""
    pages = page_source.page_text(printed(spark, sf_dir))
    return matching.match(quotations(spark, sf_dir), pages, "book_id", "page", "ord").select("book_id", "strategy", "matched_text", "start")


@query(
    f"""WITH {QUOTED_SQL}, b AS (SELECT w.book_id, w.ord, w.x0, w.x1, w.y0, w.k, v.kind, len(v.w) AS size, v.w FROM w JOIN v USING (book_id)),
two AS (SELECT a.book_id, a.ord, a.x0 AS ax0, a.x1 AS ax1, b.x0 AS bx0, b.x1 AS bx1, a.k || 'W' || b.k AS joined FROM b a
 JOIN b b ON a.book_id = b.book_id AND b.ord = a.ord + 1 WHERE a.ord % 4 = 2 AND a.kind = 1 AND a.size >= 3),
r AS (SELECT t.book_id, t.ax1 - t.ax0 AS width FROM two t JOIN two f ON f.book_id = t.book_id AND f.ord = 2 AND t.joined = f.joined UNION ALL
 SELECT t.book_id, t.bx1 - t.bx0 FROM two t JOIN two f ON f.book_id = t.book_id AND f.ord = 2 AND t.joined = f.joined
 UNION ALL SELECT a.book_id, a.x1 - a.x0 FROM b a JOIN b f ON f.book_id = a.book_id AND f.ord = 4 AND a.ord % 4 = 0 AND a.k = f.k WHERE a.kind IN (2,
  3) AND a.size >= 4)
SELECT book_id, count(*) AS n_rects, round(sum(width), 4) AS width FROM r GROUP BY book_id"""
)
def normalised_match_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rects of clippings that agree with their page only in normal form, mapped back to the page's characters: over line ends, and through ligatures."""
    w = printed(spark, sf_dir)
    found = matching.match(quotations(spark, sf_dir).where("CAST(book_id AS BIGINT) % 5 IN (1, 2, 3) AND content <> 'nowhere to be found'"),
        page_source.page_text(w), "book_id", "page", "ord").where("strategy IS NOT NULL")
    placed = matching.locate(cut(found), w, "book_id", "page", "ord")
    width = F.aggregate(F.transform("rects", lambda r: r.getField("x1") - r.getField("x0")), F.lit(0.0), lambda s, x: s + x)
    return placed.select("book_id", F.size("rects").cast("long").alias("n_rects"), F.round(width, 4).alias("width"))


@query(
    f"""WITH {QUOTED_SQL} SELECT m.content AS original_clipping, m.content AS expected_search_text, substr(p.text, 1, 500) AS pdf_context,
     1 AS page_number, m.book_id AS book_name FROM m JOIN p USING (book_id) WHERE e = 0 AND n = 0 AND five IS NULL"""
)
def learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clippings that no strategy finds, with the beginning of their page."""
    pages, clips = page_source.page_text(printed(spark, sf_dir)), quotations(spark, sf_dir)
    return matching.unmatched(clips, pages, matching.match(clips, pages, "book_id", "page", "ord"), "book_id", "page", "ord")


@query(
    """WITH r AS (SELECT l_suppkey AS b, l_linenumber AS page, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN ''
     ELSE 'text ' || (l_partkey % 9) END AS content, CASE WHEN l_linenumber % 3 = 0 THEN 'Text  ' || (l_partkey % 7) END AS hc FROM lineitem),
k AS (SELECT b, page, min(ord) AS row_ord, CASE WHEN coalesce(hc, '') <> '' THEN 'Text ' || substr(hc, 7) ELSE content END AS key FROM r GROUP BY b,
 page, CASE WHEN coalesce(hc, '') <> '' THEN 'Text ' || substr(hc, 7) ELSE content END),
c AS (SELECT DISTINCT l_suppkey AS b, l_linenumber AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'text '
 ELSE 'Text ' END || (l_partkey % 9) AS content FROM lineitem)
SELECT CAST(c.b AS VARCHAR) AS book_id, CAST(c.page AS INT) AS page, content, row_ord FROM c JOIN k ON c.b = k.b AND c.page = k.page AND c.content = k.key"""
)
def attach_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results met with the first row of their page that has the same text; a unified note is known by its highlight's text."""
    li = I.table(spark, sf_dir, "lineitem").withColumns({"book_id": F.col("l_suppkey").cast("string"), "page": F.col("l_linenumber").cast("int")})
    number = lambda m: (F.col("l_partkey") % m).cast("string")
    rows = li.select(
        "book_id", "page", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
            F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("text "), number(9))).alias("content"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Text  "), number(7))).alias("highlight_content"),
    )
    results = li.select("book_id", "page", F.concat(F.when(F.col("l_linenumber") % 2 == 0, "text ").otherwise("Text "), number(9)).alias("content")).distinct()
    return matching.attach_by_content(rows, results).select("book_id", "page", "content", "row_ord")


# --- tokens ----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH w AS ({PRINTED_SQL}), t AS (SELECT book_id, ord, unnest(CASE WHEN ord % 4 = 1 THEN ['w' || k, ','] WHEN ord % 4 = 2 THEN ['w' || k, '-']
     WHEN ord % 4 = 0 THEN ['wﬁ' || k] ELSE ['w' || k] END) AS tok, unnest(CASE WHEN ord % 4 IN (1, 2) THEN [0, 1] ELSE [0] END) AS part FROM w),
i AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord, part) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n FROM t),
 g AS (SELECT book_id, list(tok ORDER BY i) AS toks FROM i GROUP BY book_id),
c AS (SELECT book_id, toks, toks[2:5] || ['zz'] AS target FROM g WHERE len(toks) >= 5), s AS (SELECT book_id, unnest([5, 4, 3]) AS size, toks, target FROM c),
p AS (SELECT book_id, size, unnest(range(0, len(toks) - size + 1)) AS start, toks, target FROM s WHERE len(toks) >= size),
q AS (SELECT book_id, size, start, len(list_filter(range(1, size + 1), lambda x: toks[start + x] = target[x])) / 5.0::DOUBLE AS score FROM p)
SELECT book_id, arg_min(size, struct_pack(s := -size, a := start)) AS size, CAST(arg_min(start, struct_pack(s := -size,
 a := start)) AS INT) AS start, arg_min(score, struct_pack(s := -size, a := start)) AS score FROM q WHERE score >= 0.8 GROUP BY book_id"""
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tokens of a page and a fifth that isn't there: the first window that agrees in four of five."""
    pages, _ = stored(page_source.page_text(printed(spark, sf_dir)))  # read twice, so that words are put in order once
    content = F.concat(F.array_join(F.slice("_t", 2, 4), " "), F.lit(" zz"))
    target = pages.select("book_id", "page", T.tokenize("text").alias("_t")).select("book_id", "page",
        F.explode(F.when(F.size("_t") >= 5, F.array(content))).alias("content"))
    return tokens.token_windows(target, pages).select("book_id", "size", "start", "score")


@query(
    f"""WITH w AS ({PRINTED_SQL}), t AS (SELECT book_id, ord, 'w' || k AS t, n_words FROM w), g AS (SELECT book_id, n_words, list(t
     ORDER BY ord) AS ts FROM t GROUP BY book_id, n_words),
p AS (SELECT book_id, n_words, ts, CASE WHEN n_words > 1 THEN ts[2:6] ELSE ts[1:1] END AS probe, unnest(range(0, n_words)) AS s FROM g),
m AS (SELECT book_id, n_words, s, len(probe) AS n_probe, CASE WHEN n_words > 1 THEN n_words - 1 ELSE 1 END AS n_all, len(list_filter(range(1,
 len(probe) + 1), lambda x: s + x <= len(ts) AND ts[s + x] = probe[x])) AS hit FROM p)
SELECT book_id, CAST(min(s) AS INT) AS start, CAST(least(min(s) + any_value(n_all) - 1, any_value(n_words) - 1) AS INT) AS last FROM m
 WHERE hit >= least(3, n_probe) GROUP BY book_id"""
)
def word_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that begin with a page's second word: where three of five words agree first, and their estimated last word."""
    w = printed(spark, sf_dir)
    words = w.groupBy("book_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x.getField("word")).alias("w"))
    contents = words.select("book_id", "page",
        F.array_join(F.when(F.size("w") > 1, F.slice("w", F.lit(2), F.size("w") - 1)).otherwise(F.col("w")), " ").alias("content"))
    return tokens.word_sequences(contents, w).select("book_id", F.col("start").cast("int").alias("start"), F.col("last").cast("int").alias("last"))


@query(
    f"""WITH d AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), '-', ''), '[^a-z0-9]+', ' ', 'g')) AS page,
     trim(regexp_replace(replace(lower(substr(text, 60, 40)), '-', ''), '[^a-z0-9]+', ' ', 'g')) AS c FROM documents)
SELECT doc_id, strpos(page, c) AS at, length(c) AS length FROM d WHERE c <> '' AND strpos(page, c) > 0"""
)
def content_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a text found in it when only letters and digits count."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("book_id"), F.lit(0).alias("page"), "text")
    spans = tokens.content_spans(d.select("book_id", "page", F.substring("text", 60, 40).alias("content")), d)
    return spans.select(F.col("book_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("at"), F.col("length").cast("long").alias("length"))


@query(
    f"""WITH w AS ({PRINTED_SQL}), b AS (SELECT book_id, min(x0) AS l, max(x1) AS r, max(CASE WHEN ord = 1 THEN x0 END) AS a0,
 max(CASE WHEN ord = 1 THEN x0 + 2 * (x1 - x0) / 3 END) AS a1, max(CASE WHEN ord = 2 THEN x0 END) AS b0, max(CASE WHEN ord = 3 THEN x1 END) AS c1,
 max(CASE WHEN ord = 3 THEN y0 END) AS y, CAST(book_id AS BIGINT) % 2 AS kind FROM w GROUP BY book_id)
SELECT book_id, 1 AS i, round(CASE kind WHEN 0 THEN b0 ELSE a0 END, 4) AS x0, round(CASE kind WHEN 0 THEN r ELSE a1 END, 4) AS x1, 0e0 AS y0 FROM b WHERE kind = 1 OR c1 IS NOT NULL
UNION ALL SELECT book_id, 2, round(l, 4), round(c1, 4), y FROM b WHERE kind = 0 AND c1 IS NOT NULL"""
)
def content_span_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rects of contents found by their letters and digits: a page's second and third word, which a hyphen joins over the line's end, or its first one without its comma."""
    w = printed(spark, sf_dir)
    c = w.where("ord <= 3").groupBy("book_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "word"))), lambda x: x.getField("word")).alias("w"))
    content = F.when(F.col("book_id").cast("long") % 2 == 1, F.regexp_replace(F.get("w", F.lit(0)), ",", "!")).otherwise(F.concat(F.get("w", F.lit(1)), F.get("w", F.lit(2))))
    spans = tokens.content_span_words(c.select("book_id", "page", content.alias("content")), w)
    r = rects.from_words(spans, w).select("book_id", F.posexplode("rects").alias("i", "r"))
    return r.select("book_id", (F.col("i") + 1).alias("i"), F.round("r.x0", 4).alias("x0"), F.round("r.x1", 4).alias("x1"), F.col("r.y0").alias("y0"))


@query(
    f"""WITH w AS ({PRINTED_SQL}), r AS (SELECT * FROM w WHERE ord IN (2, least(4, n_words)) AND n_words >= 2)
SELECT book_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r GROUP BY book_id"""
)
def window_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box over the first and last word of a window of words."""
    w = printed(spark, sf_dir)
    windows = w.groupBy("book_id", "page").agg(F.count("*").cast("int").alias("n")).where("n >= 2").select("book_id", "page",
        F.lit(1).alias("start"), F.least(F.lit(3), F.col("n") - 1).alias("size"))
    return tokens.token_rect(windows, w).select("book_id", *[F.col(f"r.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")])
