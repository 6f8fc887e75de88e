"""Queries of file choices, logs, stores and exports, and the SQL they are checked against.

Queries that read files write them first, to the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations
from ..sinks import files as sinks
from ..sources import clippings as clipping_source
from ..sources import files, sidecar
from . import batches
from . import inputs as I
from .registry import query


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the store that driver and executors share."""
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


# --- listings --------------------------------------------------------------------------------------------------------

_FILES_SQL = """SELECT p || n AS path, n AS name, regexp_replace(n, '\\.[^.]*$', '') AS stem, lower(regexp_extract(n, '(\\.[^.]*)$', 1)) AS suffix,
 string_split(p || n, '/')[-2] AS parent, k, size FROM (
 SELECT s_suppkey AS k, s_suppkey * 1000 AS size, unnest(['/d/', '/d/', '/d/Book ' || s_suppkey || '.sdr/', '/d/b-o-o-k' || s_suppkey || 'pdf.sdr/',
  '/d/']) AS p, unnest(['Book ' || s_suppkey || '.pdf', 'x' || s_suppkey || '.PDS', 'n' || s_suppkey || '.pds', 'm' || s_suppkey || '.pds',
   'Book_' || s_suppkey || '_notes.pdt']) AS n FROM supplier)"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a document, a side-car folder with a store, a folder of equal normalised name, and other stores."""
    s, k = I.table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    name = lambda a, b: F.concat(F.lit(a), k, F.lit(b))
    paths = F.array(name("/d/Book ", ".pdf"), name("/d/x", ".PDS"), F.concat(name("/d/Book ", ".sdr/n"), k, F.lit(".pds")),
        F.concat(name("/d/b-o-o-k", "pdf.sdr/m"), k, F.lit(".pds")), name("/d/Book_", "_notes.pdt"))
    return files.describe(s.select(F.explode(paths).alias("path"), (F.col("s_suppkey") * 1000).alias("length"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime")))


@query(f"WITH f AS ({_FILES_SQL}) SELECT path, name, stem, regexp_extract(name, '(\\.[^.]*)$', 1) AS suffix, parent, size, "
    f"round(size / 1048576.0::DOUBLE, 2) AS size_mb FROM f")
def file_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir).select("path", "name", "stem", "suffix", "parent", "size", "size_mb")


@query(
    f"""WITH f AS ({_FILES_SQL}) SELECT 'documents' AS rule, path FROM f WHERE suffix = '.pdf' UNION ALL SELECT 'side-cars', path FROM f
     WHERE suffix IN ('.pds', '.pdt') AND (contains(name, '1') OR (ends_with(parent, '.sdr') AND contains(parent, '1')))
 UNION ALL SELECT 'reader files', path FROM f WHERE (starts_with(name, 'Book 1') OR starts_with(name, 'Book_1') OR starts_with(parent, 'Book 1')
  OR starts_with(parent, 'Book_1')) AND (suffix IN ('.pds', '.pdt') OR ends_with(parent, '.sdr'))
 UNION ALL SELECT 'one side-car', (SELECT path FROM f WHERE suffix = '.pds' ORDER BY CASE WHEN contains(name, 'Book 3') OR contains(parent,
  'Book 3') THEN 0 ELSE 1 END, path LIMIT 1)
 UNION ALL SELECT 'any side-car', (SELECT path FROM f WHERE suffix = '.pds' ORDER BY path LIMIT 1)
 UNION ALL SELECT 'a candidate', '/d/Book 2.pdf' UNION ALL SELECT 'by name', (SELECT path FROM f WHERE suffix = '.pdf' AND contains(lower(stem),
  'ook 4') ORDER BY path LIMIT 1)"""
)
def file_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that choose documents, side-cars and reader files from a listing."""
    f = _listing(spark, sf_dir)
    chosen = {
        "documents": files.list_documents(f), "side-cars": files.find_sidecars(f, "1"), "reader files": files.find_reader_files(f, "Book 1.pdf"),
            "one side-car": files.select_sidecar(f, "Book 3"), "any side-car": files.select_sidecar(f, "no such book"),
        "a candidate": files.find_document(f, ["/no/such.pdf", "/d/Book 2.pdf", "/d/Book 1.pdf"], "Book 4"),
            "by name": files.find_document(f, ["/no/such.pdf"], "OOK 4"),
    }
    out = None
    for rule, rows in chosen.items():
        rows = rows.select(F.lit(rule).alias("rule"), "path")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""WITH f AS ({_FILES_SQL}), d AS (SELECT path AS document, name, stem FROM f WHERE suffix = '.pdf' UNION ALL
     SELECT '/e/book' || n_nationkey || '.pdf', 'book' || n_nationkey || '.pdf', 'book' || n_nationkey FROM nation UNION ALL
      SELECT '/e/other ' || r_regionkey || '.pdf', 'other ' || r_regionkey || '.pdf', 'other ' || r_regionkey FROM region),
s AS (SELECT path, stem AS fs, regexp_replace(parent, '\\.sdr$', '') AS folder, ends_with(parent, '.sdr') AS sdr FROM f WHERE suffix = '.pds'),
m AS (SELECT document, path, CASE WHEN fs = stem OR folder = stem THEN 1 WHEN sdr AND regexp_replace(lower(folder), '[^a-z0-9]', '',
 'g') IN (regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(stem), '[^a-z0-9]', '', 'g')) THEN 2 END AS rule FROM d JOIN s ON true),
b AS (SELECT document, min(rule) AS best FROM m GROUP BY document) SELECT m.document, m.path, CAST(rule AS INT) AS rule, false AS first FROM m
 JOIN b ON m.document = b.document AND rule = best
 UNION ALL SELECT document, NULL, 3, false FROM b WHERE best IS NULL UNION ALL SELECT b.document, CASE WHEN best IS NULL THEN (SELECT min(path)
  FROM s) ELSE (SELECT min(path) FROM m WHERE m.document = b.document AND rule = best) END, CAST(coalesce(best, 3) AS INT), true FROM b"""
)
def sidecar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-cars of documents by three rules, and the first of each document."""
    f = _listing(spark, sf_dir)
    n = I.table(spark, sf_dir, "nation").select(F.concat(F.lit("/e/book"), F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("path"))
    r = I.table(spark, sf_dir, "region").select(F.concat(F.lit("/e/other "), F.col("r_regionkey").cast("string"), F.lit(".pdf")).alias("path"))
    more = files.describe(n.union(r).withColumns({"length": F.lit(1).cast("long"), "modificationTime": F.lit(None).cast("timestamp")}))
    pairs = files.match_sidecars(files.list_documents(f.unionByName(more)), f)
    return pairs.withColumn("first", F.lit(False)).unionByName(files.first_per_document(pairs, f).withColumn("first", F.lit(True)))


@query(
    """WITH f AS (SELECT c_nationkey AS device, c_custkey % 7 AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'file://' ELSE '' END || '/m' || c_nationkey ||
 CASE c_custkey % 7 WHEN 0 THEN '/system/My Clippings.txt' WHEN 1 THEN '/Documents/My Clippings.txt' WHEN 2 THEN '/documents/MyClippings.txt'
 WHEN 3 THEN '/documents/My Clippings.txt' ELSE '/other/My Clippings.txt' END AS path FROM customer WHERE c_custkey % 5 <> c_nationkey % 5 OR c_custkey % 7 > 3)
SELECT device, min(path) AS path FROM (SELECT device, path, rank() OVER (PARTITION BY device ORDER BY CASE kind WHEN 3 THEN 3 WHEN 2 THEN 4 WHEN 1 THEN 5
 ELSE 6 END) AS r FROM f WHERE kind < 4) WHERE r = 1 GROUP BY device"""
)
def log_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of each device: the first of the usual places that its listing has. Customers play files, their nations devices."""
    k = F.col("c_custkey") % 7
    place = F.when(k == 0, "/system/My Clippings.txt").when(k == 1, "/Documents/My Clippings.txt").when(k == 2, "/documents/MyClippings.txt").when(k == 3,
        "/documents/My Clippings.txt").otherwise("/other/My Clippings.txt")
    listed = I.table(spark, sf_dir, "customer").where((F.col("c_custkey") % 5 != F.col("c_nationkey") % 5) | (k > 3)).select(F.col("c_nationkey").alias("device"),
        F.concat(F.lit("/m"), F.col("c_nationkey").cast("string")).alias("folder"), F.when(F.col("c_custkey") % 2 == 0, "file://").otherwise("").alias("_s"), place.alias("_p"))
    return files.logs_of_devices(listed.select("device", "folder", F.concat("_s", "folder", "_p").alias("path")), "device").select("device", "path")


@query(
    "SELECT DISTINCT c_custkey, s_suppkey FROM (SELECT c_custkey, 'Report ' || (c_custkey * 7) || ' of ' || c_name AS name FROM customer) c JOIN "
    "(SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || ' of' AS part FROM supplier) s ON contains(name, part)"
)
def held_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names hold which parts, as an equi-join on the parts' beginnings."""
    from ..functions.containment import contained

    c = I.table(spark, sf_dir, "customer").select("c_custkey",
        F.concat(F.lit("Report "), (F.col("c_custkey") * 7).cast("string"), F.lit(" of "), F.col("c_name")).alias("name"))
    s = I.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.lit(" of")).alias("part"))
    return contained(c, s, "name", "part").join(c, "name").join(s, "part").select("c_custkey", "s_suppkey").distinct()


# --- logs and stores in files ----------------------------------------------------------------------------------------


@query(
    f"""WITH l AS ({I.LOGS_SQL})
SELECT 'Book ' || conv_id AS title, regexp_extract(title_line, '\\(([^)]+)\\)$', 1) AS author, lower(kind) AS type, CAST(page_no AS VARCHAR) AS page,
 '' AS location, '- Your ' || kind || ' on Page ' || page_no || ' | Added on Monday, March 4, 2024 1:02:0' || (turn % 10) || ' PM' AS raw_location_info,
 '2024-03-04T13:02:0' || (turn % 10) AS date_added, md5(array_to_string(list_transform(string_split(regexp_replace(content, '^\\s+|\\s+$', '', 'g'),
  chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), chr(10))) AS digest FROM l"""
)
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written as text files, read again in splits and parsed: all columns but the place in the log."""
    at = folder(spark, "logs")
    I.logs(spark, sf_dir).select("text").write.text(at)
    c = clipping_source.parse(clipping_source.read_records(spark, at))
    return c.select("title", "author", "type", "page", "location", "raw_location_info", "date_added", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '2024-03-04T13:02:05' WHEN 1 THEN '2024-03-04T13:02:05' WHEN 2 THEN '2024-03-04T13:02:05'
     ELSE 'some day' END AS date_added, CASE WHEN s_suppkey % 2 = 0 THEN '12-15' ELSE '' END AS location, CASE WHEN s_suppkey % 2 = 0 THEN ''
      ELSE '7' END AS page,
 'A Title ' || s_suppkey AS title, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'An Author' END AS author FROM supplier"""
)
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with all forms of date, with locations and pages, with and without an author."""
    s = I.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    date = F.when(k % 4 == 0, "Monday, March 4, 2024 at 1:02:05 PM").when(k % 4 == 1, "3/4/2024 1:02:05 PM").when(k % 4 == 2,
        "2024-03-04 13:02:05").otherwise("some day")
    author, place = F.when(k % 5 == 0, "").otherwise(" (An Author)"), F.when(k % 2 == 0, "Location 12-15").otherwise("Page 7")
    text = F.concat(F.lit("A Title "), k.cast("string"), author, F.lit("\n- Your Highlight on "), place, F.lit(" | Added on "), date,
        F.lit("\n\nbody\n==========\n"))
    return clipping_source.parse(s.select("s_suppkey", text.alias("text"))).select("s_suppkey", "date_added", "location", "page", "title", "author")


def _utf(c):
    body = c.cast("binary")
    return F.concat(F.unhex(F.lit("0300")), F.unhex(F.lpad(F.hex(F.length(body)), 4, "0")), body)


def _name(s: str):
    return F.unhex(F.lit(f"FE00{len(s):04X}" + s.encode().hex()))


def _int(n: int):
    return F.unhex(F.lit(f"01{n:08X}"))


def _cache(*classes):
    """An annotation cache of (class id, class name, array of annotation bytes, count) parts."""
    parts = [_name("annotation.cache.object"), _int(len(classes))]
    for number, rows in classes:
        parts += [_int(number), _name("saved.avl.interval.tree"), _int(len(rows)), *rows, F.unhex(F.lit("FF"))]
    return F.concat(*parts, F.unhex(F.lit("FF")))


def _annotation(kind: str, position, note=None):
    time = F.unhex(F.lit("02" + f"{1709557325000:016X}"))
    last = [_utf(note)] if note is not None else []
    return F.concat(_name(f"annotation.personal.{kind}"), _utf(position), _utf(position), time, time, _utf(F.lit("0")), *last, F.unhex(F.lit("FF")))


@query(
    """WITH k AS (SELECT s_suppkey AS k, '1 2 ' || s_suppkey || ' 4' AS p FROM supplier)
SELECT unnest(['annotation.personal.note', 'annotation.personal.highlight', 'annotation.personal.highlight',
 'annotation.personal.bookmark']) AS annotation_type, unnest([0, 1, 2, 3]) AS ord, p AS start_position, unnest(['note ' || k, NULL, NULL,
  NULL]) AS note_text, '2024-03-04T13:02:05' AS created, false AS failed FROM k WHERE k % 3 <> 0
 UNION ALL SELECT NULL, 0, NULL, NULL, NULL, true FROM k WHERE k % 3 = 0"""
)
def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-car stores as files of a folder: several classes, of two caches the last one (in the place of the first), an unknown class passed over,
     and files that end too early."""
    at = folder(spark, "stores")
    k = F.col("s_suppkey").cast("string")
    position = F.concat(F.lit("1 2 "), k, F.lit(" 4"))
    old = _cache((2, [_annotation("note", position, F.lit("an older note"))]))
    new = _cache((1, [_annotation("highlight", position)] * 2), (77, [_annotation("highlight", position)]),
        (2, [_annotation("note", position, F.concat(F.lit("note "), k))]), (0, [_annotation("bookmark", position)]))
    whole = F.concat(F.lit(sidecar.SIGNATURE), _int(1), _int(2), old, new)
    content = F.when(F.col("s_suppkey") % 3 == 0, F.substring(whole, F.lit(1), F.length(whole) - 30)).otherwise(whole)
    # Small tables are one part, and one task would write every file; the driver would move each to its place, and list each on its own.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = I.table(spark, sf_dir, "supplier").repartition(n, "s_suppkey")
    # The text writer passes bytes on as they are; what it puts at the end stands behind the store.
    dealt.select(content.cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("maxRecordsPerFile",
        1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(at)
    got = sidecar.read_sidecars(spark, at)
    return got.select("annotation_type", F.col("ord").cast("int").alias("ord"), "start_position", "note_text",
        F.date_format("creation_time", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), F.col("error").isNotNull().alias("failed"))


# --- exports ---------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'q \"' || l_returnflag || '\"' || chr(10) || 'é' END AS content, "
    "l_quantity FROM lineitem")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows exported as JSON, nulls written out, and read again."""
    at = folder(spark, "json")
    content = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('q "'), F.col("l_returnflag"), F.lit('"\né')))
    rows = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", content.alias("content"), "l_quantity")
    sinks.export_json(rows, at)
    return spark.read.schema(rows.schema).json(at)


@query("SELECT count(*) AS n, CAST(count_if(original_clipping IS NULL) AS BIGINT) AS nulls, min(expected_search_text) AS least, "
    "max(page_number) AS last_page FROM (SELECT text AS original_clipping, text AS expected_search_text, "
    "CAST(item_id % 9 + 1 AS INT) AS page_number FROM benchmark)")
def learning_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rows written as JSON and read again."""
    at = folder(spark, "learning")
    b = I.table(spark, sf_dir, "benchmark")
    rows = b.select(F.col("text").alias("original_clipping"), F.col("text").alias("expected_search_text"), F.lit("ctx").alias("pdf_context"),
        (F.col("item_id") % 9 + 1).cast("int").alias("page_number"), F.lit("b").alias("book_name"))
    sinks.export_unmatched(rows, at)
    back = spark.read.schema(rows.schema).json(at)
    return back.agg(F.count("*").alias("n"), F.count_if(F.col("original_clipping").isNull()).alias("nulls"),
        F.min("expected_search_text").alias("least"), F.max("page_number").alias("last_page"))


@query("SELECT 'b' || n_nationkey AS book_id, count(*) AS added, count(*) AS in_file FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY "
    "n_nationkey")
def command_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands written by book: how many each book got, and how many its files hold."""
    at = folder(spark, "commands")
    c = I.table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("book_id"), F.lit(0).alias("page"),
        F.col("c_custkey").alias("ord"), F.lit("note").alias("command"))
    added = sinks.write_commands(c, at)
    held = spark.read.parquet(at).groupBy("book_id").agg(F.count("*").alias("in_file"))
    return added.join(held, "book_id")


@query(
    """SELECT 'b' || n_nationkey AS book_id, count(*) AS in_file, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS run,
 max(CASE WHEN n_nationkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey END) AS last FROM nation JOIN customer ON c_nationkey = n_nationkey
 WHERE n_nationkey % 7 <> 3 GROUP BY n_nationkey"""
)
def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written in a batch, and again after some of them changed and some went: each book's rows, and the run that made them."""
    at = folder(spark, "batches")
    c = I.table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("book_id"),
        F.concat(F.lit("/in/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").alias("size"), F.lit(0).alias("modified"),
        F.col("c_nationkey").alias("nation"))
    changed = c.where("nation % 7 <> 3").withColumn("size", F.when(F.col("nation") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    for files in (c, changed):
        batches.run(batches.states(files), lambda books, files=files: files.join(books.select("book_id"), "book_id").select("book_id", "size"), at, 3)
    rows = batches.read(spark, at, batches.states(changed)).groupBy("book_id").agg(F.count("*").alias("in_file"), F.max("size").alias("last"))
    return rows.join(batches.done(spark, at).select("book_id", "run"), "book_id")


@query(
    """SELECT 'annotation.personal.note' AS annotation_type, (o_orderkey % 3 = 0) AS has_end, count(*) AS n, min('p' || o_orderkey) AS first_start,
     min(CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_orderkey ELSE 'p' || o_orderkey END) AS first_end FROM orders GROUP BY o_orderkey % 3 = 0"""
)
def json_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON form of a store, one file for each customer's orders, read from a folder."""
    at = folder(spark, "json-stores")
    k = F.col("o_orderkey").cast("string")
    a = F.struct(k.alias("text"), F.concat(F.lit("p"), k).alias("startPosition"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("e"), k)).alias("endPosition"))
    o = I.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey") % 16).agg(F.collect_list(a).alias("l"))
    text = F.to_json(F.struct(F.create_map(F.lit("annotation.personal.note"), F.col("l")).alias(sidecar.ANNOTATION_CACHE)))
    o.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    got = sidecar.read_annotations_json(spark, f"{at}/part-*")
    return got.groupBy("annotation_type", F.startswith("end_position", F.lit("e")).alias("has_end")).agg(F.count("*").alias("n"),
        F.min("start_position").alias("first_start"), F.min("end_position").alias("first_end"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS book_id, row_number() OVER (ORDER BY CAST(l_suppkey AS VARCHAR), l_linenumber, l_partkey % 700, "
    "l_orderkey) AS place, l_orderkey AS ord FROM lineitem")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which rows are exported: every row's place after the rows of the parts before it."""
    li = I.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("book_id"), F.col("l_linenumber").alias("page"),
        (F.col("l_partkey") % 700).cast("double").alias("pdf_y"), F.col("l_orderkey").alias("ord"))
    return annotations.placed(li).select("book_id", "place", "ord")
