"""WARC archives of pages, and the external merge of their capture indexes.

Writing: every page becomes one gzip member holding one record. Of pages with equal payloads the one with the smallest
page_id is a ``response``, the others are ``revisit`` records that refer to it and carry no payload. A page whose batch
holds its payload with a smaller page_id is a revisit for sure, so its payload goes no further, however often it occurs.
Which other pages revisit is told by a join on the digest: with a broadcast where the shared digests are few by count,
else in a shuffle. An archive is a row of members one behind the other, cut at ``FILE_BYTES`` or ``FILE_RECORDS``; Spark's
text writer passes its bytes on, one row a file (and an empty gzip member as line end), to any store Spark knows. Every
digest is checked on reading back.

Indexing: archives are read back record by record; every file gives a run of captures, sorted locally. Captures are
dealt by ranges of (URL key, time, page_id) of about ``RANGE_ROWS`` captures, so one URL with very many captures is split
too, and each range merges its runs with a loser tree: the result is globally ordered, and no task holds more than a range.

Defined results: a null html is an empty payload; repeated smallest page_ids are all responses; a null page_id revisits
the smallest id of its payload (a response if there is none); a null URL has an empty key; an empty table gives an empty
archive folder and no rows; payloads are never cut, a page larger than an archive has one of its own; extra columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, cut, prepare, remove_folder, shuffle_count, table
from .url_filter import canonical

#: Captures without a time of their own are dated from here, one second for each page_id.
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
FILE_BYTES, FILE_RECORDS = 32 << 20, 50_000
#: Shared digests that are broadcast at most; beyond that they are joined in a shuffle.
BROADCAST_DIGESTS = 200_000
RANGE_ROWS = 200_000
#: Captures that a merge holds as Python tuples, over all its runs.
HEADS = 50_000
LEVEL = 4
FEED = 1 << 16
INDEX = "page_id long, url string, urlkey string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY_MEMBER = member(b"")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The URL with its host's labels turned round, so captures of a host's subdomains sort together."""
    host, _ = canonical(url)
    if not host:
        return (url or "").lower()
    rest = url.partition("://")[2][len(host) :]
    return ",".join(reversed(host.split("."))) + ")" + rest


def record(kind: str, page_id: int | None, url: str | None, captured: str, digest: str, payload: bytes | None, size: int,
    refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; ``size`` is that of the full payload."""
    one_line = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {captured}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {one_line(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    body = payload or b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, fed in small pieces so long archives aren't copied again and again."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, parts, read = zlib.decompressobj(31), [], at
        while not d.eof:
            if read >= len(data):
                raise ValueError("an archive ends inside a record")
            parts.append(d.decompress(view[read : read + FEED]))
            read = min(read + FEED, len(data))
        end = read - len(d.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and the block of a record; its length is checked."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.lower()] = value.strip()
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block doesn't have its stated length")
    return headers, rest[:n]


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so the next winner costs one path of log k matches."""

    def __init__(self, runs: Sequence[Iterator]) -> None:
        self.runs, k = list(runs), max(1, len(runs))
        self.k = k
        self.head = [next(r, None) for r in self.runs] + [None] * (k - len(runs))
        self.tree = [-1] * k
        for leaf in range(k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None if x is not None and y is None else x is not None and y is not None and (x[0], a) < (y[0], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return  # waits here for its opponent
            if self._less(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (item := self.head[self.tree[0]]) is not None:
            yield item
            leaf = self.tree[0]
            self.head[leaf] = next(self.runs[leaf], None)
            winner, node = leaf, (leaf + self.k) // 2
            while node > 0:
                if self._less(self.tree[node], winner):
                    winner, self.tree[node] = self.tree[node], winner
                node //= 2
            self.tree[0] = winner


def _text(value) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def _captured(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _responses(revisit_bytes: int):
    """(page_id, url, size, digest, gz) of each page; gz is null where the batch itself shows that the page is a revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, htmls = (b.column(i).to_pylist() for i in range(3))
            payloads = [_text(h) for h in htmls]
            digest = [payload_digest(p) for p in payloads]
            least: dict[str, int] = {}
            for i, d, p in zip(ids, digest, payloads, strict=True):
                if i is not None and len(p) >= revisit_bytes:
                    least[d] = min(i, least.get(d, i))
            again = [d in least and (i is None or least[d] < i) and len(p) >= revisit_bytes for i, d, p in zip(ids, digest, payloads, strict=True)]
            gz = [None if a else member(record("response", i, u, _captured(i), d, p, len(p))) for i, u, d, p,
                a in zip(ids, urls, digest, payloads, again, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(p) for p in payloads], pa.int64()),
                pa.array(digest, pa.string()), pa.array(gz, pa.binary())], names=["page_id", "url", "size", "digest", "gz"])

    return run


def _archives(file_bytes: int, file_records: int):
    """One row for each archive: its members one behind the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["gz"])

        for b in batches:
            for i, u, n, digest, gz, first in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if first is not None and first != i:
                    gz = member(record("revisit", i, u, _captured(i), digest, None, n, first))
                elif gz is None:
                    raise ValueError(f"page {i} is a revisit in its batch and a response in the join")
                if held and (size + len(gz) > file_bytes or len(held) == file_records):
                    yield full()
                    held, size = [], 0
                held.append(gz)
                size += len(gz)
        if held:
            yield full()

    return run


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 0) -> None:
    """Write one record for each row (page_id, url, html) under ``folder``. Payloads under ``revisit_bytes`` are never revisits."""
    spark = prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    hexes = (
        rows.where(F.length(raw) >= revisit_bytes).groupBy(F.sha1(raw).alias("hex"))
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 AND first IS NOT NULL").select("hex", "first")
    )
    five = [F.lpad(F.conv(F.substring("hex", 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    shared = cut(hexes.select(F.translate(F.concat(*five), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567").alias("_digest"), "first"))
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    made = rows.mapInArrow(_responses(revisit_bytes), "page_id long, url string, size long, digest string, gz binary")
    chosen = made.join(shared, F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "size", "digest", "gz", "first")
    text = chosen.mapInArrow(_archives(FILE_BYTES, FILE_RECORDS), "gz binary").select(F.col("gz").cast("string").alias("value"))
    text.write.mode("overwrite").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(folder)
    spark.catalog.refreshByPath(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split(" ")[1]] for f in INDEX.split(", ")]

    def number(text: str) -> int | None:
        digits = text.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows: list[tuple] = []
            for offset, length, data in members(content.as_buffer()):
                if not data:
                    continue
                h, block = parse(data)
                digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                if kind == "response" and (payload_digest(block) != digest or len(block) != int(h["x-payload-length"])):
                    raise ValueError(f"{path} at {offset}: the payload isn't what its header says")
                url = h.get("warc-target-uri")
                refers = number(h["warc-refers-to"]) if "warc-refers-to" in h else None
                rows.append((number(h["warc-record-id"]), url, url_key(url), h["warc-date"], kind, int(h["x-payload-length"]), digest, refers, path,
                    offset, length))
            rows.sort(key=lambda r: (r[2], r[3], r[0] is None, r[0] or 0))
            for s in range(0, len(rows), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 5_000], strict=True), types, strict=True)], names=names)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives under ``folder``: each file's rows are a run sorted by (urlkey, captured, page_id)."""
    prepare(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content").mapInArrow(_read, INDEX)


def _merge(heads: int):
    """Rows of a range arrive run by run and stay as they came; the tree's heads are taken from them a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, runs, last = None, [], object()
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            files = b.column("file").to_pylist()
            start = 0
            for i in range(1, len(files) + 1):
                if i == len(files) or files[i] != files[start]:
                    if files[start] != last:
                        runs.append([])
                        last = files[start]
                    runs[-1].append(b.slice(start, i - start))
                    start = i
        if schema is None:
            return
        step = max(8, heads // len(runs))

        def rows(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
            for part in parts:
                for s in range(0, part.num_rows, step):
                    for r in zip(*(c.to_pylist() for c in part.slice(s, step).columns), strict=True):
                        yield (r[2], r[3], r[0] is None, r[0] or 0), r

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        held: list[tuple] = []
        for _, r in LoserTree([rows(x) for x in runs]):
            held.append(r)
            if len(held) == 5_000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return run


def merge_index(runs: DataFrame) -> DataFrame:
    """All captures in global order of (urlkey, captured, page_id): partition after partition, and inside each."""
    runs = cut(runs)  # the ranges are drawn from what is then merged
    n = max(shuffle_count(runs.sparkSession), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(n, "urlkey", "captured", F.coalesce("page_id", F.lit(2**62)), "file", "offset")
    return dealt.sortWithinPartitions("file", "urlkey", "captured", F.col("page_id").asc_nulls_last()).mapInArrow(_merge(HEADS), INDEX)


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    index = merge_index(read_runs(spark, folder))  # its captures are written, so the archives have served
    remove_folder(spark, folder)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS hex FROM d),
b AS (SELECT page_id, payload_bytes, hex,
        list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + CAST((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest FROM x),
m AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS least FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to FROM m
"""
