from __future__ import annotations

import gzip
import random
from pathlib import Path

from marginalia.llm import warc as W
from marginalia.llm.common import checkpoint_folder


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((rng.randint(0, 9),), i) for _ in range(rng.randint(0, 20))) for i in range(k)]
        got = list(W.LoserTree([iter(r) for r in runs]))
        assert got == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1]))


def test_record_round_trip():
    payload = "a\r\n\r\nWARC/1.1\r\n ü".encode()
    data = W.member(W.record("response", 7, "http://x/\r\ny", "2020-01-01T00:00:07Z", W.payload_digest(payload), payload, len(payload))) + W.EMPTY_MEMBER
    found = [(o, n, c) for o, n, c in W.members(data) if c]
    headers, block = W.parse(found[0][2])
    assert block == payload and headers["warc-record-id"] == "<urn:page:7>" and gzip.decompress(data[: found[0][1]]) == found[0][2]


def test_revisits_order_and_edge_cases(spark):
    rows = [(5, "http://b.com/1", "same"), (3, "http://a.com/1", "same"), (9, None, "same"), (1, "http://x.b.com/2", None),
        (2, "http://b.com/2", ""), (4, "http://b.com/1", "x" * 200_000), (None, "http://c.com", "same"), (6, "q", "<p>é\n==</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first").repartition(3)
    folder = f"{checkpoint_folder(spark)}/test-warc"
    W.write_archives(df, folder)
    merged = W.merge_index(W.read_runs(spark, folder))
    got = {r.page_id: r for r in merged.collect()}
    assert len(got) == 8
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), None: ("revisit", 3), 1: ("response", None), 2: ("revisit", 1),
            4: ("response", None), 6: ("response", None),
    }
    assert got[4].payload_bytes == 200_000 and got[5].payload_digest == W.payload_digest(b"same") and got[1].payload_bytes == 0
    order = [(r.urlkey, r.captured) for r in merged.collect()]
    assert order == sorted(order)
    files = list(Path(folder.removeprefix("file:")).glob("part-*"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: response") for f in files) == 4


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"{checkpoint_folder(spark)}/test-warc-empty"
    W.write_archives(df, folder)
    assert W.merge_index(W.read_runs(spark, folder)).count() == 0


def test_small_payloads_need_not_revisit(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    folder = f"{checkpoint_folder(spark)}/test-warc-small"
    W.write_archives(df, folder, revisit_bytes=5)
    assert {r.page_id: r.record_type for r in W.read_runs(spark, folder).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archives_are_cut_by_bytes(spark, monkeypatch):
    """Pages of 5 MB that don't compress: no archive holds more than the bound or one record, and all come back whole."""
    monkeypatch.setattr(W, "FILE_BYTES", 8 << 20)
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", rng.randbytes(2_500_000).hex() if i < 4 else "small") for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    folder = f"{checkpoint_folder(spark)}/test-warc-bytes"
    W.write_archives(df, folder)
    sizes = sorted(f.stat().st_size for f in Path(folder.removeprefix("file:")).glob("part-*"))
    assert len(sizes) == 2 and sizes[-1] < (8 << 20) and sum(sizes) > 4 * 2_500_000
    got = {r.page_id: r for r in W.read_runs(spark, folder).collect()}
    for i, _, html in pages:
        assert got[i].payload_digest == W.payload_digest(html.encode()) and got[i].payload_bytes == len(html)


def test_bytes_pass_the_text_writer(spark):
    """Loud if Spark's text writer ever touched the bytes: every file is its members and the empty one, byte for byte."""
    rng = random.Random(3)
    html = ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(3000)) for _ in range(40)]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    folder = f"{checkpoint_folder(spark)}/test-warc-raw"
    W.write_archives(df, folder)
    (file,) = Path(folder.removeprefix("file:")).glob("part-*")
    expected = b"".join(W.member(W.record("response", i, "u", W._captured(i), W.payload_digest(h.encode()), h.encode(), len(h.encode()))) for i,
        h in enumerate(html))
    assert file.read_bytes() == expected + W.EMPTY_MEMBER and set(expected) == set(range(256))


def test_payloads_are_dropped_early_and_joined_either_way(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(200) if rng.random() < 0.9 else None, f"http://h/{i % 7}", f"text {rng.choice([0, 0, 0, 1, 2, i])}") for i in range(300)]
    rows = list({(i, h): (i, u, h) for i, u, h in rows}.values())
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h] = min(i, least.get(h, i))
    count = {h: sum(x[2] == h for x in rows) for _, _, h in rows}
    expected = sorted((str(i), "revisit" if count[h] > 1 and h in least and least[h] != i else "response",
        str(least[h]) if count[h] > 1 and h in least and least[h] != i else "None") for i, _, h in rows)
    for limit in (200_000, 0):
        monkeypatch.setattr(W, "BROADCAST_DIGESTS", limit)
        folder = f"{checkpoint_folder(spark)}/test-warc-join-{limit}"
        W.write_archives(df, folder)
        assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in W.read_runs(spark, folder).collect()) == expected


def test_merge_is_a_global_sort(spark, monkeypatch):
    """Many files of one hot URL and others, small ranges and few heads: the order is that of a plain sort."""
    monkeypatch.setattr(W, "RANGE_ROWS", 40)
    monkeypatch.setattr(W, "HEADS", 30)
    monkeypatch.setattr(W, "FILE_RECORDS", 17)
    rng = random.Random(8)
    rows = [(i if i % 50 else None, rng.choice(["http://hot.com/", "http://hot.com/", f"http://h{i % 9}.org/{i % 3}", None]), str(i)) for i in range(500)]
    folder = f"{checkpoint_folder(spark)}/test-warc-sort"
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), folder)
    merged = W.merge_index(W.read_runs(spark, folder))
    assert merged.rdd.getNumPartitions() >= 13
    got = [(r.urlkey, r.captured, r.page_id is None, r.page_id or 0) for r in merged.collect()]
    assert got == sorted((W.url_key(u), W._captured(i), i is None, i or 0) for i, u, _ in rows)


def test_the_query_leaves_no_archives(spark):
    at = Path(checkpoint_folder(spark).removeprefix("file:"))
    W.query(spark, "/root/testdata/sf0.001").count()
    assert not list(at.glob("warc-*"))
