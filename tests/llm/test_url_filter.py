from __future__ import annotations

import fnmatch
import random
import re
import time

import pytest

from marginalia.llm import url_filter as U


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        (None, ("", "")), ("", ("", "")), ("no mark/en/", ("", "")), ("http://A.Example.COM", ("a.example.com", "")), ("x://h?q=/p", ("h", "")),
            ("x://h#f", ("h", "")),
        ("https://É.com/En/É?x#y", ("É.com", "/En/É")), ("a://b://c/d", ("b:", "//c/d")),
    ],
)
def test_canonical(url, expected):
    assert U.canonical(url) == expected


def test_automaton_is_glob_matching():
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("ab") for _ in range(rng.randint(a, b)))
    globs = []
    while len(globs) < 40:
        g = rng.choice(["", "*"]) + "*".join(word(1, 4) for _ in range(rng.randint(1, 3))) + rng.choice(["", "*"])
        globs.append(g)
    automaton = U.ShiftAnd([g.encode() for g in globs])
    assert automaton.words > 1
    texts = [word(0, 12) for _ in range(300)] + [""]
    got = automaton.accepts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            # A glob without * at its end may end earlier here only if its last state loops, so compare what must be equal.
            if g.endswith("*"):
                assert got[i, k] == fnmatch.fnmatchcase(t, g), (t, g)


def test_rules_and_edge_cases(spark):
    rows = [
        (1, "https://a.example.com/en/7x"), (2, "https://a.example.com/en/6"), (3, "https://example.com.evil.org/x.com/en/"), (4, None), (5, ""),
            (5, ""), (6, "https://notexample.com/en/7"),
        (7, "https://net/de/"), (8, "http://x.example.net/de/8?a"), (9, "http://" + "a" * 5000 + ".org/es/" + "b" * 20000), (None, "https://b.com/en/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    got = [(r.page_id, r.rule, r.verdict) for r in U.judge(df).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "example.com/en/7", "allow"), (2, "com/en/", "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"),
                (5, None, "allow"), (6, "com/en/", "block"), (7, "net/de/", "allow"),
            (8, "example.net/de/8", "block"), (9, "org/es/", "block"), (None, "com/en/", "block"),
        ],
        key=str,
    )
    assert U.judge(df.limit(0)).count() == 0


def test_ids_keep_their_bits_beside_nulls(spark):
    df = spark.createDataFrame([(2**53 + 1, "https://a.com/en/", "x"), (None, None, None)], "page_id long, url string, rule string")
    got = U.judge(df, keep=("page_id", "rule"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]  # a kept column with a result's name gives way
    assert {(r.page_id, r.rule) for r in got.collect()} == {(2**53 + 1, "com/en/"), (None, None)}


def test_rules_are_brute_force(spark):
    """Every URL of a mixed set against every rule, by the words of the rule."""
    rng = random.Random(9)
    hosts = ["com", "example.com", "a.example.com", "notexample.com", "net", "example.net", "b.example.net", "x.org", "org.uk", ""]
    paths = ["/en/", "/en/7", "/en/70/x", "/en", "/de/8", "/de/", "/es/1", "/ES/", "", "/"]
    urls = [f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#/de/'])}" for _ in range(400)]
    rows = U.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()
    assert len(rows) == 400
    for r in rows:
        host, path = U.canonical(urls[r.page_id])
        fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, U.DEFAULT))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_few_texts_are_walked_to_the_same_states(monkeypatch, few):
    monkeypatch.setattr(U, "FEW", few)
    rng = random.Random(2)
    globs = [b"ab*cd", b"*a*b*", b"aa*", *[bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) + rng.choice([b"", b"*"]) for _ in range(40)]]
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.choice([0, 1, 5, 30, 200]))) for _ in range(60)]
    got = U.ShiftAnd(globs).accepts(texts)
    expected = [[bool(re.fullmatch(b".*".join(map(re.escape, g.split(b"*"))), t, re.S)) for g in globs] for t in texts]
    assert got.tolist() == expected


def test_a_very_long_url_costs_little(spark):
    url = "https://a.example.com/en/7" + "x/y" * 500_000
    began = time.process_time()
    assert U.ShiftAnd([b"*.com\xff/en/*"]).accepts([b"." + url[8:].replace("/", "\xff/", 1).encode("latin-1")]).tolist() == [[True]]
    assert time.process_time() - began < 5
    r = U.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r.rule, r.verdict, len(r.path)) == ("example.com/en/7", "allow", len(url) - 21)
