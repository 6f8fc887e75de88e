from __future__ import annotations

import random

import numpy as np

from marginalia.llm import quality as Q
from marginalia.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def _held_out(spark, module, column):
    got = module.query(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    hit = [r.predicted == r[column] for r in rows]
    rare = 1 if column == "toxic" else 0
    found = [r.predicted == rare for r in rows if r[column] == rare]
    return np.mean(hit), np.mean(found)


def test_quality_on_held_out_rows(spark):
    accuracy, recall = _held_out(spark, Q, "quality")
    assert accuracy > 0.98 and recall > 0.95


def test_toxicity_on_held_out_rows(spark):
    accuracy, recall = _held_out(spark, X, "toxic")
    assert accuracy > 0.97 and recall > 0.88


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no feature alone tells
    m = Q.fit(x, y)
    assert np.mean((m.score(x) >= 0.5) == y) > 0.95 and (0, 1) in m.pairs


def test_model_without_classes():
    assert Q.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    assert Q.fit(np.ones((9, 2)), np.ones(9)).score(np.zeros((1, 2)))[0] > 0.8


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return row[-1]


def test_automaton_is_brute_force():
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    terms = [(w, False, 1.0) for w in sorted({word(3, 8) for _ in range(12)})] + [("abcab", True, 1.0)]
    a = X.LexiconAutomaton(terms)
    for _ in range(3000):
        w = word(0, 10)
        reach = [(_distance(t, w), k) for k, (t, _, _) in enumerate(terms) if _distance(t, w) <= X.edits_allowed(t)]
        reach += [(0, k) for k, (t, stem, _) in enumerate(terms) if stem and w.startswith(t)]
        assert a.match(w) == min(reach, default=None), w


def test_quotation_is_told_from_abuse():
    s = X.Scorer([("idiot", False, 5.0)])
    plain, quoted, spelled = s("you idiot go away"), s('she said "you idiot" to them'), s("you idjot go away")
    assert plain[0] > 0 and quoted[0] == 0 and quoted[5] > 0 and spelled[4] > 0 and spelled[0] == 0


def test_edge_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "word " * 60_000), (4, "you trash"), (4, "you trash"), (None, "x")])
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for module, keep in ((Q, ("doc_id", "score")), (X, ("doc_id",))):
        model = module.train(docs, labels)
        rows = module.score(docs.drop("score"), model).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert module.score(docs.drop("score").limit(0), model).count() == 0
        nothing = module.train(docs, labels.limit(0))
        assert {round(r.score, 6) for r in module.score(docs.drop("score"), nothing).collect()} == {0.5}


def test_rare_and_short_terms_are_rated(spark):
    """More frequent terms than 100 000 stand in both classes; a rare word and one of three letters mark the toxic one."""
    filler = " ".join(f"{i * 7919 % 10007:05d}".translate(str.maketrans("0123456789", "abcdefghij")) + "k" * 19 for i in range(6000))
    rows = [(filler if i < 15 else "plain words",
        0) for i in range(40)] + [((filler if i < 15 else "plain words") + (" zut rarebane" if i % 3 == 0 else ""), 1) for i in range(40)]
    words = {t for t, _, _ in X.learn_terms(spark.createDataFrame(rows, "text string, y int"))}
    assert "zut" in words and any("rarebane".startswith(t) for t in words)


BIG = 2**53 + 1


def test_ids_keep_their_bits_beside_nulls(spark, documents):
    docs = documents([(BIG, "a text"), (None, "b text"), (7, None)]).drop("score")
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (Q, X):
        rows = module.score(docs, module.train(docs, labels), ("doc_id", "n_chars", "lang")).collect()
        assert {r.doc_id for r in rows} == {BIG, None, 7} and {r.lang for r in rows} == {"en"}


def test_a_kept_column_called_score_gives_way(documents):
    docs = documents([(1, "a")])
    for module, model in ((Q, Q.fit(np.zeros((0, 17)), np.zeros(0))), (X, X.Model([], X.Logistic(np.zeros((0, X.FIELDS)), np.zeros(0))))):
        got = module.score(docs, model, ("doc_id", "score"))
        assert got.columns == ["doc_id", "score"] and got.first().score == 0.5


def test_the_model_does_not_hang_on_the_order_of_repeated_ids(spark):
    """Two texts of one id: whichever row comes first, the same one is learned from."""
    rows = [(i % 20, ("bad worst " if i % 2 else "fine good ") * (1 + i % 7)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    for module in (Q, X):
        models = [module.train(spark.createDataFrame(r, "doc_id long, text string").repartition(3), labels) for r in (rows, rows[::-1])]
        probe = spark.createDataFrame([(1, "bad fine"), (2, "good")], "doc_id long, text string")
        a, b = ([r.score for r in module.score(probe, m).orderBy("doc_id").collect()] for m in models)
        assert a == b


def test_additive_score_is_the_sum_of_its_tables():
    """Brute force: the bin of each value found by counting edges, entries added one by one."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)).round(1)
    m = Q.fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float))
    for row, got in zip(x[:80], m.score(x[:80]), strict=True):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges, strict=True)]
        z = m.base + sum(t[b] for t, b in zip(m.tables, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12


def test_trees_are_brute_force():
    """The first cut of a table's tree and the cuts of a grid's tree are the best of all."""
    rng = np.random.default_rng(8)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
        gain = lambda a, b: a * a / (b + 1.0)
        best = max(range(1, 9), key=lambda c: gain(g[:c].sum(), h[:c].sum()) + gain(g[c:].sum(), h[c:].sum()))
        expected = np.repeat([g[:best].sum() / (h[:best].sum() + 1), g[best:].sum() / (h[best:].sum() + 1)], [best, 9 - best])
        if gain(g[:best].sum(), h[:best].sum()) + gain(g[best:].sum(), h[best:].sum()) <= gain(g.sum(), h.sum()):
            expected = np.full(9, g.sum() / (h.sum() + 1))  # no cut is better than none
        assert np.allclose(Q._tree(g, h, 2), expected)
        g, h = rng.normal(size=(4, 5)), rng.uniform(0.1, 1, (4, 5))
        quads = lambda i, j: ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)),
            (slice(i, None), slice(j, None)))
        i, j = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda c: sum(gain(g[q].sum(), h[q].sum()) for q in quads(*c)))
        out = np.zeros_like(g)
        for q in quads(i, j):
            out[q] = g[q].sum() / (h[q].sum() + 1)
        assert np.allclose(Q._grid_tree(g, h), out)


def test_toxicity_features_are_brute_force():
    """Hits found by comparing every word with every term, weights and windows added up plainly."""
    rng = random.Random(6)
    terms = [("idiot", False, 5.0), ("scum", False, 2.0), ("trash", True, 3.0)]
    scorer = X.Scorer(terms)
    plain = ["idiot", "idjot", "scum", "scam", "trashy", "trash", "a", "you", '"idiot"', "said", "fine.", '"go', 'now"', "Scum!"]
    for _ in range(300):
        words = [rng.choice(plain) for _ in range(rng.randint(0, 14))]
        abuse = fuzzy = quoted = strong = count = 0.0
        kinds = set()
        for i, w in enumerate(words):
            bare = X.bare(w)
            reach = [(_distance(t, bare), k) for k, (t, _, _) in enumerate(terms) if _distance(t, bare) <= X.edits_allowed(t)]
            reach += [(0, k) for k, (t, stem, _) in enumerate(terms) if stem and bare.startswith(t)]
            if not reach:
                continue
            edits, k = min(reach)
            weight = terms[k][2]
            if X.in_quotes(words, i):
                quoted += weight
            elif edits:
                fuzzy += weight
            else:
                abuse, count, strong = abuse + weight, count + 1, strong + (weight > 4)
                kinds.add(k)
        n = len(words)
        expected = (np.log1p(abuse), abuse / (n + 20) * 20, np.log1p(strong), strong / (n + 20) * 100, np.log1p(fuzzy), np.log1p(quoted),
            len(kinds) ** 0.5, count / (n + 20) * 100, np.log1p(n))
        assert np.allclose(scorer(" ".join(words)), expected)


def test_windows_tell_quotation():
    """The rule of a window, word by word: a mark that opens before and one that closes after within the window, or a reporting word before a closing mark."""
    says = lambda text, at: X.in_quotes(text.split(), at)
    assert says('he "is an idiot indeed" ok', 3) and not says('he "said" an idiot', 3) and not says("an idiot", 1)
    assert says('they called us idiot" once', 3) and not says('they met us idiot" once', 3)
    far = '"a ' + "b " * X.WINDOW + 'idiot c"'
    assert not says(far, X.WINDOW + 1)
