"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon (whole words, and stems that stand for all words beginning with them) is learned from a bounded labelled
sample. A state of the automaton is a set of (trie node, edits so far); sets are made deterministic as they are met, so
most words leave after a few characters. Each hit is weighed by its log odds and by its window: a hit inside quotation
marks or after a word of reporting counts as quoted, not as abuse. A logistic model over these sums gives the score.

At most ``SAMPLE_ROWS`` labelled rows are learned from (a documented bound); every document is scored on its whole text.
Every word of the sample, of any length, and its beginnings of 4 to ``LONGEST_STEM`` characters are rated. All that stand
out enter the lexicon: those in 0.4 % of the sample's toxic texts (three at least), with log odds of 1.6 or more and a
likelihood ratio of ``SURPRISE`` or more. Labels, lang, source and doc_id are never inputs.

Defined results: a null text counts as empty, and empty texts have a score; without labelled rows of both classes the
score is the smoothed class share; a row without an id is scored (held_out is null); repeated rows repeat, and of an id
that has several texts one is learned from, always the same; empty tables give no rows; extra columns are not read, and
a kept column called score gives way to the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from .common import crc_mod, cut, labelled_sample, prepare, table, with_text_columns

SAMPLE_ROWS = 10_000
LONGEST_STEM = 24
SURPRISE = 15.0
FOLDS, HELD_OUT = 5, 0
WINDOW = 6
SEEN_WORDS = 400_000
FIELDS = 9

# Words that announce a quotation, in the languages of the corpus.
REPORTING = frozenset(
    "said says wrote writes called quoted quote sagte schrieb nannte zitat dijo escribió llamó cita dit écrit appelé citation".split()
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_OPEN, _CLOSE = "\"'“”„«»‘’", "\"'“”«»‘’"


def bare(word: str) -> str:
    """A token in lower case without the marks around it."""
    word = word.lower()
    return word if word.isalpha() else _EDGE.sub("", word)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1


class LexiconAutomaton:
    """Matches words within each term's edit budget. ``terms``: (text, is a stem, weight)."""

    def __init__(self, terms: Iterable[tuple[str, bool, float]]) -> None:
        self.terms = list(terms)
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget: list[int] = [0]  # of the most generous term below a node
        for k, (term, _, _) in enumerate(self.terms):
            node, budget = 0, edits_allowed(term)
            self.budget[0] = max(self.budget[0], budget)
            for ch in term:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.next[node][ch]
                self.budget[node] = max(self.budget[node], budget)
            self.ends[node].append(k)
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.stem: list[tuple[int, int] | None] = []
        self.number: dict[frozenset, int] = {}
        self._add(self._close({(0, 0)}))

    def _close(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Add what is reached by leaving out characters of a term; keep the fewest edits of each node."""
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.budget[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.next[node].values()]
        return frozenset(least.items())

    def _add(self, pairs: frozenset) -> int:
        if pairs in self.number:
            return self.number[pairs]
        self.number[pairs] = n = len(self.sets)
        self.sets.append(pairs)
        self.moves.append({})
        hits = [(e, k) for node, e in pairs for k in self.ends[node] if e <= edits_allowed(self.terms[k][0])]
        self.final.append(min(hits, default=None))
        self.stem.append(min((h for h in hits if self.terms[h[1]][1] and h[0] == 0), default=None))  # a stem is met exactly
        return n

    def _step(self, state: int, ch: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            out.add((node, e + 1))  # a character too many
            for c, child in self.next[node].items():
                out.add((child, e + (c != ch)))
        closed = self._close(out)
        target = self._add(closed) if closed else -1
        self.moves[state][ch] = target
        return target

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the best term for the word, or None."""
        state, best = 0, None
        moves = self.moves
        for ch in word:
            target = moves[state].get(ch)
            state = self._step(state, ch) if target is None else target
            if state < 0:
                return best
            if self.stem[state] is not None and best is None:
                best = self.stem[state]
        final = self.final[state]
        return best if final is None else final if best is None else min(best, final)


class Scorer:
    """Features of a text: sums of hits by kind. Keeps the words it has judged, up to a bound."""

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        self.automaton = LexiconAutomaton(terms)
        self.seen: set[str] = set()
        self.bad: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> tuple[float, ...]:
        words = (text or "").split()
        distinct = set(words)
        fresh = distinct - self.seen
        if fresh:
            if len(self.seen) > SEEN_WORDS:
                self.seen.clear()
                self.bad.clear()
                fresh = distinct
            for w in fresh:
                hit = self.automaton.match(bare(w))
                if hit is not None:
                    self.bad[w] = hit
            self.seen |= fresh
        found = distinct & self.bad.keys()
        n = len(words)
        abuse = quoted = fuzzy = strong = count = 0.0
        kinds = set()
        if found:
            for i, w in enumerate(words):
                if w in found:
                    edits, k = self.bad[w]
                    weight = self.automaton.terms[k][2]
                    if in_quotes(words, i):
                        quoted += weight
                    elif edits:
                        fuzzy += weight
                    else:
                        abuse += weight
                        count += 1
                        strong += weight > 4
                        kinds.add(k)
        size = np.log1p(n)
        return (np.log1p(abuse), abuse / (n + 20) * 20, np.log1p(strong), strong / (n + 20) * 100, np.log1p(fuzzy), np.log1p(quoted),
            len(kinds) ** 0.5, count / (n + 20) * 100, size)


def in_quotes(words: list[str], i: int) -> bool:
    """Whether the window around word i marks it as quoted: a quotation opened before and closed after it, or a reporting word just before a mark."""
    before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
    opened = next((k for k in range(len(before) - 1, -1, -1) if before[k][0] in _OPEN), None)
    if opened is None or any(w[-1] in _CLOSE for w in before[opened:-1]):
        return any(bare(w) in REPORTING for w in before[:-1]) and words[i][-1] in _CLOSE
    return any(w.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) for w in after)


class Logistic:
    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> None:
        self.mean = x.mean(0) if len(x) else np.zeros(FIELDS)
        self.scale = x.std(0) + 1e-6 if len(x) else np.ones(FIELDS)
        share = (y.sum() + 1) / (len(y) + 2)
        self.w = np.zeros(FIELDS + 1)
        self.w[0] = np.log(share / (1 - share))
        if len(y) < 4 or y.min() == y.max():
            return
        a = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        penalty = np.diag([1e-6] + [ridge] * FIELDS)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + penalty, a.T @ (y - p) - penalty @ self.w)
            self.w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:], -30, 30)))


def _terms(text: str | None) -> set[str]:
    """A text's whole words ("word ") and their beginnings of 4 to ``LONGEST_STEM`` characters ("stem")."""
    out: set[str] = set()
    for w in {bare(w) for w in (text or "").split()}:
        if w:
            out.add(w + " ")
            out.update(w[:k] for k in range(4, min(len(w), LONGEST_STEM + 1)))
    return out


def surprise(a: int, b: int, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of a term found in ``a`` of the toxic and ``b`` of the clean texts."""
    part = lambda k, n, p: (k * np.log(k / (n * p)) if k else 0.0) + ((n - k) * np.log((n - k) / (n * (1 - p))) if n > k else 0.0)
    p = (a + b) / (toxic + clean)
    return 2 * float(part(a, toxic, p) + part(b, clean, p)) if 0 < p < 1 else 0.0


def learn_terms(texts: DataFrame) -> list[tuple[str, bool, float]]:
    """Terms whose document frequency among toxic rows stands out. ``texts``: (text, y), a bounded sample."""
    n = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return []

    def counter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for f in frames:
            for t in f["text"]:
                total.update(_terms(t))
        terms = list(total)
        for i in range(0, len(terms), 50_000):
            yield pd.DataFrame({"term": terms[i : i + 50_000], "n": [total[t] for t in terms[i : i + 50_000]]})

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            odds = np.log((f["n"] + 0.5) / (toxic + 1)) - np.log((f["in_clean"] + 0.5) / (clean + 1))
            f = f.assign(odds=odds)[odds >= 1.6]
            stands_out = np.array([surprise(a, b, toxic, clean) >= SURPRISE for a, b in zip(f["n"], f["in_clean"], strict=True)], bool)
            yield f[stands_out][["term", "n", "odds"]]

    count = lambda y, n: texts.where(F.col("y") == y).select("text").mapInPandas(counter,
        "term string, n long").groupBy("term").agg(F.sum("n").alias(n))
    least = max(3, round(0.004 * toxic))
    both = count(1, "n").where(F.col("n") >= least).join(count(0, "in_clean"), "term", "left").select("term", "n",
        F.coalesce("in_clean", F.lit(0)).alias("in_clean"))
    marked = both.mapInPandas(rate, "term string, n long, odds double").collect()
    in_toxic, odds = {r.term: r.n for r in marked}, {r.term: r.odds for r in marked}
    continued: dict[str, list[str]] = {}
    for t in in_toxic:
        continued.setdefault(t.strip()[:-1], []).append(t)
        if t.endswith(" "):
            continued.setdefault(t.strip(), []).append(t)
    chosen: dict[str, bool] = {}
    for t in sorted(in_toxic, key=lambda t: (len(t), t)):  # beginnings before their continuations
        if t.endswith(" "):
            covered = any(t[:k] in chosen for k in range(4, len(t)))
            if not covered or odds[t] > max(odds[t[:k]] for k in range(4, len(t)) if t[:k] in chosen) + 1.5:
                chosen[t] = False
            continue
        longer = any(in_toxic[x] >= 0.8 * in_toxic[t] for x in continued.get(t, ()))
        if not longer and not any(t[:k] in chosen and odds[t] < odds[t[:k]] + 1.0 for k in range(4, len(t))):
            chosen[t] = True
    ranked = sorted(chosen, key=lambda t: (-odds[t] * in_toxic[t] ** 0.5, t))
    return [(t.strip(), chosen[t], odds[t]) for t in ranked]


class Model:
    def __init__(self, terms: list[tuple[str, bool, float]], logistic: Logistic) -> None:
        self.terms, self.logistic = terms, logistic


def train(docs: DataFrame, labels: DataFrame, keep=None, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from a bounded labelled sample, read from the documents once. Of an id's several texts the smallest is learned from."""
    sample = labelled_sample(labels, "toxic", F.lit(True) if keep is None else keep, rows)
    chosen = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # rows <= SAMPLE_ROWS
    picked = cut(chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.least(F.greatest(F.min("y"), F.lit(0)), F.lit(1)).alias("y")))
    terms = learn_terms(picked.select("text", "y"))
    got = _featurise(picked, terms).orderBy("doc_id").collect()
    return Model(terms, Logistic(np.array([r.x for r in got], float).reshape(-1, FIELDS), np.array([r.y for r in got], float)))


def _featurise(picked: DataFrame, terms) -> DataFrame:
    def worker():
        scorer = Scorer(terms)
        return lambda texts: [pa.array([list(map(float, scorer(t))) for t in texts], pa.list_(pa.float64()))]

    return with_text_columns(picked, ("doc_id", "y"), "text", [StructField("x", ArrayType(DoubleType()))], worker)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score double for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its terms come from at most SAMPLE_ROWS texts

    def worker():
        scorer, logistic = Scorer(shared.value.terms), shared.value.logistic
        return lambda texts: [pa.array(logistic.score(np.array([scorer(t) for t in texts], float).reshape(-1, FIELDS)))]

    return with_text_columns(docs, keep, "text", [StructField("score", DoubleType())], worker)


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", FOLDS) != HELD_OUT)
    return score(docs, model).select(
        "doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
