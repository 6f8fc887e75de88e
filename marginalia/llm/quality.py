"""Quality classifier: a generalised additive model with pairwise interactions.

Training boosts shallow trees in turn over one feature at a time (and then over the strongest feature pairs); the trees
of a feature add up to one lookup table over its bins. A score is the sum of the bins' entries: one gather per feature.

It learns from at most ``SAMPLE_ROWS`` labelled rows (a documented bound, chosen by the hash of doc_id), and every
document is scored on its whole text. Labels, lang, source and doc_id are never inputs.

Defined results: a null text counts as empty, and an empty text has a score like any other; a document without an id is
scored too (held_out is null there); with no labelled rows, or one class only, the score is the smoothed class share for
all; repeated rows give repeated results, and of an id that has several texts one is learned from, always the same;
empty tables give no rows; extra columns are not read, and a kept column called score gives way to the result.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from .common import crc_mod, labelled_sample, prepare, table, with_text_columns

SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1
BINS, ROUNDS, PAIRS, RATE, LEAVES = 32, 120, 6, 0.15, 3

FEATURES = (
    "log_words", "log_chars", "word_length", "distinct_words", "adjacent_repeats", "upper_words", "top_word", "digits", "bars", "bangs", "symbols",
    "stops", "commas", "words_a_line", "repeated_lines", "beyond_ascii", "words_a_stop",
)


def features(text: str | None) -> tuple[float, ...]:
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    w, c = max(1, n), max(1, chars)
    counts = Counter(words)
    lines = text.split("\n")
    stops = text.count(".")
    return (
        np.log1p(n), np.log1p(chars), sum(map(len, words)) / w, len(counts) / w, sum(map(operator.eq, words, words[1:])) / w,
        sum(map(str.isupper, words)) / w, max(counts.values(), default=0) / w, sum(map(text.count, "0123456789")) / c, text.count("|") / w,
        text.count("!") / w, sum(map(text.count, "#$%&*")) / w, stops / w, text.count(",") / w, n / len(lines), 1 - len(set(lines)) / len(lines),
        (len(text.encode("utf-8", "surrogatepass")) - chars) / c, n / (stops + 1),
    )


class AdditiveModel:
    """``logit = base + sum of tables[f][bin f] + sum of pair_tables[k][bin i, bin j]``."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int]], pair_tables: list[np.ndarray]) -> None:
        self.base, self.edges, self.tables, self.pairs, self.pair_tables = base, edges, tables, pairs, pair_tables

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[f]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree of at most ``leaves`` leaves, grown best split first on the bins' gradient and hessian sums."""
    parts = [(0, len(g))]
    gain = lambda a, b: a * a / (b + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (s, e) in enumerate(parts):
            if e - s < 2:
                continue
            a, b = np.cumsum(g[s:e]), np.cumsum(h[s:e])
            v = gain(a[:-1], b[:-1]) + gain(a[-1] - a[:-1], b[-1] - b[:-1]) - gain(a[-1], b[-1])
            at = int(np.argmax(v))
            if v[at] > best[0]:
                best = (v[at], (k, s + at + 1))
        if best[1] is None:
            break
        k, cut = best[1]
        s, e = parts[k]
        parts[k : k + 1] = [(s, cut), (cut, e)]
    out = np.zeros(len(g))
    for s, e in parts:
        out[s:e] = g[s:e].sum() / (h[s:e].sum() + 1.0)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A depth-two tree over a pair's grid: the best of one cut on each axis, four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    r, rh = cg[:-1, -1:], ch[:-1, -1:]
    c, chh = cg[-1:, :-1], ch[-1:, :-1]
    quads = ((a, b), (r - a, rh - b), (c - a, chh - b), (tg - r - c + a, th - rh - chh + b))
    v = sum(x * x / (np.maximum(y, 0) + 1.0) for x, y in quads)
    if not v.size:
        return np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(v)), v.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> AdditiveModel:
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(n_features)]
    model = AdditiveModel(base, edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(y) < 4 or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(n_features):
            g, h = slopes()
            size = len(model.tables[f])
            t = rate * _tree(np.bincount(b[f], g, size), np.bincount(b[f], h, size), LEAVES)
            model.tables[f] += t
            z += t[b[f]]
    g, h = slopes()
    ranked = []
    for i in range(n_features):
        for j in range(i + 1, n_features):
            shape = (len(model.tables[i]), len(model.tables[j]))
            cell = b[i] * shape[1] + b[j]
            gg, hh = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
            t = _grid_tree(gg, hh)
            ranked.append((float((t * gg).sum()), i, j))
    for _, i, j in sorted(ranked, reverse=True)[:pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(model.tables[i]), len(model.tables[j]))))
    for _ in range(rounds // 4):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            shape = model.pair_tables[k].shape
            cell = b[i] * shape[1] + b[j]
            t = rate * _grid_tree(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)))
            model.pair_tables[k] += t
            z += t[b[i], b[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, keep=None, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on the texts of a bounded labelled sample; only feature vectors (``rows`` times a few numbers) reach the driver.

    Of an id's several texts the one with the smallest features is learned from, whatever order the rows come in.
    """
    sample = labelled_sample(labels, "quality", F.lit(True) if keep is None else keep, rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # rows <= SAMPLE_ROWS
    made = with_text_columns(picked, ("doc_id", "y"), "text", [StructField("x", ArrayType(DoubleType()))],
        lambda: lambda texts: [pa.array([list(map(float, features(t))) for t in texts], pa.list_(pa.float64()))])
    got = made.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in got], float))


def score(docs: DataFrame, model: AdditiveModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score double for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: a few tables of BINS entries
    of = lambda texts: [pa.array(shared.value.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))]
    return with_text_columns(docs, keep, "text", [StructField("score", DoubleType())], lambda: of)


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", FOLDS) != HELD_OUT)
    return score(docs, model).select(
        "doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
