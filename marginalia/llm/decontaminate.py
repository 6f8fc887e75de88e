"""Benchmark decontamination by pigeonhole edit matching.

An item of length L may occur with k = floor(rate * L) edits. It is cut into k + 1 pieces; any such occurrence holds at
least one piece unchanged. All pieces stand in one Aho-Corasick automaton that passes over each whole document, and the
neighbourhood of every hit is verified with Myers' bit-parallel edit distance.

Texts are compared in lower case with white space runs as one space; start and end of a match are places in the document's
own text (code points, end exclusive), so it can be cut out there. The items are broadcast and every worker makes their
automaton once; items beyond ``MAX_CHARS`` go in several automata, one pass over the documents each, so what is broadcast
stays bounded.

Defined results: null or blank items and documents match nothing; items that repeat a text are all reported; repeated
documents repeat their matches; a document without an id is matched too (its doc_id is null); documents of any length are
read whole; empty tables give no rows; extra columns are not read. For each document and item the best occurrence is
given, the first of equals.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

ERROR_RATE = 0.08
MAX_CHARS = 16_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts (start, end) of a normalised text as parts of the text itself."""
    lower = text.lower()
    # Lower case may be longer than its character, so each lower-case character is told where it comes from.
    origin = range(len(text)) if len(lower) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    at: list[int] = []
    for m in re.finditer(r"\S+", lower):
        if at:
            at.append(at[-1] + 1)  # the space between two words
        at += origin[m.start() : m.end()]
    return [(at[s], at[e - 1] + 1) for s, e in spans]


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(rate * length)


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length; none is empty, for k is less than the length."""
    n = len(text)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Edit distance of one pattern to parts of a text, one bit for each character of the pattern."""

    def __init__(self, pattern: str) -> None:
        self.m = len(pattern)
        self.mask, self.top = (1 << self.m) - 1, 1 << (self.m - 1)
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def scan(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """(least distance, end of the first part of the text that has it); the part starts anywhere, or at 0 if anchored."""
        plus, minus, score = self.mask, 0, self.m
        best, end = score, 0
        mask, top, where = self.mask, self.top, self.where
        for j, c in enumerate(text, 1):
            eq = where.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (mask & ~(xh | plus))
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1) | anchored
            down <<= 1
            plus = (down | ~(xv | up)) & mask
            minus = up & xv & mask
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.forward: dict[int, Myers] = {}
        self.backward: dict[int, Myers] = {}

    def matches(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, start, end) of each item that occurs in the normalised text."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                starts.setdefault(n, set()).add(end + 1 - length - offset)
        out = []
        for n, found in sorted(starts.items()):
            item, pattern, k = self.items[n]
            exact = text.find(pattern)
            if exact >= 0:
                out.append((item, 0, exact, exact + len(pattern)))
                continue
            best = None
            if n not in self.forward:
                self.forward[n], self.backward[n] = Myers(pattern), Myers(pattern[::-1])
            low = high = None
            windows = []
            for s in sorted(found):
                a, b = max(0, s - k), min(len(text), s + len(pattern) + k)
                if high is not None and a <= high:
                    high = max(high, b)
                else:
                    if high is not None:
                        windows.append((low, high))
                    low, high = a, b
            windows.append((low, high))
            for a, b in windows:
                d, e = self.forward[n].scan(text[a:b])
                if d <= k and (best is None or d < best[0]):
                    stop = a + e
                    _, back = self.backward[n].scan(text[max(a, stop - len(pattern) - k) : stop][::-1], True)
                    best = (d, stop - back, stop)
            if best:
                out.append((item, *best))
        return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, shared, rate: float) -> Matcher:
    """The matcher of a broadcast item set, made once in each worker; only the last one is kept."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(shared.value, rate)
    return _MATCHERS[key]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, distance, start, end): every item that occurs in a document within its error budget, and where in its text."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in _item_sets(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared, rate)
            for b in batches:
                found = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if matches := matcher.matches(normal(t)):
                        spans = places(t, [(s, e) for _, _, s, e in matches])
                        found += [(i, item, d, *span) for (item, d, _, _), span in zip(matches, spans, strict=True)]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

        found = rows.mapInArrow(run, "doc_id long, item_id long, distance int, start long, end long")
        out = found if out is None else out.union(found)
    return out


def _item_sets(items: DataFrame) -> Iterator:
    """The items as one or more broadcast lists of about ``MAX_CHARS`` characters each."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    rounds = -(-total // MAX_CHARS) or 1
    for r in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r) if rounds > 1 else items
        yield spark.sparkContext.broadcast([(i.item_id, t) for i in part.orderBy("item_id", "text").toLocalIterator() if (t := normal(i.text))])


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item occurs within its error budget. A narrow pass for each item set."""
    prepare(docs.sparkSession)
    out = docs
    at = docs.columns.index("text")
    for shared in _item_sets(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.matches(normal(t)) for t in b.column(at).cast(pa.string()).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
