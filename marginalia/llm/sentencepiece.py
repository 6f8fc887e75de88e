"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A space becomes the marker U+2581 and one marker is put before the text; decoding turns markers back and drops that
first one. Characters without a piece fall back to byte pieces, so every text comes back exactly; a marker that stands
in the text itself goes as bytes for the same reason.

The pieces come from a model file whose path is a parameter (nothing is trained here). A unigram model's own log scores
are used. A BPE model has merge ranks instead; rank r scores ``-log(r + 1) - log(sum of 1 / r)``, Zipf's law.

Pieces hold the marker in front only, so a text is cut before each run of markers and each part is encoded on its own;
the best paths of all new parts of a batch are found together, with numpy steps over the double array. A few very long parts
(text without spaces) are walked one by one with plain steps over the same double array.

Defined results: a null text has null ids, an empty or blank text is encoded like any other; repeated rows repeat; rows
without an id are kept; empty tables give no rows; texts are never cut; extra columns are not read, and a kept column that
has the name of a result column gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

MARK = "▁"
KNOWN_PARTS = 300_000
_PARTS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
_LONG = 64  # bytes; longer parts are encoded in groups of their own
_FEW = 8  # parts; below that, numpy's steps cost more than they spare


class DoubleArray:
    """A trie over bytes in two arrays: the child of node s by byte c is t = base[s] + c, if check[t] == s."""

    def __init__(self, words: Sequence[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for number, w in enumerate(words):
            node = 0
            for c in w:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = number
        size = 1024
        while size < 4 * len(children) + 512:
            size *= 2
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = bytearray(b"\1") * size
        free[0] = 0
        lowest, todo = 1, [(0, 0)]
        while todo:
            later = []
            for node, slot in todo:  # level by level
                value[slot] = ends[node]
                kids = sorted(children[node])
                if not kids:
                    continue
                while not free[lowest]:
                    lowest += 1
                at = free.find(1, max(lowest, kids[0] + 1))
                tries = 0
                while True:
                    b = at - kids[0]
                    if all(free[b + c] for c in kids):
                        break
                    at, tries = free.find(1, at + 1), tries + 1
                    if tries > 64 and len(kids) > 1:  # the lower part is nearly full
                        lowest = max(lowest, at - 256)
                base[slot] = b
                for c in kids:
                    free[b + c] = 0
                    check[b + c] = slot
                    later.append((children[node][c], b + c))
            todo = later
        last = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
        self.base, self.check, self.value = base[:last].copy(), check[:last].copy(), value[:last].copy()


class Vocabulary:
    """Pieces with log scores, byte pieces and the trie; made on the driver and broadcast."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int]) -> None:
        self.byte_ids = np.array(byte_ids, np.int32)
        usable = [(i, p, s) for i, p, s in pieces if p and MARK not in p.lstrip(MARK) and "\n" not in p]
        if len(usable) != sum(bool(p) for _, p, _ in pieces):
            raise ValueError("a piece holds the marker after other characters, or a line break")
        self.ids = np.array([i for i, _, _ in usable], np.int32)
        self.scores = np.array([s for _, _, s in usable], np.float64)
        self.unknown = float(self.scores.min(initial=0.0)) - 10.0
        self.trie = DoubleArray([p.encode() for _, p, _ in usable])
        self.longest = max((len(p.encode()) for _, p, _ in usable), default=1)
        self.text: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for i, p, _ in usable}
        self.text |= {int(b): bytes([n]) for n, b in enumerate(byte_ids)}
        self.plain = [self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist(), self.ids.tolist()]

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        scores = np.array([m.get_score(i) for i in normal])
        if len(scores) and scores.min() <= -1000:  # ranks, not log probabilities
            rank = (-scores).argsort(kind="stable").argsort() + 1
            scores = -np.log(rank) - np.log((1 / np.arange(1, len(rank) + 1)).sum())
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return Vocabulary([(i, m.id_to_piece(i), float(s)) for i, s in zip(normal, scores, strict=True)], byte_ids)


class Codec:
    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.known: dict[str, int] = {}
        self.lengths, self.starts, self.pool = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def viterbi(self, parts: list[bytes]) -> list[np.ndarray]:
        """The best path of each part. Ties go to the path found first: longer pieces from later starts don't replace an equal score."""
        v, t = self.v, self.v.trie
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(parts)
        s = 0
        while s < len(order):
            longest = len(parts[order[s]])
            e = s
            limit = max(_LONG, longest)
            while e < len(order) and len(parts[order[e]]) <= max(limit if longest > _LONG else 2 * longest + 4, longest) and (e - s + 1) * (len(parts[order[e]]) + 1) <= 4_000_000:
                e += 1
            e = max(e, s + 1)
            group = [parts[i] for i in order[s:e]]
            n, width = len(group), max(map(len, group))
            if n < _FEW and width > _LONG:
                for i in order[s:e]:
                    out[i] = self._walk(parts[i])
                s = e
                continue
            lengths = np.array([len(g) for g in group])
            text = np.zeros((n, width + 1), np.int32)
            flat = np.frombuffer(b"".join(group), np.uint8)
            text[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            best = np.full((n, width + 1), -np.inf)
            best[:, 0] = 0
            came, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
            for i in range(width):
                rows = np.flatnonzero((lengths > i) & (best[:, i] > -np.inf))
                if not len(rows):
                    continue
                start = best[rows, i]
                lead = text[rows, i]
                # A character without a piece: one step over all its bytes.
                to = np.minimum(i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), lengths[rows])
                score = start + v.unknown
                better = score > best[rows, to]
                r = rows[better]
                best[r, to[better]], came[r, to[better]], piece[r, to[better]] = score[better], i, -1
                node = np.zeros(len(rows), np.int32)
                for d in range(i, min(width, i + v.longest)):
                    child = t.base[node] + text[rows, d]
                    keep = (t.check[child] == node) & (lengths[rows] > d)
                    if not keep.any():
                        break
                    rows, node, start = rows[keep], child[keep], start[keep]
                    number = t.value[node]
                    ends = number >= 0
                    if ends.any():
                        r = rows[ends]
                        score = start[ends] + v.scores[number[ends]]
                        better = score > best[r, d + 1]
                        r = r[better]
                        best[r, d + 1], came[r, d + 1], piece[r, d + 1] = score[better], i, number[ends][better]
            # All paths are walked back together, a piece at a time.
            at, rows, step, walked = lengths.copy(), np.flatnonzero(lengths > 0), 0, []
            steps, odd = np.zeros(n, np.int64), np.zeros(n, bool)
            while len(rows):
                number = piece[rows, at[rows]]
                odd[rows[number < 0]] = True
                walked.append((rows, number))
                steps[rows] = step = step + 1
                at[rows] = came[rows, at[rows]]
                rows = rows[at[rows] > 0]
            ends = np.cumsum(steps)
            flat_ids = np.zeros(int(ends[-1]) if n else 0, np.int32)
            for i, (rows, number) in enumerate(walked):
                flat_ids[ends[rows] - 1 - i] = v.ids[np.maximum(number, 0)]
            bounds = (ends - steps).tolist()
            for k in range(n):
                out[order[s + k]] = flat_ids[bounds[k] : bounds[k] + int(steps[k])]
            for k in np.flatnonzero(odd).tolist():  # characters without a piece become their bytes
                at_k, path = len(group[k]), []
                while at_k > 0:
                    p, back = int(piece[k, at_k]), int(came[k, at_k])
                    path += [int(v.ids[p])] if p >= 0 else [int(v.byte_ids[c]) for c in reversed(group[k][back:at_k])]
                    at_k = back
                out[order[s + k]] = np.array(path[::-1], np.int32)
            s = e
        return out

    def _walk(self, part: bytes) -> np.ndarray:
        """The best path of one part, as :meth:`viterbi` finds it: the same steps in the same order."""
        base, check, value, scores, ids = self.v.plain
        n, unknown = len(part), self.v.unknown
        best, came, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            start, lead = best[i], part[i]
            if start == -np.inf:
                continue
            to = min(i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), n)
            if start + unknown > best[to]:
                best[to], came[to], piece[to] = start + unknown, i, -1
            node, d = 0, i
            while d < n:
                child = base[node] + part[d]
                if check[child] != node:
                    break
                node, d = child, d + 1
                number = value[node]
                if number >= 0 and start + scores[number] > best[d]:
                    best[d], came[d], piece[d] = start + scores[number], i, number
        path, at = [], n
        while at > 0:
            back = came[at]
            path += [ids[piece[at]]] if piece[at] >= 0 else [int(self.v.byte_ids[c]) for c in reversed(part[back:at])]
            at = back
        return np.array(path[::-1], np.int32)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray | None]:
        if len(self.known) > KNOWN_PARTS:
            self.__init__(self.v)
        split: list[list[str] | None] = []
        for t in texts:
            if t is None:
                split.append(None)
                continue
            # A marker in the text itself is shielded as U+0000 U+0001 until the bytes are made.
            shielded = t.replace("\0", "\0\0").replace(MARK, "\0\1") if MARK in t or "\0" in t else t
            split.append(_PARTS.findall(MARK + shielded.replace(" ", MARK)))
        known = self.known
        fresh = list({p for parts in split if parts for p in parts} - known.keys())
        if fresh:
            plain = [p for p in fresh if "\0" not in p]
            odd = [p for p in fresh if "\0" in p]
            paths = self.viterbi([p.encode("utf-8", "surrogatepass") for p in plain]) + [self._shielded(p) for p in odd]
            known.update(zip(plain + odd, range(len(self.lengths), len(self.lengths) + len(paths)), strict=True))
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, paths), np.int64, len(paths))])
            self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
            self.pool = np.concatenate([self.pool, *paths])
        counts = [len(parts) for parts in split if parts is not None]
        which = np.fromiter((known[p] for parts in split if parts for p in parts), np.int64, sum(counts))
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.starts[which] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[np.cumsum([0, *counts])].tolist()
        pieces = iter([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        return [None if parts is None else next(pieces) for parts in split]

    def _shielded(self, part: str) -> np.ndarray:
        """A part with shielded characters: these go as bytes, what lies between them is encoded as usual."""
        out: list[np.ndarray] = []
        for run in re.findall("\0[\0\1]|[^\0]+", part):
            if run[0] == "\0":
                out.append(self.v.byte_ids[list(MARK.encode() if run[1] == "\1" else b"\0")])
            else:
                out += self.viterbi([run.encode("utf-8", "surrogatepass")])
        return np.concatenate(out)

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        data = b"".join(map(self.v.text.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "surrogatepass")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _shared(docs: DataFrame, model: str | None):
    spark = prepare(docs.sparkSession)
    return spark.sparkContext.broadcast(Vocabulary.load(model or default_model()))  # the vocabulary: fixed size


def _others(keep: tuple[str, ...], *made: str) -> list[str]:
    return [k for k in keep if k.lower() not in made]


def encode(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids array<int>, n_tokens int and restored boolean: whether the ids decode to the very text."""
    shared = _shared(docs, model)
    picked = docs.select(*_others(keep, "ids", "n_tokens", "restored"), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = codec.encode(texts)
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                offsets = np.cumsum([0] + [0 if x is None else len(x) for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in ids]))
                counts = pa.array([None if x is None else len(x) for x in ids], pa.int32())
                same = pa.array([None if x is None else codec.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, counts, same], names=[*part.schema.names[:-1], "ids", "n_tokens", "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{fields}, ids array<int>, n_tokens int, restored boolean")


def decode(rows: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and text of rows with ids."""
    shared = _shared(rows, model)
    picked = rows.select(*_others(keep, "text"), F.col("ids").cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int32)) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{fields}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
