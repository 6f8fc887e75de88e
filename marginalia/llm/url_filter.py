"""URL filters: glob rules packed into multiword Shift-And masks and run side by side over every canonical URL.

A rule is ``host/path`` with an action; it fits the host and all its subdomains if the URL's path starts with the
rule's path, and the longest rule that fits wins. Each rule becomes the glob ``*.host<SEP>path*`` over the canonical
form ``.host<SEP>path``. All globs sit one behind the other in one bit vector of as many 64-bit words as needed; a step
of the automaton is ``D = ((((D << 1) & inner) | starts) & mask[byte]) | (D & loops)`` for a whole block of URLs at once.

Defined results: a null URL or one without ``://`` has empty host and path and gets no rule; a URL without a rule gets
the default verdict; equal rows give equal results; an empty table gives no rows. Of two rules of one length that both
fit, the one listed first wins. URLs of any length are read whole. Extra columns are not read; a kept column called like
a result column gives way to it, any other passes as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField

from .common import prepare, table, with_text_columns

#: (host, path, action) of the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DEFAULT = "allow"
SEP = 0xFF  # never a byte of UTF-8
#: So many texts that still run are walked one by one.
FEW = 8
_LOWER = {c: c + 32 for c in range(65, 91)}


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find("?"), tail.find("#")) if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


class ShiftAnd:
    """Glob rules as one bit-parallel automaton; ``*`` stands for any bytes, everything else for itself."""

    def __init__(self, globs: Sequence[bytes]) -> None:
        states: list[tuple[int, bool]] = []  # (byte, may loop on any byte before the next one)
        self.starts, self.ends, begins_open, ends_open = [], [], [], []
        for g in globs:
            body = g.strip(b"*")
            if not body:
                raise ValueError("a rule needs at least one byte besides *")
            self.starts.append(len(states))
            begins_open.append(g.startswith(b"*"))
            ends_open.append(g.endswith(b"*"))
            for i, b in enumerate(body):
                if b != 0x2A:
                    states.append((b, i + 1 < len(body) and body[i + 1] == 0x2A))
            self.ends.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.masks = np.zeros((256, self.words), np.uint64)
        self.loops, self.always, self.first, begin = (np.zeros(self.words, np.uint64) for _ in range(4))
        for i, (b, loop) in enumerate(states):
            self.masks[b, i // 64] |= np.uint64(1 << (i % 64))
            if loop:
                self.loops[i // 64] |= np.uint64(1 << (i % 64))
        for s, e, begins, ends in zip(self.starts, self.ends, begins_open, ends_open, strict=True):
            (self.always if begins else self.first)[s // 64] |= np.uint64(1 << (s % 64))
            begin[s // 64] |= np.uint64(1 << (s % 64))
            if ends:
                self.loops[e // 64] |= np.uint64(1 << (e % 64))
        self.plain: tuple | None = None
        self.inner = ~begin  # a glob's first state is not reached from the last one of the glob before it

    def _walked(self, state: np.ndarray, text: bytes, at: int) -> np.ndarray:
        """The state after the rest of one text, in plain integers of as many bits as there are: for few long texts a step of arrays costs more."""
        if self.plain is None:
            whole = lambda words: int.from_bytes(np.ascontiguousarray(words).astype("<u8").tobytes(), "little")
            self.plain = [whole(m) for m in self.masks], *map(whole, (self.inner, self.always, self.first, self.loops))
        masks, inner, always, first, loops = self.plain
        d = int.from_bytes(state.astype("<u8").tobytes(), "little")
        if at == 0 and text:
            d = (((d << 1) & inner | always | first) & masks[text[0]]) | (d & loops)
            at = 1
        for b in text[at:]:
            d = (((d << 1) & inner | always) & masks[b]) | (d & loops)
        return np.frombuffer(d.to_bytes(8 * self.words, "little"), "<u8")

    def accepts(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix (texts, globs). Texts are taken longest first, so each step touches only those still running."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        state = np.zeros((len(texts), self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        alive = len(texts)
        for at in range(int(lengths[0]) if len(texts) else 0):
            while alive and lengths[alive - 1] <= at:
                alive -= 1
            if alive <= FEW:
                for i in range(alive):
                    state[i] = self._walked(state[i], texts[order[i]], at)
                break
            d = state[:alive]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved = (moved & self.inner) | (self.always if at else (self.always | self.first))
            state[:alive] = (moved & self.masks[flat[offsets[:alive] + at]]) | (d & self.loops)
        out = np.zeros((len(texts), len(self.ends)), bool)
        for k, e in enumerate(self.ends):
            out[order, k] = (state[:, e // 64] >> np.uint64(e % 64)) & one != 0
        return out


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, url: str = "url",
    keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule (null if none fits) and verdict of every row."""
    globs = [b"*." + h.encode() + bytes([SEP]) + p.encode() + b"*" for h, p, _ in rules]
    names = [h + p for h, p, _ in rules]
    rank = np.array(sorted(range(len(rules)), key=lambda i: -len(names[i])), np.int64)

    def worker():
        automaton = ShiftAnd(globs) if globs else None

        def of(urls: list[str | None]) -> list[pa.Array]:
            parts = [canonical(u) for u in urls]
            best = np.full(len(urls), -1)
            if automaton and urls:
                hit = automaton.accepts([b"." + h.encode("utf-8", "surrogatepass") + bytes([SEP]) + p.encode("utf-8", "surrogatepass") for h,
                    p in parts])[:, rank]
                best = np.where(hit.any(axis=1), rank[hit.argmax(axis=1)], -1)
            rule = [names[b] if b >= 0 else None for b in best]
            verdict = [rules[b][2] if b >= 0 else default for b in best]
            return [pa.array(c, pa.string()) for c in ([h for h, _ in parts], [p for _, p in parts], rule, verdict)]

        return of

    return with_text_columns(df, keep, url, [StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")], worker)


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return judge(table(spark, sf_dir, "pages"))


SQL = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM a),
c AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM b),
r(rule_host, rule_path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                            ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
      FROM c JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM c LEFT JOIN m USING (page_id)
"""
