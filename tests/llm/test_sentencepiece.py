from __future__ import annotations

import random

import numpy as np
import pytest

from marginalia.llm import sentencepiece as S


def _best(v: S.Vocabulary, part: bytes) -> float:
    pieces = {v.text[int(i)].replace(b" ", S.MARK.encode()): s for i, s in zip(v.ids, v.scores, strict=True)}
    best = [0.0] + [-np.inf] * len(part)
    for i in range(len(part)):
        if best[i] == -np.inf:
            continue
        width = 1 + sum(part[i] >= x for x in (0xC0, 0xE0, 0xF0))
        best[min(i + width, len(part))] = max(best[min(i + width, len(part))], best[i] + v.unknown)
        for j in range(i + 1, len(part) + 1):
            if (s := pieces.get(part[i:j])) is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


@pytest.fixture(scope="module")
def small():
    rng = random.Random(1)
    words = sorted({rng.choice(["", S.MARK]) + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(60)} | {S.MARK, "a", "b", "c"})
    return S.Vocabulary([(300 + i, w, -rng.uniform(1, 9)) for i, w in enumerate(words)], list(range(256)))


def test_paths_score_like_brute_force(small):
    rng = random.Random(2)
    score = {int(i): s for i, s in zip(small.ids, small.scores, strict=True)}
    parts = [rng.choice(["", S.MARK]) + "".join(rng.choice("abcéx") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for part, ids in zip(parts, S.Codec(small).viterbi([p.encode() for p in parts]), strict=True):
        joined = b"".join(small.text[i].replace(b" ", S.MARK.encode()) for i in ids.tolist())
        assert joined == part.encode()
        if all(i in score for i in ids.tolist()):
            assert sum(score[i] for i in ids.tolist()) == pytest.approx(_best(small, part.encode()))


TEXTS = [None, "", " ", "hello world", "  two  spaces\nand lines\r\n\t", "naïve ▁mark▁ and \0 null \1", "日本語 🙂 é", "x" * 5000, "word " * 30_000, "\n\n"]


def test_round_trip_with_the_public_model():
    codec = S.Codec(S.Vocabulary.load(S.default_model()))
    for ids, t in zip(codec.encode(TEXTS), TEXTS, strict=True):
        assert codec.decode(ids) == t


def test_known_parts_may_be_dropped(small, monkeypatch):
    monkeypatch.setattr(S, "KNOWN_PARTS", 3)
    codec = S.Codec(small)
    for t in ("abc abc", "aab bca", "abc cab", "abc abc"):
        assert codec.decode(codec.encode([t])[0]) == t


def test_tables(spark, documents):
    docs = documents(list(enumerate(TEXTS)) + [(1, ""), (None, "x")])
    got = S.encode(docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "ids", "n_tokens", "restored"] and len(rows) == len(TEXTS) + 2
    assert all(r.restored for r in rows if r.ids is not None) and sum(r.ids is None for r in rows) == 1
    back = {r.doc_id: r.text for r in S.decode(got).collect()}
    assert back[3] == "hello world" and back[0] is None and back[7] == "x" * 5000
    assert S.encode(docs.limit(0)).count() == 0


def test_walking_alone_finds_the_same_paths(small):
    rng = random.Random(7)
    parts = [("".join(rng.choice("abcéx") for _ in range(rng.randint(1, 200)))).encode() for _ in range(200)]
    codec = S.Codec(small)
    for part, ids in zip(parts, codec.viterbi(parts), strict=True):
        assert codec._walk(part).tolist() == ids.tolist()


def test_a_long_run_without_spaces_is_quick():
    codec = S.Codec(S.Vocabulary.load(S.default_model()))
    for text in ("x" * 300_000, "漢字かな" * 60_000, "abcdefg" * 40_000):
        assert codec.decode(codec.encode([text])[0]) == text


def _field(number: int, data: bytes) -> bytes:
    out, n = bytearray([number << 3 & 0x7F | 2] if number < 16 else [(number << 3 | 2) & 0x7F | 0x80, (number << 3 | 2) >> 7]), len(data)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n]) + data


def test_a_unigram_models_own_scores_are_used(tmp_path):
    """A unigram model file written by hand (protocol buffers): its log scores choose the path, and the library agrees with it."""
    import struct

    import sentencepiece

    kinds = {"normal": 1, "unknown": 2, "control": 3, "byte": 6}
    pieces = [("<unk>", 0.0, "unknown"), ("<s>", 0.0, "control"), ("</s>", 0.0, "control")] + [(f"<0x{b:02X}>", -20.0, "byte") for b in range(256)]
    words = {"▁": -3.0, "▁the": -2.0, "▁t": -4.0, "he": -3.5, "r": -4.2, "e": -4.0, "re": -3.1, "▁there": -7.5, "h": -4.4, "t": -4.1, "▁is": -2.5,
        "i": -4.3, "s": -4.5, "a": -3.9, "▁a": -2.2, "at": -3.3}
    pieces += [(w, x, "normal") for w, x in words.items()]
    body = b"".join(_field(1, _field(1, p.encode()) + b"\x15" + struct.pack("<f", x) + b"\x18" + bytes([kinds[k]])) for p, x, k in pieces)
    trainer = b"\x18\x01" + bytes([35 << 3 & 0x7F | 0x80, 35 >> 4, 1])  # unigram, with byte fallback
    normaliser = _field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"
    path = tmp_path / "unigram.model"
    path.write_bytes(body + _field(2, trainer) + _field(3, normaliser))
    v = S.Vocabulary.load(str(path))
    assert {w: round(float(x), 4) for w, x in zip((S.MARK if v.text[int(i)] == b" " else v.text[int(i)].decode().replace(" ",
        S.MARK) for i in v.ids), v.scores, strict=True)} == words
    codec = S.Codec(v)
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in ("there is a the", "at the there", "this is that", "hat rat the re", "é is"):
        ids = codec.encode([text])[0].tolist()
        assert codec.decode(np.array(ids, np.int32)) == text and ids == library.encode(text), text


def test_kept_columns_give_way_to_results(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, ids string, N_tokens int")
    got = S.encode(df, keep=("doc_id", "ids", "N_tokens", "text"))
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "restored"] and got.first().restored
    assert S.decode(got, keep=("doc_id", "text")).columns == ["doc_id", "text"] and S.decode(got).first().text == "a b"
