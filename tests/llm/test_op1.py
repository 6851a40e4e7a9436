"""Encoding against the library, folds against the library and brute force, decoding as a round trip."""

from __future__ import annotations

import random
from functools import lru_cache

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from brooklet.llm import op1_sentencepiece as op
from brooklet.session import table
from tests.llm.conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_documents_as_the_library(llm, library):
    docs = {r["doc_id"]: r["text"] for r in table(llm, SF, "documents").collect()}
    rows = op.query(llm, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["ids"] == library.encode(docs[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["exact"]


def test_odd_texts(llm, odd_docs, odd_texts, library):
    extra = ["  two  blanks ", "a\u2581b", "tab\tline\n\n  end ", "\x00\x01", "=" * 500, "ab" * 700, "naïve café", "𝔘𝔫𝔦"]
    docs = odd_docs.select("doc_id", "text").unionByName(llm.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    found = sorted(((r["doc_id"], r["text"], r["ids"]) for r in op.encode(docs, op.Pieces.read(PATH)).collect()), key=str)
    every = [*odd_texts, *((100 + i, t) for i, t in enumerate(extra))]
    assert found == sorted(((i, t, None if t is None else library.encode(t)) for i, t in every), key=str)


def test_empty_table(llm, odd_docs):
    assert op.encode(odd_docs.filter("false"), op.Pieces.read(PATH)).count() == 0


def test_decode(llm):
    rows = llm.createDataFrame([(1, [28705, 3]), (2, []), (3, None)], "k int, ids array<int>")
    pieces = op.Pieces.read(PATH)
    found = {r["k"]: r["decoded"] for r in op.decode(rows, pieces).collect()}
    assert found == {1: "\x00", 2: "", 3: None}


def test_long_units_as_short_ones(library):
    pieces = op.Pieces.read(PATH)
    order = sorted(range(len(pieces.ids)), key=lambda k: -pieces.scores[k])
    rank = {pieces.names[k]: (r, pieces.ids[k]) for r, k in enumerate(order)}
    rng = random.Random(1)
    for _ in range(200):
        word = "▁" + "".join(rng.choice("thenai") for _ in range(rng.randint(1, 90)))
        assert op.merge_long(word, rank, pieces.byte_ids) == library.encode(word[1:])


def _best(word: str, scores: dict[str, float]) -> float:
    least = min(scores.values()) + op.UNKNOWN

    @lru_cache(None)
    def at(i: int) -> float:
        if i == 0:
            return 0.0
        return max(at(j) + scores.get(word[j:i], least if i - j == 1 else float("-inf")) for j in range(i))

    return at(len(word))


def test_viterbi_against_brute_force(llm):
    names = ["a", "b", "ab", "ba", "aba", "bb", "abb", "é", "aé"]
    rng = random.Random(2)
    scores = [-rng.random() * 5 for _ in names]
    pieces = op.Pieces(names, list(range(10, 10 + len(names))), scores, list(range(100, 356)), bpe=False)
    words = sorted({"".join(rng.choice("abéz") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    found = {r["unit"]: r["ids"] for r in op.encoded_units(llm.createDataFrame([(w,) for w in words], "unit string"), pieces).collect()}
    by_id = dict(zip(pieces.ids, names, strict=True))
    own = dict(zip(names, scores, strict=True))
    for w in words:
        ids, total, raw = list(found[w]), 0.0, b""
        while ids:
            if ids[0] in by_id:
                total, raw = total + own[by_id[ids[0]]], raw + by_id[ids.pop(0)].encode()
            else:
                letter = bytes([ids.pop(0) - 100])
                while ids and ids[0] >= 100 and (ids[0] - 100) & 0xC0 == 0x80:
                    letter += bytes([ids.pop(0) - 100])
                total, raw = total + min(scores) + op.UNKNOWN, raw + letter
        assert raw.decode() == w
        assert total == pytest.approx(_best(w, own))


def test_cuts_are_where_no_piece_reaches():
    cutter = op.Cutter({"ab", "bc"})
    import numpy as np

    data = np.frombuffer(b"abcab", dtype=np.uint8)
    cp, s, e, first = cutter.units(data, np.array([0, 5]))
    assert ["".join(map(chr, cp[a:b])) for a, b in zip(s, e, strict=True)] == ["▁", "abc", "ab"] and first.tolist() == [0, 3]


def test_lattice_is_joined_not_collected(llm):
    pieces = op.Pieces(["ab", "a", "b"], [0, 1, 2], [-1.0, -2.0, -3.0], list(range(3, 259)))
    plan = op.lattice(llm.createDataFrame([("ab",)], "unit string"), pieces.frame(llm), 2)
    assert plan.select("n", F.size("edges").alias("m")).collect()[0][:] == (2, 2)


def _message(*fields: tuple[int, object]) -> bytes:
    """Fields in protocol-buffer form."""
    import struct

    def number(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += number(k << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += number(k << 3) + number(v)
        else:
            raw = v.encode() if isinstance(v, str) else v
            out += number(k << 3 | 2) + number(len(raw)) + raw
    return out


def test_a_unigram_model_as_the_library(llm, tmp_path):
    """A hand-made piece table: short texts, units of 80 and 10,000 characters, and the type as the file has it."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(60)}) + ["a", "b", "c", "\u2581", "\u2581a", "\u2581ab"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((n, -rng.randint(16, 160) / 16, 1) for n in names)]
    model = _message(*((1, _message((1, n), (2, s), (3, k))) for n, s, k in pieces), (2, _message((3, 1))), (3, _message((1, "identity"), (3, 1), (4, 0), (5, 1))))
    path = f"{tmp_path}/hand.model"
    with open(path, "wb") as file:
        file.write(model)
    assert op.model_type(model) == "unigram" and op.model_type(open(PATH, "rb").read()) == "bpe"
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [" ".join(word(rng.randint(1, 30)) for _ in range(20)) for _ in range(20)] + [word(60), word(61), word(62), word(63), word(80), word(10_000)]
    mine = op.Pieces.read(path)
    assert not mine.bpe
    score = dict(zip(mine.ids, mine.scores, strict=True))
    for r in op.encode(llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), mine).collect():
        own, theirs = r["ids"], library.encode(texts[r["doc_id"]])
        assert library.decode(own) == texts[r["doc_id"]]
        assert sum(score[i] for i in own) == pytest.approx(sum(score[i] for i in theirs))  # of equal paths either may be taken
