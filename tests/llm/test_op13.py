"""BPE by a trie against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brooklet.llm import op13_bpe
from brooklet.session import table
from tests.llm.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _row(key, text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return key, len(ids), _sha(" ".join(map(str, ids))), _sha(LIBRARY.decode(ids, skip_special_tokens=False))


def _encode(texts):
    raw = [t.encode() for t in texts]
    flat, counts = op13_bpe.encoder(PATH).encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def _expected(texts):
    return [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def test_documents_as_the_library(llm):
    docs = table(llm, SF, "documents").collect()
    assert sorted(map(tuple, op13_bpe.query(llm, SF).collect())) == sorted(_row(r["doc_id"], r["text"]) for r in docs)


def test_odd_documents(llm, odd_docs, odd_texts):
    found = op13_bpe.digests(odd_docs, PATH)
    assert sorted(map(tuple, found.collect()), key=str) == sorted((_row(*r) for r in odd_texts), key=str)
    assert op13_bpe.digests(odd_docs.filter("false"), PATH).count() == 0


def test_ids_and_their_text(llm, odd_docs, odd_texts):
    found = op13_bpe.encoded(odd_docs, PATH)
    ids = [LIBRARY.encode(t or "", add_special_tokens=False).ids for _, t in odd_texts]
    texts = [LIBRARY.decode(x, skip_special_tokens=False) for x in ids]
    assert sorted((r["ids"], r["decoded"]) for r in found.collect()) == sorted(zip(ids, texts, strict=True))
    again = op13_bpe.decoded(found.select("doc_id", "ids"), PATH)
    assert sorted(r["decoded"] for r in again.collect()) == sorted(texts)
    odd = llm.createDataFrame([(1, None), (2, [None, 320]), (3, [10**6, -5]), (4, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in op13_bpe.decoded(odd, PATH).orderBy("doc_id").collect()] == ["", LIBRARY.decode([320]), "", ""]


def test_runs_tokens_and_letters():
    rng, names = random.Random(3), [n.replace("</w>", "") for n in LIBRARY.get_vocab()]
    texts = [c * k for c in ("a", "the", "!", "=-", "lol", "0") for k in range(60)]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    texts += ["".join(rng.choice(names) for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    assert _encode(texts) == _expected(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aabehimnorstvl'’ .,!?0129\t\n\r\x0b\x1c\x1f\x85 　ÀéßñΣσςİıŃ漢字カ가각🎉ﬁǅ̧̣́Å")), min_size=1))
def test_any_text(texts):
    assert _encode(texts) == _expected(texts)


def test_added_tokens():
    texts = ["x<|endoftext|>y<|startoftext|>", "<|ENDOFTEXT|>", "e<|endoftext|>́", "it's <|endoftext|>'s ' s", "<|endoftext|><|endoftext|>", "<|endof text|>"]
    assert _encode(texts) == _expected(texts)


def test_a_long_word():
    text = "ab" * 100_000 + "c"
    assert _encode([text]) == _expected([text])


def test_stretches_that_share_a_hash(monkeypatch):
    bpe = op13_bpe.WordEncoder(PATH)
    monkeypatch.setattr(bpe, "_look", lambda *_: None)
    data, off = np.frombuffer(b"one two, three's", dtype=np.uint8), np.array([0, 4, 4, 16])
    flat, counts = bpe.encode(data, off)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == _expected(["one ", "", "two, three's"])


def test_prefixes_are_encoded_once(monkeypatch):
    merges = op13_bpe.encoder(PATH).tokenizer.merges
    asked, ending = [], merges.ending
    monkeypatch.setattr(merges, "ending", lambda tokens, text, end, depth, state: asked.append(depth) or ending(tokens, text, end, depth, state))
    words = ["inter", "internal", "internals", "international", "interest"]
    ids = op13_bpe.encode_words(merges, words)
    assert ids == _expected(words)
    prefixes = {w[:n] for w in words for n in range(1, len(w) + 1)}
    assert len(asked) == len(prefixes) + len(words)


def test_a_token_of_two_merges_is_refused():
    vocab = {s: i for i, s in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    with pytest.raises(ValueError):
        op13_bpe.Merges(vocab, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], "</w>")
