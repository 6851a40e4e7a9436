"""Operator 13: BPE of words by a trie whose shared prefixes are encoded once, and its decoding.

The vocabulary has word ends: the last symbol of a word is another one than the same character inside a word. A text is normalised
and cut into words by the tokenizer's own rules; the ids of each distinct word then come from the traversal of a trie:

1. The distinct words of a batch are inserted into a trie (an edge holds a run of characters, so a long word is one edge).
2. Depth-first, each prefix gets its state: the last token of the prefix's encoding. Of the tokens that end a prefix, it is the
   one that may follow the last token of what is before it: two tokens may be neighbours if no merge crosses their border before the
   pieces at that border are themselves merged away (``crossing``). Exactly one token does, so the state of a prefix is found once for
   all words that begin with it.
3. At the end of a word the same is asked of the tokens with a word end, and the ids are read back along the states.

Texts are cut at ASCII white space first: it belongs to no word, and nothing composes across it. Each worker remembers the ids of
such stretches, up to a bound. No shuffle; memory doesn't depend on the size of a partition.

An added token's string in a text (an end-of-text mark) is one id, and what is around it is normalised apart, as by the library.
Decoding joins the tokens of the ids by one space, as the library does for a tokenizer without a decoder; ids outside the vocabulary give
nothing.

Nulls and odd rows: a null text is an empty one, without ids, and decodes to an empty text; a null doc_id stays null; repeated rows
give their ids again; a text of any length is encoded whole, a word of any length too; other columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm._bpe import SLICE, Encoder
from brooklet.llm._text import BASE2, Hasher, batches, gather, runs
from brooklet.session import table

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Pairs of tokens, and words, remembered by one worker before it starts afresh.
PAIRS, WORDS = 1 << 20, 1 << 18
#: Characters by which the tokens that may end a text are looked up.
TAIL = 4
NEVER = 1 << 60


class Merges:
    """Which tokens stand alone, and which may be neighbours."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end, self.vocab = end, vocab
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(merges)}
        if len(self.parts) < len(merges):
            raise ValueError("a token is made by two merges")
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for token in vocab.values():  # merges come in the order of their ranks, so a token's parts have lower ids
            self.left[token], self.right[token] = self._edge(token, 0), self._edge(token, 1)
        alone: dict[int, bool] = {}
        for token, (a, b, r) in sorted(self.parts.items(), key=lambda x: x[1][2]):
            alone[token] = alone.get(a, True) and alone.get(b, True) and self.crossing(a, b) == r
        width = {t: len(s.removesuffix(end)) for s, t in vocab.items()}
        #: Tokens inside words and at their ends that merging can leave, by their characters; how many characters each has.
        self.inner = {s: t for s, t in vocab.items() if not s.endswith(end) and alone.get(t, width[t] == 1)}
        self.last = {s.removesuffix(end): t for s, t in vocab.items() if s.endswith(end) and alone.get(t, width[t] == 1)}
        self.width = width
        self.longest = max(width.values())
        #: Lengths of the tokens that end in the same few characters, longest first; ``lengths`` adds what a text asks for.
        self.ends: dict[str, tuple[int, ...]] = {}
        for s in self.inner.keys() | self.last.keys():
            for k in range(1, min(len(s), TAIL) + 1):
                self.ends[s[-k:]] = (*self.ends.get(s[-k:], ()), len(s))
        for tail, found in self.ends.items():
            short = (k for k in range(1, len(tail)) if tail[-k:] in self.inner or tail[-k:] in self.last)
            self.ends[tail] = tuple(sorted({*found, *short}, reverse=True))
        self.asked: dict[str, tuple[int, ...]] = {}

    def lengths(self, tail: str) -> tuple[int, ...]:
        """How long the tokens may be that end a text whose last ``TAIL`` characters, or all of them, are ``tail``."""
        if len(self.asked) >= PAIRS:
            self.asked.clear()
        known = next((k for k in range(len(tail), 0, -1) if tail[-k:] in self.ends), 0)
        found = self.asked[tail] = tuple(n for n in self.ends[tail[-known:]] if n <= known or known == len(tail)) if known else ()
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stand at one edge of the token while it is merged, each with the rank of the merge that takes it in."""
        out, taken = [], NEVER
        while True:
            out.append((token, taken))
            if token not in self.parts:
                return out
            taken = self.parts[token][2]
            token = self.parts[token][side]

    def crossing(self, a: int, b: int) -> int:
        """The rank of the first merge across the border of two neighbours; ``NEVER`` if there is none.

        Of equal merges the leftmost comes first: a piece on the left is taken in before a merge of the same rank crosses, one on the right isn't.
        """
        return min((r for x, end_x in self.right[a] for y, end_y in self.left[b] if (r := self.rank.get((x, y), NEVER)) < end_x and r <= end_y), default=NEVER)

    def neighbours(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[a, b] = self.crossing(a, b) >= NEVER
        return found

    def ending(self, tokens: dict[str, int], text: str, end: int, depth: int, state: list[int]) -> int:
        """The token that ends the encoding of the ``depth`` characters before ``end``, by the states of their prefixes."""
        tail = text[max(0, end - min(TAIL, depth)) : end]
        lengths = self.asked.get(tail)
        for n in self.lengths(tail) if lengths is None else lengths:
            if n <= depth and (token := tokens.get(text[end - n : end])) is not None:
                if n == depth:
                    return token
                before = state[depth - n]
                fits = self.known.get((before, token))
                if self.neighbours(before, token) if fits is None else fits:
                    return token
        raise ValueError(f"no encoding ends in {text[max(0, end - self.longest) : end]!r}")


class Node:
    """A trie's node: the characters on the edge to it, the word that ends here, the edges on by first character."""

    __slots__ = ("label", "next", "word")

    def __init__(self, label: str, word: int | None = None):
        self.label, self.word, self.next = label, word, {}


def insert(root: Node, word: str, number: int) -> None:
    node, at = root, 0
    while at < len(word):
        child = node.next.get(word[at])
        if child is None:
            node.next[word[at]] = Node(word[at:], number)
            return
        label, n = child.label, len(child.label)
        if not word.startswith(label, at):
            n = next(i for i in range(1, n + 1) if at + i == len(word) or word[at + i] != label[i])
            between = Node(label[:n])
            between.next[label[n]], child.label = child, label[n:]
            node.next[word[at]] = child = between
        node, at = child, at + n
    node.word = number


def encode_words(merges: Merges, words: list[str]) -> list[list[int]]:
    """The ids of distinct words, by one depth-first traversal of their trie."""
    root = Node("")
    for k, word in enumerate(words):
        if word:
            insert(root, word, k)
    out: list[list[int]] = [[] for _ in words]
    inner, last, width, longest, ending = merges.inner, merges.last, merges.width, merges.longest, merges.ending
    state = [-1]  # state[n]: the last token of the encoding of the first n characters on the way from the root
    todo = [(child, 0, "") for child in root.next.values()]
    while todo:
        node, depth, tail = todo.pop()
        text = tail + node.label
        del state[depth + 1 :]
        for end in range(len(tail) + 1, len(text) + 1):
            depth += 1
            state.append(ending(inner, text, end, depth, state))
        if node.word is not None:
            ids, at = [ending(last, text, len(text), depth, state)], depth
            while at := at - width[ids[-1]]:
                ids.append(state[at])
            out[node.word] = ids[::-1]
        tail = text[-longest:]
        todo += [(child, depth, tail) for child in node.next.values()]
    return out


class Stretches:
    """Ids of stretches of text without white space; words that were seen are remembered."""

    def __init__(self, path: str, library):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"])
        self.library, self.seen = library, {}
        self.added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

        cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        #: The pattern of words, where all that the rules do to printable ASCII is to lower it and take what the pattern finds.
        self.plain = None
        if [n.get("type") for n in (file.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]:
            if cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]:
                self.plain = regex.compile(cuts[0]["pattern"]["Regex"])

    def _words(self, text: str) -> list[str | int]:
        if self.plain and text.isascii() and text.isprintable() and not (self.mark and self.mark.search(text)):
            return self.plain.findall(text.lower())
        parts = self.mark.split(text) if self.mark else [text]
        found: list[str | int] = []
        for part in parts:
            if part in self.added:
                found.append(self.added[part])
            elif part:
                found += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return found

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[SimpleNamespace]:
        """As the library's method of this name, for the tokenizer's remembering encoder."""
        cut = [self._words(t) for t in texts]
        if len(self.seen) >= WORDS:
            self.seen.clear()
        new = list({w for words in cut for w in words if isinstance(w, str) and w not in self.seen})
        collecting = gc.isenabled()
        gc.disable()  # a trie is many objects and no cycle
        try:
            self.seen.update(zip(new, encode_words(self.merges, new), strict=True))
        finally:
            if collecting:
                gc.enable()
        return [SimpleNamespace(ids=[i for w in words for i in ([w] if isinstance(w, int) else self.seen[w])]) for words in cut]


class WordEncoder(Encoder):
    """Ids of whole texts, and their decoding."""

    def __init__(self, path: str):
        super().__init__(path)
        names = {i: self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())}
        self.names = _Pieces([(names[i] + " ").encode() if names[i] is not None else b"" for i in names])
        self.numbers = _Pieces([f"{i} ".encode() for i in names])
        self.tokenizer = Stretches(path, self.tokenizer)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = runs(~_SPACE[data], off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        h, check = Hasher(data).spans(starts, ends), Hasher(data, BASE2).spans(starts, ends)
        h[h == 0] = 1
        parts = [self._look(data, starts[i : i + SLICE], ends[i : i + SLICE], h[i : i + SLICE], check[i : i + SLICE]) for i in range(0, len(starts), SLICE)]
        if any(p is None for p in parts):  # two stretches share a hash: without memory
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts)]
            parts = [(np.array([i for x in ids for i in x], dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64))]
        flat, lengths = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        edges = np.searchsorted(starts, off)
        return flat, total[edges[1:]] - total[edges[:-1]]


class _Pieces:
    """Byte strings by number, each with a space at its end, put together for many lists of numbers at once."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def joined(self, numbers: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """The pieces of each list, without the last space."""
        edges = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = numbers[a:b]
            own = own[(own >= 0) & (own < len(self.size))]
            yield gather(self.flat, self.start[own], self.size[own])[:-1].tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and the text that they decode to."""

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in rows:
            for a, b, data, off in batches(batch.column(1), 1 << 20):
                ids, counts = bpe.encode(data, off)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                texts = pa.array([t.decode() for t in bpe.names.joined(ids, counts)], pa.string())
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists, texts], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def decoded(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids); null ids, or a null among them, give nothing."""

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in rows:
            lists = [[] if x is None else [-1 if i is None else i for i in x] for x in batch.column(1).to_pylist()]
            ids, counts = np.array([i for x in lists for i in x], dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64)
            texts = pa.array([t.decode() for t in bpe.names.joined(ids, counts)], pa.string())
            yield pa.record_batch([batch.column(0), texts], names=["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(work, "doc_id long, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text: what ``encoded`` gives, as digests, without moving it."""

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in rows:
            for a, b, data, off in batches(batch.column(1), 1 << 20):
                ids, counts = bpe.encode(data, off)
                sums = [pa.array([hashlib.sha256(x).hexdigest() for x in table.joined(ids, counts)], pa.string()) for table in (bpe.numbers, bpe.names)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), *sums], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
