"""Near-duplicate texts and vectors against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brooklet.llm import _links, op5_jaccard, op6_embeddings, registry
from brooklet.llm._links import components
from brooklet.session import table
from tests.compare import rows_of, rows_of_sql
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def _brute(rows, linked):
    """(id, links, class) of each row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i][1], rows[j][1]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, links[i], least.get(find(i))) for i, (key, _) in enumerate(rows)), key=str)


def _near(a, b):
    return bool(a and b) and len(a & b) / len(a | b) >= 0.8


def _family(rng, n, words=120):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = base[:]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_documents(llm):
    rows = [(r["doc_id"], _set(r["text"])) for r in table(llm, SF, "documents").collect()]
    found = sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in op5_jaccard.query(llm, SF).collect()), key=str)
    assert found == _brute(rows, _near)


def test_families_of_several_blocks(llm, odd_texts, monkeypatch):
    rng = random.Random(4)
    texts = [t for n in (60, 25, 2, 1) for t in _family(rng, n)] * 2
    rows = list(enumerate(texts, 100)) + odd_texts + [(50, "One two"), (51, "one, TWO"), (52, "one two three")]
    monkeypatch.setattr(op5_jaccard.links, "__defaults__", (16,))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in op5_jaccard.classes(docs).collect()), key=str)
    assert found == _brute([(i, _set(t)) for i, t in rows], _near)


def test_blocks_are_bounded_by_bytes(llm, monkeypatch):
    monkeypatch.setattr(_links, "BLOCK_BYTES", 40_000)

    def verify(payloads):
        if sum(map(len, payloads)) > 200_000:  # two blocks of four on average, by hash
            raise MemoryError("a unit is too large")
        return np.ones((len(payloads), len(payloads)), dtype=bool)

    nodes = llm.range(60).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("weight"), F.repeat(F.lit("x"), 10_000).cast("binary").alias("payload"))
    buckets = nodes.select(F.lit(1).cast("long").alias("bucket"), "node", F.octet_length("payload").cast("long").alias("bytes"))
    assert {r["links"] for r in _links.links(buckets, nodes, verify).collect()} == {59}
    with pytest.raises(Exception, match="a unit is too large"):
        _links.links(buckets.drop("bytes"), nodes, verify).collect()


def test_one_of_each(llm, odd_docs, odd_texts):
    kept = op5_jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:20]) for r in kept.collect()), key=str) == sorted({(i, (t or "")[:20]) for i, t in odd_texts if i != 8}, key=str)
    assert op5_jaccard.one_of_each(odd_docs.filter("false")).count() == 0


def test_bands_follow_from_the_recall():
    b = op5_jaccard.n_bands(0.8, 8, 0.9998)
    assert 1 - (1 - 0.8**8) ** b >= 0.9998 > 1 - (1 - 0.8**8) ** (b - 1)


def test_components(llm):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["node"]: r["component"] for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


def _vectors(rng):
    base = rng.standard_normal((6, 24))
    rows = []
    for i in range(160):
        v = base[i % 6] + rng.standard_normal(24) * 0.12
        rows.append((i, v.tolist(), int(i % 2)))
    rows += [(200, base[0].tolist(), 0), (201, (base[0] * 3).tolist(), 0), (202, base[0].tolist(), 1), (203, base[0].tolist(), None), (204, None, 0), (205, [0.0] * 24, 0), (206, [float("nan")] * 24, 0), (207, [None] + base[0].tolist()[1:], 0), (208, [], 0), (209, [1.0], 0), (209, [1.0], 0), (None, base[1].tolist(), 1), (None, [5.0, 5.0], 9), (211, [float("inf"), 1.0], 0), (212, [1e-200, 0.0], 3), (213, [1e200, 0.0], 3)]
    return rows


def _cosine(a, b):
    (x, k), (y, m) = a, b
    if k is None or k != m or x is None or y is None or len(x) != len(y) or not x:
        return False
    if any(v is None or not np.isfinite(v) for v in (*x, *y)):
        return False
    x, y = (np.array(v) / np.abs(v).max() if np.any(v) else np.array(v) for v in (x, y))
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return bool(n) and x @ y / n >= 0.98


def test_vectors(llm, monkeypatch):
    rows = _vectors(np.random.default_rng(6))
    monkeypatch.setattr(op6_embeddings.links, "__defaults__", (16,))
    df = llm.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    found = op6_embeddings.components_of(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=str) == _brute([(i, (v, k)) for i, v, k in rows], _cosine)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)
    assert op6_embeddings.components_of(df.filter("false")).count() == 0


def test_recall_on_the_table(llm):
    t = table(llm, "/root/testdata/sf0.1", "embeddings").toPandas()
    truth = 0
    for _, g in t.groupby("label"):
        x = np.stack(g["embedding"]).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a = x @ x.T >= 0.98
        truth += a.sum() - len(a)
    assert sum(r["n_links"] for r in op6_embeddings.query(llm, "/root/testdata/sf0.1").collect()) >= 0.9 * truth


def test_collision_chance_as_simulated():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((20000, 2)) @ np.array([0.2, 0.0]) / 1.0
    shift = rng.random(20000) * 1.6
    same = np.floor(shift / 1.6) == np.floor((shift + a) / 1.6)
    assert same.mean() == pytest.approx(op6_embeddings.collision(0.2, 1.6), abs=0.01)


@pytest.mark.parametrize("name", ["op5_ngram_jaccard_join", "op6_embedding_near_dedup", "op7_decontaminate"])
def test_query_by_sql(llm, name):
    assert rows_of(registry.queries()[name](llm, "/root/testdata/sf0.01")) == rows_of_sql(registry.oracle_sql()[name], "/root/testdata/sf0.01")


def test_pairs_that_share_several_buckets_count_once(llm, monkeypatch):
    """Random memberships: links by brute force, with blocks of 8 so that buckets are cut, and a hub node in every bucket."""
    rng = random.Random(8)
    kind = {i: rng.randint(0, 2) for i in range(120)}
    members = {b: rng.sample(range(1, 120), rng.choice((1, 2, 3, 40, 70))) + [0] * (b % 3 == 0) for b in range(25)}
    members[30] = members[7]  # the same members again
    shared = {(i, j) for m in members.values() for i in m for j in m if i != j and kind[i] == kind[j]}
    buckets = llm.createDataFrame([(b, i) for b, m in members.items() for i in m], "bucket long, node long")
    payloads = llm.createDataFrame([(i, 1 + i % 3, bytes([k])) for i, k in kind.items()], "node long, weight long, payload binary")
    monkeypatch.setattr(_links, "HEAVY", 10)
    found = {r["node"]: (r["links"], r["component"]) for r in _links.links(buckets, payloads, lambda p: np.array(p)[:, None] == np.array(p)[None], 8).collect()}
    weights = {i: sum(1 + j % 3 for k, j in shared if k == i) for i in kind}
    assert {i: n for i, (n, _) in found.items()} == {i: n for i, n in weights.items() if n}
    root = {i: i for i in kind}
    for _ in kind:
        for i, j in shared:
            root[i] = root[j] = min(root[i], root[j])
    assert all(c == root[i] for i, (_, c) in found.items())


def test_ties_at_the_threshold(llm):
    """20 texts of which each pair has exactly 8 of 10 n-grams in common, and as many with 7 of 10."""
    def text(own, k, n):
        return " ".join(f"{own}{i}" for i in range(n)) + f" {own}x{k}" * 1

    rows = [(k, text("a", k, 12)) for k in range(20)] + [(100 + k, text("b", k, 11)) for k in range(20)]
    sets = [(i, _set(t)) for i, t in rows]
    assert {len(a & b) / len(a | b) for (i, a) in sets[:20] for (j, b) in sets[:20] if i < j} == {0.8}
    found = sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in op5_jaccard.classes(llm.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == _brute(sets, _near) and found[0][1] == 19 and all(n == 0 for i, n, _ in found if i >= 100)


def test_texts_that_are_merely_akin_do_not_meet(llm):
    """Texts that share half of their n-grams chain no candidate groups, so that no payload is copied for them."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base + [f"x{rng.randint(0, 10**9)}" for _ in range(28)]) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = [_set(t) for t in texts[:40]]
    assert max(len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]) < 0.51
    sketched = op5_jaccard.sketches(llm.createDataFrame(rows, "doc_id long, text string"), 5, op5_jaccard.n_bands(0.8, 8, 0.9998), 8).collect()
    near = op5_jaccard.akin(0.8)([bytes(r["sketch"]) for r in sketched])
    assert near.sum() == len(rows)


def test_labels_that_are_no_whole_numbers(llm):
    rows = [(1, [1.0, 0.0], 1.2), (2, [1.0, 0.0], 1.7), (3, [2.0, 0.0], 1.2)]
    found = op6_embeddings.components_of(llm.createDataFrame(rows, "vec_id long, embedding array<double>, label double")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 1, 1), (2, 0, 2), (3, 1, 1)]


def test_hashes_follow_the_number_of_vectors():
    far = np.full(1000, np.sqrt(2))
    found = [op6_embeddings.least_work(far, n, 0.98, 1.6, 0.9998) for n in (10, 10**4, 10**6, 10**9)]
    assert found == sorted(found) and found[0] < found[-1]
    k = found[-1]  # at 10^9 vectors of a label, chance leaves less than one other vector to a bucket's row
    assert 10**9 * op6_embeddings.collision(np.sqrt(2), 1.6) ** k < 4
