"""Clusters and codes of vectors against brute force in Python's integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from brooklet.llm import _whole, op11_clusters, op12_codes, registry
from brooklet.session import table
from tests.compare import rows_of, rows_of_sql
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label string, cluster string, n int, error string, key string"


def _floor(v, scale):
    return v.numerator * scale // v.denominator if hasattr(v, "denominator") else math.floor(v * scale) if abs(v) < 1e200 else int(v) * scale


def _d(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))


def _nearest(x, entries):
    return min(range(len(entries)), key=lambda j: (_d(x, entries[j]), j))


def _moved(points, owner, entries):
    out = []
    for j, old in enumerate(entries):
        own = [p for p, o in zip(points, owner, strict=True) if o == j]
        out.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else old)
    return out


def _fit(v):
    return v if v is not None and v < 1 << 63 else None


def _whole_rows(rows):
    return [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]


def _clusters(rows, k, rounds, width, scale=1024, salt="3:"):
    rows = [(i, [_floor(v, scale) for v in e]) for i, e, *_ in _whole_rows(rows) if len(e) == width]
    order = sorted(rows, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    c, points = [x for _, x in order[:k]], [x for _, x in rows]
    for _ in range(rounds):
        c = _moved(points, [_nearest(x, c) for x in points], c)
    owner = [_nearest(x, c) for x in points]
    d = [_d(x, c[j]) for x, j in zip(points, owner, strict=True)]
    per = {j: None if any(_fit(v) is None for v, o in zip(d, owner, strict=True) if o == j) else _fit(sum(v for v, o in zip(d, owner, strict=True) if o == j)) for j in set(owner)}
    total = None if None in per.values() else _fit(sum(per.values()))
    return sorted(((i, j, _fit(v), per[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), j, v in zip(rows, owner, d, strict=True)), key=str)


def _codes(rows, parts, entries, rounds, scale=4096):
    rows = sorted(_whole_rows(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) if rows else 0
    fit = [k for k, r in enumerate(rows) if len(r[1]) == width and width and width % parts == 0]
    w, code, error, digest = width // parts, [None] * len(rows), [None] * len(rows), []
    for p in range(parts if fit else 0):
        points = [[_floor(v, scale) for v in rows[k][1][p * w : (p + 1) * w]] for k in fit]
        book = points[:entries]
        for _ in range(rounds):
            book = _moved(points, [_nearest(x, book) for x in points], book)
        digest += [str(v) for e in book for v in e]
        for k, x in zip(fit, points, strict=True):
            j = _nearest(x, book)
            code[k], error[k] = (code[k] or "") + f"{j:02x}", (error[k] or 0) + _d(x, book[j])
    for k in range(len(rows)):
        if rows and width == 0 and not rows[k][1]:
            code[k], error[k] = "00" * parts, 0
    error = [_fit(e) for e in error]
    per = {}
    for r, e in zip(rows, error, strict=True):
        per[r[2]] = None if e is None or per.get(r[2], 0) is None else _fit(per.get(r[2], 0) + e)
    sha = hashlib.sha256(",".join(digest).encode()).hexdigest()
    return sorted(((r[0], c, e, per[r[2]], sha) for r, c, e in zip(rows, code, error, strict=True)), key=str)


def _rows(n, width, seed, steps=6):
    """Vectors on a coarse grid, so that ties abound, with copies and odd rows."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(v) for v in rng.integers(-steps, steps, width) / 1024], f"l{rng.integers(0, 3)}" if i % 7 else None) for i in rng.permutation(n)]
    odd = [(None, rows[0][1], "l1"), (None, rows[1][1], None), (5000, None, "l0"), (5001, [None] * width, "l0"), (5002, [math.nan] * width, None), (5003, [math.inf] + [0.0] * (width - 1), "l2"), (5004, [0.0], "l9"), (5005, [], "l9"), rows[3], rows[3]]
    return rows + odd


def _table(llm, rows):
    return llm.createDataFrame([(*r, "x", 1, None, "k") for r in rows], SCHEMA)


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_vector_codes"])
def test_query_as_its_sql(llm, name):
    assert rows_of(registry.queries()[name](llm, SF)) == rows_of_sql(registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_with_ties_and_odd_rows(llm, seed):
    rows = _rows(300, 4, seed)
    assert _got(op11_clusters.clusters(_table(llm, rows).repartition(3), 7, 4, 4)) == _clusters(rows, 7, 4, 4)


def test_few_or_no_vectors(llm):
    few = [(3, [0.5, 1.0], "a"), (1, [0.25, -1.0], None), (1, [0.25, -1.0], None)]
    assert _got(op11_clusters.clusters(_table(llm, few), 8, 3, 2)) == _clusters(few, 8, 3, 2)
    assert _got(op12_codes.compressed(_table(llm, few), 2, 16, 3).drop("label")) == _codes(few, 2, 16, 3)
    for found in (op11_clusters.clusters(_table(llm, []), 8, 3, 2), op12_codes.compressed(_table(llm, [])), op11_clusters.clusters(_table(llm, few), 8, 3, 5)):
        assert found.collect() == []


def test_numbers_beyond_64_bits(llm):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.standard_normal(4) * 10.0 ** rng.integers(-3, 30)], "a" if i < 20 else "b") for i in range(60)]
    rows += [(60 + i, [float(v) for v in rng.standard_normal(4)], "c") for i in range(60)]
    assert _got(op11_clusters.clusters(_table(llm, rows), 6, 4, 4)) == _clusters(rows, 6, 4, 4)
    assert _got(op12_codes.compressed(_table(llm, rows), 2, 6, 4).drop("label")) == _codes(rows, 2, 6, 4)
    rows += [(999, [1e308, -1e308, 1e307, 0.0], "d"), (1000, [1e308, -1e308, 0.0, 1e-320], "d")]
    assert _got(op11_clusters.clusters(_table(llm, rows), 6, 3, 4)) == _clusters(rows, 6, 3, 4)
    assert _got(op12_codes.compressed(_table(llm, rows), 2, 6, 3).drop("label")) == _codes(rows, 2, 6, 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_with_ties_and_odd_rows(llm, monkeypatch, seed):
    monkeypatch.setattr(op12_codes, "BLOCK", 100)
    rows = _rows(300, 6, seed)
    assert _got(op12_codes.compressed(_table(llm, rows).repartition(2), 3, 5, 4).drop("label")) == _codes(rows, 3, 5, 4)


def test_vectors_of_no_component_and_odd_lengths(llm):
    rows = [(1, [], "a"), (2, [], None), (3, [1.0], "a")]
    assert _got(op12_codes.compressed(_table(llm, rows)).drop("label")) == _codes(rows, 8, 16, 6)
    rows = [(1, [1.0, 2.0, 3.0], "a"), (2, [1.0, 2.0, 4.0], "a")]
    assert _got(op12_codes.compressed(_table(llm, rows), 2).drop("label")) == _codes(rows, 2, 16, 6)


def test_bounds_spare_distances(llm):
    log = []
    n = op11_clusters.clusters(table(llm, "/root/testdata/sf0.1", "embeddings"), log=log).count()
    assert len(log) == 11 and sum(log) < 0.7 * 8 * 11 * n


def test_bounds_hold_after_any_moves():
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (400, 3))
    c = op11_clusters.Centroids.of(x[:9])
    state = np.zeros(len(x), dtype=np.int64), np.full(len(x), math.inf), np.zeros((len(x), 9))
    for _ in range(12):
        *state, _ = op11_clusters.assign(x, c, *state)
        d = op11_clusters.squares(x[:, None], c.x[None])
        assert (state[0] == d.argmin(axis=1)).all()
        assert (state[1] >= np.sqrt(d.min(axis=1))).all() and (state[2] <= np.sqrt(d)).all()
        c = op11_clusters.Centroids.of(c.x + rng.integers(-3, 4, c.x.shape), c.x)


def test_trees_assign_whole_subtrees():
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((4000, 2)) * 3 + rng.integers(0, 6, (4000, 1)) * 1000).astype(np.int64)
    entries = np.array([[k * 1000, k * 1000] for k in range(6)] + [[0, 0]])
    owner, sums, count, single = op12_codes.Tree(x).nearest(x, entries)
    d = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (owner == d.argmin(axis=1)).all() and single < 0.05 * len(x)
    assert (count == np.bincount(owner, minlength=7)).all() and all((sums[j] == x[owner == j].sum(axis=0)).all() for j in range(7))


def test_sums_beyond_a_long_are_null(llm):
    df = llm.createDataFrame([("a", (1 << 62)), ("a", (1 << 62)), ("b", 1), ("b", None), ("c", 2)], "k string, v long")
    assert dict(map(tuple, df.groupBy("k").agg(_whole.summed("v").alias("s")).collect())) == {"a": None, "b": None, "c": 2}
