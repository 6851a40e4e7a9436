"""Delta frames dealt over stretches, against a walk over all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brooklet.functions.columns import div
from brooklet.operators import deltas, frames


def _walk(rows, delta, closed=False):
    """(number, start, end, length) of the frames of (t, v) in order."""
    out, opened = [], None
    for k, (t, v) in enumerate(rows):
        if opened is None or abs(v - opened[1]) >= delta:
            if opened is not None:
                out.append((len(out) + 1, opened[0], t if closed else rows[k - 1][0], k - opened[2]))
            opened = (t, v, k)
    if opened is not None:
        out.append((len(out) + 1, opened[0], rows[-1][0], len(rows) - opened[2]))
    return out


def _values(kind, rng, n):
    walk = np.cumsum([rng.choice((-1.0, 0.0, 1.0)) for _ in range(n)])
    return {
        "noise": [float(rng.randint(0, 30)) for _ in range(n)],
        "walk": walk.tolist(),
        "ramp": [float(k) for k in range(n)],
        "fall": [-0.5 * k for k in range(n)],
        "flat": [3.0] * n,
        "odd": [rng.choice((math.nan, math.inf, -math.inf, 0.0, 5.0, 9.0)) for _ in range(n)],
    }[kind]


KINDS = ("noise", "walk", "ramp", "fall", "flat", "odd")


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("delta", [0.0, 1.0, 7.0, 100.0])
def test_changes_put_together(kind, delta):
    rng = random.Random(f"{kind}{delta}")
    for n in (1, 2, 3, 7, 64, 200):
        v = np.array(_values(kind, rng, n))
        t = np.arange(n) * 10
        after = [next((j for j in range(i + 1, n) if abs(v[j] - v[i]) >= delta), n) for i in range(n)]
        with np.errstate(invalid="ignore"):
            assert deltas.next_rows(v, delta).tolist() == after
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(5))})
        parts = [deltas.Change.of(t[a:b], v[a:b], delta) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.then(p, delta)
        expected = _walk(list(zip(t.tolist(), v.tolist(), strict=True)), delta)
        one = deltas.Entry.after(None, whole, delta)
        step = None
        for p in parts:
            step = deltas.Entry.after(step, p, delta)
        for e in (one, step):
            assert (e.number, e.t, e.last, e.rows - e.pos) == expected[-1]


@pytest.mark.parametrize("kind", KINDS)
def test_frames_of_any_stretches(spark, monkeypatch, kind):
    monkeypatch.setattr(deltas, "COARSE", 4)
    rng = random.Random(kind)
    rows = [(g, t, v) for g in ("a", None, "b") for t, v in enumerate(_values(kind, rng, 300 if g else 40))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t long, v double")
    for closed in (False, True):
        found = frames.delta_frames(df, "g", "t", "v", 4.0, div("t", 7), closed)
        expected = [(g, *f) for g in ("a", None, "b") for f in _walk(sorted((t, v) for k, t, v in rows if k == g), 4.0, closed)]
        assert sorted(((r["frame_group"], r["frame_id"], r["frame_start"], r["frame_end"], r["length"]) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_one_group_is_dealt_over_many_tasks(spark):
    df = spark.range(8000).select(F.lit("g").alias("g"), F.col("id").alias("t"), F.pmod(F.col("id") * 7919, F.lit(101)).cast("double").alias("v"))
    placed = deltas._sorted(deltas.dealt(df, "g", "t", "v", div("t", 50)), ["g", "b"], ["kind", "t", "v"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        share = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(share) == 4 and max(share) < 0.5 * 8000
    rows = [(r["t"], r["v"]) for r in df.orderBy("t").collect()]
    found = frames.delta_frames(df, "g", "t", "v", 60.0, div("t", 50))
    assert sorted((r["frame_id"], r["frame_start"], r["frame_end"], r["length"]) for r in found.collect()) == _walk(rows, 60.0)


def test_a_summary_of_noise_is_small():
    rng = np.random.default_rng(1)
    change = deltas.Change.of(np.arange(100_000), rng.standard_normal(100_000), 2.0)
    assert len(change.high) + len(change.low) < 60


@pytest.mark.parametrize("whole", [0, 60, 1 << 16])
def test_small_groups_are_cut_in_one_pass(spark, monkeypatch, whole):
    monkeypatch.setattr(deltas, "WHOLE", whole)
    rng = random.Random(whole)
    sizes = {g: 1 + g % 90 for g in range(300)} | {None: 70}
    rows = [(g, t, v) for g, n in sizes.items() for t, v in enumerate(_values(KINDS[(g or 0) % 6], rng, n))]
    calls = []
    monkeypatch.setattr(deltas, "_of_stretches", lambda *a, real=deltas._of_stretches: calls.append(1) or real(*a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for closed in (False, True):
            found = frames.delta_frames(spark.createDataFrame(rows, "g long, t long, v double"), "g", "t", "v", 4.0, div("t", 7), closed)
            expected = [(g, *f) for g in sizes for f in _walk([(t, v) for k, t, v in rows if k == g], 4.0, closed)]
            assert sorted(((r["frame_group"], r["frame_id"], r["frame_start"], r["frame_end"], r["length"]) for r in found.collect()), key=str) == sorted(expected, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(calls) == (2 if whole < 90 else 0)
