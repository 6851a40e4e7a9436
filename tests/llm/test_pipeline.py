"""The pipeline against its operators, stage by stage."""

from __future__ import annotations

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from brooklet.llm import op2_quality, op8_toxicity  # noqa: E402
from brooklet.session import table  # noqa: E402
from tests.llm.conftest import SF  # noqa: E402
from tests.llm.test_duplicates import _brute, _near, _set  # noqa: E402


def test_stages(llm, tmp_path):
    docs, benchmark = table(llm, SF, "documents"), [r["text"] for r in table(llm, SF, "benchmark").collect()]
    columns, labels = docs.columns, table(llm, SF, "labels")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(llm, docs, SF)
        found.write.parquet(f"{tmp_path}/{i}")
        after, before = llm.read.parquet(f"{tmp_path}/{i}"), {r["doc_id"]: r["text"] for r in docs.collect()}
        kept = {r["doc_id"] for r in after.collect()}
        assert name == "encoding" or after.columns == columns
        if name in ("toxicity", "quality"):
            module = op8_toxicity if name == "toxicity" else op2_quality
            scores = {r["doc_id"]: r["score"] for r in module.score(docs.select("doc_id", "text"), module.train(docs, labels)).collect()}
            good = (lambda s: s < 0.3) if name == "toxicity" else (lambda s: s >= 0.7)
            assert kept == {k for k, s in scores.items() if good(s)}
        elif name == "near duplicates":
            rows = _brute([(k, _set(t)) for k, t in before.items()], _near)
            assert kept == {c for _, _, c in rows}
        elif name == "decontamination":
            from tests.llm.test_duplicates import WORD

            windows = set()
            for b in benchmark:
                w = WORD.findall((b or "").lower())
                windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
            sizes = {len(w) for w in windows}

            def leaked(text):
                w = WORD.findall(text.lower())
                hit = {i for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for i in range(k, k + n)}
                return bool(hit) and 20 * len(hit) >= len(w)

            assert kept == {k for k, t in before.items() if not leaked(t)}
        else:
            assert kept == set(before) and all(r["exact"] for r in after.collect())
        docs = after


def test_odd_documents(llm, odd_texts, tmp_path):
    docs = llm.createDataFrame([(i, t, "en", "s", None, 1) for i, t in odd_texts], "doc_id long, text string, lang string, source string, n_chars long, key int")
    kept = [sorted(((i, t) for i, t in odd_texts), key=str)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = llm.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            kept.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str))
    words = lambda t: re.search(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", t or "")
    for before, after in zip(kept[:2], kept[1:3], strict=True):  # rows alike in text meet one fate
        assert set(after) <= set(before) and all(before.count(x) == after.count(x) for x in after)
    # Of texts alike the one with the smallest id stays, repeated rows once; texts without words all stay.
    least = {}
    for i, t in kept[2]:
        least[t] = min(least.get(t, (i is None, i)), (i is None, i), key=lambda x: (x[0], x[1] or 0))
    assert kept[3] == sorted([(i, t) for i, t in kept[2] if not words(t)] + [(x[1], t) for t, x in least.items() if words(t)], key=str)
    assert kept[4] == kept[3] and docs.count() == len(kept[4])
    empty = table(llm, SF, "documents").filter("false")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm, empty, SF).write.parquet(f"{tmp_path}/e{i}")
        empty = llm.read.parquet(f"{tmp_path}/e{i}")
        assert empty.count() == 0
