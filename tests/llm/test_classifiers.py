"""Held-out accuracy and odd input of the two document classifiers, and of the url filter."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from brooklet.llm import op2_quality, op3_urls, op8_toxicity
from brooklet.llm._text import batches
from brooklet.session import table
from tests.llm.conftest import SF

SF_LEARN = "/root/testdata/sf0.01"


def _fold(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize(("module", "label", "least"), [(op2_quality, "quality", 0.9), (op8_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(llm, module, label, least):
    labels = {r["doc_id"]: r[label] for r in table(llm, SF_LEARN, "labels").collect()}
    rows = module.query(llm, SF_LEARN).collect()
    docs = table(llm, SF_LEARN, "documents")
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 and r["held_out"] == _fold(r["doc_id"]) and r["predicted"] == (r["score"] >= module.THRESHOLD) for r in rows)
    judged = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(judged) >= least


@pytest.mark.parametrize("module", [op2_quality, op8_toxicity])
def test_odd_texts(llm, odd_docs, module):
    labels = llm.createDataFrame([(1, 1, 1), (5, 0, 0), (3, None, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    model = module.train(odd_docs, labels)
    found = module.score(odd_docs, model)
    assert found.count() == 9 and found.columns == ["doc_id", "text", "n", "items", "score"]
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    assert module.score(odd_docs.filter("false"), model).count() == 0
    keep = module.keep_good if module is op2_quality else module.keep_clean
    assert keep(odd_docs, model).columns == odd_docs.columns


@pytest.mark.parametrize("module", [op2_quality, op8_toxicity])
def test_without_labels_nothing_is_learnt(llm, odd_docs, module):
    model = module.train(odd_docs, llm.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len({r["score"] for r in module.score(odd_docs, model).collect()}) == 1


def test_labels_of_the_held_out_fold_change_nothing(llm):
    labels = table(llm, SF_LEARN, "labels").toPandas()
    docs = table(llm, SF_LEARN, "documents")
    turned = labels.copy()
    held = turned["doc_id"].map(_fold)
    turned.loc[held, "toxic"] = 1 - turned.loc[held, "toxic"]
    turned.loc[held, "quality"] = 1 - turned.loc[held, "quality"]
    for module in (op2_quality, op8_toxicity):
        one, two = (module.train(docs, llm.createDataFrame(x)) for x in (labels, turned))
        assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_prior_is_estimated():
    rng = np.random.default_rng(3)
    p = rng.normal(2, 1, (1500, 3))
    u = np.concatenate([rng.normal(2, 1, (1600, 3)), rng.normal(-2, 1, (400, 3))])
    assert 0.7 <= op2_quality.estimate_prior(p, u) <= 0.95


def test_slope_of_the_pu_risk_by_finite_differences():
    rng = np.random.default_rng(4)
    for prior, shift in ((0.4, 0.0), (0.9, 4.0)):  # the second has a negative estimate below 0
        z = rng.normal(0, 1, 50) + np.where(np.arange(50) < 20, shift, -shift)
        risk, slope = op2_quality.pu_risk(z, 20, prior)
        zp, zu = z[:20], z[20:]
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        assert risk == pytest.approx(prior * np.log1p(np.exp(-zp)).mean() + max(0, negative)) and (negative < 0) == (shift > 0)
        by = (lambda z: op2_quality.pu_risk(z, 20, prior)[0]) if negative > 0 else (lambda z: prior * np.logaddexp(0, z[:20]).mean() - np.logaddexp(0, z[20:]).mean())
        steps = np.eye(50) * 1e-5
        assert slope == pytest.approx(np.array([(by(z + d) - by(z - d)) / 2e-5 for d in steps]), abs=1e-7)


def test_slope_of_the_noisy_or_by_finite_differences():
    rng = np.random.default_rng(5)
    columns = rng.integers(0, 7, (9, 3))  # place 6 stands for no feature
    word, starts, owner = rng.integers(0, 9, 40), np.array([0, 5, 5, 12, 30, 36]), np.array([0, 0, 1, 2, 2, 3])
    y, weight, w = np.array([1.0, 0, 1, 0]), np.array([0.1, 0.4, 0.2, 0.3]), rng.normal(0, 1, 6)
    loss = lambda w, b: op8_toxicity.risk(w, b, columns, word, starts, owner, y, weight)[0]
    value, gw, gb = op8_toxicity.risk(w, -1.0, columns, word, starts, owner, y, weight)
    z = [sum(w[c] for k in word[a:b] for c in columns[k] if c < 6) - 1.0 for a, b in zip(starts, [*starts[1:], 40], strict=True)]
    clean = [math.prod(1 - 1 / (1 + math.exp(-v)) for v, o in zip(z, owner, strict=True) if o == i) for i in range(4)]
    assert value == pytest.approx(-sum(g * (t * math.log(1 - c) + (1 - t) * math.log(c)) for g, t, c in zip(weight, y, clean, strict=True)))
    assert gw == pytest.approx(np.array([(loss(w + d, -1.0) - loss(w - d, -1.0)) / 2e-5 for d in np.eye(6) * 1e-5]), abs=1e-7)
    assert gb == pytest.approx((loss(w, -1.0 + 1e-5) - loss(w, -1.0 - 1e-5)) / 2e-5, abs=1e-7)


def test_samples_are_bounded_by_rows_and_bytes(llm, monkeypatch):
    texts = [(1, f"text number {k}") for k in range(300)] + [(None, "no id")] * 300 + [(k, "long " * 60) for k in range(2, 80)] + [(99, "x" * 5000)]
    docs = llm.createDataFrame(texts, "doc_id long, text string")
    labels = llm.createDataFrame([(k, 1, k % 2) for k in (1, *range(2, 80), 99)], "doc_id long, quality int, toxic int")
    found, n = op8_toxicity.sample(docs, labels, "toxic", {1: 1000, 0: 1000}, max_bytes=6000, longest=4000)
    rows = found.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and 99 not in {r["doc_id"] for r in rows}
    assert 0 < sum(len(r["text"]) for r in rows) < 12000 and sum(n.values()) > 50
    seen = []
    monkeypatch.setattr(op2_quality, "fit", lambda x, n_p: seen.append((len(x), n_p)))
    op2_quality.train(docs, labels)
    ids = {k for k in (1, *range(2, 80), 99) if not _fold(k)}
    assert seen[0][1] == len(ids)  # one text an id
    assert seen[0][0] - seen[0][1] == (0 if _fold(1) else 300) + 1 + len(ids - {1})  # a row that comes 300 times counts once


def test_noisy_or():
    model = op8_toxicity.Model(np.zeros(1 << op8_toxicity.BITS, dtype=np.float32), math.log(0.25 / 0.75))
    text = b"one. two! three?"
    data = np.frombuffer(text, dtype=np.uint8)
    found = op8_toxicity._scores(model, data, np.array([0, len(text)]))[0]
    assert found[0] == pytest.approx(1 - 0.75**3)


def test_offending_sentences_are_located(llm):
    texts = [(i, f"good day number {i}. " + ("you vile zork. bye." if i % 5 == 0 else "have a nice day. bye.")) for i in range(400)]
    docs = llm.createDataFrame(texts, "doc_id long, text string")
    labels = llm.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in texts], "doc_id long, quality int, toxic int")
    model = op8_toxicity.train(docs, labels)
    found = op8_toxicity.sentences(docs, model).collect()
    assert {r["doc_id"] for r in found} == {i for i, _ in texts if i % 5 == 0}
    assert {r["text"] for r in found} == {"you vile zork"}


def test_features_do_not_depend_on_the_share_of_toxic_texts(llm):
    for toxic, rare in ((20, 6), (400, 6), (1200, 40)):
        texts = [(i, f"good day number{i}. have a nice day.", 0) for i in range(1600)] + [(-i - 1, "good day. you vile zork." + (" qwzx" if i < rare else ""), 1) for i in range(toxic)]
        common = set(op8_toxicity._common(llm.createDataFrame(texts, "doc_id long, text string, label int")).tolist())
        numbers = [op8_toxicity.features(np.frombuffer(w, dtype=np.uint8), np.array([0, len(w)]))[0][0, 0] for w in (b"zork", b"qwzx", b"day")]
        assert [k in common for k in numbers] == [True, True, False]


def test_a_mark_of_most_texts_is_learnt(llm):
    docs = llm.createDataFrame([(i, "good day. " + ("you vile zork. bye." if i % 5 < 2 else "have a nice day. bye.")) for i in range(400)], "doc_id long, text string")
    model = op8_toxicity.train(docs, llm.createDataFrame([(i, 1, int(i % 5 < 2)) for i in range(400)], "doc_id long, quality int, toxic int"))
    assert all((r["score"] >= op8_toxicity.THRESHOLD) == (r["doc_id"] % 5 < 2) for r in op8_toxicity.score(docs, model).collect())


URLS = [
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/fr/", "example.net", "/fr/", "net/", "block"),
    ("https://example.com/de/x", "example.com", "/de/x", "example.com/de/", "block"),
    ("x://m.example.org/fr/9#a/b", "m.example.org", "/fr/9", "org/fr/", "allow"),
    ("https://planet/", "planet", "/", None, None),
    ("https://example.net", "example.net", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("https://É.example.net/EN/1", "É.example.net", "/EN/1", "net/", "block"),
]


def test_urls_and_rules(llm):
    pages = llm.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    rows = op3_urls.judge(pages, op3_urls.train(pages.select(*(c.alias(n) for c, n in zip(op3_urls.parsed(pages["url"]), ("host", "path"), strict=True))))).orderBy("page_id").collect()
    for r, (_, host, path, rule, verdict) in zip(rows, URLS, strict=True):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_segmentation_against_brute_force():
    cost = {"cheap": 3.0, "pills": 4.0, "pill": 3.5, "s": 1.0, "che": 6.0, "ap": 2.5}
    cutter = op3_urls.Segmenter(cost)

    def price(parts):
        return sum(cost[p] if k else op3_urls.RUN + op3_urls.LETTER * len(p) for p, k in parts)

    def every(name, open_run):
        if not name:
            yield []
        for i in range(1, len(name) + 1):
            if name[:i] in cost:
                yield from ([(name[:i], True), *rest] for rest in every(name[i:], False))
            if not open_run:
                yield from ([(name[:i], False), *rest] for rest in every(name[i:], True))

    for name in ("cheappills", "xcheapy", "cheaps", "zzz", "pillsche", ""):
        least = min(price(p) for p in every(name, False))
        own = [(w, w in cost) for w in cutter.words(name)]
        assert "".join(w for w, _ in own) == name and price(own) == pytest.approx(least)


def test_spam_names_are_blocked_and_others_kept(llm):
    rows = op3_urls.query(llm, SF_LEARN).filter("rule IS NULL").collect()
    spam = ("cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track", "spam-farm")
    assert all((r["verdict"] == "block") == any(s in r["host"] for s in spam) for r in rows)
    hosts = llm.createDataFrame([("cheappills.example.com", "/en/1"), ("ththan.example.com", "/en/2")] + [("casino-win.example.com", "/en/3"), ("cheap-pills.example.com", "/en/4")] * 20 + [(f"th{k}.example.com", "/en/5") for k in range(60)], "host string, path string")
    model = op3_urls.train(hosts)
    assert model.score("cheappills.example.com", "/en/1") >= 0.5 > model.score("ththan.example.com", "/en/2")


@pytest.mark.parametrize(("hot", "others"), [(10, 60), (300, 60), (1, 2000), (300, 2000)])
def test_a_frequent_concatenated_name_stays_blocked(llm, hot, others):
    hosts = [("cheappills.example.com", "/en/1")] * hot + [("casino-win.example.com", "/en/3"), ("cheap-pills.example.com", "/en/4")] * 20 + [(f"th{k}.example.com", "/en/5") for k in range(others)]
    model = op3_urls.train(llm.createDataFrame(hosts, "host string, path string"))
    assert model.score("cheappills.example.com", "/en/1") >= 0.5 > model.score("th7.example.com", "/en/2")


def test_rare_words_count_as_the_others(llm, monkeypatch):
    words = ("cheap", "green", "tea", "blue", "pills", "casino", "win", "shop", "tree", "news")
    pairs = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :]]
    hosts = [f"{a}-{b}.example.com" for a, b in pairs] + [f"{a}{b}.example.com" for a, b in pairs[::3]] + ["", "12.34", "éa-b.example.com"]
    pages = llm.createDataFrame([(i % 50, f"https://{h}/en/{i}/w{i % 23}x") for i, h in enumerate(hosts * 2)] + [(None, None)], "page_id long, url string")
    parts = pages.select(*(c.alias(n) for c, n in zip(op3_urls.parsed(pages["url"]), ("host", "path"), strict=True)))
    found = []
    for bound in (200_000, 12):
        monkeypatch.setattr(op3_urls, "VOCABULARY", bound)
        model = op3_urls.train(parts)
        rows = sorted((tuple(r) for r in op3_urls.judge(pages, model, []).collect()), key=str)
        found.append(([r[:5] for r in rows], [r[5] for r in rows], model.prior, model.score("cheappills.example.com", "/en/w3x")))
    assert found[0][0] == found[1][0] and len(found[0][0]) == 2 * len(hosts) + 1
    for k in (1, 2, 3):
        assert found[0][k] == pytest.approx(found[1][k])


def test_long_words_are_known(llm):
    word = "pneumonoultramicroscopicsilico"
    model = op3_urls.train(llm.createDataFrame([("example.com", f"/{word}")] * 50, "host string, path string"))
    assert model.segmenter.words(f"{word}zz") == [word, "zz"]


def test_no_pages(llm):
    pages = llm.createDataFrame([], "page_id long, url string")
    model = op3_urls.train(pages.selectExpr("url AS host", "url AS path"))
    assert op3_urls.judge(pages, model).count() == 0


@pytest.fixture(scope="module")
def learnt(llm):
    """Labels, features and folds of the larger table for the quality classifier; its fold 1 is left out of the fits here."""
    where = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in table(llm, where, "labels").collect()}
    docs = table(llm, where, "documents").select("doc_id", "text").toArrow()
    x = np.concatenate([op2_quality.features(data, off) for _, _, data, off in batches(docs.column("text").combine_chunks())])
    ids = docs.column("doc_id").to_pylist()
    return x, np.array([zlib.crc32(str(i).encode()) % 4 for i in ids]), np.array([-1 if labels.get(i) is None else labels[i] for i in ids])


def test_prior_and_recall_of_each_class_in_any_order(learnt):
    x, fold, y = learnt
    train, judged = np.isin(fold, (0, 3)), fold == 1
    share = (y[train] == 1).sum() / (y[train] >= 0).sum()
    for order in range(10):
        rng = np.random.default_rng(order)
        p, u = (part[rng.permutation(len(part))] for part in (x[train & (y == 1)], x[train]))
        if order < 3:
            model = op2_quality.fit(np.concatenate([p, u]).astype(np.float32), len(p))
            good = op2_quality._sigmoid(x[judged] @ model.weights + model.bias) >= op2_quality.THRESHOLD
            assert np.mean(~good[y[judged] == 0]) >= 0.95 and np.mean(good[y[judged] == 1]) >= 0.99
            prior = model.prior
        else:
            mean, scale = u.mean(axis=0), u.std(axis=0) + 0.02
            prior = op2_quality.estimate_prior((p - mean) / scale, (u - mean) / scale)
        assert abs(prior - share) < 0.02
