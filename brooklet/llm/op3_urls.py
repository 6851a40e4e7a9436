"""Operator 3: url filter: rules first, then naive Bayes over segmented names.

* A rule is a host and the beginning of a path; it fits its host and all subdomains; the longest one that fits decides.
* Otherwise the labels of the host are cut into words (unigram Viterbi: a known word costs -log of its share, a stretch that
  is no known word costs ``RUN`` + ``LETTER`` a character and stays one word), and a multinomial naive Bayes model scores the words of host
  and path. A url is blocked if P(block) >= 0.5.

Known words are the delimited parts of host labels and paths of all urls (``cheap-pills`` has two; a label without a delimiter
is no word by itself, as it may be several) and the seed words. The naive Bayes counts come from all urls: those with a seed word
among their delimited parts or their segmented words teach the class block, the others allow; each seed word counts as ``SEED`` examples more. No word is left out of
either table: the ``VOCABULARY`` most frequent ones are sent to the workers, and the rest, where there is one, stays a relation
that is joined by word to the substrings of the hosts and to the words of the urls.

Nulls and odd rows: a null url or one without ``://`` has an empty host and path, fits no rule and is scored by the prior alone;
a repeated row gets its verdict again; a null page_id stays null; other columns are ignored; without any row there is no result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.session import checkpointed, table

#: (host, path, verdict) of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that name what is not wanted.
SEEDS = (
    "adserver", "ads", "adult", "bet", "bets", "betting", "casino", "cialis", "clickbait", "crack", "escort", "gambling", "hentai",
    "jackpot", "keygen", "loans", "malware", "nude", "payday", "phishing", "pills", "poker", "porn", "replica", "sex", "slots",
    "spam", "torrent", "viagra", "warez", "xxx",
)
VOCABULARY, SEED = 200_000, 5
RUN, LETTER, SMOOTH = 6.0, 2.0, 0.5
NUMBER = "0"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PART = re.compile(r"[^\W_]+")
_DELIMITED = re.compile(r"[^.:@\[\]]+")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Segmenter:
    """Words of a name by unigram Viterbi."""

    cost: dict[str, float]

    def __post_init__(self) -> None:
        self.lengths = sorted({len(w) for w in self.cost})

    def words(self, name: str, more: dict[str, float] | None = None) -> list[str]:
        """``more``: costs of the known words in ``name`` that are not in ``cost``."""
        more = more or {}
        lengths = sorted({*self.lengths, *map(len, more)}) if more else self.lengths
        # best[i][known]: least cost of name[:i], and how it got there; an open unknown stretch may go on for LETTER a character.
        inf = math.inf
        best = [[(0.0, 0, 0), (inf, 0, 0)]]
        for i in range(1, len(name) + 1):
            known = (inf, 0, 0)
            for k in lengths:
                if k > i:
                    break
                j = i - k
                c = self.cost.get(name[j:i], more.get(name[j:i]))
                if c is not None:
                    state = 0 if best[j][0][0] <= best[j][1][0] else 1
                    known = min(known, (best[j][state][0] + c, j, state))
            start, on = best[i - 1][0][0] + RUN + LETTER, best[i - 1][1][0] + LETTER
            best.append([known, (start, i - 1, 0) if start <= on else (on, i - 1, 1)])
        found, i = [], len(name)
        state = 0 if best[i][0][0] <= best[i][1][0] else 1
        while i:
            _, j, before = best[i][state]
            if state == 1:
                end = i
                while before == 1:
                    i, (_, j, before) = j, best[j][1]
                found.append(name[j:end])
            else:
                found.append(name[j:i])
            i, state = j, before
        return found[::-1]


def _names(host: str) -> list[str]:
    """The parts of a host that are to be cut into words."""
    return [p for p in _PART.findall(host) if not p.isdecimal()]


def _pieces(host: str, lengths: Sequence[int]) -> set[str]:
    return {name[i : i + k] for name in _names(host) for k in lengths for i in range(len(name) - k + 1)}


def _host_words(segmenter: Segmenter, host: str, more: dict[str, float] | None = None) -> tuple[str, ...]:
    return tuple(w for label in _PART.findall(host) for w in ([NUMBER] if label.isdecimal() else segmenter.words(label, more)))


def _cutter(segmenter: Segmenter) -> Callable[[str, list | None], tuple[str, ...]]:
    plain = lru_cache(1 << 16)(lambda host: _host_words(segmenter, host))
    return lambda host, more: _host_words(segmenter, host, dict(more)) if more else plain(host)


@dataclass
class Model:
    segmenter: Segmenter
    #: Log of P(word | block) / P(word | allow).
    ratio: dict[str, float]
    prior: float
    #: (word, cost) and (word, ratio) of the words that are in neither of the two tables; None where there are none.
    rare_costs: DataFrame | None = None
    rare_ratios: DataFrame | None = None

    def score(self, host: str, path: str) -> float:
        """P(block) of one url."""
        more = _looked_up(self.rare_costs, _pieces(host, range(2, len(host) + 1)))
        tokens = (*_host_words(self.segmenter, host, more), *_parts(path))
        ratio = _looked_up(self.rare_ratios, set(tokens)) | {t: self.ratio[t] for t in tokens if t in self.ratio}
        z = self.prior + sum(ratio.get(t, 0.0) for t in tokens)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _looked_up(rare: DataFrame | None, words: set[str]) -> dict[str, float]:
    return {} if rare is None else dict(map(tuple, rare.filter(F.col("word").isin(sorted(words))).collect()))


def _parts(text: str) -> list[str]:
    return [NUMBER if p.isdecimal() else p for p in map(str.lower, _PART.findall(text))]


def _delimited(host: str, path: str) -> tuple[list[str], list[str]]:
    """All parts of host and path, and those that stand as words: of labels with a delimiter, and of the path."""
    every, as_words = [], []
    for label in _DELIMITED.findall(host):
        own = _parts(label)
        every += own
        as_words += own if len(own) > 1 else []
    own = _parts(path)
    return every + own, as_words + own


def matched(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest rule that fits, and its verdict; ``rules``: (path, verdict) by host, longest paths first."""
    labels = host.split(".")
    fits = [(len(h) + len(p), h + p, verdict) for i in range(len(labels)) for h in [".".join(labels[i:])] for p, verdict in rules.get(h, ()) if path.startswith(p)]
    return max(fits)[1:] if fits else None


def _frequent(counted: DataFrame) -> tuple[list, DataFrame | None]:
    """Rows of the ``VOCABULARY`` most frequent words, and the others if there are any."""
    rows = counted.orderBy(F.desc("n"), "word").limit(VOCABULARY + 1).collect()
    if len(rows) <= VOCABULARY:
        return rows, None
    last = rows[VOCABULARY - 1]
    return rows[:VOCABULARY], counted.filter((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))


def _with_rare(pages: DataFrame, rare_costs: DataFrame | None) -> DataFrame:
    """``pages`` with ``more``: cost by word of the rare words within its host."""
    if rare_costs is None:
        return pages.withColumn("more", F.lit(None).cast("map<string,double>"))
    lengths = sorted(r[0] for r in rare_costs.select(F.length("word")).distinct().collect())

    def pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for host in batch.column(0).to_pylist():
                if found := list(_pieces(host, lengths)):
                    yield pa.record_batch([pa.array([host] * len(found), pa.string()), pa.array(found, pa.string())], names=["host", "word"])

    held = pages.select("host").distinct().mapInArrow(pieces, "host string, word string").join(rare_costs, "word")
    return pages.join(held.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("word", "cost"))).alias("more")), "host", "left")


def train(pages: DataFrame, seeds: Sequence[str] = SEEDS) -> Model:
    """Word costs and naive Bayes counts over the urls of ``pages`` (host, path)."""
    bad = frozenset(seeds)

    def known(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in rows:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update(_delimited(host, path)[1])
            if len(counts) > 1 << 16:
                yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
                counts = Counter()
        yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    extra = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sorted(bad))).cast("array<string>")).alias("word"), F.lit(SEED).cast("long").alias("n"))
    # One letter is no word of a name.
    words = checkpointed(pages.mapInArrow(known, "word string, n long").unionByName(extra).filter(F.length("word") > 1).groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0]
    found, rare = _frequent(words)
    segmenter = Segmenter({r["word"]: math.log(total / r["n"]) for r in found})
    rare_costs = None if rare is None else rare.select("word", F.log(F.lit(total) / F.col("n")).alias("cost"))

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(segmenter)
        counts = Counter()

        def flush() -> pa.RecordBatch:
            found = list(counts.items())
            counts.clear()
            return pa.record_batch([pa.array([k[0] for k, _ in found], pa.int32()), pa.array([k[1] for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["blocked", "word", "n"])

        for batch in rows:
            for host, path, more in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = (*cut(host, more), *_parts(path))
                blocked = int(not (bad.isdisjoint(found) and bad.isdisjoint(_delimited(host, path)[0])))
                counts[blocked, None] += 1
                for t in found:
                    counts[blocked, t] += 1
            if len(counts) > 1 << 16:
                yield flush()
        yield flush()

    taught = _with_rare(pages, rare_costs).select("host", "path", "more").mapInArrow(counted, "blocked int, word string, n long")
    by = [F.sum(F.when(F.col("blocked") == k, F.col("n")).otherwise(0)) for k in (0, 1)]
    counts = checkpointed(taught.unionByName(extra.withColumn("blocked", F.lit(1))).groupBy("word").agg(by[0].alias("n0"), by[1].alias("n1"), F.sum("n").alias("n")))
    is_word = F.col("word").isNotNull()
    sums = counts.agg(F.count("word"), *(F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)) for c in (is_word, ~is_word) for n in ("n0", "n1"))).first()
    size = [n + SMOOTH * sums[0] for n in sums[1:3]]
    found, rare = _frequent(counts.filter(is_word))
    ratio = {r["word"]: math.log((r["n1"] + SMOOTH) / size[1]) - math.log((r["n0"] + SMOOTH) / size[0]) for r in found}
    rare_ratios = None if rare is None else rare.select("word", (F.log((F.col("n1") + SMOOTH) / size[1]) - F.log((F.col("n0") + SMOOTH) / size[0])).alias("ratio"))
    return Model(segmenter, ratio, math.log((1 + sums[4]) / (1 + sums[3])), rare_costs, rare_ratios)


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (P(block) by the model) of each page."""
    by: dict[str, list[tuple[str, str]]] = {}
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[1])):
        by.setdefault(h, []).append((p, verdict))

    segmenter, ratio, prior, rest = model.segmenter, model.ratio, model.prior, model.rare_ratios is not None

    def decide(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(segmenter)
        for batch in rows:
            found = []
            for host, path, more in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                tokens = (*cut(host, more), *_parts(path))
                z = prior + sum(ratio.get(t, 0.0) for t in tokens)
                found.append((*(matched(host, path, by) or (None, None)), z, [t for t in tokens if t not in ratio] if rest else []))
            new = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())))]
            yield pa.record_batch([*batch.columns[:3], *new], names=["page_id", "host", "path", "rule", "verdict", "z", "rare"])

    host, path = parsed(F.col("url"))
    judged = _with_rare(pages.select("page_id", host.alias("host"), path.alias("path")), model.rare_costs).select("page_id", "host", "path", "more")
    judged = judged.mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string, z double, rare array<string>")
    z = F.col("z")
    if rest:
        judged = checkpointed(judged)
        each = judged.filter(F.size("rare") > 0).select("host", "path", "rare").distinct().select("host", "path", F.explode("rare").alias("word"))
        judged = judged.join(each.join(model.rare_ratios, "word").groupBy("host", "path").agg(F.sum("ratio").alias("added")), ["host", "path"], "left")
        z = z + F.coalesce("added", F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))
    verdict = F.coalesce("verdict", F.when(score >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url")
    host, path = parsed(F.col("url"))
    return judge(pages, train(pages.select(host.alias("host"), path.alias("path"))))
