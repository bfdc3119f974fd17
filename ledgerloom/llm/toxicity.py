"""Toxicity scores from a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to letters and everything else
that is not a letter to a space. A lexicon entry is a word prefix, so that one entry covers
a stem's endings. Entries and weights come from labelled training documents: smoothed log
odds of document frequencies of prefixes whose likelihood-ratio statistic stands out among
all that were tried, greedily chosen so that no entry contains another. A hit that
lies in an exception phrase (a phrase around an entry that only clean training documents
use) does not count. The sum of hit weights, alone and per length, goes through a logistic
curve fitted on the same bounded sample.

Training reads at most about SAMPLE labelled documents per class, chosen by a hash of the
id; that bound on rows is the only one. Statistics over them are sums in Spark, of which every
prefix that stands out comes to the driver: prefixes of words of the bounded sample. Scoring
reads every whole text in one narrow pass.

Defined results: null or empty text has no hits and gets the curve's least score; a null
doc_id is scored, never held out; repeated rows are scored alike; of several labels of a
document toxic counts; entries of equal strength are taken longest first; without labels of both
classes every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, held_out, held_out_py, table

SAMPLE = 6_000
LEAST_ODDS = 2.5
NO_HIT = 0.49
SHORTEST, LONGEST = 3, 10
HELD_COUNTS = 400_000

# Letters of other scripts that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ƅ": "b", "ʀ": "r",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """str.translate table over lower-cased text, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HOMOGLYPHS:
            out = HOMOGLYPHS[c]
        elif c in SUBSTITUTES:
            out = SUBSTITUTES[c]
        elif 0xFF21 <= code <= 0xFF5A or 0x1D400 <= code <= 0x1D7FF:
            import unicodedata

            plain = unicodedata.normalize("NFKC", c).lower()
            out = SUBSTITUTES.get(plain, plain if plain.isalpha() else " ")
        elif c.isalpha():
            out = c
        else:
            out = "" if c in "​‌‍⁠﻿­" else " "
        self[code] = out
        return out


FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded text between spaces, so that ' ab' is the prefix ab of a word."""
    return f" {(text or '').lower().translate(FOLD)} "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            a.add_word(" " + word, (len(word) + 1, weight))
        for phrase in self.exceptions:
            if not a.exists(p := f" {phrase} "):
                a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a

    def score(self, total: float, length: int) -> float:
        if not self.curve:
            return 0.0
        x = sum(c * f for c, f in zip(self.curve, features(total, length), strict=True))
        p = 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
        return p if total > 0 else min(p, NO_HIT)  # without a hit nothing speaks for toxicity


def features(total: float, length: int) -> tuple[float, float, float]:
    """Constant, summed weight, and summed weight per 1,000 characters."""
    return 1.0, math.log1p(max(0.0, total)), math.log1p(max(0.0, 1000 * total / max(length, 100)))


def hits(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of each counted entry; those within an exception phrase are left out."""
    if not len(automaton):
        return []
    found, free = [], []
    for end, (n, weight) in automaton.iter(folded):
        (free if weight is None else found).append((end - n + 1, end + 1, weight))
    if free and found:
        free.sort()
        starts, reach = [s for s, _, _ in free], list(accumulate((e for _, e, _ in free), max))  # how far phrases that start by then go
        found = [h for h in found if not ((k := bisect_right(starts, h[0])) and reach[k - 1] >= h[1])]
    return found


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the bounded training sample, and how many labels there are; held-out documents count in neither."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.lit(0)
    for y, n in sizes.items():
        share = F.when(F.col("toxic") == y, min(1_000_000, sample * 1_000_000 // n)).otherwise(share)
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), sizes


def _counted(rows: DataFrame, terms, fields: str = "term string, toxic int") -> DataFrame:
    """Document frequencies of terms(text) by class; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())], names=["term", "toxic", "n"])
            held.clear()
            return batch

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held.update((t, y) for t in terms(text.as_py()))
                if len(held) > HELD_COUNTS:
                    yield out()
        yield out()

    return rows.mapInArrow(run, f"{fields}, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))


def prefixes(text: str | None) -> set[str]:
    out: set[str] = set()
    for w in set(fold(text).split()):
        out.update(w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def choose(candidates: Iterable[tuple[str, int, int]], bad: int, good: int) -> dict[str, float]:
    """Entries with weights: strongest first, longest of equals, none a prefix of another."""
    odds = lambda a, b: math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1))
    ranked = sorted(((odds(a, b) * math.sqrt(a), len(t), t, odds(a, b)) for t, a, b in candidates), reverse=True)
    kept: dict[str, float] = {}
    stems: set[str] = set()
    for _, _, term, weight in ranked:
        if weight < LEAST_ODDS or term in stems or any(term[:k] in kept for k in range(1, len(term) + 1)):
            continue
        kept[term] = weight
        stems.update(term[:k] for k in range(1, len(term) + 1))
    return kept


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    pull = ridge * np.diag([0.1] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + pull, x.T @ (weight * (y - p)) - pull @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


class _Around:
    """Two-word phrases around hits."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "automaton": None}

    def __call__(self, text: str | None) -> set[str]:
        self.automaton = self.automaton or self.lexicon.automaton()
        folded, out = fold(text), set()
        for start, _, _ in hits(self.automaton, folded):
            left = folded[max(0, start - 60) : start].split()[-1:]
            here, *right = folded[start : start + 120].split()[:2]
            out.update(" ".join(p) for p in (left + [here], [here] + right) if len(p) == 2)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    rows, marks = _training(docs, labels, sample)
    rows = cut(rows)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Lexicon()
    counts = cut(_counted(rows, prefixes).where("bad >= 3"))
    tried = counts.count()
    both = F.col("bad") + F.col("good")
    gain = lambda n, share: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (both * share))).otherwise(0.0)
    g2 = 2 * (gain("bad", bad / (bad + good)) + gain("good", good / (bad + good)))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    strong = counts.withColumn("s", odds * F.sqrt("bad")).where((odds >= LEAST_ODDS) & (g2 >= 2 * math.log(max(tried, 1)) + 4))
    lexicon = Lexicon(choose(((r["term"], r["bad"], r["good"]) for r in strong.collect()), bad, good), exceptions)

    if lexicon.weights:
        clean = _counted(rows, _Around(lexicon)).where(f"bad = 0 and good >= {max(3, good // 500)}").orderBy(F.desc("good"), "term")
        lexicon.exceptions += tuple(r["term"] for r in clean.collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            f = [fold(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(h[2] for h in hits(automaton, t)) for t in f], pa.float64()), pa.array([len(t) for t in f], pa.int64()), batch.column(1)], names=["total", "length", "toxic"])

    seen = rows.mapInArrow(measure, "total double, length long, toxic int").toPandas()  # one small row per sampled document
    x = np.array([features(t, n) for t, n in zip(seen.total, seen.length, strict=True)])
    y = seen.toxic.to_numpy(dtype=float)
    lexicon.curve = fit_curve(x, y, np.where(y == 1, marks[1] / bad, marks[0] / good))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            held, scores, n = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folded = fold(text.as_py())
                found = hits(automaton, folded)
                held.append(held_out_py(key))
                scores.append(lexicon.score(sum(h[2] for h in found), len(folded)))
                n.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(n, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "n_hits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long")


def clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs that are not predicted toxic, in one narrow pass."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            good = []
            for text in batch.column(at):
                folded = fold(text.as_py())
                good.append(lexicon.score(sum(h[2] for h in hits(automaton, folded)), len(folded)) < 0.5)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op2_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
