"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. The rules' accuracies and the share
of good documents are estimated by expectation maximisation without labels (a latent-class
model with conditionally independent rules); a document's posterior probability of being good
replaces the all-must-pass filter. The model only needs how often each vote pattern
occurs among the documents that pass the base rules, a table of at most 3^len(RULES) rows
counted over all of them; documents that fail the base rules are rejected in any case.

Defined results: null text counts as empty; a text without words gets zero counts and fails
the base rules; a null doc_id is carried as is; repeated rows are scored alike; a posterior of
exactly one half is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, table

SYMBOLS = "#*$%&|<>"  # fixed value
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GOOD, ABSTAIN, BAD = 1, 0, -1
KNOWN_WORDS = 400_000


def _rejects(bad: Callable[[dict], bool]) -> Callable[[dict], int]:
    """Votes bad or abstains: passing such a rule says nothing, so that unlike defects do not vouch for each other."""
    return lambda s: BAD if bad(s) else ABSTAIN


RULES: dict[str, Callable[[dict], int]] = {
    "symbols": _rejects(lambda s: s["n_symbols"] > 0.2 * s["n_words"]),
    "duplicate_lines": _rejects(lambda s: s["n_dup_lines"] > 0.3 * s["n_lines"]),
    "repeated_words": _rejects(lambda s: s["n_repeat_words"] > 0.4 * s["n_words"]),
    "word_length": _rejects(lambda s: not 2.5 <= s["word_chars"] / s["n_words"] <= 14),
    "capitals": _rejects(lambda s: s["upper"] > 0.4 * s["letters"]),
    "exclamations": _rejects(lambda s: s["exclamations"] > 0.15 * s["n_words"]),
    "length": _rejects(lambda s: s["n_words"] < 10),
    "symbol_chars": _rejects(lambda s: s["n_symbols"] > 0.05 * s["word_chars"]),
    "letters": lambda s: BAD if s["letters"] < 0.7 * s["word_chars"] else GOOD if s["letters"] > 0.9 * s["word_chars"] and s["n_symbols"] < 0.02 * s["n_words"] else ABSTAIN,
}


class Counter:
    """Counts of one text."""

    def __init__(self):
        import xxhash

        self.hash, self.known = xxhash.xxh3_64_intdigest, {}

    def repeated(self, words: list[bytes]) -> int:
        """Words that lie in a three-word window which occurs at least twice."""
        n = len(words) - 2
        if n < 2:
            return 0
        known = self.known
        fresh = set(words).difference(known)
        if fresh:
            if len(known) + len(fresh) > KNOWN_WORDS:
                known.clear()
                fresh = set(words)
            known.update((w, self.hash(w)) for w in fresh)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        window = h[:n] * np.uint64(0x9E3779B97F4A7C15) + (h[1 : n + 1] ^ (h[1 : n + 1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[2:] * np.uint64(0x94D049BB133111EB)
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        covered = np.zeros(len(words), bool)
        at = np.union1d(order[1:][same], order[:-1][same])
        for k in range(3):
            covered[at + k] = True
        return int(covered.sum())

    def __call__(self, text: str | None) -> dict[str, int]:
        text = text or ""
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper = int(seen[65:91].sum())
        return {
            "n_words": len(words),
            "word_chars": len(text) - int(seen[[32, 9, 10, 11, 12, 13]].sum()),
            "n_symbols": int(seen[[ord(c) for c in SYMBOLS]].sum()),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": self.repeated(words),
            "n_lines": len(lines),
            "upper": upper,
            "letters": upper + int(seen[97:123].sum()) + int(seen[0xC2:0xF5].sum()),
            "exclamations": int(seen[33]),
        }


def votes(s: dict[str, int]) -> list[int]:
    return [rule(s) for rule in RULES.values()] if s["n_words"] else [ABSTAIN] * len(RULES)


def pattern(v: list[int]) -> int:
    out = 0
    for x in v:
        out = 3 * out + x + 1
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, pattern) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            rows = [count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], pa.int64()) for c in COUNTS), pa.array([pattern(votes(r)) for r in rows], pa.int32())], names=["doc_id", *COUNTS, "pattern"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, pattern int")


def estimate(histogram: dict[int, int], n_rules: int, rounds: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of good documents, vote probabilities [rule, class, vote], posterior by pattern).

    Starts from rules that seldom reject good documents; Dirichlet pseudo-counts, worth one
    document in a hundred (ten documents for the share), keep every probability defined and the
    classes in place, so that any share of good documents can be found.
    """
    keys = np.array(sorted(histogram), dtype=np.int64)
    n = np.array([histogram[int(k)] for k in keys], dtype=float)
    v = np.array([[(k // 3 ** (n_rules - 1 - r)) % 3 for r in range(n_rules)] for k in keys], dtype=np.int64).reshape(len(keys), n_rules)
    start = np.array([[0.01, 0.6, 0.39], [0.3, 0.5, 0.2]])  # [good, bad] x [votes bad, abstains, votes good]
    prior = start * max(1.0, 0.01 * n.sum())
    prob = np.tile(start, (n_rules, 1, 1))
    share = 0.85
    post = np.full(len(keys), share)
    for _ in range(rounds):
        log = np.log([share, 1 - share])[:, None] + sum(np.log(prob[r][:, v[:, r]]) for r in range(n_rules))
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))
        moved, post = np.abs(new - post).max(initial=0), new
        share = float((n @ post + 8.5) / (n.sum() + 10))
        for r in range(n_rules):
            for c, weight in enumerate((n * post, n * (1 - post))):
                got = np.bincount(v[:, r], weights=weight, minlength=3) + prior[c]
                prob[r, c] = got / got.sum()
        if moved < 1e-10:
            break
    return share, prob, {int(k): float(p) for k, p in zip(keys, post, strict=True)}


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, posterior, kept) per row."""
    rows = cut(counted(docs))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passing = rows.groupBy("pattern").agg(F.count_if(~failed).alias("n")).collect()  # at most 3 ** len(RULES) rows
    histogram = {r["pattern"]: r["n"] for r in passing}
    _, _, posterior = estimate(histogram, len(RULES)) if histogram else (0, None, {})
    known = rows.sparkSession.createDataFrame(list(posterior.items()) or [(-1, 0.0)], "pattern int, posterior double")
    return rows.join(F.broadcast(known), "pattern").select("doc_id", *COUNTS, failed.alias("base_failed"), "posterior", (~failed & (F.col("posterior") >= 0.5)).alias("kept"))


def op8_weak_supervision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
