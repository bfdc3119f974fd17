"""Scoring of trials: intervals, paired differences, partition checks, verdicts."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _below(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if p <= 0 or p >= 1:
        return 1.0 if p <= 0 or k >= n else 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs, default=-math.inf)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs)) if logs else 0.0


def _root(f) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(successes: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact interval of a proportion; (0, 1) without trials."""
    if n == 0:
        return 0.0, 1.0
    a = (1 - confidence) / 2
    low = 0.0 if successes == 0 else _root(lambda p: a - (1 - _below(successes - 1, n, p)))
    high = 1.0 if successes == n else _root(lambda p: _below(successes, n, p) - a)
    return low, high


def proportions(rows: DataFrame, by: str, success: Column, confidence: float = 0.95) -> DataFrame:
    """successes, n and interval per key; the interval is computed on the aggregate."""
    sums = rows.groupBy(by).agg(F.count_if(success).alias("successes"), F.count("*").alias("n"))

    def run(batches):
        for pdf in batches:
            both = [clopper_pearson(int(s), int(n), confidence) for s, n in zip(pdf.successes, pdf.n, strict=True)]
            yield pdf.assign(low=[b[0] for b in both], high=[b[1] for b in both])

    return sums.mapInPandas(run, T.StructType(list(sums.schema)).add("low", "double").add("high", "double"))


def bootstrap(rows: DataFrame, by: str, family: str, value: str, draws: int = 500, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """Interval of the mean over families, families drawn with replacement; family means come from Spark."""
    means = rows.groupBy(by, family).agg(F.avg(value).alias("mean")).groupBy(by).agg(F.array_sort(F.collect_list("mean")).alias("means"))

    @F.pandas_udf(T.StructType().add("mean", "double").add("low", "double").add("high", "double"))
    def interval(m: pd.Series) -> pd.DataFrame:
        out = []
        for xs in m:
            rng, xs = random.Random(seed), list(xs)
            sums = sorted(sum(rng.choices(xs, k=len(xs))) / len(xs) for _ in range(draws))
            at = lambda p: sums[min(draws - 1, max(0, math.ceil(p * draws) - 1))]
            out.append((sum(xs) / len(xs), at((1 - confidence) / 2), at((1 + confidence) / 2)))
        return pd.DataFrame(out, columns=["mean", "low", "high"])

    return means.select(by, F.size("means").alias("families"), interval("means").alias("i")).select(by, "families", "i.*")


def paired(rows: DataFrame, case: str, family: str, arm: str, arms: tuple[str, str], value: str) -> DataFrame:
    """Mean difference of two arms per family, over cases that have both."""
    wide = rows.groupBy(family, case).pivot(arm, list(arms)).agg(F.avg(value))
    both = wide.where(F.col(arms[0]).isNotNull() & F.col(arms[1]).isNotNull())
    return both.groupBy(family).agg(F.count("*").alias("cases"), F.round(F.avg(F.col(arms[0]) - F.col(arms[1])), 6).alias("difference"))


def verdict(low: Column, high: Column, threshold: float) -> Column:
    return F.when(low >= threshold, "accept").when(high < threshold, "revise").otherwise("inconclusive")


def partition_problems(cases: DataFrame) -> DataFrame:
    """(problem, subject): repeated ids, families in two partitions, chronology that does not rise, sessions in two families."""
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_case").alias("problem"), F.col("case_id").cast("string").alias("subject"))
    spread = cases.groupBy("family").agg(F.count_distinct("part").alias("n")).where("n > 1").select(F.lit("family_in_two_partitions").alias("problem"), F.col("family").cast("string").alias("subject"))
    w = Window.partitionBy("family").orderBy("case_id")
    back = cases.withColumn("_p", F.lag("chronology").over(w)).where("chronology <= _p").select(F.lit("chronology").alias("problem"), F.col("family").cast("string").alias("subject")).distinct()
    leak = cases.groupBy("session_root").agg(F.count_distinct("family").alias("n")).where("n > 1").select(F.lit("session_in_two_families").alias("problem"), F.col("session_root").alias("subject"))
    return twice.unionByName(spread).unionByName(back).unionByName(leak)


def trial_problems(trials: DataFrame, cases: DataFrame, most: int) -> DataFrame:
    """(problem, subject): unknown cases, repeated trials, too many repetitions."""
    unknown = trials.join(cases.select("case_id"), "case_id", "left_anti").select(F.lit("unknown_case").alias("problem"), F.col("case_id").cast("string").alias("subject")).distinct()
    twice = trials.groupBy("case_id", "arm", "repetition").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_trial").alias("problem"), F.col("case_id").cast("string").alias("subject")).distinct()
    many = trials.groupBy("case_id", "arm").agg(F.count_distinct("repetition").alias("n")).where(F.col("n") > most).select(F.lit("repetitions").alias("problem"), F.col("case_id").cast("string").alias("subject")).distinct()
    return unknown.unionByName(twice).unionByName(many)
