"""Mixing sources to target weights by soft domain membership.

A multinomial naive Bayes classifier, fitted by sums over the labelled table, gives every
document posterior probabilities of the domains (language and quality). Nonnegative
document rates are then fitted so that the expected tokens of each domain, sum over i of
rate_i * tokens_i * posterior_ik, match the targets: projected gradient on the least-squares
misfit, preconditioned by the tokens, where each step is one sum over all documents and only
as many numbers as there are domains pass the driver. Starting from rate 1, the result
is the nearest such set of rates in the token-weighted sense.

The evidence is every piece of a text: what is not white space, cut into pieces of up to PIECE
characters from the start of each word. Pieces fall into BUCKETS by their hash, so every domain is told by
all of its labelled text, and a document is scored in one pass over its pieces, whatever the
number of domains is. A domain's frequencies lean on those of its language and of all domains in
fixed parts, so that a piece which no domain knows favours none, however much labelled text
each has. The classifier covers all labelled documents, the rates all documents. The model
is a table of BUCKETS rows and a column per domain; more than MOST_DOMAINS domains are an error.

Copies are drawn systematically: within a domain, ordered by length, a document gets another
copy where the running sum of fractional rates passes a whole number, so that the sampled
tokens stay near the expected ones. Only DataFrame functions are used.

Defined results: null text counts as empty, with no tokens and prior posteriors; null labels
are left out of the fit; of several labels of a document the better counts; without labels there is
one domain; a null doc_id is carried; repeated rows are documents of their own; a target for a
domain without tokens is left unmet; rates that do not settle are an error; of domains of equal posterior the
first by name is named; an empty table gives an empty result; columns of docs, whatever their names, are
kept by sample().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, join_hot, n_shuffle, table

PIECE, BUCKETS = 3, 8_192
OWN, LANGUAGE, COMMON = 0.85, 0.13, 0.02  # parts of a domain's frequencies: its own, the mean of its language, the mean of all
MOST_DOMAINS = 512
TEMPER = 40.0  # characters that count as one piece of evidence
ROUNDS, TOLERANCE = 60, 1e-4
SETTLED = 1e-3  # of a domain's tokens: a misfit that still moves by more after the last round is an error
WHOLE = 1_000_000_000  # fractional rates are counted in such parts
SHARES = {"low": 0.25}  # share of a domain's own tokens that is asked for; 1 for others
WORD = "[^\\x20\\x09-\\x0D]+"


def _sum(terms: list[Column]) -> Column:
    """A sum as a balanced tree, so that its depth stays small for many domains."""
    if len(terms) < 2:
        return terms[0] if terms else F.lit(0.0)
    half = len(terms) // 2
    return _sum(terms[:half]) + _sum(terms[half:])


def pieces(text: Column) -> Column:
    """The buckets, from 1, of all pieces of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[^\\x20\\x09-\\x0D]{{1,{PIECE}}}"), F.lit(0)), lambda g: (F.pmod(F.xxhash64(g), F.lit(BUCKETS)) + 1).cast("int"))


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))


def _with_domain(docs: DataFrame, known: DataFrame) -> DataFrame:
    rows = docs.where("doc_id is not null and lang is not null").select("doc_id", "lang", "text").join(known, "doc_id")
    return rows.select(F.concat_ws(":", "lang", F.when(F.col("_quality") == 1, "good").otherwise("low")).alias("_domain"), "text")


@dataclass
class Model:
    """Log prior of each domain, and a row per bucket: _b, and _wK, its log likelihood in the K-th domain."""

    priors: dict[str, float]
    weights: DataFrame


def fit_classifier(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier of all labelled documents; a single domain without evidence if there are none."""
    rows = _with_domain(docs, _known(labels).hint("merge"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = rows.select("_domain", F.explode(F.concat(F.array(F.lit(0)), pieces(text))).alias("_b"))  # bucket 0 counts documents
    counts = cut(seen.groupBy("_domain", "_b").agg(F.count("*").alias("_n")))
    sizes = counts.groupBy("_domain").agg(F.sum(F.when(F.col("_b") == 0, F.col("_n"))).alias("_docs"), F.greatest(F.lit(1), F.sum(F.when(F.col("_b") > 0, F.col("_n")).otherwise(0))).alias("_size"))
    if sizes.limit(MOST_DOMAINS + 1).count() > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    grid = sizes.select("_domain", "_docs", "_size", F.explode(F.sequence(F.lit(1), F.lit(BUCKETS))).alias("_b")).join(counts, ["_domain", "_b"], "left")
    language = F.expr("left(_domain, char_length(_domain) - char_length(substring_index(_domain, ':', -1)))")
    mine = grid.withColumns({"_x": F.coalesce(F.col("_n") / F.col("_size"), F.lit(0.0)), "_lang": language})
    spoken, common = F.avg("_x").over(Window.partitionBy("_lang", "_b")), (F.avg("_x").over(Window.partitionBy("_b")) + 1e-6) / (1 + 1e-6 * BUCKETS)
    domains = {r["_domain"]: r["_docs"] for r in sizes.select("_domain", "_docs").orderBy("_domain").collect()}
    if not domains:
        return Model({"all": 0.0}, docs.sparkSession.range(1, BUCKETS + 1).select(F.col("id").cast("int").alias("_b"), F.lit(0.0).alias("_w0")))
    weighed = mine.select("_domain", "_b", F.log(OWN * F.col("_x") + LANGUAGE * spoken + COMMON * common).alias("_w"))
    columns = (F.max(F.when(F.col("_domain") == d, F.col("_w"))).alias(f"_w{k}") for k, d in enumerate(domains))
    total = sum(domains.values())
    return Model({d: math.log(n / total) for d, n in domains.items()}, cut(weighed.groupBy("_b").agg(*columns)))


def posteriors(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, _tokens and _p0.._pK-1, the tempered posterior of each domain.

    Pieces meet a table of BUCKETS rows and are summed up by the hash of their text before they travel; equal texts
    share one row of sums, told to all of them.
    """
    ks = range(len(model.priors))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("_key")
    told = docs.select(key, F.regexp_count(text, F.lit(WORD)).cast("double").alias("_tokens"), F.char_length(text).cast("double").alias("_n"), F.concat(F.array(F.lit(0)), pieces(text)).alias("_at"))
    found = told.select("_key", "_tokens", "_n", F.explode("_at").alias("_b")).join(F.broadcast(model.weights), "_b", "left")  # BUCKETS x MOST_DOMAINS numbers
    own = [F.count_if(F.col("_b") == 0).alias("_copies"), F.max("_tokens").alias("_tokens"), F.max("_n").alias("_n")]
    sums = found.groupBy("_key").agg(*own, *(F.coalesce(F.sum(f"_w{k}"), F.lit(0.0)).alias(f"_w{k}") for k in ks))
    rows = join_hot(docs.select(*keep, key), cut(sums), "_key", "_copies")
    scale = F.when(F.col("_n") > 0, 1 / F.greatest(F.lit(1.0), F.sqrt(F.col("_n") / TEMPER))).otherwise(0.0)
    rows = rows.select(*keep, "_tokens", *((F.lit(prior) + scale * F.col(f"_w{k}") / F.col("_copies")).alias(f"_s{k}") for k, prior in enumerate(model.priors.values())))
    top = F.greatest(*(F.col(f"_s{k}") for k in ks)) if len(model.priors) > 1 else F.col("_s0")
    rows = rows.select(*keep, "_tokens", *(F.exp(F.col(f"_s{k}") - top).alias(f"_e{k}") for k in ks))
    whole = _sum([F.col(f"_e{k}") for k in ks])
    return rows.select(*keep, "_tokens", *((F.col(f"_e{k}") / whole).alias(f"_p{k}") for k in ks))


def fit_rates(rows: DataFrame, targets: list[float]) -> tuple[Column, list[float]]:
    """(rate as an expression over _p0.., expected tokens per domain) for rows with _tokens and posteriors."""
    ks = range(len(targets))
    first = rows.agg(*(F.sum(F.col("_tokens") * F.col(f"_p{k}")).alias(f"n{k}") for k in ks)).first()
    own = [first[k] or 0.0 for k in ks]
    steps: list[list[float]] = []

    def rate() -> Column:
        free = F.lit(1.0)
        for g in steps:
            free = F.greatest(F.lit(0.0), free - _sum([F.col(f"_p{k}") * g[k] for k in ks]))
        return free

    now, before = own, None
    for _ in range(ROUNDS):
        gap = [(s - t) / n if n > 0 else 0.0 for s, t, n in zip(now, targets, own, strict=True)]
        moved = max((abs(a - b) for a, b in zip(gap, before, strict=True)), default=0.0) if before else math.inf
        if max(map(abs, gap), default=0.0) <= TOLERANCE or moved <= TOLERANCE / 10:
            break  # met, or as near as nonnegative rates come
        before = gap
        if len(steps) >= 2 and steps[-1] and not clipped:
            steps[-1] = [a + b for a, b in zip(steps[-1], gap, strict=True)]  # steps that clip nothing add up
        else:
            steps.append(gap)
        got = rows.select("_tokens", *(f"_p{k}" for k in ks), rate().alias("_r")).agg(*(F.sum(F.col("_tokens") * F.col("_r") * F.col(f"_p{k}")).alias(f"s{k}") for k in ks), F.count_if(F.col("_r") <= 0).alias("zero")).first()
        now, clipped = [got[k] or 0.0 for k in ks], bool(got["zero"])
    else:
        if moved > SETTLED:
            raise RuntimeError(f"rates did not settle in {ROUNDS} rounds; misfit by domain {gap}")
    return rate(), now


def rated(docs: DataFrame, model: Model, keep: list[str], shares: dict[str, float]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(keep, tokens, posteriors and rate per row, {domain: (target, expected tokens)})."""
    domains = list(model.priors)
    rows = cut(posteriors(docs, model, keep))
    totals = rows.agg(*(F.sum(F.col("_tokens") * F.col(f"_p{k}")) for k in range(len(domains)))).first()
    targets = [(totals[k] or 0.0) * shares.get(d, shares.get(d.rpartition(":")[2], 1.0)) for k, d in enumerate(domains)]
    rate, reached = fit_rates(rows, targets)
    return rows.withColumn("_rate", rate), dict(zip(domains, zip(targets, reached, strict=True), strict=True))


def mixed(docs: DataFrame, labels: DataFrame, keep: list[str], shares: dict[str, float] = SHARES) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """rated() with a classifier fitted on the labelled documents."""
    return rated(docs, fit_classifier(docs, labels), keep, shares)


def domain_number(n: int) -> Column:
    """The number, from 0, of the domain with the largest of n posteriors."""
    ps = [F.col(f"_p{k}") for k in range(n)]
    return (F.array_position(F.array(*ps), F.greatest(*ps)) - 1).cast("int") if n > 1 else F.lit(0)


def drawn(rows: DataFrame, n: int) -> DataFrame:
    """rows (row, _tokens, posteriors of n domains, _rate) with _copies: the whole part of the rate, and one more where the domain's running sum of fractional parts passes a whole number.

    A domain is dealt over as many parts as there are shuffle partitions; the sums of earlier parts carry over.
    """
    spark = rows.sparkSession
    parts = rows.withColumn("_h", F.xxhash64("row.doc_id", "row.text")).withColumn("_d", domain_number(n)).withColumn("_s", F.pmod("_h", F.lit(n_shuffle(spark)))).withColumn("_part", F.round((F.col("_rate") - F.floor("_rate")) * WHOLE).cast("long"))
    before = parts.groupBy("_d", "_s").agg(F.sum("_part").alias("_all")).select("_d", "_s", (F.sum("_all").over(Window.partitionBy("_d").orderBy("_s")) - F.col("_all")).alias("_before"))
    run = F.sum("_part").over(Window.partitionBy("_d", "_s").orderBy("_tokens", "_h").rowsBetween(Window.unboundedPreceding, 0))
    reached = parts.withColumn("_run", run).join(before, ["_d", "_s"]).withColumn("_run", F.col("_run") + F.col("_before") + F.pmod(F.xxhash64("_d"), F.lit(WHOLE)))
    more = F.floor(F.col("_run") / WHOLE) - F.floor((F.col("_run") - F.col("_part")) / WHOLE)
    return reached.withColumn("_copies", (F.floor("_rate") + more).cast("int"))


def sample(docs: DataFrame, labels: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """Rows of docs repeated or dropped by their rates."""
    model = fit_classifier(docs, labels)
    rows, _ = rated(docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), "text"), model, ["row"], shares)
    copies = drawn(rows, len(model.priors)).where("_copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def op6_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, fitted = mixed(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    k = range(len(fitted))
    names = F.array(*(F.lit(d) for d in fitted))
    domain = F.element_at(names, domain_number(len(fitted)) + 1)
    return rows.select("doc_id", F.col("_tokens").cast("long").alias("n_tokens"), domain.alias("domain"), F.map_from_arrays(names, F.array(*(F.round(f"_p{i}", 6) for i in k))).alias("posteriors"), F.col("_rate").alias("rate"))
