from frames import docs, odd_rows, prose
from pyspark.sql import functions as F

from ledgerloom.llm import mixing


def corpus(spark):
    source, labels = [], []
    for i in range(200):
        low = i % 5 == 0
        source.append((i, prose(50 + i % 30, i) if not low else "$$$ ### !! " * (20 + i % 9)))
        labels.append((i, int(not low), 1))
    return docs(spark, source), spark.createDataFrame(labels, "doc_id long, quality int, lang int")


def test_rates_meet_the_targets(spark):
    df, labels = corpus(spark)
    out, fitted = mixing.mixed(df, labels, ["doc_id"], {"low": 0.25})
    assert set(fitted) == {"en:good", "en:low"}
    for target, reached in fitted.values():
        assert abs(reached - target) <= 1e-3 * target + 1e-6
    rates = dict(out.select("doc_id", "_rate").collect())
    assert all(r >= 0 for r in rates.values()) and all(abs(rates[i] - (1 if i % 5 else 0.25)) < 0.05 for i in rates)


def test_upweighting_and_unreachable_targets(spark):
    df, labels = corpus(spark)
    out, fitted = mixing.mixed(df, labels, ["doc_id"], {"low": 0.0, "good": 3.0})
    n = {r.doc_id: r.n for r in mixing.sample(df, labels, {"low": 0.0, "good": 3.0}).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(n.get(i, 0) == (3 if i % 5 else 0) for i in range(200))


def test_sampling_keeps_columns_and_clean_rows(spark):
    df, labels = corpus(spark)
    kept = mixing.sample(df, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and {i for i in range(200) if i % 5} <= ids and len([i for i in ids if i % 5 == 0]) < 30


def test_odd_rows(spark):
    df = docs(spark, odd_rows())
    for marks in ([], [(4, None, 1), (None, 1, 1)], [(4, 1, 1), (6, 0, 1)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, lang int")
        assert mixing.mixed(df, labels, ["doc_id"])[0].count() == len(odd_rows())
        assert mixing.sample(docs(spark, []), labels).collect() == []


def test_drawn_copies_sum_to_the_rates(spark):
    for rate in (0.03, 0.08, 0.5, 0.95, 1.08, 2.0):
        rows = spark.range(20_000).select(F.struct(F.col("id").alias("doc_id"), F.lit("t").alias("text")).alias("row"), F.lit(5.0).alias("_tokens"), F.lit(1.0).alias("_p0"), F.lit(rate).alias("_rate"))
        got = mixing.drawn(rows, 1).agg(F.sum("_copies"), F.min("_copies"), F.max("_copies")).first()
        assert abs(got[0] - 20_000 * rate) <= 1 and got[1] >= int(rate) and got[2] <= int(rate) + (rate % 1 > 0)


def test_sampled_tokens_are_near_the_targets(spark):
    source = [(i, prose(20 + i % 200, i) if i % 3 else "$$$ ### !! " * (5 + i % 97)) for i in range(3_000)]
    df, labels = docs(spark, source), spark.createDataFrame([(i, int(i % 3 > 0), 1) for i in range(3_000)], "doc_id long, quality int, lang int")
    shares = {"low": 0.3, "good": 0.7}
    _, fitted = mixing.mixed(df, labels, ["doc_id"], shares)
    words = F.size(F.split(F.trim("text"), "\\s+"))
    got = {r.low: r.n for r in mixing.sample(df, labels, shares).groupBy((F.col("doc_id") % 3 == 0).alias("low")).agg(F.sum(words).alias("n")).collect()}
    for low, domain in ((True, "en:low"), (False, "en:good")):
        assert abs(got[low] / fitted[domain][0] - 1) < 0.01


def test_rates_are_the_least_squares_solution(spark):
    """Against plain projected gradient over all rates, whose domains overlap."""
    import numpy as np

    rng = np.random.default_rng(3)
    t, p = rng.uniform(1, 50, 60), rng.dirichlet([0.4, 0.4, 0.4], 60)
    for shares in ([0.2, 1.0, 1.4], [0.5, 0.9, 1.2], [1.0, 1.0, 1.0]):
        own = (t[:, None] * p).sum(axis=0)
        target = own * shares
        r = np.ones(60)
        for _ in range(200_000):
            step = p @ (((t * r) @ p - target) / own)
            new = np.maximum(0, r - 0.2 * step)
            if np.abs(new - r).max() < 1e-12:
                break
            r = new
        rows = spark.createDataFrame([(i, float(t[i]), *map(float, p[i])) for i in range(60)], "i int, _tokens double, _p0 double, _p1 double, _p2 double")
        rate, reached = mixing.fit_rates(rows, list(target))
        got = np.array([x.r for x in rows.select("i", rate.alias("r")).orderBy("i").collect()])
        misfit = lambda x: ((((t * x) @ p - target) ** 2) / own).sum()
        assert misfit(got) <= misfit(r) + 1e-5 * own.sum()
        assert np.allclose(reached, (t * got) @ p) and (got >= 0).all()


def test_rates_that_do_not_settle_are_an_error(spark, monkeypatch):
    import pytest

    df, labels = corpus(spark)
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="settle"):
        mixing.mixed(df, labels, ["doc_id"], {"low": 0.25})


def test_columns_with_clashing_names_are_kept(spark):
    df, labels = corpus(spark)
    odd = df.withColumns({c: F.lit(7) for c in ("_tokens", "_copies", "_copy", "_rate", "_p0", "_d", "_s", "row", "_domain", "_quality")})
    kept = mixing.sample(odd, labels)
    assert kept.columns == odd.columns and {tuple(r) for r in kept.select("_tokens", "_copies", "_copy", "_rate", "_p0", "row").collect()} == {(7,) * 6}


def brute_posteriors(labelled, text):
    """The tempered posterior of each domain, from the pieces of all labelled texts."""
    import math
    import re
    from collections import Counter

    import pandas as pd

    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]{1,3}", t)
    counts = {d: Counter(g for e, t in labelled if e == d for g in cut(t)) for d in {d for d, _ in labelled}}
    shares = pd.DataFrame({d: {g: n / c.total() for g, n in c.items()} for d, c in counts.items()}).fillna(0.0)
    seen = sorted(set(cut(text)) & set(shares.index))
    scores = {}
    for d in shares:
        spoken = shares[[e for e in shares if e.split(":")[0] == d.split(":")[0]]].mean(axis=1)
        common = lambda g: ((shares.loc[g].mean() if g in seen else 0.0) + 1e-6) / (1 + 1e-6 * mixing.BUCKETS)  # noqa: B023, E731
        w = lambda g: mixing.OWN * (shares[d][g] if g in seen else 0) + mixing.LANGUAGE * (spoken[g] if g in seen else 0) + mixing.COMMON * common(g)  # noqa: B023, E731
        scale = 1 / max(1, math.sqrt(len(text) / mixing.TEMPER)) if text else 0
        scores[d] = math.log(sum(e == d for e, _ in labelled) / len(labelled)) + scale * sum(math.log(w(g)) for g in cut(text))
    top = max(scores.values())
    whole = sum(math.exp(s - top) for s in scores.values())
    return {d: math.exp(s - top) / whole for d, s in scores.items()}


def test_posteriors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 1 << 14)  # so few pieces hardly ever share a bucket
    source = [(i, ["abc def ghi", "abd xyz", "$$ ## abc", "\u4f60\u597d\u4e16\u754c \u4f60"][i % 4] * (1 + i % 3)) for i in range(24)]
    df = docs(spark, source).withColumn("lang", F.when(F.col("doc_id") % 4 == 3, "zh").otherwise("en"))
    labels = spark.createDataFrame([(i, int(i % 4 != 2), 1) for i in range(20)], "doc_id long, quality int, lang int")
    labelled = [(f"{'zh' if i % 4 == 3 else 'en'}:{'low' if i % 4 == 2 else 'good'}", t) for i, t in source[:20]]
    model = mixing.fit_classifier(df, labels)
    more = docs(spark, [*source, (90, None), (91, "never seen before"), (92, "abc $$ " * 40)])
    for r in mixing.posteriors(more, model, ["doc_id", "text"]).collect():
        want = brute_posteriors(labelled, r.text or "")
        assert all(abs(r[f"_p{k}"] - want[d]) < 2e-3 for k, d in enumerate(model.priors)), (r.text, want)


def test_forty_languages_of_two_qualities_are_told_apart(spark):
    import random

    rng = random.Random(1)
    source, labels, langs = [], [], []
    for k in range(40):
        words = ["".join(chr(0x4E00 + 128 * k + rng.randrange(24)) for _ in range(rng.randrange(2, 8))) for _ in range(200)]
        for _ in range(48):
            low = rng.random() < 0.3
            source.append((len(source), " ".join(rng.choice(["$$", "##", rng.choice(words)]) if low else rng.choice(words) for _ in range(40 if low else 60))))
            labels.append((len(labels), int(not low), 0))
            langs.append(f"l{k:02d}")
    df = docs(spark, source).drop("lang").join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def hits(known, asked):
        model = mixing.fit_classifier(df, told.where(known))
        assert len(model.priors) == 80
        domain = F.element_at(F.array(*map(F.lit, model.priors)), mixing.domain_number(80) + 1)
        right = mixing.posteriors(df, model, ["doc_id", "lang"]).select("doc_id", "lang", domain.alias("domain")).join(told, "doc_id").where(asked)
        hit = F.avg((F.col("domain") == F.concat("lang", F.lit(":"), F.when(F.col("quality") == 1, "good").otherwise("low"))).cast("int"))
        return [r.hit for r in right.groupBy("lang").agg(hit.alias("hit")).collect()]

    assert min(hits("true", "true")) >= 0.95
    held_out = hits("doc_id % 2 = 0", "doc_id % 2 = 1")
    assert sum(held_out) / 40 >= 0.97


def test_too_many_domains_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(mixing, "MOST_DOMAINS", 1)
    df, labels = corpus(spark)
    with pytest.raises(ValueError, match="domains"):
        mixing.fit_classifier(df, labels)


def test_a_domain_cut_below_a_tenth_keeps_its_share(spark):
    source = [(i, prose(50, i) if i % 2 else "$$$ ### !! " * (20 + i % 9)) for i in range(2_000)]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(2_000)], "doc_id long, quality int, lang int")
    n = mixing.sample(docs(spark, source), labels, {"low": 0.08}).where("doc_id % 2 = 0").count()
    assert 50 <= n <= 110


def test_every_labelled_domain_has_a_class_and_a_target(spark):
    source = [(i, prose(20, i) if i % 2 else "$$$ ### !! " * 9) for i in range(140)]
    df = docs(spark, source).withColumn("lang", F.concat(F.lit("l"), (F.floor(F.col("doc_id") / 2) % 35).cast("string")))
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(140)], "doc_id long, quality int, lang int")
    out, fitted = mixing.mixed(df, labels, ["doc_id"])
    assert set(fitted) == {f"l{k}:{q}" for k in range(35) for q in ("good", "low")} and all(t > 0 for t, _ in fitted.values())
    assert out.count() == 140
