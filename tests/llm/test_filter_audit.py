"""Counts of the matrices against applying the filters one after the other, and odd rows."""

import random
import re
from collections import Counter

from frames import DOCS, prose
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit
from ledgerloom.llm.filter_audit import COUNTS, FILTERS, ORDERS


def failures(rows):
    """The set of failing filters of each row (doc_id, text, lang)."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append({k for k, v in fails.items() if v})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    out, shapley = {}, Counter()
    told = list(zip(rows, failures(rows), strict=True))
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in told if (r[2] or "") == part]
        for order in ORDERS:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [i for i, fails in left if f in fails]
                left = [(i, fails) for i, fails in left if f not in fails]
                counts = [len(left), len(gone), sum(f in fails for _, fails in mine) - len(gone), sum(fails == {f} for _, fails in mine), sum(i in good for i in gone), sum(i in toxic for i in gone)]
                out[part, order, step] = counts
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 7, "x", "y", 1) for i, t, lang in rows], DOCS)


def of(spark, rows, labels):
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(frame(spark, rows), told).collect()}


def some_rows():
    rng = random.Random(5)
    out = []
    for i in range(150):
        text = prose(rng.choice([5, 150, 199, 200, 260]), i % 60)
        text = rng.choice([text, text.upper(), text + " 5%", "same words " * 150, text + " ÉÉÉ" * 40])
        out.append((i, text, rng.choice(["en", "de", None, ""])))
    odd = [(200, None, "en"), (201, "", "en"), (202, " \n\t", "fr"), (203, "A", "fr"), (None, "A", "fr"), (None, None, None), (7, "A", "fr"), (7, "A", "fr"), (7, "A", "de"), (204, " ".join(["w"] * 300), "en")]
    return out + odd


def test_all_counts_equal_applying_the_filters_in_turn(spark):
    rng = random.Random(6)
    rows = some_rows()
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 210, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    got = of(spark, rows, labels)
    assert got == brute(rows, labels)
    assert len(got) == 600 * 4


def test_shapley_adds_up_to_what_goes(spark):
    rows = some_rows()
    got = of(spark, rows, [])
    for part in ("en", "de", "fr", ""):
        shares = {o[s - 1]: v[COUNTS.index("shapley")] for (p, o, s), v in got.items() if p == part}
        gone = sum(bool(f) for r, f in zip(rows, failures(rows), strict=True) if (r[2] or "") == part)
        assert sum(shares.values()) == 120 * gone and set(shares) == set(FILTERS)


def test_a_text_of_very_many_copies(spark, monkeypatch):
    from ledgerloom.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 10)
    monkeypatch.setattr(common, "HOT", 16)
    rows = [(i, "Same", "en") for i in range(80)] + [(100 + i, prose(3, i), "en") for i in range(40)] + [(90, prose(3, 1), "de")]
    assert of(spark, rows, []) == brute(rows, [])


def test_no_rows_and_other_columns(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1)).withColumn("a.b", F.lit(1))
    assert filter_audit.audit(frame(spark, []), labels).collect() == []
    df = frame(spark, [(1, "A", "en")]).withColumn("mask", F.lit(2)).withColumn("a.b", F.lit(1)).withColumn("digest", F.lit(1)).withColumn("size", F.lit(9))
    assert filter_audit.audit(df, labels).count() == 600
