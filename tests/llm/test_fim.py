"""Boundaries against a unit-by-unit reading, the exact way back, and odd rows."""

import hashlib
import random
import re

import pytest
from frames import docs, odd_rows, prose
from pyspark.sql import functions as F

from ledgerloom.llm import fim

UNIT = {"tokens": r"[A-Za-z]+|[^A-Za-z]", "characters": r"[\s\S]", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+"}
ODD = ["", "a", " ", "ab", "a b", "\n", "a\r\nb", "\U0001f600", "a\U0001f600b", "\U0001f600\U0001f601", "é", "éx", "ß z", "\x00a", "<", "<P", "P>", "<<S>", "<S", "a<M>b", "1", "x1y22", "\U00010400Q퟿"]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("aZ <>PSM\n\t1é\U0001f600́") for _ in range(rng.randrange(1, 60))) for _ in range(300)]


def expected(doc_id, text):
    u = re.findall(UNIT["tokens"], text)
    n = len(u)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("grammar", sorted(fim.GRAMMARS))
def test_units_are_those_of_a_reading_from_left_to_right(spark, grammar):
    df = spark.createDataFrame([(t,) for t in texts()], "text string")
    for r in df.select("text", fim.units(F.col("text"), grammar).alias("u")).collect():
        assert r.u == re.findall(UNIT[grammar], r.text), repr(r.text)


def test_every_row_equals_brute_force_and_comes_back(spark):
    rows = list(enumerate(texts())) + [(None, "some text here"), (10**15, "x " * 50), (-4, "minus four")]
    done = fim.fill_in_middle(docs(spark, rows))
    got = {r.doc_id: r for r in done.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n, r.form, r.prefix, r.middle, r.output) == expected(i, t) and r.back == t
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_shares_of_forms(spark):
    forms = [r.form for r in fim.fill_in_middle(docs(spark, [(i, "one two three") for i in range(4000)])).select("form").collect()]
    assert 0.88 < 1 - forms.count("plain") / 4000 < 0.92 and 0.17 < forms.count("spm") / (4000 - forms.count("plain")) < 0.23


def test_nulls_empty_long_and_repeated_texts(spark):
    rows = odd_rows() + [(9, "(" * 200_000 + prose(100_000, 4))]
    got = fim.fill_in_middle(docs(spark, rows)).collect()
    assert len(got) == len(rows) and [r.n for r in got if r.doc_id in (1, 2)] == [0, 0]
    for (i, t), r in zip(rows, got, strict=True):
        assert (r.n, r.form, r.prefix, r.middle, r.output) == expected(i, t or "")
    assert fim.fill_in_middle(docs(spark, [])).collect() == []


def test_other_columns_and_parameters(spark):
    df = docs(spark, [(1, "a b c")]).withColumn("u", F.lit(1)).withColumn("x.y", F.lit(2)).withColumn("h", F.lit(3)).withColumn("form", F.lit("f"))
    assert fim.fill_in_middle(df, seed=2, plain_from=100, spm_below=100).first().form == "spm"
    assert fim.fill_in_middle(df, grammar="characters", plain_from=0).first().form == "plain"


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = fim.fill_in_middle(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
