"""Texts of a batch become Python objects slice by slice."""

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.functions import text as X


def test_a_batch_is_held_in_slices(monkeypatch):
    monkeypatch.setattr(X, "SLICE_BYTES", 1000)
    sizes, made = [], pa.array
    monkeypatch.setattr(pa, "array", lambda rows, kind: sizes.append(len(rows)) or made(rows, kind))
    rows = made(["x" * 100, None, ""] * 100, pa.string())
    assert X.by_slices(lambda t: t, pa.string(), rows).equals(rows) and max(sizes) <= 40 and sum(sizes) == 300
    assert len(X.by_slices(lambda t: t, pa.string(), rows.slice(0, 0))) == 0


def test_values_are_those_of_each_row(spark):
    long = "é" * 700_000
    data = [(1, None, None), (2, long, [None, "password: ", "hunter22x"]), (3, "token=abcdefgh", []), (4, "", [""])]
    df = spark.createDataFrame(data, "id int, t string, p array<string>").coalesce(1)
    got = {r.id: r for r in df.select("id", X.finish("t", F.lit(5)).alias("f"), X.excerpt("t", F.lit(3)).alias("e"), X.redact_parts("p").alias("p")).collect()}
    assert [tuple(got[k].f) for k in (1, 2, 4)] == [(None, 0), ("éé", X.TRUNCATED), ("", 0)] and got[3].f.flags == X.REDACTED | X.TRUNCATED
    assert [got[k].e for k in (1, 2, 3, 4)] == [None, "é\n...\né", "tok\n...\nfgh", ""]
    assert got[1].p is None and got[3].p == [] and got[4].p == [""] and "hunter22x" not in "".join(got[2].p)
