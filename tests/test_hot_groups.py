"""Operators whose groups may be large: against a fold or brute force, and without a group in one task's memory."""

import hashlib
import random

from ledgerloom.operators import ledger, stats, windows


def plan(df):
    return df._jdf.queryExecution().toString()


def folded(lines, most_bytes, most_lines):
    out, i = [], 0
    while i < len(lines):
        used, j = 0, i
        while j < len(lines) and j - i < most_lines and (j == i or used + (lines[j][1] or 0) <= most_bytes):
            used += lines[j][1] or 0
            j += 1
        if j < len(lines) and not lines[j][2]:
            j = next((k for k in range(j - 1, i, -1) if lines[k][2]), None) or j
        out.append((len(out), lines[i][0], lines[j - 1][0], j - i, sum(x[1] or 0 for x in lines[i:j])))
        i = j
    return out


def test_windows_equal_the_fold_and_no_source_is_one_group(spark):
    rng = random.Random(3)
    sources = {s: [(line, rng.choice([None, -50, 0, 90, 300, 2000]), rng.random() < 0.2) for line in range(1, n + 1)] for s, n in ((1, 300), (2, 1), (3, 37), (4, 8))}
    df = spark.createDataFrame([(s, *x) for s, xs in sources.items() for x in xs], "source_id long, line long, bytes long, is_prompt boolean")
    out = windows.split_windows(df, 900, 10)
    assert sorted(tuple(r) for r in out.collect()) == [(s, *w) for s in sorted(sources) for w in folded(sources[s], 900, 10)]
    assert "FlatMapGroups" not in plan(out)


def test_snapshot_streams_its_groups(spark):
    data = [("a" if i % 3 else None, i % 7, f"é{i * 7919 % 101}") for i in range(500)]
    out = stats.snapshot(spark.createDataFrame(data, "g string, k int, t string"), "k", "t", by="g")
    for g, digest, n in out.collect():
        lines = sorted(f"={k}|={t}".encode() for x, k, t in data if x == g)
        assert n == len(lines) and digest == hashlib.sha256(b"\n".join(lines)).hexdigest()
    assert out.count() == 2 and "collect_list" not in plan(out)


def test_a_hot_thread_makes_no_pairs(spark):
    rng = random.Random(4)
    ask = [(f"R{i}", "p", "t", f := rng.randrange(400), f + rng.randrange(6)) for i in range(300)]
    off = [(f"C{i}", "p", "t", f := rng.randrange(400), f + rng.randrange(4)) for i in range(60)]
    schema = "request_id string, provider string, thread_id string, from_line long, through_line long"
    out = ledger.unsuppressed(spark.createDataFrame(ask, schema), spark.createDataFrame(off, schema))
    want = [(r, max([f, *(b + 1 for *_, a, b in off if a <= f <= b)]), t) for r, _, _, f, t in ask]
    assert sorted(tuple(r) for r in out.collect()) == sorted(w for w in want if w[1] <= w[2])
    joins = [x for x in plan(out).split("== Optimized")[0].splitlines() if "Join" in x]
    assert joins and all("from_line" in x for x in joins)
