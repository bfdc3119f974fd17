"""Links and components against comparing every pair, with copies, large groups and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import vector_dedup

VECS = "vec_id long, embedding array<float>, label int, rep long, v string, b int"


def frame(spark, rows, schema=VECS):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "z", 3) for i, v in rows], schema)


def brute(rows, cosine=0.95, kind=np.float32):
    """(vec_id, n_links, component_id, kept) per row, from all pairs of distinct (id, vector)."""
    good = sorted({(i, tuple(kind(c) for c in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, kind)).all() and np.array(v, kind).any()})
    n = {}
    up = {i: i for i, _ in good}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for dim in {len(v) for _, v in good}:
        mine = [g for g in good if len(g[1]) == dim]
        x = np.array([v for _, v in mine], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        near = (x @ x.T) / norm / norm[:, None] >= cosine - 1e-12
        np.fill_diagonal(near, False)
        for k, g in enumerate(mine):
            n[g] = int(near[k].sum())
            for j in np.flatnonzero(near[k]):
                a, b = root(g[0]), root(mine[j][0])
                up[max(a, b)] = min(a, b)
    out = []
    for i, v in rows:
        key = (i, tuple(kind(c) for c in v)) if v and None not in v else None
        if key in n:
            out.append((i, n[key], root(i), root(i) == i))
        else:
            out.append((i, 0, i, True))
    return sorted(out, key=repr)


def of(df, **more):
    return sorted((tuple(r) for r in vector_dedup.near_vectors(df, **more).collect()), key=repr)


def near_copies(rng, dim, groups, size, noise):
    out = []
    for _ in range(groups):
        base = rng.standard_normal(dim)
        out += [base + noise * rng.standard_normal(dim) for _ in range(size)]
    return out


def test_links_and_components_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    x = list(rng.standard_normal((1500, 32))) + near_copies(rng, 32, 40, 6, 0.2) + near_copies(rng, 32, 3, 60, 0.15)
    rows = [(i, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist()) for i, v in enumerate(x)]
    want, got = brute(rows), of(frame(spark, rows))
    assert [g[0] for g in got] == [w[0] for w in want]
    links = sum(w[1] for w in want)
    assert links > 2000 and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= (1 - 3 * vector_dedup.MISS) * links
    assert sum(g[2:] != w[2:] for g, w in zip(got, want, strict=True)) <= 1


def test_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(2000):  # pairs just below and just above
        a, r = rng.standard_normal((2, 16))
        a /= np.linalg.norm(a)
        r -= r @ a * a
        r /= np.linalg.norm(r)
        angle = math.acos(0.95 + (1e-5 if k % 2 else -1e-5))
        rows += [(2 * k, a.tolist()), (2 * k + 1, (math.cos(angle) * a + math.sin(angle) * r).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[0]: r[1] for r in of(df)}
    between = {r[0]: r[1] for r in brute(rows, kind=np.float64)}
    assert all(got[i] <= between[i] for i in got)
    assert sum(got.values()) >= (1 - 4 * vector_dedup.MISS) * sum(between.values()) - 2


def test_copies_odd_vectors_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(70, 10, -1)] + [(5, [2.0, 4.0, 0.0]), (6, [-1.0, -2.0, 0.0]), (7, [-1.0, -2.0, -0.0])]
    rows += [(80, None), (81, []), (82, [0.0, 0.0, 0.0]), (83, [nan, 1.0, 1.0]), (84, [None, 1.0, 1.0]), (85, [inf, 1.0, 1.0]), (86, [1.0, 2.0]), (87, [1.0, 2.0]), (None, [1.0, 2.0, 0.0])]
    rows += [(88, [0.0, 0.0, 1.0])] * 3 + [(89, [0.0, 0.0, 3e38]), (90, [1e-38, 0.0, 0.0]), (90, [0.0, 1e-38, 0.0]), (91, [1e-30, 0.0, 0.0]), (92, [0.0, 7.0, 0.0])]
    assert of(frame(spark, rows)) == brute(rows)


def test_large_buckets_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    monkeypatch.setattr(vector_dedup, "HOT_BUCKETS", 1 << 30)
    rng = np.random.default_rng(2)
    x = near_copies(rng, 24, 1, 700, 0.1) + list(rng.standard_normal((200, 24)))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    want, got = brute(rows), of(frame(spark, rows))
    assert sum(abs(g[1] - w[1]) for g, w in zip(got, want, strict=True)) <= 1e-3 * sum(w[1] for w in want)
    assert [g[2:] for g in got] == [w[2:] for w in want]


def test_codes_do_not_depend_on_the_batch():
    how = vector_dedup.Hashing.of(10**6, 0.95)
    x = np.random.default_rng(3).standard_normal((300, 100)).astype(np.float32).astype(np.float64)
    whole = how.codes(x, how.planes(100))
    assert all((how.codes(x[k : k + 1], how.planes(100)) == whole[k]).all() for k in range(300))
    assert (how.codes(x * 4, how.planes(100)) == whole).all() and whole.max() < 1 << how.bits


@pytest.mark.parametrize("n", [0, 1, 10**4, 10**6, 10**9, 4 * 10**11])
def test_tables_keep_the_promise_at_every_size(n):
    how = vector_dedup.Hashing.of(n, 0.95)
    same = (1 - math.acos(0.95) / math.pi) ** how.bits
    assert (1 - same) ** how.tables <= vector_dedup.MISS
    assert n / 2**how.bits <= vector_dedup.BUCKET or how.bits == 31
    assert how.in_word * how.bits <= 64 and how.furthest < how.in_word * how.bits


def test_another_threshold_empty_tables_and_names(spark):
    assert of(frame(spark, [])) == []
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])]
    assert of(frame(spark, rows), cosine=0.7) == brute(rows, 0.7)
    df = frame(spark, rows).withColumn("a.b", F.lit(1)).withColumn("h1", F.lit(1)).withColumn("id", F.lit(4)).withColumn("size", F.lit(4))
    assert of(df) == brute(rows)
