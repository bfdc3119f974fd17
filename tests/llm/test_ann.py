import numpy as np

from ledgerloom.llm import ann

VECS = "vec_id long, embedding array<float>, label int, rep long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "z") for i, v in rows], VECS)


def brute(rows, every, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    return {q: sorted(((-float((good[q] * x).sum()), i) for i, x in good.items() if i != q))[:k] for q in good if q % every == 0}


def test_recall_and_scores(spark):
    x = np.random.default_rng(0).standard_normal((1500, 16)) * np.linspace(0.5, 2, 1500)[:, None]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(frame(spark, rows), every=20, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, 20, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    found = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert found >= 0.9 * 10 * len(want)
    assert all(abs(s - dict((i, s) for s, i in want[q]).get(i, s)) < 1e-9 for q in got for s, i in got[q])


def test_copies_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(i, [0.0, 1.0, 0.0]) for i in range(60, 63)] + [(80, None), (100, [0.0, 0.0, 0.0]), (120, [float("nan"), 1.0, 0.0]), (140, [None, 1.0, 0.0]), (160, [1.0, 2.0]), (0, [1.0, 0.0, 0.0])]
    got = {}
    for r in ann.nearest(frame(spark, rows), every=20, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 40: [0, 1, 2, 3, 4], 60: [61, 62, 0, 1, 2]}


def test_few_and_no_rows(spark):
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(frame(spark, [(0, [1.0, 1.0]), (1, [1.0, 0.5])])).collect()] == [(0, 1, 1)]
    assert ann.nearest(frame(spark, [])).collect() == []


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    x = np.random.default_rng(1).standard_normal((400, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, 20, 5)
    got = ann.nearest(frame(spark, rows), every=20, k=5).collect()
    assert len(got) == 5 * len(want) and sum((r.vec_id in {i for _, i in want[r.query_id]}) for r in got) >= 0.9 * len(got)


def test_vectors_of_another_length_are_searched_by_themselves(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(2).tolist()) for i in range(59)] + [(100 + 20 * i, rng.standard_normal(3).tolist()) for i in range(2)]
    got = {}
    for r in ann.nearest(frame(spark, rows), every=20, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(v) for q, v in got.items()} == {0: 5, 20: 5, 40: 5, 100: 1, 120: 1} and got[100] == [120]


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(6) * 1e-3 + 1).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: np.array(v) for i, v in rows}
    got = ann.nearest(df, every=20, k=5).collect()
    assert len(got) == 50 and all(r.score == float((x[r.query_id] * x[r.vec_id]).sum()) for r in got)


def ascent(strings, asked, least):
    """Synchronous ascent of one query, bit by bit over sorted arrays: (level, candidates)."""
    from bisect import bisect_left

    arrays = [sorted((int(c[t]), i) for i, c in strings.items()) for t in range(ann.TREES)]
    shared = lambda a, b: ann.BITS - (int(a) ^ int(b)).bit_length()
    depth = []
    for t, array in enumerate(arrays):
        at = bisect_left(array, (int(asked[t]), -1))
        depth.append(max(shared(asked[t], c) for c, _ in array[max(0, at - 1) : at + 1]))
    level, found = max(depth), {}
    while True:
        n, found = 0, set()
        for t, array in enumerate(arrays):
            near = [i for c, i in array if shared(asked[t], c) >= level]
            n += len(near)
            found |= set(near)
        if n >= least or level == 0:
            return level, found
        level -= 1


def test_levels_and_answers_equal_the_ascent_over_sorted_arrays(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 4)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 5)) * rng.uniform(0.2, 2, (300, 1))
    x[:100] = x[0] + rng.standard_normal((100, 5)) * 1e-3  # a third of all in one dense place
    rows = ann.packed(frame(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]), "vec_id", "embedding")
    points = ann.cut(ann.classes(rows, 5))
    asked = points.where("rep % 20 = 0").select("rep", "dim", "v", "norm2")
    top = {5: points.agg({"norm2": "max"}).first()[0]}
    index, queries = ann.coded(points, top, False), ann.coded(asked, top, True)
    strings = {r.rep: r.codes for r in index.collect()}
    for depth in (0, 2, 5):
        counts = {r.rep: r for r in ann.totals(index, queries, depth).collect()}
        for q in queries.collect():
            for level in (0, 1, 3, 7, 20, 32):
                want = sum((int(c[t]) ^ int(q.codes[t])).bit_length() <= ann.BITS - level for c in strings.values() for t in range(ann.TREES))
                assert counts[q.rep][f"n{level}"] == want
    least = ann.calibrated(points, index, queries, ann.totals(index, queries, 2), 5)
    levels = {r.rep: r.level for r in ann.totals(index, queries, 2).select("rep", ann.level_for(least).alias("level")).collect()}
    found = {}
    for r in ann.search_classes(points, asked, 5).collect():
        found.setdefault(r.query, []).append((-r.score, r.rep))
    vectors = {r.rep: np.frombuffer(bytes(r.v), np.float32).astype(float) for r in points.collect()}
    for q in queries.collect():
        level, candidates = ascent(strings, q.codes, least)
        assert levels[q.rep] == level
        want = sorted((-float((vectors[i] * vectors[q.rep]).sum()), i) for i in candidates)[:5]
        assert [i for _, i in sorted(found[q.rep])] == [i for _, i in want]


def test_bases_serve_every_level():
    for histogram in ({}, {0: 5}, {3: 100, 2: 1}, {0: 15, 3: 85}, {7: 90, 1: 10}, {5: 50, 0: 1}):
        bases = ann.bases_of(histogram)
        assert all(any(b <= x and (b > 0 or x == 0) for b in bases) for x in histogram)
