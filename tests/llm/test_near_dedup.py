import re

import numpy as np
import pytest
from frames import docs, odd_rows, prose, rows

from ledgerloom.llm import graph, near_dedup


def brute(source):
    sets = {}
    for key, text in source:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    keys = sorted(k for k in sets if k is not None)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted(((k, len(sets[k]), root(k) if k is not None else None, k is None or root(k) == k) for k, _ in source), key=repr)


def family(seed, copies, edits):
    base = prose(120, seed).split()
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(copies):
        w = list(base)
        for at in rng.integers(0, len(w), edits):
            w[at] = f"edit{rng.integers(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [400_000, 2_000])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "HUBS", 3)
    source = odd_rows() + [(1000 * f + i, t) for f, edits in ((1, 0), (2, 1), (3, 2), (4, 4)) for i, t in enumerate(family(f, 12, edits))] + [(9000, "ONE Two")]
    assert rows(near_dedup.near_groups(docs(spark, source))) == brute(source)


def test_empty_table(spark):
    assert rows(near_dedup.near_groups(docs(spark, []))) == []


def test_sketches_merge_and_estimate():
    shingle = near_dedup.Shingler()
    a, b = shingle(prose(400, 1)), shingle(prose(380, 1) + " " + prose(20, 2))
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (near_dedup.registers(np.union1d(a, b)) == np.maximum(ra, rb)).all()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    n = np.array([float(len(a))]), np.array([float(len(b))])
    assert abs(near_dedup.estimate(ra[None], rb[None], *n)[0] - j) < 0.1
    assert near_dedup.may_reach(ra, rb[None], n[0], n[1], j - 0.15)[0] and not near_dedup.may_reach(ra, rb[None], n[0], n[1], min(0.999, j + 0.15))[0]


def test_components_of_chains_rings_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1), (7, 7), (None, 4)]
    got = dict(graph.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1, 3: 1, 7: 7}


def test_components_of_hubs_equal_union_find(spark, monkeypatch):
    import random

    from ledgerloom.llm import graph

    monkeypatch.setattr(graph, "LEAST_HUB", 5)
    monkeypatch.setattr(graph, "HUBS", 16)
    rng = random.Random(9)
    edges = [(rng.choice((7, 800)), k) for k in range(400)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(399, 1399)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}
