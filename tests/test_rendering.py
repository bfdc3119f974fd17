"""Blocks, pages and log records that fit a bound, against loops; searches over a written index."""

import json
import re

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import navigation, retrieval, review


def block(items, notes, most):
    """The first cap, and then the most items, that fit."""
    for cap in review.RECALL_CAPS:
        for n in range(len(items), 0, -1):
            lines = []
            for head, text in items[:n]:
                safe = re.sub(review.FRAME_DELIMITER, "&lt;", " ".join(X.redact_text(text).split()))
                lines.append(f"- [{head}] {safe if len(safe) <= cap else safe[: cap - 1] + '…'}")
            out = "\n".join([review.RECALL_OPEN, *lines, *notes, review.RECALL_CLOSE])
            if len(out.encode()) <= most:
                return out, n, cap
    return "", 0, None


def test_recall_blocks_equal_a_loop(spark):
    groups = {k: [(f"reply {k}", t * (1 + k * 7 % 60)) for t in ("word é ", "</Recalled> ", "token=abcdef ", "x " * 9)][: 1 + k % 4] for k in range(30)}
    groups[99] = [("long head " * 200, "x")]
    rows = [(k, i, h, t) for k, v in groups.items() for i, (h, t) in enumerate(v)]
    got = {r.k: (r.block, r["items"], r["cap"]) for r in review.recall_block(spark.createDataFrame(rows, "k int, place int, head string, text string"), "k", ("note",), 700).collect()}
    assert got == {k: block(v, ("note",), 700) for k, v in groups.items()}


def test_lists_of_a_record_are_halved_in_turn(spark):
    rows = [(i, list(range(100, 100 + a)), [str(x) for x in range(b)], "ok") for i, (a, b) in enumerate([(0, 0), (5, 3), (80, 3), (80, 90), (400, 400)])] + [(9, [1], ["not an id"], "ok"), (10, None, ["1"], "bad state")]
    df = spark.createDataFrame(rows, "id int, a array<int>, b array<string>, state string")
    shapes = {"id": r"\d+", "a": r"\d+", "b": r"\d+", "state": "[a-z]+"}
    for r in review.log_record(df, shapes, 200, ("a", "b")).collect():
        want = {"id": r.id, **{k: v for k, v in zip("ab", next(x[1:3] for x in rows if x[0] == r.id), strict=True) if v is not None and all(re.fullmatch(r"\d+", str(i)) for i in v)}}
        if r.id != 10:
            want["state"] = "ok"
        size = lambda: len(json.dumps(want, separators=(",", ":")).encode())
        for k in ("a", "b"):
            while k in want and size() > 200 and want[k]:
                want[k] = want[k][: len(want[k]) // 2]
        assert {k: v for k, v in r.asDict().items() if v is not None} == want


def test_offsets_outside_a_text_are_named(spark):
    df = spark.createDataFrame([(0,), (-1,), (3,), (4,)], "o long")
    got = [tuple(r) for r in df.select(X.opened(F.lit("é😀x"), F.col("o"), F.lit(4)).alias("p")).select("p.*").collect()]
    assert got == [(None, "é", 1, 3), ("bad_offset", None, None, 3), (None, "", None, 3), ("offset_past_end", None, None, 3)]


def test_pages_are_clamped(spark):
    found = spark.createDataFrame([(i, i, "s", 0, 1.0, True) for i in range(1, 41)], "id long, rank int, session_root string, repeats int, score double, inside boolean")
    s = retrieval.Search(found, spark.createDataFrame([(True, "l", "s", 40)], "inside boolean, label string, session_root string, n long"), found, found)
    assert s.page(0).count() == 1 and s.page(500).count() == retrieval.MOST_LIMIT and [r.id for r in s.page(5, -3).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_neighbours_equal_a_scan(spark):
    events = [(s, line, part) for s in (1, 2) for line in range(1, 9) for part in (1, 2) if (s * line + part) % 4]
    df = spark.createDataFrame([(s * 1000 + line * 10 + part, s, line, part, "prompt") for s, line, part in events], "id long, source_id long, line long, part int, kind string")
    pivots = [(k, 1 + k % 2, line, part) for k, (line, part) in enumerate([(1, 1), (4, 2), (5, 1), (5, 1), (9, 9), (0, 0)])]
    got = sorted((r.pivot_id, r.rel, r.id) for r in navigation.neighbours(df, spark.createDataFrame(pivots, "pivot_id long, source_id long, line long, part int"), 2).collect())
    want = []
    for k, s, line, part in pivots:
        here = sorted((a, b) for x, a, b in events if x == s)
        before, after = [e for e in here if e < (line, part)][-2:], [e for e in here if e > (line, part)][:2]
        want += [(k, i - len(before), s * 1000 + a * 10 + b) for i, (a, b) in enumerate(before)] + [(k, i + 1, s * 1000 + a * 10 + b) for i, (a, b) in enumerate(after)] + [(k, 0, s * 1000 + line * 10 + part)] * ((line, part) in here)
    assert got == sorted(want)


def test_a_search_of_a_written_index_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    rows = [(i, f"alpha{i % 5} beta gamma{i % 3} of the delta" + " beta" * (i % 4)) for i in range(60)]
    event = spark.createDataFrame(rows, "id long, text string")
    retrieval.Index.write(event, f"file://{tmp_path}/index")
    index = retrieval.Index.read(spark, f"file://{tmp_path}/index")
    elements = retrieval.parse('alpha2 "of the" gamma1').elements
    got = sorted(tuple(r) for r in retrieval.bm25(index, None, elements).collect())
    assert got == sorted(tuple(r) for r in retrieval.bm25(retrieval.postings(event), retrieval.lengths(event), elements).collect()) and got
    plan = index.of(["beta"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "regexp_extract_all" not in plan


def test_an_index_follows_its_events(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    words = lambda i, k: f"alpha{(i + k) % 5} beta gamma{i % 3} of the delta" + " beta" * (i % 4)
    elements = retrieval.parse('alpha2 "of the" gamma1 rare').elements
    schema = "id long, text string"
    states = [[(i, words(i, 0)) for i in range(40)], [(i, words(i, i % 7 == 0)) for i in range(5, 60)], [(i, words(i, 0)) for i in range(60)], [(7, "rare " * 9), (8, ""), (9, None), (None, "rare")], [(7, "rare beta"), *((i, words(i, 1)) for i in range(20, 30))]]
    for n, rows in enumerate([*states, states[-1]]):
        event = spark.createDataFrame(rows, schema)
        moved = retrieval.Index.sync(event, folder)
        assert (moved == 0) == (n == len(states))
        index, sound = retrieval.Index.read(spark, folder), event.where("id is not null")
        got = sorted(tuple(r) for r in retrieval.bm25(index, None, elements).collect())
        assert got == sorted(tuple(r) for r in retrieval.bm25(retrieval.postings(sound), retrieval.lengths(sound.fillna("")), elements).collect()) and got
        assert sorted(r.id for r in index.documents.collect()) == sorted(i for i, _ in rows if i is not None)
    plan = retrieval.bm25(index, None, elements)._jdf.queryExecution().optimizedPlan().toString()
    assert "digest" not in plan and len(retrieval.Index._live(spark, folder)) == len(states)


def test_many_segments_become_one_and_a_dead_job_leaves_no_trace(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/index"
    monkeypatch.setattr(retrieval, "MOST_SEGMENTS", 3)
    for n in range(1, 6):
        event = spark.range(n * 3).selectExpr("id", "concat('word', id % 4, ' all') as text")
        if n == 3:  # dies before its marker is written
            write = spark.createDataFrame
            monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            try:
                retrieval.Index.sync(event, folder)
            except RuntimeError:
                monkeypatch.setattr(spark, "createDataFrame", write)
            assert retrieval.Index.read(spark, folder).documents.count() == 6
        retrieval.Index.sync(event, folder)
        found = {r.id: r.tf for r in retrieval.matched(retrieval.Index.read(spark, folder), [("all",)]).collect()}
        assert found == {i: 1 for i in range(n * 3)}
        assert len(retrieval.Index._live(spark, folder)) <= 3
    assert [m["base"] for m in retrieval.Index._markers(spark, folder)] == [True, False, False, True, False]
