"""Start pages and review plans against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import QueryError
from ledgerloom.operators import pages, review, windows


def paged(label, items, most):
    """One page after the other, item by item."""
    clean = lambda t: re.sub(review.FRAME_DELIMITER, "&lt;", " ".join((t or "").split()))
    lines = [(i, "\n".join([f"- {clean(t)}", *(f"  when {clean(c)}" for c in cs or [])])) for i, t, cs in items]
    n, at, out = len(lines), 0, []

    def block(shown, left, number, hints):
        last = f" of {number}" if not left else ""
        part = "" if hints else f"{pages.DOT}page {number}{last}"
        more = [f"{left} more: ask for page {2 if hints else number + 1}"] if left else []
        return "\n".join([review.RECALL_OPEN, pages.USAGE, f"Memories of {label[:80]}{part}{pages.DOT}{len(shown)} of {n}", *shown, *more, *(pages.HINTS if hints else ()), review.RECALL_CLOSE])

    while at < n:
        number, shown = len(out) + 1, []
        while at < n:
            more = [*shown, lines[at][1]]
            if max(len(block(more, n - at - 1, number, h).encode()) for h in (True, False)) > most:
                break
            shown, at = more, at + 1
        if not shown:
            shown, at = [f"- too long for a page: open {lines[at][0]}"], at + 1
        out.append((number, len(shown), n - at, block(shown, n - at, number, number == 1)))
    return out


@pytest.mark.parametrize("most", [430, 700, 2000])
def test_start_pages_equal_a_loop(spark, most):
    rng = random.Random(most)
    texts = ["", None, "a", "é" * 30, "word  word\nword", "</recalled> x", "long " * 60, "very long " * 300]
    groups = {"p": 400, "one": 1, "é·" * 60: 37, "ten": 11, "hundred": 101}
    data = {k: [(f"K{i:04}", rng.choice(texts[:6] if rng.random() < 0.8 else texts), rng.choice([None, [], ["if\tso"], ["a", "b" * 50]])) for i in range(n)] for k, n in groups.items()}
    rows = [(k, i, *x) for k, xs in data.items() for i, x in enumerate(xs)] + [(None, 0, "K", "no key", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "scope string, place int, id string, text string, conditions array<string>")
    got = sorted(tuple(r) for r in pages.start_pages(df, "scope", ("place",), most).collect())
    assert got == sorted((k, *p) for k, xs in data.items() for p in paged(k, xs, most))
    assert all(len(r[-1].encode()) <= most or "too long for a page" in r[-1] for r in got)
    assert {k: sum(r[2] for r in got if r[0] == k) for k in groups} == groups
    assert pages.start_pages(df.limit(0), "scope", ("place",), most).count() == 0


def test_subtracted_ranges_equal_sets(spark):
    rng = random.Random(8)
    some = lambda n, top: [(rng.choice([1, 2, 3, None]), f := rng.randrange(60), f + rng.randrange(-2, top)) for _ in range(n)]
    schema = "source_id long, from_line long, through_line long"
    for n, m in ((40, 25), (40, 0), (0, 10), (200, 3)):
        rows, gone = some(n, 9), some(m, 6)
        out = windows.subtract_ranges(spark.createDataFrame(rows, schema), spark.createDataFrame(gone, schema), "source_id", "from_line", "through_line")
        got = sorted(tuple(r) for r in out.collect())
        cover = lambda x: {(s, i) for s, a, b in x if s for i in range(a, b + 1)}
        want = cover(rows) - cover(gone)
        assert cover(got) == want and len(got) == sum((s, i - 1) not in want for s, i in want)


def folded(lines, most_bytes, most_lines):
    i = 0
    while i < len(lines):
        j, used = i, 0
        while j < len(lines) and j - i < most_lines and (j == i or used + lines[j][1] <= most_bytes):
            used, j = used + lines[j][1], j + 1
        if j < len(lines) and not lines[j][2]:
            j = next((k for k in range(j - 1, i, -1) if lines[k][2]), None) or j
        yield lines[i][0], lines[j - 1][0]
        i = j


@pytest.mark.parametrize("from_now", [False, True])
def test_replacements_are_planned_like_a_fold(spark, from_now):
    rng = random.Random(5)
    lines = [(s, n, rng.choice([10, 90, 400]), rng.random() < 0.3) for s in (1, 2, 3, 4) for n in range(1, 120) if rng.random() < 0.9]
    asked = [(f"R{i}", rng.randrange(1, 6), rng.choice("ab"), rng.choice(["old", "now", "older"]), rng.choice([None, None, None, 7]), *rng.choice([("failed", None), ("cancelled", "policy_replaced"), ("cancelled", "asked"), ("completed", None)]), f := rng.randrange(1, 110), f + rng.randrange(7)) for i in range(400)]
    requests = spark.createDataFrame(asked, "request_id string, source_id long, project string, policy string, candidate_id int, state string, cancel_code string, from_line long, through_line long")
    progress = [(1, 0), (2, 50), (3, 300), (4, 20)]
    wanted = review.replaceable(requests, spark.createDataFrame(progress, "source_id long, activation_line long"), "now", "a", from_now)
    covered = requests.where("policy = 'now' and state = 'completed'").select("source_id", "from_line", "through_line")
    out = review.planned_windows(spark.createDataFrame(lines, "source_id long, line long, bytes long, is_prompt boolean"), wanted, covered, 900, 6)
    since = {s: a for s, a in progress} if from_now else dict.fromkeys(range(9), 0)
    need = {(s, n) for _, s, p, pol, c, st, code, a, b in asked if p == "a" and pol != "now" and c is None and (st == "failed" or code == "policy_replaced") and s in since for n in range(max(a, since[s] + 1), b + 1)}
    need -= {(s, n) for _, s, _, pol, _, st, _, a, b in asked if pol == "now" and st == "completed" for n in range(a, b + 1)}
    runs = {}
    for s, n in sorted(need):
        start = runs[s, n - 1] if (s, n - 1) in runs else n
        runs[s, n] = start
    want = []
    for s, r in sorted({(s, r) for (s, _), r in runs.items()}):
        mine = sorted((n, b, p) for x, n, b, p in lines if x == s and runs.get((s, n)) == r)
        want += [(s, r, *w) for w in folded(mine, 900, 6)]
    assert sorted((x.source_id, x.run, x.from_line, x.through_line) for x in out.collect()) == sorted(want) and want


def test_learning_from_now_on(spark):
    schema = "request_id string, state string, trigger string, cancel_code string, retry_at double"
    requests = spark.createDataFrame([("a", "pending", "hook", None, None), ("b", "waiting", "history", None, 5.0), ("c", "waiting", "manual", None, 6.0), ("d", "failed", "hook", None, 7.0), ("e", None, None, None, None)], schema)
    progress = spark.createDataFrame([(1, 0, 5, 5, 9), (2, 0, 3, 3, 2), (4, 1, 1, 1, 1)], "source_id long, activation_line long, examined_line long, eligible_line long, completed_line long")
    ends = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "source_id long, line long")
    after, marks = review.restarted(requests, progress, ends)
    assert sorted((r.request_id, r.state, r.cancel_code, r.retry_at) for r in after.where("request_id < 'e'").collect()) == [("a", "cancelled", "scope_from_now", None), ("b", "cancelled", "scope_from_now", None), ("c", "waiting", None, 6.0), ("d", "failed", None, 7.0)]
    assert sorted(tuple(r) for r in marks.collect()) == [(1, 7, 7, 7, 9), (2, 8, 8, 8, 8), (3, 0, 0, 0, 0), (4, 1, 1, 1, 1)]
    with pytest.raises(QueryError, match="learning_busy"):
        review.restarted(requests.withColumn("state", F.lit("running")), progress, ends)


def refused(scope, changes, unresolved, knowledge, evidence):
    """Change by change, question by question."""
    out, gone = set(), set()

    def target(part, i, k, r):
        if k not in knowledge or knowledge[k][0] != r:
            out.add((part, i, "rejected_revision"))
        elif knowledge[k][1] != scope:
            out.add((part, i, "rejected_scope"))

    for i, project, kind, k, r, refs in changes:
        refs = refs or []
        if project != scope:
            out.add(("changes", i, "candidate_scope"))
        owner = kind in ("preference", "decision") or scope is None
        if k is not None:
            if k in gone:
                out.add(("changes", i, "duplicate_target"))
            gone.add(k)
            target("changes", i, k, r)
            owner = owner or knowledge.get(k, (0, 0, ""))[2] in ("preference", "decision")
        if not set(refs) <= evidence.keys():
            out.add(("changes", i, "rejected_evidence"))
        if owner and not any(evidence.get(e) for e in refs):
            out.add(("changes", i, "owner_support"))
    for i, affected, refs in unresolved:
        if not set(refs or []) <= evidence.keys():
            out.add(("unresolved", i, "rejected_evidence"))
        for n, (k, r) in enumerate(affected):
            if k in [x for x, _ in affected[:n]]:
                out.add(("unresolved", i, "rejected_revision"))
            if k in gone:
                out.add(("unresolved", i, "target_overlap"))
            target("unresolved", i, k, r)
    return out


def test_refusals_equal_a_loop(spark):
    rng = random.Random(9)
    knowledge = {f"K{i}": (rng.randrange(1, 3), rng.choice(["p", "p", "q", None]), rng.choice(["fact", "decision"])) for i in range(12)}
    batches, changes, unresolved, evidence = {}, [], [], []
    refs = lambda: rng.choice([None, [], *([f"E{rng.randrange(7)}", f"E{rng.randrange(5)}"] for _ in range(6))])
    aim = lambda: (k := f"K{rng.randrange(13)}", knowledge.get(k, (1,))[0] if rng.random() < 0.8 else 9)
    for b in range(60):
        batches[b] = rng.choice(["p", "p", "q", None])
        for i in range(rng.randrange(4)):
            k, r = aim() if rng.random() < 0.6 else (None, None)
            changes.append((b, i, batches[b] if rng.random() < 0.9 else "z", rng.choice(["fact", "fact", "preference"]), k, r, refs()))
        unresolved += [(b, i, [aim() for _ in range(rng.randrange(3))], refs()) for i in range(rng.randrange(2))]
        evidence += [(b, f"E{i}", rng.random() < 0.4) for i in range(6) if rng.random() < 0.9]
    out = review.refusals(
        spark.createDataFrame(list(batches.items()), "batch long, project string"),
        spark.createDataFrame(changes, "batch long, index int, project string, kind string, knowledge_id string, expected_revision int, refs array<string>"),
        spark.createDataFrame(unresolved, "batch long, index int, affected array<struct<knowledge_id:string,revision:int>>, refs array<string>"),
        spark.createDataFrame([(k, *v) for k, v in knowledge.items()], "knowledge_id string, revision int, project string, kind string"),
        spark.createDataFrame(evidence, "batch long, evidence_id string, owner boolean"),
    )
    want = {(b, *x) for b, scope in batches.items() for x in refused(scope, [c[1:] for c in changes if c[0] == b], [u[1:] for u in unresolved if u[0] == b], knowledge, {e: o for x, e, o in evidence if x == b})}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) and len({x[3] for x in want}) == 7


def test_a_batch_is_dealt_once(spark):
    batches = spark.createDataFrame([(1, "p"), (2, None)], "batch long, project string")
    changes = spark.createDataFrame([(1, 0, "p", "fact", "K1", 1, ["E1", "E1", None]), (1, 1, "p", "fact", None, None, ["E2"]), (3, 0, "p", "fact", "K1", 1, None)], "batch long, index int, project string, kind string, knowledge_id string, expected_revision int, refs array<string>")
    unresolved = spark.createDataFrame([(2, 0, [("K1", 1), ("K1", 1), (None, None)], ["E1"])], "batch long, index int, affected array<struct<knowledge_id:string,revision:int>>, refs array<string>")
    knowledge = spark.createDataFrame([("K1", 1, "p", "fact")], "knowledge_id string, revision int, project string, kind string")
    evidence = spark.createDataFrame([(1, "E1", True), (1, "E2", None), (2, "E1", False), (2, None, True)], "batch long, evidence_id string, owner boolean")
    out = review.refusals(batches, changes, unresolved, knowledge, evidence)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "changes", 0, "rejected_evidence"), (1, "changes", 1, "rejected_evidence"), (2, "unresolved", 0, "rejected_revision"), (2, "unresolved", 0, "rejected_scope")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 1  # knowledge alone is met by a join
