import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import QueryError
from ledgerloom.functions import text as X
from ledgerloom.operators import erase, evaluate, filters, ledger, lineage, retrieval, stats, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bad_requests_name_their_fault(spark):
    for call, code in (
        (lambda: filters.kind_is(("poem",)), "bad_kind"),
        (lambda: filters.eligible(provider="nobody"), "bad_provider"),
        (lambda: filters.day_bounds("2024-13-01"), "bad_date"),
        (lambda: filters.day_bounds(None, "yesterday"), "bad_date"),
        (lambda: erase.plan_match(None, "abc"), "match_too_short"),
    ):
        with pytest.raises(QueryError) as e:
            call()
        assert e.value.code == code


def test_session_prefix(spark):
    s = spark.createDataFrame([("ab1",), ("ab2",), ("c",)], "session_root string")
    assert filters.resolve_session(s, "c") == "c"
    with pytest.raises(QueryError, match="ambiguous_session"):
        filters.resolve_session(s, "ab")
    with pytest.raises(QueryError, match="unknown_session"):
        filters.resolve_session(s, "zz")
    assert filters.resolve_session(spark.createDataFrame([("ab",), ("ab2",)], "session_root string"), "ab") == "ab"


def test_query_parsing():
    q = retrieval.parse('the "Hook Core" a.b/c hook_core x thing')
    assert q.words == ("hook_core", "thing") and ("hook", "core") in q.phrases and ("a", "b", "c") in q.phrases
    assert not retrieval.parse("the of").elements


def test_compose_equals_a_sequential_fold(spark):
    data = [(i, f"s{i % 3}", f"t{i % 4}" if i % 2 else "same", i) for i in range(1, 40)]
    got = rows(retrieval.compose(spark.createDataFrame(data, "id long, session_root string, text string, rank int"), 2).select("id", "repeats"))
    entries, per = {}, {}
    for i, s, t, _ in data:
        if (s, t) in entries:
            entries[s, t][1] += 1
        elif per.get(s, 0) < 2:
            per[s] = per.get(s, 0) + 1
            entries[s, t] = [i, 0]
    assert got == sorted((i, r) for i, r in entries.values())


def test_caps_only_shrink_and_pages_are_disjoint(spark):
    data = [(i, f"s{i % 5}", f"x{i}", i) for i in range(60)]
    df = spark.createDataFrame(data, "id long, session_root string, text string, rank int")
    few, more = ({r[0] for r in rows(retrieval.compose(df, n).select("id"))} for n in (1, 3))
    assert few < more


def test_redaction_unites_spans_before_replacing():
    assert X.redact_text("password=token=abc123 x") == "password=[redacted:secret] x"
    assert X.redact_text("nothing here") == "nothing here"
    assert X.redact_text("go to https://me:pw@host/") == "go to https://[redacted:secret]@host/"


def test_finish_cuts_bytes_and_sets_flags(spark):
    df = spark.createDataFrame([("ééé",), ("secret: abcdefgh",), (None,)], "t string")
    got = [tuple(r) for r in df.select(X.finish("t", F.lit(5)).alias("f")).select("f.text", "f.flags").collect()]
    assert got[0] == ("éé", 4) and got[1][1] == 6 and got[2] == (None, 0)


def test_text_pages_join_to_the_text(spark):
    text, at, out = "añb😀c" * 30, 0, ""
    while at is not None:
        page, at = spark.createDataFrame([(text,)], "t string").select(X.text_page("t", F.lit(at), F.lit(17)).alias("p")).select("p.*").first()
        out += page
    assert out == text


def test_walk_ends_in_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, next string")
    start = spark.createDataFrame([("a", "a")], "root string, node string")
    assert rows(lineage.walk(start, edges)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]


def test_unknown_values_stay_unknown(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", 2)], "k string, v int")
    assert rows(df.groupBy("k").agg(stats.known_sum(F.col("v")))) == [("x", None), ("y", 2)]
    empty = spark.createDataFrame([], "state string, created_at double")
    assert tuple(stats.ages(empty, 5.0).first()) == (None, None)


def test_intervals():
    assert evaluate.clopper_pearson(0, 0) == (0.0, 1.0)
    low, high = evaluate.clopper_pearson(5, 10)
    assert math.isclose(low, 0.1870860, abs_tol=1e-6) and math.isclose(high, 0.8129140, abs_tol=1e-6)


def test_window_split_keeps_lines_and_limits(spark):
    data = [(1, i, 100 * (1 + i % 4), i % 5 == 1) for i in range(1, 60)]
    out = windows.split_windows(spark.createDataFrame(data, "source_id long, line long, bytes long, is_prompt boolean"), 900, 10).orderBy("window").collect()
    assert [r.from_line for r in out] == [1, *(r.through_line + 1 for r in out[:-1])] and out[-1].through_line == 59
    assert all(r.lines <= 10 and (r.bytes <= 900 or r.lines == 1) for r in out)


def test_transitions_are_idempotent(spark):
    k = spark.createDataFrame([("K1", 1, "active"), ("K2", 2, "active")], "knowledge_id string, current_revision long, state string")
    u = spark.createDataFrame([("U1", "open", "K1", 1, "K9", 1)], "unresolved_id string, state string, k1 string, r1 long, k2 string, r2 long")
    once = ledger.withheld(k, u)
    assert rows(once) == [("K1", 1, "withheld"), ("K2", 2, "active")] == rows(ledger.withheld(once, u))


def test_erased_text_is_not_found(spark):
    event = spark.createDataFrame([(1, "keep this"), (2, "drop secretword")], "id long, text string")
    gone = erase.plan_match(event, "secretword")
    left = erase.remaining(event, gone)
    assert rows(left.select("id")) == [(1,)] and erase.plan_match(left, "secretword").count() == 0


def test_tokens_lose_diacritics_of_any_letter(spark):
    import unicodedata

    texts = ["Čeština ŐSZI žluťoučký Ǟ ǆ ł", unicodedata.normalize("NFD", "Čeština Őszi é"), "ÅNGSTRÖM naïve"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.tokens(F.col("t")).alias("t")).collect()]
    assert got == [["cestina", "oszi", "zlutoucky", "a", "ǆ", "ł"], ["cestina", "oszi", "e"], ["angstrom", "naive"]]
    assert retrieval.parse("Čeština ŐSZI").elements == [("cestina",), ("oszi",)]


def test_support_closure_reads_its_edges_once(spark, monkeypatch):
    levels, made = [], lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df: levels.append(1) or made(df))
    start = spark.createDataFrame([("E:E_1",), ("E:E_1",), ("K:K_2@1",), ("U:U_4",), ("E:none",)], "node string")
    support = spark.createDataFrame([("E_1", "K_1", 1), ("E_1", "K_2", 1), ("E_2", "K_3", 1)], "evidence_id string, knowledge_id string, revision long")
    unresolved = spark.createDataFrame([("U_1", "K_1", 1, "K_3", 1), ("U_2", "K_1", 1, "K_2", 1), ("U_3", "K_3", 1, "K_3", 2), ("U_4", "K_1", 1, "K_1", 1)], "unresolved_id string, k1 string, r1 long, k2 string, r2 long")
    got = sorted(tuple(r) for r in lineage.support_closure(start, support, unresolved).collect())
    assert got == [("E:E_1", 0), ("E:none", 0), ("K:K_1@1", 1), ("K:K_2@1", 0), ("U:U_1", 2), ("U:U_2", 1), ("U:U_4", 0)]
    assert len(levels) == 2  # the start and the versions; nothing leads on from an unresolved item
