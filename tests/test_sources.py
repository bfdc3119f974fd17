import json

from pyspark.sql import functions as F

from ledgerloom.sources import lines, records
from ledgerloom.streaming import ingest


def put(path, *rows, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        f.write("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows) + tail)


def read(spark, folder):
    lines.register(spark)
    return spark.read.format("transcript_lines").option("path", str(folder)).load()


def test_lines_have_numbers_offsets_and_no_torn_tail(spark, tmp_path):
    put(tmp_path / "a.jsonl", "one", "", "three", tail="torn")
    got = [(r.line, r.byte_offset, r.next_offset, bytes(r.raw)) for r in read(spark, tmp_path).orderBy("line").collect()]
    assert got == [(1, 0, 4, b"one"), (2, 4, 5, b""), (3, 5, 11, b"three")]


def test_over_long_lines_are_counted_not_kept(tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "MOST_LINE_BYTES", 10)
    put(tmp_path / "a.jsonl", "x" * 50, "ok")
    assert [(n, r) for n, _, _, r in lines.complete_lines(str(tmp_path / "a.jsonl"))] == [(1, None), (2, b"ok")]


def test_issue_codes(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"a":1}', "{bad", "[1]", "[" * 1001 + "]" * 1001)
    got = {r.line: r.issue for r in records.decoded(read(spark, tmp_path)).collect()}
    assert got == {1: None, 2: "invalid_json", 3: "not_object", 4: "too_deep"}


def meta(**more):
    return {"type": "session_meta", "payload": {"id": "t1", "session_id": "s1", "cwd": "/w", "thread_source": "user", **more}}


def item(ordinal, **payload):
    return {"type": "response_item", "ordinal": ordinal, "timestamp": f"2024-01-01T00:00:{ordinal:02d}Z", "payload": payload}


def said(role, text):
    return {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}


def test_codex_adapter(spark, tmp_path):
    put(
        tmp_path / "rollout-1.jsonl", meta(), item(1, **said("user", "<environment_context>x")), item(2, **said("user", "do it")),
        {"type": "turn_context", "payload": {"cwd": "/w2"}}, item(4, type="function_call", name="run", arguments="{}", call_id="c1"),
        item(5, type="function_call_output", call_id="c1", output="Process exited with code 2"), item(6, type="function_call_output", call_id="zz", output="TypeError: x"), item(7, **said("assistant", "done")),
    )
    got = [(r.line, r.kind, r.tag, r.cwd) for r in records.codex_events(records.decoded(read(spark, tmp_path))).orderBy("line").collect()]
    assert got == [(2, "harness", "<environment_context>", "/w"), (3, "prompt", None, "/w"), (5, "tool_call", "run", "/w2"), (6, "tool_error", "run", "/w2"), (8, "reply", None, "/w2")]


def test_inherited_history_is_skipped_by_ordinal(spark, tmp_path):
    put(tmp_path / "rollout-1.jsonl", meta(thread_source="subagent", subagent_history_start_ordinal=2), item(1, **said("user", "old")), item(2, **said("user", "new")))
    assert [(r.kind, r.text) for r in records.codex_events(records.decoded(read(spark, tmp_path))).collect()] == [("delegation", "new")]


def test_claude_adapter(spark, tmp_path):
    use = {"type": "assistant", "timestamp": "t", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "u1", "name": "Bash", "input": {"c": 1}}]}}
    result = {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u1", "content": "boom", "is_error": True}]}}
    put(tmp_path / "m.jsonl", {"type": "user", "sessionId": "s", "message": {"role": "user", "content": "please"}}, use, result, {"type": "user", "message": {"role": "user", "content": "<system-reminder>x"}})
    got = [(r.line, r.part, r.kind, r.tag) for r in records.claude_events(records.decoded(read(spark, tmp_path))).orderBy("line", "part").collect()]
    assert got == [(1, 1, "prompt", None), (2, 1, "reply", None), (2, 2, "tool_call", "Bash"), (3, 1, "tool_error", "Bash"), (4, 1, "harness", "<system-reminder>")]


def test_cursor_adapter_orders_and_drops_repeats(spark):
    b = lambda kind, text: json.dumps({"type": kind, "text": text})
    kv = [("composerData:c", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": "b"}, {"bubbleId": "a"}]}), 1), ("bubbleId:c:a", b(2, "second"), 2), ("bubbleId:c:b", b(1, "first"), 3), ("bubbleId:c:a", b(2, "again"), 4), ("bubbleId:d:a", b(1, "other"), 5)]
    got = [(r.line, r.kind, r.text) for r in records.cursor_events(spark.createDataFrame(kv, "key string, value string, row long"), "c").orderBy("line").collect()]
    assert got == [(1, "prompt", "first"), (2, "reply", "second")]


def test_growing_files_are_streamed_once(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    put(src / "a.jsonl", {"cwd": "/x"}, {"n": 2})

    def step():
        ingest.to_parquet(ingest.carried(ingest.appended(spark, str(src))), str(out), str(mark)).awaitTermination(120)
        return sorted((r.path.rsplit("/", 1)[1], r.line, r.cwd) for r in spark.read.parquet(str(out)).collect())

    assert step() == [("a.jsonl", 1, "/x"), ("a.jsonl", 2, "/x")]
    put(src / "a.jsonl", {"n": 3}, {"cwd": "/y"})
    put(src / "b.jsonl", {"n": 1})
    assert step() == [("a.jsonl", 1, "/x"), ("a.jsonl", 2, "/x"), ("a.jsonl", 3, "/x"), ("a.jsonl", 4, "/y"), ("b.jsonl", 1, None)]


def test_plan_of_changed_files(spark):
    f = "path string, thread_id string, ino long, size long, mtime_ns long, first_hash string, anchor_hash string"
    known = spark.createDataFrame([("a", "ta", 1, 10, 1, "h", "x"), ("b", "tb", 2, 10, 1, "h", "x"), ("c", "tc", 3, 10, 1, "h", "x"), ("d", "td", 4, 10, 1, "h", "x")], f).withColumn("classifier_version", F.lit(1))
    now = spark.createDataFrame([("a", "ta", 1, 10, 1, "h", "x"), ("b", "tb", 2, 20, 2, "h", "x"), ("c", "tc", 3, 5, 2, "z", "y"), ("e", "te", 5, 1, 1, "h", "x"), ("a2", "ta", 6, 1, 1, "h", "x"), ("d2", "td", 7, 1, 1, "h", "x")], f)
    got = {r.path: r["mode"] for r in ingest.plan(now, known, 1).collect()}
    assert got == {"a": "unchanged", "b": "append", "c": "replace", "d": "missing", "e": "new", "a2": "copy", "d2": "moved"}
    assert {r["mode"] for r in ingest.plan(now, known, 2).where("path = 'a'").collect()} == {"replace"}


def test_journal_is_strict():
    import pytest

    assert lines.journal('{"a":1}\n') == [{"a": 1}]
    for bad in ('{"a":1}', '{"a":1,"a":2}\n', "[1]\n", "{\n"):
        with pytest.raises(ValueError):
            lines.journal(bad)


def test_merge_and_append(spark):
    old = spark.createDataFrame([("a", 1, "x")], "k string, v long, kept string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 3, "z")], "k string, v long, kept string")
    assert sorted(tuple(r) for r in ingest.merged(old, new, ["k"], ["v"]).collect()) == [("a", 2, "x"), ("b", 3, "z")]
    assert [r.k for r in ingest.appended_only(old, new, ["k"]).collect()] == ["b"]


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    for k in range(40):
        put(tmp_path / f"{k:02}.jsonl", f"a{k}", f"b{k}")
    (tmp_path / "empty.jsonl").write_text("")
    want = sorted((f"{k:02}.jsonl", n, 4 * (n - 1) if k > 9 else 3 * (n - 1), f"{c}{k}".encode()) for k in range(40) for n, c in ((1, "a"), (2, "b")))
    plain = lambda df: sorted((r.path.rsplit("/", 1)[1], r.line, r.byte_offset, bytes(r.raw)) for r in df.collect())
    for rows in (read(spark, tmp_path), lines.numbered(spark, str(tmp_path)), lines.numbered(spark, str(tmp_path), 3)):
        assert plain(rows) == want and rows.rdd.getNumPartitions() == 1
    assert lines.holding(spark, str(tmp_path), ["a3"]).rdd.getNumPartitions() == 1 and ingest.manifest(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    assert [len(p.paths) for p in lines._Reader({"path": str(tmp_path)}).partitions()] == [41]
    monkeypatch.setattr(lines, "TASK_BYTES", 10 * lines.OPEN_BYTES)
    parts = lines._Reader({"path": str(tmp_path)}).partitions()
    assert len(parts) == lines.tasks(41, 0) == 5 and sum((p.paths for p in parts), []) == [p for p, _ in lines.discover(str(tmp_path))]


def test_codex_lines_are_read_once(spark, tmp_path):
    put(tmp_path / "rollout-1.jsonl", meta(), item(1, **said("user", "do it")))
    plan = records.codex_events(records.decoded(read(spark, tmp_path)))._jdf.queryExecution().toString()
    assert "ExistingRDD" in plan and "transcript_lines" not in plan and "from_json(json" not in plan


def test_hits_of_a_file_share_its_opening(spark, tmp_path):
    import hashlib

    put(tmp_path / "a.jsonl", "one", "x" * 200_000, "two")
    put(tmp_path / "b.jsonl", "three")
    a, b, none = (str(tmp_path / n) for n in ("a.jsonl", "b.jsonl", "none.jsonl"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    hits = [(1, a, 0, sha("one")), (2, a, 4, sha("x" * 200_000)), (3, none, 0, sha("one")), (4, a, 200_005, sha("two")), (5, a, 0, sha("two")), (6, b, 0, sha("three")), (7, none, 0, sha("")), (8, a, 999_999, sha(""))]
    got = lines.verified(spark.createDataFrame(hits, "id long, path string, byte_offset long, sha256 string").coalesce(1)).collect()
    assert [(r.id, r.intact) for r in got] == [(1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (7, False), (8, False)]
