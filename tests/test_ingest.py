"""Passes over growing, moved and rewritten transcripts, against one pass over everything."""

import json
import os

import pytest
from test_sources import item, meta, put, said

from ledgerloom.sources import lines, records
from ledgerloom.streaming import ingest

COLUMNS = ("thread_id", "line", "part", "kind", "tag", "cwd", "call_id", "parent_line", "parent_part", "text")


def events(store):
    return sorted(tuple(r) for r in store.events().select(*COLUMNS).fillna("-").fillna(-1).collect())


def modes(store, folder, **more):
    return {r.path.rsplit("/", 1)[1]: r["mode"] for r in ingest.run_pass(store, str(folder), **more).collect()}


LINES = [
    meta(), item(1, **said("user", "do it")), item(2, type="function_call", name="run", arguments="{}", call_id="c1"), {"type": "turn_context", "payload": {"cwd": "/w2"}},
    item(4, **said("assistant", "token=abcdef later")), item(5, type="function_call_output", call_id="c1", output="Process exited with code 2"), item(6, type="function_call", name="look", arguments="{}", call_id="c2"),
    item(7, type="function_call_output", call_id="c2", output="fine"), item(8, type="function_call_output", call_id="c2", output="TypeError: x"),
]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    put(at / "in" / "rollout-1.jsonl", *LINES)
    store = ingest.Store(spark, str(at / "store"))
    assert modes(store, at / "in") == {"rollout-1.jsonl": "new"}
    return events(store)


def test_events_are_linked_and_redacted(whole):
    assert [(r[1], r[3], r[5], r[7]) for r in whole] == [(2, "prompt", "/w", -1), (3, "tool_call", "/w", -1), (5, "reply", "/w2", -1), (6, "tool_error", "/w2", 3), (7, "tool_call", "/w2", -1), (9, "tool_error", "/w2", 7)]
    assert "abcdef" not in whole[2][-1] and len({r[:3] for r in whole}) == len(whole)


def test_passes_add_up_to_one(spark, tmp_path, whole):
    store, at = ingest.Store(spark, str(tmp_path / "store")), 0
    for k, stop in enumerate([3, 5, len(LINES)]):
        put(tmp_path / "in" / "rollout-1.jsonl", *LINES[at:stop])
        at = stop
        assert modes(store, tmp_path / "in") == {"rollout-1.jsonl": "append" if k else "new"}
    assert events(store) == whole and modes(store, tmp_path / "in") == {"rollout-1.jsonl": "unchanged"} and events(store) == whole
    os.rename(tmp_path / "in" / "rollout-1.jsonl", tmp_path / "in" / "rollout-2.jsonl")
    assert modes(store, tmp_path / "in") == {"rollout-1.jsonl": "missing", "rollout-2.jsonl": "moved"} and events(store) == whole
    assert modes(store, tmp_path / "in", version=2) == {"rollout-2.jsonl": "replace"} and events(store) == whole
    (tmp_path / "in" / "rollout-2.jsonl").write_text("")
    put(tmp_path / "in" / "rollout-2.jsonl", LINES[0], LINES[1])
    assert modes(store, tmp_path / "in", version=2) == {"rollout-2.jsonl": "replace"} and len(events(store)) == 1


def test_a_pass_without_its_marker_does_not_count(spark, tmp_path, whole, monkeypatch):
    put(tmp_path / "in" / "rollout-1.jsonl", *LINES[:3])
    store = ingest.Store(spark, str(tmp_path / "store"))
    modes(store, tmp_path / "in")
    first = events(store)
    put(tmp_path / "in" / "rollout-1.jsonl", *LINES[3:])
    modes(store, tmp_path / "in")
    os.remove(tmp_path / "store" / "commits" / "2")  # as if the pass had died before its marker
    assert events(store) == first
    assert modes(store, tmp_path / "in") == {"rollout-1.jsonl": "append"} and events(store) == whole


def test_forks_lose_what_they_repeat_whatever_the_order(spark, tmp_path):
    fork = [meta(id="t2", forked_from_id="t1"), *LINES[1:2], LINES[4], item(9, **said("user", "new turn")), LINES[1]]
    put(tmp_path / "in" / "rollout-0.jsonl", *fork)  # listed before its parent
    put(tmp_path / "in" / "rollout-1.jsonl", *LINES[:5])
    store = ingest.Store(spark, str(tmp_path / "store"))
    modes(store, tmp_path / "in")
    assert [(r[1], r[-1]) for r in events(store) if r[0] == "t2"] == [(4, "new turn"), (5, "do it")]
    put(tmp_path / "in" / "rollout-0.jsonl", LINES[4])
    modes(store, tmp_path / "in")
    assert [r[1] for r in events(store) if r[0] == "t2"] == [4, 5, 6]  # the prefix was closed


def test_a_fork_is_read_again_once_its_parent_is_there(spark, tmp_path):
    put(tmp_path / "in" / "rollout-0.jsonl", meta(id="t2", forked_from_id="t1"), LINES[1], item(9, **said("user", "new turn")))
    store = ingest.Store(spark, str(tmp_path / "store"))
    modes(store, tmp_path / "in")
    assert [r[1] for r in events(store)] == [2, 3]
    put(tmp_path / "in" / "rollout-1.jsonl", *LINES[:5])
    assert modes(store, tmp_path / "in") == {"rollout-0.jsonl": "replace", "rollout-1.jsonl": "new"}
    assert [r[1] for r in events(store) if r[0] == "t2"] == [3]
    assert set(modes(store, tmp_path / "in").values()) == {"unchanged"}


def test_claude_results_find_their_calls_in_an_earlier_pass(spark, tmp_path):
    use = {"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "u1", "name": "Bash", "input": {"c": 1}}]}}
    result = {"type": "user", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u1", "content": "boom", "is_error": True}]}}
    put(tmp_path / "in" / "m.jsonl", {"type": "user", "sessionId": "s", "message": {"role": "user", "content": "please"}}, use)
    store = ingest.Store(spark, str(tmp_path / "store"))
    modes(store, tmp_path / "in", provider="claude")
    put(tmp_path / "in" / "m.jsonl", result)
    modes(store, tmp_path / "in", provider="claude")
    assert [(r[1], r[3], r[4], r[7], r[8]) for r in events(store)] == [(1, "prompt", "-", -1, -1), (2, "tool_call", "Bash", -1, -1), (3, "tool_error", "Bash", 2, 1)]


def test_links_and_pipes_are_not_read(tmp_path):
    put(tmp_path / "out" / "rollout-9.jsonl", "x")
    put(tmp_path / "in" / "rollout-1.jsonl", "x")
    put(tmp_path / "in" / "other.jsonl", "x")
    os.symlink(tmp_path / "out" / "rollout-9.jsonl", tmp_path / "in" / "rollout-2.jsonl")
    os.symlink(tmp_path / "out", tmp_path / "in" / "sub")
    os.mkfifo(tmp_path / "in" / "rollout-3.jsonl")
    got = lines.discover_roots({"codex-sessions": str(tmp_path / "in"), "claude-projects": str(tmp_path / "out")})
    assert [(name, path.rsplit("/", 1)[1]) for name, path, _ in got] == [("codex-sessions", "rollout-1.jsonl"), ("claude-projects", "rollout-9.jsonl")]
    with pytest.raises(ValueError):
        lines.discover_roots({"elsewhere": "/"})


def test_long_files_are_read_in_ranges(spark, tmp_path):
    put(tmp_path / "a.jsonl", *[f"line {i} " + "x" * (i % 37) for i in range(500)], tail="torn")
    put(tmp_path / "b.jsonl", "one", "", "three")
    put(tmp_path / "c.jsonl")
    want = sorted((os.path.basename(p), *row) for p in map(str, tmp_path.glob("*.jsonl")) for row in lines.complete_lines(p))
    for size in (7, 100, 1 << 20):
        got = sorted((r.path.rsplit("/", 1)[1], r.line, r.byte_offset, r.next_offset, bytes(r.raw)) for r in lines.numbered(spark, str(tmp_path), size).collect())
        assert got == want


def test_a_line_that_arrives_in_parts_is_streamed_once_and_whole(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    text = json.dumps({"cwd": "/x", "n": "é" * 50}) + "\n"
    src.mkdir()
    for cut in (text.encode()[:31], text.encode()[31:] + b"{}\n{", b"}\n"):
        with open(src / "a.jsonl", "ab") as f:
            f.write(cut)
        ingest.to_parquet(ingest.carried(ingest.appended(spark, str(src))), str(out), str(mark)).awaitTermination(120)
    got = sorted((r.line, r.cwd, r.raw) for r in spark.read.parquet(str(out)).collect())
    assert got == [(1, "/x", text[:-1]), (2, "/x", "{}"), (3, "/x", "{}")]


def test_open_lines_are_those_that_later_ones_may_need(spark, tmp_path):
    put(tmp_path / "rollout-1.jsonl", *LINES[:7])
    lines.register(spark)
    rows = records.decoded(spark.read.format("transcript_lines").option("path", str(tmp_path)).load())
    assert sorted(r.line for r in records.open_lines(rows, "codex").collect()) == [1, 4, 7]


def running(ordinal, call_id, cell):
    return item(ordinal, type="function_call_output", call_id=call_id, output=f"Script running with cell ID {cell}\nso far")


def wait(ordinal, call_id, cell):
    return item(ordinal, type="function_call", name="wait", arguments=json.dumps({"cell_id": cell}), call_id=call_id)


CELLS = [
    meta(), item(1, type="custom_tool_call", name="exec", input="build it", call_id="x1"), running(2, "x1", "7"), item(3, type="custom_tool_call", name="exec", input="other", call_id="x2"), running(4, "x2", "8"),
    wait(5, "w1", "7"), running(6, "w1", "9"), wait(7, "w2", "9"), wait(8, "w3", "8"), running(9, "w2", "9"), wait(10, "w4", "9"), item(11, type="function_call_output", call_id="w4", output="Process exited with code 3"),
    item(12, type="function_call_output", call_id="w3", output="fine"), wait(13, "w5", "9"), item(14, type="function_call_output", call_id="w5", output="Process exited with code 4"), wait(15, "w6", "none"), item(16, type="function_call_output", call_id="w6", output="Process exited with code 5"),
]


def test_an_exec_cells_output_belongs_to_its_call_over_all_passes(spark, tmp_path):
    want = [(2, "tool_call", "exec", "x1", -1), (4, "tool_call", "exec", "x2", -1), (12, "tool_error", "exec", "x1", 2)]  # a cell is handed on once, so w5 has none
    store, at = ingest.Store(spark, str(tmp_path / "store")), 0
    for stop in (3, 7, 10, len(CELLS)):  # the failing output comes three passes after its call
        put(tmp_path / "in" / "rollout-1.jsonl", *CELLS[at:stop])
        at = stop
        modes(store, tmp_path / "in")
    got = [(r.line, r.kind, r.tag, r.call_id, r.parent_line if r.parent_line is not None else -1) for r in store.events().orderBy("line").collect()]
    assert got == want
    assert {r.line for r in store.open_lines().collect()} == {1}  # nothing runs any more
    whole = ingest.Store(spark, str(tmp_path / "whole"))
    modes(whole, tmp_path / "in")
    assert events(whole) == events(store)


def test_a_pass_computes_each_step_of_its_lines_once(spark, tmp_path, monkeypatch):
    put(tmp_path / "in" / "rollout-1.jsonl", *LINES)
    hashed, parsed, made = [], [], ingest.X.record_hash
    monkeypatch.setattr(ingest.X, "record_hash", lambda line: hashed.append(1) or made(line))
    of = records.F.from_json
    monkeypatch.setattr(records.F, "from_json", lambda c, schema, *more: parsed.append(schema) or of(c, schema, *more))
    assert modes(ingest.Store(spark, str(tmp_path / "store")), tmp_path / "in") == {"rollout-1.jsonl": "new"}
    assert len(hashed) == 1 and parsed.count(records.CODEX) == 1
    rows = records.decoded(lines.numbered(spark, str(tmp_path / "in")))
    plan = records.codex_events(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # what runs along a file is not computed again for messages, calls and outputs
