"""Which fields of a record may be cited, as what, and which spans of them."""

import json

from test_sources import item, said

from ledgerloom.sources import records


def fields(spark, provider, *lines):
    df = spark.createDataFrame([("p", i + 1, json.dumps(x)) for i, x in enumerate(lines)], "path string, line long, json string")
    return records.evidence_fields(df, provider)


def plain(df):
    return sorted((r.line, r.part, r.pointer, r.text, r.evidence_type, r.role, r.status) for r in df.collect())


def test_codex_fields(spark):
    hidden = item(4, **said("assistant", "thought"))
    hidden["payload"]["channel"] = "analysis"
    got = plain(fields(
        spark, "codex", item(1, **said("user", "ask")), item(2, type="function_call", name="run", arguments='{"a": 1}', call_id="c"), item(3, type="custom_tool_call_output", call_id="c", output=[{"type": "output_text", "text": "out"}, {"type": "image"}]),
        hidden, item(5, **said("system", "no")), {"type": "event_msg", "payload": {"type": "message", "role": "user", "content": "no"}}, item(6, type="message", role="assistant", content="[plain text]"),
    ))
    assert got == [
        (1, 1, "/payload/content/0/text", "ask", "owner_statement", "user", None), (2, 1, "/payload/arguments", '{"a": 1}', "tool_request", "assistant", None),
        (3, 1, "/payload/output/0/text", "out", "tool_result", "user", None), (7, 1, "/payload/content", "[plain text]", "assistant_report", "assistant", None),
    ]


def test_claude_and_cursor_fields(spark):
    blocks = [{"type": "text", "text": "say"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_use", "name": "Read", "input": {"command": "no"}}]
    result = [{"type": "tool_result", "content": "boom", "is_error": True}, {"type": "tool_result", "content": [{"type": "text", "text": "fine"}]}]
    got = plain(fields(
        spark, "claude", {"type": "user", "message": {"role": "user", "content": "ask"}}, {"type": "assistant", "message": {"stop_reason": "tool_use", "content": blocks}}, {"type": "assistant", "message": {"content": blocks[:1]}},
        {"type": "user", "message": {"content": result}}, {"type": "user", "message": {"role": "assistant", "content": "no"}}, {"type": "assistant", "message": {"stop_reason": "max_tokens", "content": "cut"}}, {"type": "system"},
    ))
    assert got == [
        (1, 1, "/message/content", "ask", "owner_statement", "user", None), (2, 2, "/message/content/1/input/command", "ls", "tool_request", "assistant", None), (3, 1, "/message/content/0/text", "say", "assistant_report", "assistant", None),
        (4, 1, "/message/content/0/content", "boom", "tool_result", "user", "reported_error"), (4, 2, "/message/content/1/content/0/text", "fine", "tool_result", "user", None),
    ]
    assert plain(fields(spark, "cursor", {"type": 1, "text": "ask"}, {"type": 2, "text": "tell"}, {"type": 3, "text": "no"})) == [(1, 1, "/text", "ask", "owner_statement", "user", None), (2, 1, "/text", "tell", "assistant_report", "assistant", None)]


def test_selectors(spark):
    found = fields(spark, "cursor", {"type": 1, "text": "some words"}, {"type": 1, "text": "token=abcdef x"}, {"type": 1, "text": "a   b"})
    asked = [(1, 1, "/text", 5, 10), (2, 1, "/other", None, None), (3, 1, "/text", 5, 99), (4, 1, "/text", 5, 5), (5, 2, "/text", 0, 8), (6, 2, "/text", None, None), (7, 3, "/text", 1, 3), (8, 1, "/text", None, None)]
    df = spark.createDataFrame([(i, "p", line, 1, pointer, a, b) for i, line, pointer, a, b in asked], "id int, path string, line long, part int, pointer string, start int, end int")
    got = {r.id: (r.problem, r.excerpt) for r in records.selected_evidence(found, df).collect()}
    assert got == {1: (None, "words"), 2: ("forbidden_selector", None), 3: ("invalid_span", None), 4: ("invalid_span", None), 5: ("redacted_span", None), 6: (None, "token=[redacted:secret] x"), 7: ("empty_evidence", None), 8: (None, "some words")}


def test_what_does_not_fit_is_skipped_and_the_next_is_tried(spark):
    import random

    from ledgerloom.operators import review

    rng = random.Random(9)
    rows = [("a", 1, 1, 100), ("a", 2, 1, 2000), ("a", 3, 1, 100), ("b", 1, 1, None), ("b", 1, 2, 1500), (None, 1, 1, 5), ("d", 1, 1, 1501)]
    rows += [("c", k, p, rng.randrange(1, 600)) for k in range(300) for p in (1, 2)]
    want, used = set(), {}
    for key, line, part, size in rows:
        if key and size is not None and used.get(key, 0) + size <= 1500:
            used[key] = used.get(key, 0) + size
            want.add((key, line, part))
    df = spark.createDataFrame(rows, "k string, line long, part int, bytes long").repartition(5)
    got = review.select_evidence(df, "k", 1500).collect()
    assert len(got) == len(rows) and {(r.k, r.line, r.part) for r in got if r.taken} == want
    assert review.select_evidence(df.limit(0), "k", 1500).collect() == []


def test_changed_files_are_refused_window_by_window(spark, tmp_path):
    from pyspark.sql import functions as F
    from test_sources import put

    from ledgerloom.operators import review
    from ledgerloom.sources import lines

    for name in "abc":
        put(tmp_path / f"{name}.jsonl", *({"n": k, "pad": "x" * (500 if k == 1 else 5)} for k in range(4)))
    rows = lines.numbered(spark, str(tmp_path)).withColumn("window_id", F.substring(F.element_at(F.split("path", "/"), -1), 1, 1))
    records = rows.select("window_id", "line", F.lit(1).alias("part"), F.octet_length("raw").alias("bytes"), "path", "byte_offset", F.sha2("raw", 256).alias("line_sha256")).collect()
    records = spark.createDataFrame(records)
    windows = spark.createDataFrame([(r.window_id, r.line, "other" if r.window_id == "c" else r.line_sha256) for r in records.where("line = 4").collect()], "window_id string, boundary_line long, boundary_hash string")
    text = (tmp_path / "b.jsonl").read_text()
    (tmp_path / "b.jsonl").write_text(text.replace('"n": 2', '"n": 7'))
    kept, told = review.initial_evidence(records, windows, 100)
    assert {r.window_id: (r.bytes_used > 0, r.truncated, r.problem) for r in told.collect()} == {"a": (True, True, None), "b": (False, False, "evidence_changed"), "c": (False, False, "evidence_changed")}
    assert sorted((r.window_id, r.line) for r in kept.collect()) == [("a", 1), ("a", 3), ("a", 4)]
