"""From raw transcript lines to events: decoding, issue codes, and one adapter per provider.

Adapters are joins, windows and exploded arrays; state that runs along a file (directory, class,
calls seen) is a window over (path, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text as X
from ledgerloom.shared import cut

MOST_DEPTH = 1000
BLOCKS = "array<struct<type:string,text:string,name:string,id:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
CODEX = (
    "timestamp string, type string, ordinal long, payload struct<type:string, role:string, content:string, name:string, arguments:string, input:string, call_id:string, output:string, cwd:string, "
    "id:string, session_id:string, thread_source:string, source:string, parent_thread_id:string, forked_from_id:string, subagent_history_start_ordinal:long, history_base:string>"
)
CLAUDE = "timestamp string, type string, sessionId string, isSidechain boolean, isMeta boolean, isCompactSummary boolean, cwd string, toolUseResult string, message struct<role:string, content:string>, attachment struct<type:string, prompt:string, origin:struct<kind:string>>"
# How texts that no person typed begin.
CODEX_HARNESS = ("<environment_context>", "# AGENTS.md instructions", "<user_instructions>", "<hook_prompt", "<subagent_notification>", "<turn_aborted>", "<recommended_plugins>", "<INSTRUCTIONS>", "<codex_internal_context", "<user_shell_command>", "<skill", "<task")
CLAUDE_HARNESS = ("<command-name>", "<command-message>", "<local-command-stdout>", "<local-command-caveat>", "<system-reminder>", "[Request interrupted", "Caveat:", "Base directory for this skill", "<task-notification>", "This session is being continued")
EVENT = ["path", "line", "part", "seq", "ts", "role", "kind", "tag", "cwd", "call_id", "text", "parent_line", "parent_part"]


@F.pandas_udf(T.IntegerType())
def _depth(raw):
    """Nesting depth of JSON text, brackets within strings left out."""
    import re

    import pandas as pd

    def one(t):
        d = most = 0
        for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", t or ""):
            d += (c in "[{") - (c in "]}")
            most = max(most, d)
        return most

    return pd.Series([one(t) for t in raw])


def decoded(lines: DataFrame) -> DataFrame:
    """path, line, json (null where there is an issue) and issue: line_too_large, too_deep, invalid_json, not_object."""
    text = F.col("raw").cast("string")
    brackets = F.length(F.regexp_replace(text, r"[^\[\{]", ""))
    deep = F.when(brackets > MOST_DEPTH, _depth(text) > MOST_DEPTH).otherwise(False)
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    issue = F.when(F.col("raw").isNull(), "line_too_large").when(deep, "too_deep").when(value.isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "not_object")
    return lines.withColumn("issue", issue).withColumn("json", F.when(F.col("issue").isNull(), text)).drop("raw")


def _along() -> Window:
    return Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)


def _text_of(content: Column) -> Column:
    """The text of a content field: a plain string, or its text blocks one per line."""
    blocks = F.from_json(content, BLOCKS)
    return F.when(F.ltrim(content).startswith("["), X.join_text(blocks)).otherwise(content)


def _opens(text: Column, openings: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("string")
    for o in reversed(openings):
        out = F.when(F.ltrim(text).startswith(o), o).otherwise(out)
    return out


def user_kind(tag: Column, thread_class: Column) -> Column:
    return F.when(tag.isNotNull(), "harness").when(thread_class == "subagent", "delegation").otherwise("prompt")


def codex_threads(rows: DataFrame) -> DataFrame:
    """One row per file from its first line: identity, class and reason, and how inherited history is told apart."""
    meta = rows.where("line = 1 and r.type = 'session_meta'").select("path", "r.payload.*")
    other = F.get_json_object("source", "$.subagent.other")
    kind = F.coalesce("thread_source", F.lit("missing"))
    cls = F.when(kind == "guardian_review", "reviewer").when(other == "guardian", "reviewer").when(kind.isin("user", "chatgpt_handoff"), "primary").when(kind == "subagent", "subagent").otherwise("other")
    reason = F.when((kind != "guardian_review") & (other == "guardian"), "subagent.other=guardian").otherwise(F.concat(F.lit("thread_source="), F.left(kind, F.lit(64))))
    mode = F.when(F.col("subagent_history_start_ordinal").isNotNull(), "ordinal").when(F.col("history_base").isNotNull(), "history_base").when(F.coalesce("forked_from_id", F.lit("")) != "", "content_prefix").otherwise("none")
    return meta.select("path", F.lit("codex").alias("provider"), F.col("id").alias("thread_id"), F.coalesce("session_id", "id").alias("session_root"), "parent_thread_id", "forked_from_id", cls.alias("thread_class"), reason.alias("class_reason"), mode.alias("replay_mode"), F.col("subagent_history_start_ordinal").alias("replay_before"))


def codex_parsed(lines: DataFrame) -> DataFrame:
    """(path, line, r) of rollout lines (path, line, json), read and parsed once."""
    return cut(lines.where("json is not null").select("path", "line", F.from_json("json", CODEX).alias("r")))


def codex_events(lines: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """EVENT columns of rollout lines (path, line, json), or of rows that codex_parsed gave. What runs along a file is computed once: messages, calls and outputs are filters of it."""
    rows = codex_parsed(lines) if rows is None else rows
    threads = codex_threads(rows).select("path", "thread_class", "replay_before")
    own = rows.join(threads, "path", "left")
    given = F.when(((F.col("r.type") == "session_meta") & (F.col("line") == 1)) | (F.col("r.type") == "turn_context"), F.nullif(F.col("r.payload.cwd"), F.lit("")))
    own = own.withColumn("cwd", F.last(given, ignorenulls=True).over(_along()))
    inherited = F.coalesce(F.coalesce("r.ordinal", F.col("line") - 1) < F.col("replay_before"), F.lit(False))
    items = cut(own.where((F.col("r.type") == "response_item") & ~inherited).select("path", "line", F.coalesce("r.ordinal", "line").alias("seq"), F.nullif("r.timestamp", F.lit("")).alias("ts"), "cwd", "thread_class", *(f"r.payload.{c}" for c in ("type", "role", "content", "name", "arguments", "input", "call_id", "output"))))
    text = F.regexp_replace(_text_of(F.col("content")), r"^\s*(?:<image\b[^>]*>\s*(?:</image>\s*)?)+", "")
    tag = F.when(F.col("role") == "user", _opens(text, CODEX_HARNESS))
    messages = items.where("type = 'message' and role in ('user', 'assistant')").select("path", "line", F.lit(1).alias("part"), "seq", "ts", "role", F.when(F.col("role") == "assistant", "reply").otherwise(user_kind(tag, F.col("thread_class"))).alias("kind"), tag.alias("tag"), "cwd", F.lit(None).cast("string").alias("call_id"), text.alias("text")).where("trim(text) != ''")
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown"))
    body = F.when(F.col("type") == "function_call", F.col("arguments")).otherwise(F.col("input"))
    owners = exec_owners(*codex_tools(rows))
    calls = items.where("type in ('function_call', 'custom_tool_call')").where(~name.isin(*WAIT_TOOLS)).select("path", "line", F.lit(1).alias("part"), "seq", "ts", F.lit("assistant").alias("role"), F.lit("tool_call").alias("kind"), name.alias("tag"), "cwd", "call_id", F.concat(name, F.lit(": "), F.coalesce(body, F.lit("null"))).alias("text"))
    outputs = items.where("type in ('function_call_output', 'custom_tool_call_output')").select("path", "line", F.lit(1).alias("part"), "seq", "ts", "cwd", "call_id", _text_of(F.col("output")).alias("text"))
    return messages.unionByName(calls).unionByName(tool_errors(calls, _with_owner(outputs.where(X.is_error_text(F.col("text"))), owners)), allowMissingColumns=True).select(*EVENT)


def tool_errors(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Failing outputs whose call came earlier in the same file, tagged with its tool and linked to it."""
    seen = calls.where("call_id is not null").groupBy("path", "call_id").agg(F.min(F.struct("line", "part", "tag")).alias("_call"))
    return outputs.join(seen, ["path", "call_id"]).where(F.col("_call.line") <= F.col("line")).select(
        "path", "line", "part", "seq", "ts", F.lit("user").alias("role"), F.lit("tool_error").alias("kind"), F.col("_call.tag").alias("tag"), "cwd", "call_id", "text",
        F.col("_call.line").alias("parent_line"), F.col("_call.part").alias("parent_part"),
    )


# Tools whose calls wait for others and are no events, and how an output tells that its exec cell goes on.
WAIT_TOOLS = ("wait", "wait_agent", "list_agents", "interrupt_agent", "sleep")
RUNNING = r"\AScript running with cell ID (\S+)"


def codex_tools(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, outputs) of rollout rows (path, line, r): path, line and call_id, with the name and the cell a call waits for, or the cell an output leaves running."""
    items = rows.where("r.type = 'response_item' and r.payload.call_id is not null").select("path", "line", *(f"r.payload.{c}" for c in ("type", "name", "arguments", "input", "call_id", "output")))
    body = F.when(F.col("type") == "function_call", F.col("arguments")).otherwise(F.col("input"))
    cell = F.when(F.col("name") == "wait", F.nullif(F.get_json_object(body, "$.cell_id"), F.lit("")))
    calls = items.where("type in ('function_call', 'custom_tool_call')").select("path", "line", "call_id", "name", cell.alias("cell"))
    running = F.nullif(F.regexp_extract(_text_of(F.col("output")), RUNNING, 1), F.lit(""))
    return calls, items.where("type in ('function_call_output', 'custom_tool_call_output')").select("path", "line", "call_id", running.alias("cell"))


def exec_owners(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """(path, call_id, owner) of waits for an exec cell: the call that started what they wait for.

    An output that leaves a cell running hands it to the next wait for that cell, whose output may do so again. So a wait
    points to the call of the output right before it along its cell; these pointers are followed by joins that
    double their reach. A wait that nothing hands its cell to has no owner.
    """
    along = cut(calls.where("cell is not null").select("path", "cell", "line", "call_id", F.lit(True).alias("waits")).unionByName(outputs.where("cell is not null").select("path", "cell", "line", "call_id", F.lit(False).alias("waits"))))
    if not along.take(1):  # most files wait for no cell
        return calls.sparkSession.createDataFrame([], "path string, call_id string, owner string")
    w = Window.partitionBy("path", "cell").orderBy("line", "waits", "call_id")
    handed = along.withColumn("_id", F.lag("call_id").over(w)).withColumn("_w", F.lag("waits").over(w)).where("waits and not _w").select("path", "call_id", F.col("_id").alias("owner"), "line")
    up = cut(handed.where("call_id != owner").groupBy("path", "call_id").agg(F.min_by("owner", "line").alias("owner")))
    names = calls.groupBy("path", "call_id").agg(F.min_by("name", "line").alias("name"))
    for _ in range(64):  # reach doubles: no file is longer
        above = up.select("path", F.col("call_id").alias("owner"), F.col("owner").alias("_up"))
        if not up.join(above, ["path", "owner"], "left_semi").take(1):
            break
        up = cut(up.join(above, ["path", "owner"], "left").where("_up is null or _up != call_id").select("path", "call_id", F.coalesce("_up", "owner").alias("owner")))
    started = names.where(~F.coalesce(F.col("name"), F.lit("")).isin(*WAIT_TOOLS)).select("path", F.col("call_id").alias("owner"))
    return up.join(started, ["path", "owner"], "left_semi").select("path", "call_id", "owner")


def _with_owner(outputs: DataFrame, owners: DataFrame) -> DataFrame:
    """Outputs of waits as outputs of the call that owns the cell."""
    told = outputs.join(owners, ["path", "call_id"], "left")
    return told.withColumn("call_id", F.coalesce("owner", "call_id")).select(*outputs.columns)


def open_chains(rows: DataFrame) -> DataFrame:
    """(path, line) of the calls and outputs of exec cells that later waits, or later outputs of waits, may belong to."""
    calls, outputs = (cut(df) for df in codex_tools(rows))
    if not calls.where("cell is not null").take(1) and not outputs.where("cell is not null").take(1):
        return rows.select("path", "line").limit(0)
    owners = cut(exec_owners(calls, outputs))
    of = lambda df: df.join(owners, ["path", "call_id"], "left").select("path", "line", "call_id", "cell", F.coalesce("owner", "call_id").alias("owner"))
    last = Window.partitionBy("path", "cell").orderBy(F.desc("line"))
    both = of(calls).withColumn("out", F.lit(False)).unionByName(of(outputs).withColumn("out", F.lit(True)))
    running = both.where("cell is not null").withColumn("_k", F.row_number().over(last)).where("_k = 1 and out").select("path", "owner")
    unanswered = of(calls.join(outputs.select("path", "call_id"), ["path", "call_id"], "left_anti")).join(owners.select("path", "call_id"), ["path", "call_id"], "left_semi").select("path", "owner")
    return both.join(running.unionByName(unanswered).distinct(), ["path", "owner"], "left_semi").select("path", "line").distinct()


def open_lines(lines: DataFrame, provider: str, parsed: DataFrame | None = None) -> DataFrame:
    """The lines (path, line, json) that lines still to come may refer to: the first, the last that tells a directory, calls without an output, and exec cells that still run.

    parsed: what codex_parsed gave for these lines, if it is at hand.
    """
    text = F.col("json")
    at = lambda path: F.get_json_object(text, path)
    if provider == "codex":
        kind = at("$.payload.type")
        called = F.array(F.when(kind.isin("function_call", "custom_tool_call"), at("$.payload.call_id")))
        answered = F.array(F.when(kind.isin("function_call_output", "custom_tool_call_output"), at("$.payload.call_id")))
        given = F.nullif(at("$.payload.cwd"), F.lit(""))
    else:
        blocks = F.coalesce(F.from_json(at("$.message.content"), BLOCKS), F.array().cast(BLOCKS))
        ids = lambda kind, name: F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: b[name])
        called, answered = ids("tool_use", "id"), ids("tool_result", "tool_use_id")
        given = F.lit(None).cast("string")
    lines = lines.where("json is not null")
    # read out of the JSON once; the branches below take their columns
    rows = cut(lines.select("path", "line", F.array_compact(called).alias("called"), F.array_compact(answered).alias("answered"), given.isNotNull().alias("given")))
    done = rows.select("path", F.explode("answered").alias("call_id")).distinct()
    waiting = rows.select("path", "line", F.explode("called").alias("call_id")).join(done, ["path", "call_id"], "left_anti").select("path", "line")
    last = rows.where("given").groupBy("path").agg(F.max("line").alias("line"))
    first = rows.where("line = 1").select("path", "line")
    keep = waiting.union(last).union(first)
    if provider == "codex":
        keep = keep.union(open_chains(codex_parsed(lines) if parsed is None else parsed))
    return lines.select("path", "line", "json").join(keep.distinct(), ["path", "line"], "left_semi")


def claude_threads(rows: DataFrame) -> DataFrame:
    """One row per file from its path and first record."""
    first = rows.groupBy("path").agg(F.min_by("r", "line").alias("r"))
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
    below = F.element_at(parts, -2) == "subagents"
    side = F.coalesce("r.isSidechain", F.lit(False))
    cls = F.when(below | side, "subagent").otherwise("primary")
    session = F.coalesce(F.nullif("r.sessionId", F.lit("")), F.when(below, F.try_element_at(parts, F.lit(-3))), stem)
    thread = F.when(cls == "subagent", stem).otherwise(session)
    return first.select("path", F.lit("claude").alias("provider"), thread.alias("thread_id"), session.alias("session_root"), F.when(session != thread, session).alias("parent_thread_id"), F.lit(None).cast("string").alias("forked_from_id"), cls.alias("thread_class"), F.when(below, "path:subagents").when(side, "isSidechain").otherwise("path:main").alias("class_reason"), F.lit("none").alias("replay_mode"), F.lit(None).cast("long").alias("replay_before"))


def claude_events(lines: DataFrame) -> DataFrame:
    """EVENT columns of transcript lines (path, line, json)."""
    rows = lines.where("json is not null").select("path", "line", F.from_json("json", CLAUDE).alias("r"))
    queued = (F.col("r.type") == "attachment") & (F.col("r.attachment.type") == "queued_command") & (F.col("r.attachment.origin.kind") == "human")
    said = F.col("r.type").isin("user", "assistant") & F.col("r.message").isNotNull() & F.coalesce(F.col("r.message.role") == F.col("r.type"), F.lit(True))
    content = F.when(queued, F.col("r.attachment.prompt")).otherwise(F.col("r.message.content"))
    own = rows.where(queued | said).select("path", "line", F.col("line").alias("seq"), F.nullif("r.timestamp", F.lit("")).alias("ts"), "r.cwd", F.when(queued, "user").otherwise(F.col("r.type")).alias("role"), content.alias("content"), F.from_json(content, BLOCKS).alias("blocks"), (F.coalesce("r.isCompactSummary", F.lit(False)) | F.coalesce("r.isMeta", F.lit(False))).alias("meta"), F.coalesce("r.isSidechain", F.lit(False)).alias("side"), F.col("r.toolUseResult").isNotNull().alias("result"))
    own = own.withColumn("result", F.col("result") | F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))).withColumn("text", _text_of(F.col("content")))
    tag = F.coalesce(_opens(F.col("text"), CLAUDE_HARNESS), F.when(F.col("meta"), "meta"))
    thread = F.when(F.col("side"), "subagent").otherwise("primary")
    none = F.lit(None).cast("string").alias("call_id")
    prompts = own.where("role = 'user' and not result and trim(text) != ''").select("path", "line", F.lit(1).alias("part"), "seq", "ts", "role", user_kind(tag, thread).alias("kind"), tag.alias("tag"), "cwd", none, "text")
    replies = own.where("role = 'assistant' and trim(text) != ''").select("path", "line", F.lit(1).alias("part"), "seq", "ts", "role", F.lit("reply").alias("kind"), F.lit(None).cast("string").alias("tag"), "cwd", none, "text")
    uses = F.filter("blocks", lambda b: b["type"] == "tool_use")
    spoken = F.when(F.coalesce(F.trim("text"), F.lit("")) != "", 2).otherwise(1)
    called = own.where("role = 'assistant'").select("*", spoken.alias("_first"), F.posexplode(uses).alias("_k", "b"))
    name = F.coalesce(F.nullif("b.name", F.lit("")), F.lit("unknown"))
    calls = called.select("path", "line", (F.col("_first") + F.col("_k")).alias("part"), "seq", "ts", "role", F.lit("tool_call").alias("kind"), name.alias("tag"), "cwd", F.col("b.id").alias("call_id"), F.concat(name, F.lit(": "), F.coalesce("b.input", F.lit("null"))).alias("text"))
    got = own.where("role = 'user' and result").select("path", "line", "seq", "ts", "cwd", F.posexplode(F.filter("blocks", lambda b: b["type"] == "tool_result")).alias("_k", "b"))
    outputs = got.select("path", "line", (F.col("_k") + 1).alias("part"), "seq", "ts", "cwd", F.col("b.tool_use_id").alias("call_id"), _text_of(F.col("b.content")).alias("text"), F.coalesce("b.is_error", F.lit(False)).alias("bad"))
    failed = outputs.where(F.col("bad") | X.is_error_text(F.col("text"))).drop("bad")
    return prompts.unionByName(replies).unionByName(calls).unionByName(tool_errors(calls, failed), allowMissingColumns=True).select(*EVENT)


def cursor_events(pairs: DataFrame, conversation: str) -> DataFrame:
    """EVENT columns of one conversation from a key/value table (key, value, row): declared order, else row order, first of repeats."""
    shown = F.from_json("value", "type int, text string, createdAt string, bubbleId string")
    head = f"bubbleId:{conversation}:"
    bubbles = pairs.where((F.col("key") >= head) & (F.col("key") < f"bubbleId:{conversation};")).select(F.substr("key", F.lit(len(head) + 1)).alias("bubble"), "row", shown.alias("b")).where("b.type in (1, 2) and trim(b.text) != ''")
    one = bubbles.withColumn("_k", F.row_number().over(Window.partitionBy("bubble").orderBy("row"))).where("_k = 1")
    declared = pairs.where(F.col("key") == f"composerData:{conversation}").select(F.posexplode(F.from_json("value", "fullConversationHeadersOnly array<struct<bubbleId:string>>")["fullConversationHeadersOnly"]).alias("place", "h")).groupBy(F.col("h.bubbleId").alias("bubble")).agg(F.min("place").alias("place"))
    ordered = one.join(declared, "bubble", "left").withColumn("line", F.row_number().over(Window.orderBy(F.col("place").isNull(), "place", "row")))
    user = F.col("b.type") == 1
    return ordered.select(F.lit(f"cursor:{conversation}").alias("path"), "line", F.lit(1).alias("part"), F.col("line").alias("seq"), F.col("b.createdAt").alias("ts"), F.when(user, "user").otherwise("assistant").alias("role"), F.when(user, "prompt").otherwise("reply").alias("kind"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("cwd"), F.lit(None).cast("string").alias("call_id"), F.col("b.text").alias("text"))


FIELD = "struct<part:int,pointer:string,text:string,evidence_type:string,role:string,status:string>"
VISIBLE = ("text", "input_text", "output_text")  # fixed values: types of blocks whose text a person or a model wrote to be read
SHELLS = {"Bash": "command", "exec_command": "cmd"}  # fixed values: tools whose request is evidence, and its field
ENDED = ("end_turn", "stop_sequence")  # fixed values: reasons with which a message is final


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _visible(content: Column, pointer: Column, part: Column, evidence: Column, role: Column, status: Column | None = None) -> Column:
    """array<FIELD> of a content: its text if it is one, else the texts of its visible blocks, each with its pointer."""
    made = lambda at, text: F.struct(part.cast("int").alias("part"), at.alias("pointer"), text.alias("text"), evidence.alias("evidence_type"), role.alias("role"), (F.lit(None) if status is None else status).cast("string").alias("status")).cast(FIELD)
    kind = F.schema_of_variant(content)
    blocks = F.transform(F.coalesce(_get(content, "$", "array<variant>"), F.array().cast("array<variant>")), lambda b, i: F.struct(i.alias("i"), _get(b, "$.type").alias("type"), F.when(F.schema_of_variant(_get(b, "$.text", "variant")) == "STRING", _get(b, "$.text")).alias("text")))
    many = F.transform(F.filter(blocks, lambda b: b["type"].isin(*VISIBLE) & b["text"].isNotNull()), lambda b: made(F.concat(pointer, F.lit("/"), b["i"].cast("string"), F.lit("/text")), b["text"]))
    return F.when(kind == "STRING", F.array(made(pointer, _get(content, "$")))).when(kind.startswith("ARRAY"), many).otherwise(F.array().cast(f"array<{FIELD}>"))


def evidence_fields(lines: DataFrame, provider: str) -> DataFrame:
    """(path, line, and FIELD): the fields of a record that may be cited as evidence, and as what; a finite list per provider."""
    rows = lines.where("json is not null").select("path", "line", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    said = lambda role: F.when(role == "user", "owner_statement").otherwise("assistant_report")
    if provider == "codex":
        kind, role, channel = _get(v, "$.payload.type"), _get(v, "$.payload.role"), _get(v, "$.payload.channel")
        message = (kind == "message") & role.isin("user", "assistant") & F.coalesce(channel == "final", F.lit(True))
        output = kind.isin("function_call_output", "custom_tool_call_output")
        name = F.when(message, "content").when(kind == "function_call", "arguments").when(kind == "custom_tool_call", "input").when(output, "output")
        content = F.coalesce(*(F.when(name == n, _get(v, f"$.payload.{n}", "variant")) for n in ("content", "arguments", "input", "output")))
        evidence = F.when(message, said(role)).when(output, "tool_result").otherwise("tool_request")
        who = F.when(message, role).when(output, "user").otherwise("assistant")
        found = rows.where((_get(v, "$.type") == "response_item") & name.isNotNull()).select("path", "line", _visible(content, F.concat(F.lit("/payload/"), name), F.lit(1), evidence, who).alias("f"))
    elif provider == "claude":
        role, stop = _get(v, "$.type"), _get(v, "$.message.stop_reason")
        own = rows.where(role.isin("user", "assistant") & F.coalesce(_get(v, "$.message.role") == role, F.lit(True)))
        content = _get(v, "$.message.content", "variant")
        own = own.select("path", "line", role.alias("role"), content.alias("c"), (F.coalesce(stop.isin(*ENDED), F.lit(True)) | (role != "assistant")).alias("final"))
        role = F.col("role")
        whole = own.where((F.schema_of_variant("c") == "STRING") & F.col("final")).select("path", "line", _visible(F.col("c"), F.lit("/message/content"), F.lit(1), said(role), role).alias("f"))
        block = own.select("path", "line", "role", "final", F.posexplode(_get(F.col("c"), "$", "array<variant>")).alias("i", "b"))
        b, at, part = F.col("b"), F.concat(F.lit("/message/content/"), F.col("i").cast("string")), F.col("i") + 1
        kind, tool = _get(b, "$.type"), _get(b, "$.name")
        none = F.array().cast(f"array<{FIELD}>")
        fields = (
            F.when((kind == "text") & F.col("final"), _visible(_get(b, "$.text", "variant"), F.concat(at, F.lit("/text")), part, said(role), role))
            .when((kind == "tool_result") & (role == "user"), _visible(_get(b, "$.content", "variant"), F.concat(at, F.lit("/content")), part, F.lit("tool_result"), role, F.when(_get(b, "$.is_error", "boolean"), "reported_error")))
        )
        for shell, key in SHELLS.items():
            fields = fields.when((kind == "tool_use") & (role == "assistant") & (tool == shell), _visible(_get(b, f"$.input.{key}", "variant"), F.concat(at, F.lit(f"/input/{key}")), part, F.lit("tool_request"), role))
        found = whole.unionByName(block.select("path", "line", fields.otherwise(none).alias("f")))
    else:
        kind = _get(v, "$.type", "int")
        found = rows.where(kind.isin(1, 2)).select("path", "line", _visible(_get(v, "$.text", "variant"), F.lit("/text"), F.lit(1), F.when(kind == 1, "owner_statement").otherwise("assistant_report"), F.when(kind == 1, "user").otherwise("assistant")).alias("f"))
    return found.select("path", "line", F.inline("f"))


def selected_evidence(fields: DataFrame, selectors: DataFrame) -> DataFrame:
    """selectors (id, path, line, part, pointer, start, end) with problem, or evidence_type and excerpt.

    A selector names exactly one field; a span lies within it, and may not be cut from a text that redaction changed.
    """
    both = selectors.join(fields.withColumnRenamed("text", "_text"), ["path", "line", "part", "pointer"], "left")
    one = both.groupBy("id", "start", "end").agg(F.count("_text").alias("_n"), F.first("_text").alias("_text"), F.first("evidence_type").alias("evidence_type"))
    first, last = F.coalesce("start", F.lit(0)), F.coalesce("end", F.char_length("_text"))
    safe = one.withColumn("_safe", X.redact(F.col("_text")))
    excerpt = F.substring(F.col("_safe"), (first + 1).cast("int"), (last - first).cast("int"))
    spanned = F.col("start").isNotNull() | F.col("end").isNotNull()
    problem = (
        F.when(F.col("_n") != 1, "forbidden_selector").when((last > F.char_length("_text")) | (first >= last), "invalid_span")
        .when(spanned & (F.col("_safe") != F.col("_text")), "redacted_span").when(F.trim(X.collapse(F.when(spanned, excerpt).otherwise(F.col("_safe")))) == "", "empty_evidence")
    )
    out = safe.select("id", problem.alias("problem"), "evidence_type", F.when(spanned, excerpt).otherwise(F.col("_safe")).alias("excerpt"))
    good = lambda c: F.when(F.col("problem").isNull(), F.col(c)).alias(c)
    return out.select("id", "problem", good("evidence_type"), good("excerpt"))


def call_log(spark, files: list[str]) -> DataFrame:
    """Allow-listed fields of the call log's generations; torn and foreign lines are left out."""
    fields = "at double, cmd string, ok boolean, actor string, stages map<string,long>, _bad string"
    rows = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(files)
    return rows.where("_bad is null and cmd is not null").select("at", "cmd", "ok", X.actor(F.col("actor")).alias("actor"), "stages")
