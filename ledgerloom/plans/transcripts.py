"""Queries that start from files: transcripts written from the conversations, read back by the sources and passes.

The text of every line is SQL that Spark and DuckDB read alike, so that an oracle tells what the files hold.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import erase, review
from ledgerloom.plans.fixtures import Data
from ledgerloom.shared import cut, shared_dir
from ledgerloom.sources import lines, records
from ledgerloom.streaming import ingest

_S = "CAST({} AS VARCHAR(20))"
_CLASS = "CASE conv_id % 4 WHEN 1 THEN 'subagent' WHEN 2 THEN 'guardian_review' ELSE 'user' END"
# (file, place, value): a line of a file, and where it stands there
RAW = f"""SELECT conv_id AS file, turn AS place, CASE turn % 5 WHEN 1 THEN '{{bad' WHEN 2 THEN '[1]' ELSE concat('{{"n":', {_S.format('turn')}, ',"len":', {_S.format('length(text)')}, '}}') END AS value FROM conversations"""
_HEAD = f"""concat('{{"type":"response_item","ordinal":', {_S.format('turn + 1')}, ',"timestamp":"2024-01-01T00:00:0', {_S.format('turn % 10')}, 'Z","payload":"""
ROLLOUT = f"""SELECT DISTINCT conv_id AS file, CAST(-1 AS BIGINT) AS place, concat('{{"type":"session_meta","payload":{{"id":"thr-', {_S.format('conv_id')}, '","session_id":"ses-', {_S.format('conv_id')}, '","cwd":"/w', {_S.format('conv_id % 5')}, '","thread_source":"', {_CLASS}, '"}}}}') AS value FROM conversations
UNION ALL SELECT conv_id, turn * 10, {_HEAD}{{"type":"message","role":"', role, '","content":[{{"type":"input_text","text":"say ', {_S.format('turn')}, '"}}]}}}}') FROM conversations
UNION ALL SELECT conv_id, turn * 10 + 1, {_HEAD}{{"type":"function_call","name":"run","arguments":"{{}}","call_id":"c', {_S.format('turn')}, '"}}}}') FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn * 10 + 2, {_HEAD}{{"type":"function_call_output","call_id":"c', {_S.format('turn')}, '","output":"Process exited with code ', {_S.format('turn % 2')}, '"}}}}') FROM conversations WHERE role = 'assistant'"""
LOG = f"""SELECT event_id % 3 AS file, event_id AS place, CASE WHEN event_id % 13 = 0 THEN '{{"at' ELSE concat('{{"at":', {_S.format('event_id')}, ',"cmd":"', event_type, '","ok":true,"actor":"A ', {_S.format('user_id % 5')}, '"}}') END AS value FROM events"""
PLACED = "p AS (SELECT *, row_number() OVER w AS line, CAST(sum(strlen(value) + 1) OVER w AS BIGINT) AS next_offset FROM f WINDOW w AS (PARTITION BY file ORDER BY place))"
FILES_PER_TASK = 250
_WRITTEN: dict[tuple[str, str, str], str] = {}
_STORES: dict[tuple[str, str], tuple[ingest.Store, DataFrame]] = {}


def _writer(path: str):
    """Writes the lines of each file, which come one after another; a file has its name once it is whole, so a task may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = lines._fs(path)
        rows = ((f, v or "") for batch in batches for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        n = 0
        for file, held in itertools.groupby(rows, key=lambda r: r[0]):
            at, n = f"{base}/file={file}", n + 1
            system.create_dir(at, recursive=True)
            part = f"{at}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                while block := "".join(f"{v}\n" for _, v in itertools.islice(held, 10_000)):
                    f.write(block.encode())
            system.move(part, f"{at}/lines.txt")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return run


def folder(d: Data, name: str, sql: str) -> str:
    """A folder with a file per value of `file`, written once in a session."""
    key = (d.spark.sparkContext.applicationId, d.sf_dir, name)
    if key not in _WRITTEN:
        path = f"{shared_dir(d.spark)}/transcripts-{uuid.uuid4().hex}"
        tables = {t: getattr(d, t) for t in ("conversations", "events") if f" {t}" in sql}
        for t in tables:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        # braces of JSON texts are no names of tables
        safe = sql.replace("{", "{{").replace("}", "}}")
        for t in tables:
            safe = safe.replace(f"{{{{{t}}}}}", f"{{{t}}}")
        rows = d.spark.sql(safe, **tables)
        n = max(1, min(10_000, rows.select("file").distinct().count() // FILES_PER_TASK))
        # the number of tasks is given: by their bytes these files would all go to one
        rows.repartition(n, "file").sortWithinPartitions("file", "place").select("file", "value").mapInArrow(_writer(path), "files long").agg(F.sum("files")).collect()
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.regexp_extract("path", "file=([0-9]+)", 1).cast("long"))


def raw_lines(d: Data) -> DataFrame:
    return _file(lines.numbered(d.spark, folder(d, "raw", RAW), 256, ".txt"))


def rollout(d: Data) -> DataFrame:
    lines.register(d.spark)
    return records.decoded(d.spark.read.format("transcript_lines").options(path=folder(d, "rollout", ROLLOUT), suffix=".txt").load())


def threads(d: Data) -> DataFrame:
    return records.codex_threads(rollout(d).where("json is not null").select("path", "line", F.from_json("json", records.CODEX).alias("r")))


def passes(d: Data) -> tuple[ingest.Store, DataFrame]:
    """The store after two passes, and the modes of the second: first the files' beginnings, then the whole files at other paths."""
    key = (d.spark.sparkContext.applicationId, d.sf_dir)
    if key not in _STORES:
        store = ingest.Store(d.spark, f"{shared_dir(d.spark)}/store-{uuid.uuid4().hex}")
        ingest.run_pass(store, folder(d, "begun", f"SELECT * FROM ({ROLLOUT}) AS r WHERE place < 32"), suffix=".txt")
        _STORES[key] = store, ingest.run_pass(store, folder(d, "rollout", ROLLOUT), suffix=".txt")
    return _STORES[key]


ERASED_LINE, ERASED_FILE = "place >= 0 AND place % 30 = 0", "file % 11 = 4"


def erased(d: Data) -> tuple[ingest.Store, DataFrame]:
    """The store after a pass, an erasure of lines and threads, and a pass that reads everything again; and the modes of that pass."""
    key = (d.spark.sparkContext.applicationId, d.sf_dir, "erased")
    if key not in _STORES:
        store = ingest.Store(d.spark, f"{shared_dir(d.spark)}/store-{uuid.uuid4().hex}", b"key")
        ingest.run_pass(store, folder(d, "rollout", ROLLOUT), suffix=".txt")
        events = store.events().withColumn("file", F.substr("thread_id", F.lit(5)).cast("long"))
        # the ordinal of a message is its turn and one
        store.erase(events.where("kind in ('prompt', 'reply', 'delegation') and (seq - 1) % 3 = 0").select("thread_id", "line"), threads=events.where(ERASED_FILE).select("thread_id").distinct())
        _STORES[key] = store, ingest.run_pass(store, folder(d, "rollout", ROLLOUT), version=2, suffix=".txt")
    return _STORES[key]


def verified(d: Data) -> DataFrame:
    rows = raw_lines(d)
    sha = F.when(F.col("line") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("raw", 256))
    return lines.verified(rows.select((F.col("file") * 1000 + F.col("line")).alias("id"), "path", "byte_offset", sha.alias("sha256")))


def revalidated(d: Data) -> DataFrame:
    """Files as windows of their lines: every third one's boundary is another, every fourth one holds a record that changed."""
    rows = cut(raw_lines(d))
    end = rows.groupBy("file").agg(F.max("line").alias("boundary_line"), F.max_by(F.sha2("raw", 256), "line").alias("boundary_hash"))
    windows = end.select(F.col("file").alias("window_id"), "boundary_line", F.when(F.col("file") % 3 == 0, F.lit("other")).otherwise(F.col("boundary_hash")).alias("boundary_hash"))
    sha = F.when((F.col("file") % 4 == 0) & (F.col("line") == 1), F.sha2(F.lit("other"), 256)).otherwise(F.sha2("raw", 256))
    records = rows.select(F.col("file").alias("window_id"), "line", F.lit(1).alias("part"), F.octet_length("raw").alias("bytes"), "path", "byte_offset", sha.alias("line_sha256"))
    return review.initial_evidence(records, windows, 60)[1]


def held(d: Data) -> DataFrame:
    """Where the files of the rollouts hold three needles, read in ranges much shorter than a file."""
    needle = d.spark.createDataFrame([("say 1",), ("exited with code 1",), ('"role":"assistant"',)], "needle string")
    return _file(erase.residue(d.spark, folder(d, "rollout", ROLLOUT), needle, range_bytes=300)).groupBy("file", "needle").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def call_log(d: Data) -> DataFrame:
    return records.call_log(d.spark, [folder(d, "log", LOG)]).groupBy("cmd", "actor").agg(F.count("*").alias("n"))


def cursor(d: Data) -> DataFrame:
    """A conversation of a key/value table that holds them all, declared backwards."""
    c = d.conversations
    bubble = F.struct(F.when(F.col("role") == "assistant", 2).otherwise(1).alias("type"), F.concat(F.lit("say "), F.col("turn").cast("string")).alias("text"))
    bubbles = c.select(F.concat(F.lit("bubbleId:"), "conv_id", F.lit(":b"), "turn").alias("key"), F.to_json(bubble).alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row"))
    heads = F.transform(F.reverse(F.array_sort(F.collect_list("turn"))), lambda t: F.struct(F.concat(F.lit("b"), t.cast("string")).alias("bubbleId")))
    declared = c.groupBy("conv_id").agg(heads.alias("h")).select(F.concat(F.lit("composerData:"), "conv_id").alias("key"), F.to_json(F.struct(F.col("h").alias("fullConversationHeadersOnly"))).alias("value"), (F.col("conv_id") * 1000 + 999).alias("row"))
    return records.cursor_events(bubbles.unionByName(declared), "3").select("line", "kind", "text")


_ISSUE = "CASE WHEN value = '{bad' THEN 'invalid_json' WHEN value = '[1]' THEN 'not_object' END"
_EVENTS = f"""WITH f AS ({ROLLOUT}), {PLACED}, k AS (SELECT p.*, CASE WHEN place % 10 = 0 AND place >= 0 THEN json_extract_string(value, '$.payload.role') END AS role, json_extract_string(value, '$.payload.call_id') AS call_id FROM p),
e AS (SELECT file, line, CASE WHEN role = 'assistant' THEN 'reply' WHEN role = 'user' AND file % 4 = 1 THEN 'delegation' WHEN role = 'user' THEN 'prompt' WHEN place % 10 = 1 THEN 'tool_call' WHEN place % 10 = 2 AND (place // 10) % 2 = 1 THEN 'tool_error' END AS kind,
  concat('/w', file % 5) AS cwd, place, CASE WHEN place % 10 = 2 THEN line - 1 END AS parent_line FROM k WHERE place >= 0)
SELECT file, line, kind, cwd, parent_line FROM e WHERE kind IS NOT NULL"""


def register(query) -> None:
    """Adds the queries by name with their SQL."""
    query("src01_files", lambda d: _file(d.spark.createDataFrame(lines.discover(folder(d, "raw", RAW), ".txt"), "path string, size long")).select("file", "size"), f"WITH f AS ({RAW}), {PLACED} SELECT file, max(next_offset) AS size FROM p GROUP BY 1")
    query("src02_lines", lambda d: raw_lines(d).select("file", "line", "byte_offset", "next_offset", F.sha2("raw", 256).alias("sha256")), f"WITH f AS ({RAW}), {PLACED} SELECT file, line, next_offset - strlen(value) - 1 AS byte_offset, next_offset, sha256(value) AS sha256 FROM p")
    query("src03_decoded", lambda d: records.decoded(raw_lines(d)).select("file", "line", "issue", F.get_json_object("json", "$.len").cast("long").alias("len")), f"WITH f AS ({RAW}), {PLACED} SELECT file, line, {_ISSUE} AS issue, CASE WHEN {_ISSUE} IS NULL THEN CAST(json_extract(value, '$.len') AS BIGINT) END AS len FROM p")
    query("src04_codex_events", lambda d: _file(records.codex_events(rollout(d))).select("file", "line", "kind", "cwd", "parent_line"), _EVENTS)
    query("src06_cursor_events", cursor, "SELECT row_number() OVER (ORDER BY turn DESC) AS line, CASE role WHEN 'assistant' THEN 'reply' ELSE 'prompt' END AS kind, concat('say ', turn) AS text FROM conversations WHERE conv_id = 3")
    query("src07_call_log", call_log, "SELECT event_type AS cmd, concat('a-', user_id % 5) AS actor, count(*) AS n FROM events WHERE event_id % 13 <> 0 GROUP BY 1, 2")
    query(
        "knw27_revalidated", revalidated,
        f"""WITH RECURSIVE f AS ({RAW}), {PLACED}, s AS (SELECT file, line, CAST(strlen(value) AS BIGINT) AS b FROM p),
        folded AS (SELECT DISTINCT file, CAST(0 AS BIGINT) AS line, CAST(0 AS BIGINT) AS used, true AS taken FROM f
          UNION ALL SELECT s.file, s.line, CASE WHEN d.used + s.b <= 60 THEN d.used + s.b ELSE d.used END, d.used + s.b <= 60 FROM folded d JOIN s ON s.file = d.file AND s.line = d.line + 1),
        w AS (SELECT file, max(used) AS used, bool_or(NOT taken) AS cut, max(line) AS n, file % 3 = 0 OR file % 4 = 0 AND bool_or(taken AND line = 1) OR file % 4 = 0 AND max(line) = 1 AS bad FROM folded GROUP BY 1)
        SELECT file AS window_id, CASE WHEN bad THEN 0 ELSE used END AS bytes_used, NOT bad AND cut AS truncated, CASE WHEN bad THEN 'evidence_changed' END AS problem FROM w""",
    )
    query("era09_files", held, f"""WITH f AS ({ROLLOUT}), {PLACED}, n AS (SELECT unnest(['say 1', 'exited with code 1', '"role":"assistant"']) AS needle),
        h AS (SELECT file, needle, next_offset - strlen(value) - 1 + instr(value, needle) - 1 AS pos FROM p, n WHERE contains(value, needle)) SELECT file, needle, count(*) AS n, min(pos) AS first FROM h GROUP BY 1, 2""")
    query("src10_verified", verified, f"WITH f AS ({RAW}), {PLACED} SELECT file * 1000 + line AS id, line % 3 <> 0 AS intact FROM p")
    query("scl08_thread_class", lambda d: threads(d).select("thread_id", "thread_class", "class_reason"), f"SELECT DISTINCT concat('thr-', conv_id) AS thread_id, CASE {_CLASS} WHEN 'user' THEN 'primary' WHEN 'subagent' THEN 'subagent' ELSE 'reviewer' END AS thread_class, concat('thread_source=', {_CLASS}) AS class_reason FROM conversations")
    stored = lambda d: passes(d)[0].events().select(F.substr("thread_id", F.lit(5)).cast("long").alias("file"), "line", "kind", "cwd", "parent_line")
    query("snk01_events_of_two_passes", stored, f"SELECT * FROM ({_EVENTS}) WHERE file % 4 <> 2")
    again = lambda d: erased(d)[0].events().select(F.substr("thread_id", F.lit(5)).cast("long").alias("file"), "line", "kind", "cwd", "parent_line")
    query("era12_reread_after_erasure", again, f"{_EVENTS} AND file % 4 <> 2 AND NOT ({ERASED_LINE}) AND NOT ({ERASED_FILE})")
    query("era12_modes", lambda d: erased(d)[1].groupBy("mode").agg(F.count("*").alias("files")), f"SELECT CASE WHEN file % 4 <> 2 AND {ERASED_FILE} THEN 'blocked' ELSE 'replace' END AS mode, count(*) AS files FROM (SELECT DISTINCT conv_id AS file FROM conversations) GROUP BY 1")
    query("str02_modes", lambda d: passes(d)[1].groupBy("mode").agg(F.count_distinct("thread_id").alias("threads")), "SELECT m AS mode, count(DISTINCT conv_id) AS threads FROM conversations CROSS JOIN (SELECT unnest(['moved', 'missing']) AS m) GROUP BY 1")
    query("str03_cursors", lambda d: passes(d)[0].cursors().select("thread_id", "cursor_bytes", "cursor_line", "prefix_open", "status"), f"WITH f AS ({ROLLOUT}), {PLACED} SELECT concat('thr-', file) AS thread_id, max(next_offset) AS cursor_bytes, max(line) AS cursor_line, file % 4 = 2 AS prefix_open, 'active' AS status FROM p GROUP BY file")
    query("str03_open_lines", lambda d: passes(d)[0].open_lines().select("thread_id", "line"), f"WITH f AS ({ROLLOUT}), {PLACED} SELECT concat('thr-', file) AS thread_id, line FROM p WHERE line = 1")
