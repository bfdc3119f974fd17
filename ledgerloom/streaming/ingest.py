"""Incremental ingest: change detection against a manifest, a stream of appended lines, exactly-once sinks."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import erase, family, lineage
from ledgerloom.shared import cut
from ledgerloom.sources import lines, records

CLASSIFIER = 1  # raised whenever the adapters read something else; sources of an earlier version are read again
INDEXED = ("primary", "subagent")  # classes of threads that get events; others are only known
MANIFEST = "path string, thread_id string, ino long, size long, mtime_ns long, first_hash string, anchor_hash string"
CURSORS = MANIFEST + ", classifier_version long, cursor_bytes long, cursor_line long, anchor_offset long, since long, prefix_open boolean, status string"
EVENTS = "pass long, thread_id string, line long, part long, byte_offset long, line_sha256 string, seq long, ts string, role string, kind string, tag string, cwd string, call_id string, parent_line long, parent_part long, flags int, text string"
THREADS = "thread_id string, provider string, session_root string, parent_thread_id string, forked_from_id string, thread_class string, class_reason string, replay_mode string, replay_before long"
OPEN = "thread_id string, line long, json string"
TOMBSTONES = "provider string, level string, session_root string, thread_id string, line long, line_sha256 string"


def plan(now: DataFrame, known: DataFrame, version: int) -> DataFrame:
    """(path, mode) of a manifest against known sources.

    Manifest: path, thread_id, ino, size, mtime_ns, first_hash, anchor_hash (of the bytes up to the known
    cursor). Modes: new, unchanged, append, replace, moved, missing, and copy for a second path of
    a thread whose first one is still there.
    """
    n, k = now.alias("n"), known.alias("k")
    both = n.join(k, F.col("n.path") == F.col("k.path"), "full_outer")
    same = (F.col("n.ino") == F.col("k.ino")) & (F.col("n.size") == F.col("k.size")) & (F.col("n.mtime_ns") == F.col("k.mtime_ns")) & (F.col("k.classifier_version") == version)
    grown = (F.col("n.first_hash") == F.col("k.first_hash")) & (F.col("n.size") >= F.col("k.size")) & (F.col("n.anchor_hash") == F.col("k.anchor_hash")) & (F.col("k.classifier_version") == version)
    at = both.select(F.coalesce("n.path", "k.path").alias("path"), F.coalesce("n.thread_id", "k.thread_id").alias("thread_id"), F.when(F.col("k.path").isNull(), "new").when(F.col("n.path").isNull(), "missing").when(same, "unchanged").when(grown, "append").otherwise("replace").alias("mode"))
    threads = at.groupBy("thread_id").agg(F.bool_or(F.col("mode").isin("unchanged", "append", "replace")).alias("_here"), F.bool_or(F.col("mode") == "missing").alias("_gone"))
    return at.join(threads, "thread_id", "left").select("path", "thread_id", F.when((F.col("mode") == "new") & F.col("_here"), "copy").when((F.col("mode") == "new") & F.col("_gone"), "moved").otherwise(F.col("mode")).alias("mode"))


def _digest(raw: bytes | None) -> str | None:
    """Identity of a line, as functions.text.record_hash has it."""
    return None if raw is None else hashlib.sha256(raw.rstrip(b"\r\n")).hexdigest()


def _thread(raw: bytes | None, path: str) -> str:
    """The thread that a file's first line names, else the file's own name; side files name themselves."""
    stem = path.rsplit("/", 1)[-1].removesuffix(".jsonl")
    try:
        first = json.loads(raw or b"")
        named = first["payload"].get("id") if first.get("type") == "session_meta" else first.get("sessionId")
    except (ValueError, TypeError, KeyError, AttributeError):
        return stem
    return stem if "/subagents/" in path or first.get("isSidechain") or not isinstance(named, str) or not named else named


def manifest(spark: SparkSession, folder: str, known: DataFrame | None = None, suffix: str = ".jsonl", prefix: str = "") -> DataFrame:
    """MANIFEST rows of a folder's files. The driver lists; tasks read a file's first line and the line at its known anchor."""
    listed = lines.listed(folder, suffix, prefix)
    found = spark.createDataFrame(listed, "path string, size long, mtime_ns long")
    anchors = (known if known is not None else spark.createDataFrame([], CURSORS)).select("path", "anchor_offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size, mtime, anchor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = next((r for _, _, _, r in lines.complete_lines(path)), None)
                held = next((r for _, _, _, r in lines.complete_lines(path, anchor)), None) if anchor is not None and anchor < size else None
                local = path.removeprefix("file://")
                out.append((path, _thread(first, path), os.stat(local).st_ino if local.startswith("/") and os.path.exists(local) else None, size, mtime, _digest(first), _digest(held)))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    asked = found.join(anchors, "path", "left").select("path", "size", "mtime_ns", "anchor_offset")
    return asked.repartition(lines.tasks(len(listed), 0), "path").mapInArrow(run, MANIFEST)  # of each file two lines


@dataclass
class Store:
    """Events, threads, cursors and open lines below a folder; a pass counts once its marker is there.

    Every pass appends its own events and rewrites the three tables that describe sources. What a pass wrote
    without its marker is overwritten by the next one, so a pass that dies leaves nothing behind.
    """

    spark: SparkSession
    folder: str
    key: bytes | None = None  # of content tombstones; without it only lines, threads and sessions leave tombstones

    def passes(self) -> list[int]:
        """Numbers of the committed passes."""
        return sorted(int(p.rsplit("/", 1)[1]) for p, _ in lines.discover(f"{self.folder}/commits", ""))

    def _last(self, name: str, schema: str) -> DataFrame:
        done = self.passes()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/pass={done[-1]}") if done else self.spark.createDataFrame([], schema)

    def cursors(self) -> DataFrame:
        return self._last("cursors", CURSORS)

    def threads(self) -> DataFrame:
        return self._last("threads", THREADS)

    def open_lines(self) -> DataFrame:
        return self._last("open", OPEN)

    def tombstones(self) -> DataFrame:
        """TOMBSTONES rows: levels line, thread and session, and content with the keyed tag of a role and text in line_sha256."""
        return self._last("tombstones", TOMBSTONES)

    def tag(self, role, text):
        return X.content_tag(self.key)(F.lit(""), F.lit(""), role, text)

    def events(self) -> DataFrame:
        """Events of the committed passes, those of a source only since it was last read from its start."""
        done = self.passes()
        if not done:
            return self.spark.createDataFrame([], EVENTS)
        rows = self.spark.read.schema(EVENTS).option("basePath", f"{self.folder}/events").parquet(*(f"{self.folder}/events/pass={n}" for n in done))
        since = self.cursors().select("thread_id", "since").dropDuplicates(["thread_id"])
        return rows.join(since, "thread_id").where(F.col("pass") >= F.col("since")).drop("since").select(*self.spark.createDataFrame([], EVENTS).columns)

    def commit(self, number: int, **tables: DataFrame) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/pass={number}")
        system, path = lines._fs(f"{self.folder}/commits")
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{number}") as f:
            f.write(b"")


    def erase(self, doomed: DataFrame | None = None, threads: DataFrame | None = None, sessions: DataFrame | None = None) -> None:
        """Removes lines (thread_id, line), threads (thread_id) and sessions (session_root) in one commit, with tombstones, and then what earlier passes still hold of them."""
        spark, number = self.spark, (self.passes() or [0])[-1] + 1
        none = lambda schema: spark.createDataFrame([], schema)
        known, events = cut(self.threads()), cut(self.events())
        who = known.select("thread_id", "provider")
        whole = (threads if threads is not None else none("thread_id string")).select("thread_id").join(who, "thread_id")
        by_session = (sessions if sessions is not None else none("session_root string")).select("session_root").join(known.select("session_root", "thread_id", "provider"), "session_root")
        going = cut(whole.select("thread_id").unionByName(by_session.select("thread_id")).distinct())
        lost = cut(events.join((doomed if doomed is not None else none("thread_id string, line long")).select("thread_id", "line").distinct(), ["thread_id", "line"]).join(who, "thread_id"))
        null = F.lit(None).cast("string")
        mark = lambda rows, level, session, thread, line, sha: rows.select("provider", F.lit(level).alias("level"), session.alias("session_root"), thread.alias("thread_id"), line.cast("long").alias("line"), sha.alias("line_sha256"))
        thread = F.col("thread_id")
        made = mark(lost, "line", null, thread, F.col("line"), F.col("line_sha256"))
        made = made.unionByName(mark(whole, "thread", null, thread, null, null)).unionByName(mark(by_session, "session", F.col("session_root"), null, null, null))
        if self.key:
            made = made.unionByName(mark(lost, "content", null, thread, null, self.tag(F.col("role"), F.col("text"))))
        touched = cut(lost.select("thread_id").distinct())
        kept = events.join(touched, "thread_id", "left_semi").join(lost.select("thread_id", "line").distinct(), ["thread_id", "line"], "left_anti")
        cursors = self.cursors().join(going, "thread_id", "left_anti").join(touched.withColumn("_t", F.lit(True)), "thread_id", "left")
        cursors = cursors.withColumn("since", F.when(F.col("_t"), F.lit(number).cast("long")).otherwise(F.col("since")))
        open_lines = self.open_lines().join(going, "thread_id", "left_anti").join(lost.select("thread_id", "line").distinct(), ["thread_id", "line"], "left_anti")
        self.commit(number, events=kept.drop("pass"), threads=known.join(going, "thread_id", "left_anti"), cursors=cursors.select(*(c.split()[0] for c in CURSORS.split(", "))), open=open_lines, tombstones=self.tombstones().unionByName(made).distinct())
        self.compact()

    def compact(self) -> None:
        """All live events in one pass, the folders of earlier ones removed: nothing erased stays on disk, and a pass reads few folders."""
        done = self.passes()
        if not done:
            return
        number = done[-1] + 1
        cursors = self.cursors().withColumn("since", F.lit(number).cast("long"))
        self.commit(number, events=self.events().drop("pass"), threads=self.threads(), cursors=cursors, open=self.open_lines(), tombstones=self.tombstones())
        system, base = lines._fs(self.folder)
        for n in done:  # first the markers: a folder without one does not count
            system.delete_file(f"{base}/commits/{n}")
        for n in done:
            for name in ("events", "threads", "cursors", "open", "tombstones"):
                system.delete_dir(f"{base}/{name}/pass={n}")


def _first_lines(todo: DataFrame) -> DataFrame:
    """(path, line, raw) of each file's first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            first = [next((r for _, _, _, r in lines.complete_lines(p)), None) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([1] * len(paths), pa.int64()), pa.array(first, pa.binary())], names=["path", "line", "raw"])

    return todo.select("path").repartition(lines.tasks(todo.count(), 0), "path").mapInArrow(run, "path string, line long, raw binary")


def _barred(store: Store, todo: DataFrame, named, schema: str, marks: DataFrame) -> DataFrame:
    """(path) of the files that erasure forbids to index, told by their first lines."""
    rows = records.decoded(_first_lines(todo)).where("json is not null")
    heads = cut(named(rows.select("path", "line", F.from_json("json", schema).alias("r"))).drop("thread_id").join(todo.select("path", "thread_id"), "path"))
    continues = F.when(F.col("replay_mode") == "history_base", F.col("parent_thread_id")).alias("continues")
    known = store.threads().select("provider", "thread_id", "session_root").unionByName(heads.select("provider", "thread_id", "session_root"))
    return erase.barred(heads.select("path", "provider", "thread_id", "session_root", continues, "forked_from_id"), known, marks).select("path").distinct()


def _read(todo: DataFrame) -> DataFrame:
    """(path, thread_id, line, byte_offset, next_offset, raw) of complete lines from each file's cursor on."""

    names, kinds = ["thread_id", *lines.NAMES], [pa.string(), *lines.KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield from lines._batches(((thread, path, *row) for path, thread, at, number in files for row in lines.complete_lines(path, at, number)), names, kinds)

    files, size = todo.agg(F.count("*"), F.coalesce(F.sum(F.col("size") - F.col("_at")), F.lit(0))).first()
    rows = todo.select("path", "thread_id", "_at", "_line").repartition(lines.tasks(files, size), "path")
    return rows.mapInArrow(run, "thread_id string, path string, line long, byte_offset long, next_offset long, raw binary").select("path", "thread_id", "line", "byte_offset", "next_offset", "raw")


def without_inherited(events: DataFrame, threads: DataFrame, earlier: DataFrame, marks: DataFrame, store: Store) -> DataFrame:
    """events (thread_id, line, part, role, text, line_sha256, ...) without the leading run that content-prefix forks repeat of any ancestor.

    Forks come last by data flow: their ancestors' events are those committed (earlier) and all of this pass. What was
    erased of an ancestor still belongs to the run, told by its line's hash or by the tag of its content.
    """
    forks = threads.where("replay_mode = 'content_prefix' and prefix_open").select("thread_id", "forked_from_id")
    if not forks.take(1):
        return events
    up = cut(lineage.ancestors(threads, of=forks.select("thread_id"), most_depth=None).where("depth > 0").select("thread_id", "ancestor"))
    of_ancestors = up.select(F.col("ancestor").alias("thread_id")).distinct()
    told = F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("_told")
    every = events.unionByName(earlier, allowMissingColumns=True).select("thread_id", "role", "text").join(of_ancestors, "thread_id", "left_semi")
    inherited = every.select(F.col("thread_id").alias("ancestor"), told).join(up, "ancestor").select("thread_id", "_told").distinct().withColumn("_live", F.lit(True))
    child = events.join(forks.select("thread_id"), "thread_id", "left_semi").select("thread_id", "line", "part", "role", "text", "line_sha256", told)
    child = child.join(inherited, ["thread_id", "_told"], "left").withColumn("_known", F.col("_live").isNotNull()).drop("_live")
    gone = cut(marks.where("line_sha256 is not null").select(F.col("thread_id").alias("ancestor"), "level", "line_sha256").join(up, "ancestor").select("thread_id", "level", "line_sha256").distinct())
    by_line = gone.where("level = 'line'").select("thread_id", "line_sha256", F.lit(True).alias("_gone"))
    child = child.join(by_line, ["thread_id", "line_sha256"], "left").withColumn("_known", F.col("_known") | F.col("_gone").isNotNull()).drop("_gone")
    by_content = gone.where("level = 'content'").select("thread_id", F.col("line_sha256").alias("_tag"), F.lit(True).alias("_gone"))
    if store.key and by_content.take(1):
        child = child.withColumn("_tag", store.tag(F.col("role"), F.col("text"))).join(by_content, ["thread_id", "_tag"], "left").withColumn("_known", F.col("_known") | F.col("_gone").isNotNull())
    run = family.before_first(child.select("thread_id", "line", "part", "_known"), "_known", "thread_id").select("thread_id", "line", "part")
    return events.join(run, ["thread_id", "line", "part"], "left_anti")


def run_pass(store: Store, folder: str, provider: str = "codex", version: int = CLASSIFIER, full: bool = False, suffix: str = ".jsonl", prefix: str = "") -> DataFrame:
    """One pass over a folder: plan, read what is new, decode, commit together; returns (path, thread_id, mode).

    Lines that earlier ones leave open (the first, the directory in force, calls without an output) are
    read back beside the new ones, so an output finds its call however many passes lie between. Files of erased
    threads and sessions are not read (mode blocked), and lines that a tombstone names are not decoded.
    """
    spark = store.spark
    number, known = (store.passes() or [0])[-1] + 1, cut(store.cursors())
    now = cut(manifest(spark, folder, known, suffix, prefix))
    waiting = store.threads().where("replay_mode = 'content_prefix'").join(store.threads().select(F.col("thread_id").alias("forked_from_id")), "forked_from_id", "left_anti")
    arrived = waiting.join(now.select(F.col("thread_id").alias("forked_from_id")), "forked_from_id", "left_semi").select("thread_id", F.lit(True).alias("_arrived")).dropDuplicates(["thread_id"])
    again = F.col("_arrived").isNotNull() & F.col("mode").isin("unchanged", "append")  # a fork read before its parent is read again once the parent is there
    modes = cut(plan(now, known, version if not full else -1).join(arrived, "thread_id", "left").select("path", "thread_id", F.when(again, "replace").otherwise(F.col("mode")).alias("mode")))
    old = known.select("thread_id", "cursor_bytes", "cursor_line", "since", "prefix_open", F.col("anchor_offset").alias("_anchor"), F.col("anchor_hash").alias("_old_hash")).dropDuplicates(["thread_id"])
    at = modes.join(old, "thread_id", "left").withColumn("_kept", F.col("mode").isin("append", "moved") & F.col("cursor_bytes").isNotNull())
    todo = cut(at.where(F.col("mode").isin("new", "append", "replace", "moved")).join(now.select("path", "size"), "path").withColumn("_at", F.when(F.col("_kept"), F.col("cursor_bytes")).otherwise(0)).withColumn("_line", F.when(F.col("_kept"), F.col("cursor_line")).otherwise(0)))
    adapt = {"codex": records.codex_events, "claude": records.claude_events}[provider]
    named = {"codex": records.codex_threads, "claude": records.claude_threads}[provider]
    marks = cut(store.tombstones().where(F.col("provider") == provider))
    if marks.where("level in ('thread', 'session')").take(1):
        barred = cut(_barred(store, todo, named, records.CODEX if provider == "codex" else records.CLAUDE, marks))
        todo = cut(todo.join(barred, "path", "left_anti"))
        modes = cut(modes.join(barred.withColumn("_b", F.lit("blocked")), "path", "left").select("path", "thread_id", F.coalesce("_b", "mode").alias("mode")))
    hashed = cut(_read(todo).withColumn("line_sha256", X.record_hash(F.col("raw").cast("string"))))
    erased = marks.where("level = 'line'").select("thread_id", "line", "line_sha256")
    fresh = records.decoded(hashed.join(erased, ["thread_id", "line", "line_sha256"], "left_anti") if erased.take(1) else hashed)  # an erased line never enters again
    held = store.open_lines().join(todo.where("_kept").select("thread_id", "path"), "thread_id")
    every = cut(fresh.select("path", "thread_id", "line", "json").unionByName(held.select("path", "thread_id", "line", "json")))
    rows = every.select("path", "line", "json")
    codex = provider == "codex"
    parsed = records.codex_parsed(rows) if codex else rows.where("json is not null").select("path", "line", F.from_json("json", records.CLAUDE).alias("r"))
    met = named(parsed).join(todo.select("path", F.col("thread_id").alias("_id"), "_kept", "prefix_open"), "path").drop("path", "thread_id").withColumnRenamed("_id", "thread_id")
    met = met.dropDuplicates(["thread_id"])
    threads = cut(met.select(*(c.split()[0] for c in THREADS.split(", "))).unionByName(store.threads().join(met.select("thread_id"), "thread_id", "left_anti")))
    own = todo.select("path", "thread_id")
    # held lines stand before the cursor, so none of them is among the fresh ones
    new = (adapt(rows, parsed) if codex else adapt(rows)).join(fresh.select("path", "thread_id", "line", "byte_offset", "line_sha256"), ["path", "line"])
    limit = F.when(F.col("kind") == "tool_call", X.MOST_CALL_BYTES).otherwise(X.MOST_EVENT_BYTES)
    new = new.join(threads.where(F.col("thread_class").isin(*INDEXED)).select("thread_id"), "thread_id", "left_semi")
    new = cut(new.withColumn("_f", X.finish("text", limit)).select("thread_id", "line", F.col("part").cast("long").alias("part"), "byte_offset", "line_sha256", "seq", "ts", "role", "kind", "tag", "cwd", "call_id", "parent_line", F.col("parent_part").cast("long").alias("parent_part"), F.col("_f.flags").alias("flags"), F.col("_f.text").alias("text")))
    prefix = threads.join(met.select("thread_id", F.coalesce(F.when(F.col("_kept"), F.col("prefix_open")), F.lit(True)).alias("prefix_open")), "thread_id", "left").withColumn("prefix_open", F.coalesce("prefix_open", F.lit(False)))
    kept = cut(without_inherited(new, prefix, store.events(), marks, store))
    ends = hashed.groupBy("thread_id").agg(F.max("next_offset").alias("_bytes"), F.max("line").alias("_lines"), F.max_by("byte_offset", "line").alias("_last"), F.max_by("line_sha256", "line").alias("_hash"))
    grown = kept.groupBy("thread_id").agg(F.lit(False).alias("_open"))
    here = now.join(modes.select("path", "mode"), "path").where("mode not in ('copy', 'blocked')")
    done = here.join(old, "thread_id", "left").join(ends, "thread_id", "left").join(grown, "thread_id", "left")
    restarted = F.col("mode").isin("new", "replace")
    cursors = done.select(
        "path", "thread_id", "ino", "size", "mtime_ns", "first_hash", F.coalesce("_hash", F.when(~restarted, F.col("_old_hash"))).alias("anchor_hash"), F.lit(version).cast("long").alias("classifier_version"),
        F.coalesce("_bytes", F.when(~restarted, F.col("cursor_bytes")), F.lit(0)).alias("cursor_bytes"), F.coalesce("_lines", F.when(~restarted, F.col("cursor_line")), F.lit(0)).alias("cursor_line"),
        F.coalesce("_last", F.when(~restarted, F.col("_anchor"))).alias("anchor_offset"), F.when(restarted, F.lit(number)).otherwise(F.coalesce("since", F.lit(number))).cast("long").alias("since"),
        F.coalesce("_open", F.when(~restarted, F.col("prefix_open")), F.lit(True)).alias("prefix_open"), F.lit("active").alias("status"),
    )
    gone = known.join(here.select("thread_id"), "thread_id", "left_anti").join(modes.where("mode = 'blocked'").select("thread_id"), "thread_id", "left_anti").withColumn("status", F.lit("missing"))
    still = records.open_lines(rows, provider, parsed if codex else None).join(own, "path").select("thread_id", "line", "json")
    rest = store.open_lines().join(own.select("thread_id"), "thread_id", "left_anti")
    store.commit(number, events=kept, threads=threads, cursors=cursors.unionByName(gone.select(*cursors.columns)), open=still.unionByName(rest), tombstones=store.tombstones())
    return modes


def appended(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A stream of complete lines appended below a folder."""
    lines.register(spark)
    return spark.readStream.format("transcript_lines").options(path=folder, **options).load()


def carried(stream: DataFrame) -> DataFrame:
    """Lines with their number in the file and the directory in force there; both are kept as state of each file between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        cwd, before = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("byte_offset")
        out = []
        for given in rows.given:
            cwd = given if isinstance(given, str) and given else cwd
            out.append(cwd)
        state.update((cwd, before + len(rows)))
        yield rows.assign(cwd=out, line=range(before + 1, before + len(rows) + 1))[["path", "line", "cwd", "raw"]]

    text = F.col("raw").cast("string")
    given = F.coalesce(F.get_json_object(text, "$.payload.cwd"), F.get_json_object(text, "$.cwd"))
    rows = stream.select("path", "byte_offset", given.alias("given"), text.alias("raw"))
    return rows.groupBy("path").applyInPandasWithState(run, "path string, line long, cwd string, raw string", "cwd string, lines long", "append", "NoTimeout")


def to_parquet(stream: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Writes each batch into its own partition, overwriting it if the batch is repeated."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def poll(store: Store, folder: str, checkpoint: str, seconds: int = 60, once: bool = False, **options):
    """A streaming query whose trigger runs a pass over the folder every so many seconds, or once.

    Its own rows are ticks without content. A pass commits events, cursors and open lines together, so a batch that is
    repeated after a failure finds what its first run committed and adds nothing twice; a pass that died left no marker.
    """
    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    if once:  # a rate source has nothing to give at its first moment
        ticks = store.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, number: run_pass(store, folder, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def merged(old: DataFrame, new: DataFrame, keys: list[str], changed: list[str]) -> DataFrame:
    """Upsert: new rows replace old ones of the same key; `changed` columns come from new, the rest is kept."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in changed or c in keys else F.coalesce(f"o.{c}", f"n.{c}")
    return o.join(n, cond, "full_outer").select(*(pick(c).alias(c) for c in old.columns))


def last_issue(old: DataFrame, new: DataFrame) -> DataFrame:
    """One issue per (source_id, line): the newest."""
    return old.unionByName(new).groupBy("source_id", "line").agg(F.max_by("code", "at").alias("code"), F.max("at").alias("at"))


def appended_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not there yet, once each."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def unchanged_imports(digests: DataFrame, known: DataFrame) -> DataFrame:
    """Conversations to import again, and those that only need a touch, by content digest."""
    both = digests.join(known.select("conversation", F.col("digest").alias("_old")), "conversation", "left")
    return both.select("conversation", F.when(F.col("_old").isNull(), "import").when(F.col("_old") == F.col("digest"), "touch").otherwise("replace").alias("action"))
