"""Erasure: what a request covers, what remains after it, and whether any of it is left."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.errors import QueryError
from ledgerloom.functions import text as X
from ledgerloom.operators import family, lineage
from ledgerloom.sources import lines

LEAST_MATCH, NEEDLES, LEAST_NEEDLE, NEEDLE_BYTES, RARE = 4, 50, 12, 48, 3
TOMB = ["provider", "level", "session_root", "thread_id", "line", "line_sha256"]


def plan_session(event: DataFrame, source: DataFrame, session: str) -> DataFrame:
    """Events of the session's threads and of everything forked from them, transitively."""
    threads = lineage.session_closure(source, session)
    doomed = source.join(threads, "thread_id", "left_semi").select("source_id")
    return event.join(doomed, "source_id", "left_semi")


def plan_event(event: DataFrame, source: DataFrame, source_id: int, line: int) -> DataFrame:
    """All parts of a line and of the lines that copy it in the family."""
    at = event.where((F.col("source_id") == source_id) & (F.col("line") == line))
    copies = family.copies_of(event, source, at).select("source_id", "line").distinct()
    return at.unionByName(event.join(copies, ["source_id", "line"], "left_semi").select(*event.columns)).dropDuplicates(["id"])


def plan_match(event: DataFrame, needle: str) -> DataFrame:
    if len(needle) < LEAST_MATCH:
        raise QueryError("match_too_short", needle)
    return event.where(F.instr("text", needle) > 0)


def remaining(event: DataFrame, doomed: DataFrame) -> DataFrame:
    return event.join(doomed.select("id"), "id", "left_anti")


def dry_run(doomed: DataFrame) -> DataFrame:
    return doomed.agg(F.count("*").alias("events"), F.count_distinct("source_id").alias("threads"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


def tombstones(doomed: DataFrame, source: DataFrame) -> DataFrame:
    return doomed.join(source, "source_id").select("provider", F.lit("line").alias("level"), "session_root", "thread_id", "line", X.record_hash(F.col("text")).alias("line_sha256")).distinct()


def blocked(event: DataFrame, source: DataFrame, tombstone: DataFrame) -> DataFrame:
    """Events that no tombstone forbids: neither their thread's, nor their line's."""
    rows = event.join(source.select("source_id", "provider", "thread_id"), "source_id")
    by_thread = tombstone.where("level = 'thread'").select("provider", "thread_id").distinct()
    by_line = tombstone.where("level = 'line'").select("provider", "thread_id", "line").distinct()
    return rows.join(by_thread, ["provider", "thread_id"], "left_anti").join(by_line, ["provider", "thread_id", "line"], "left_anti")


def barred(thread: DataFrame, known: DataFrame, tombstone: DataFrame) -> DataFrame:
    """The threads that may not be indexed, before any of their lines is read.

    thread: provider, thread_id, session_root, continues (a thread, or null), forked_from_id and what else identifies it.
    A tombstone of the thread or of the one it continues bars it, and one of its session, of the session that its
    fork names, or of the session of the thread it was forked from, as far as `known` (provider, thread_id, session_root) tells.
    """
    marks = tombstone.where("level in ('thread', 'session')").select("provider", "level", F.when(F.col("level") == "thread", F.col("thread_id")).otherwise(F.col("session_root")).alias("id")).distinct()
    parent = known.select("provider", F.col("thread_id").alias("forked_from_id"), F.col("session_root").alias("_session")).dropDuplicates(["provider", "forked_from_id"])
    named = lambda level, c: F.struct(F.lit(level).alias("level"), F.col(c).alias("id"))
    asked = thread.join(parent, ["provider", "forked_from_id"], "left").select(*thread.columns, F.explode(F.array(named("thread", "thread_id"), named("thread", "continues"), named("session", "session_root"), named("session", "forked_from_id"), named("session", "_session"))).alias("_n"))
    return asked.select(*thread.columns, "_n.*").join(marks, ["provider", "level", "id"], "left_semi").select(*thread.columns).distinct()


def missing(journal: DataFrame, table: DataFrame) -> DataFrame:
    """Journal rows that the table lacks; null equals null."""
    same = F.lit(True)
    for c in TOMB:
        same = same & journal[c].eqNullSafe(table[c])
    return journal.join(table, same, "left_anti").distinct()


def replay_plan(event: DataFrame, source: DataFrame, tombstone: DataFrame) -> DataFrame:
    """Indexed events that line tombstones name: what a replay still has to delete."""
    rows = event.join(source.select("source_id", "provider", "thread_id"), "source_id")
    return rows.join(tombstone.where("level = 'line'").select("provider", "thread_id", "line").distinct(), ["provider", "thread_id", "line"])


def needles(doomed: DataFrame) -> DataFrame:
    """Beginnings of the longest distinct erased texts, to look for afterwards."""
    texts = doomed.select("text").distinct().where(F.octet_length("text") >= LEAST_NEEDLE)
    top = texts.orderBy(F.desc(F.octet_length("text")), "text").limit(NEEDLES)
    return top.select(F.left("text", F.lit(NEEDLE_BYTES)).alias("needle")).distinct()


def survivors(kept: DataFrame, needle: DataFrame) -> DataFrame:
    """Kept events that hold a needle; there are at most NEEDLES of them, so they travel to the events."""
    return kept.join(F.broadcast(needle), F.contains(kept["text"], needle["needle"]), "left_semi")


def residue(spark: SparkSession, folder: str, needle: DataFrame, **how) -> DataFrame:
    """(path, needle, at) of needles that files below a folder still hold, as they are and as JSON writes them; at most NEEDLES go to the driver."""
    plain = [r["needle"] for r in needle.limit(NEEDLES).collect()]
    # within a JSON string quotes, breaks and, in some writers, all but ASCII are escaped
    return lines.holding(spark, folder, sorted({form for n in plain for form in (n, json.dumps(n)[1:-1], json.dumps(n, ensure_ascii=False)[1:-1])}), **how)


def rare_terms(index: DataFrame, doomed: DataFrame) -> DataFrame:
    """Terms in at most RARE erased events and in no other: they must vanish from the vocabulary."""
    pairs = index.select("id", "term").distinct()
    gone = pairs.join(doomed.select("id"), "id", "left_semi").groupBy("term").agg(F.count("*").alias("erased")).where(F.col("erased") <= RARE)
    every = pairs.groupBy("term").agg(F.count("*").alias("df"))
    return gone.join(every, "term").where("erased = df").select("term", "erased")


def scrubbed(version: DataFrame, governed: DataFrame, now: float) -> DataFrame:
    """Versions with the content of governed (knowledge_id, revision) removed."""
    hit = governed.select("knowledge_id", "revision").distinct().withColumn("_hit", F.lit(True))
    return version.join(hit, ["knowledge_id", "revision"], "left").withColumn("content", F.when(F.col("_hit").isNull(), F.col("content"))).withColumn("erased_at", F.when(F.col("_hit"), F.lit(now))).drop("_hit")


def last_parent_state(source: DataFrame) -> DataFrame:
    """Forks whose parent is not indexed: they stay unverified until it arrives."""
    known = source.select(F.col("thread_id").alias("forked_from_id"), F.lit(True).alias("_known"))
    return source.where("forked_from_id is not null").join(known, "forked_from_id", "left").select("thread_id", "forked_from_id", F.when(F.col("_known"), "verified").otherwise("unverified").alias("fork_state"))


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
