"""Fork families: ancestors, members, the run of inherited events that a fork starts with, and copies of erased content.

A fork names its parent's thread; both belong to one provider. Walks end at loops and at
parents that are not stored. Everything starts from the threads that are asked about, so that a
request touches the events of its own families only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.lineage import walk
from ledgerloom.shared import cut


def parents(source: DataFrame) -> DataFrame:
    """(source_id, parent_id) of forks whose parent is stored."""
    child = source.where("forked_from_id is not null").select("provider", F.col("forked_from_id").alias("thread_id"), "source_id")
    return child.join(source.select("provider", "thread_id", F.col("source_id").alias("parent_id")), ["provider", "thread_id"]).select("source_id", "parent_id")


def ancestors(source: DataFrame, of: DataFrame) -> DataFrame:
    """(source_id, ancestor_id) of the sources in `of` (source_id), without themselves."""
    start = of.select(F.col("source_id").alias("root"), F.col("source_id").alias("node"))
    up = walk(start, parents(source).select(F.col("source_id").alias("node"), F.col("parent_id").alias("next")))
    return up.where("depth > 0 and root != node").select(F.col("root").alias("source_id"), F.col("node").alias("ancestor_id"))


def members(source: DataFrame, of: DataFrame) -> DataFrame:
    """(root, source_id, older): the ancestors of the sources in `of` (source_id), and every fork, direct or not, of these and of the root."""
    up = cut(ancestors(source, of).select(F.col("source_id").alias("root"), F.col("ancestor_id").alias("node")))
    start = up.unionByName(of.select(F.col("source_id").alias("root"), F.col("source_id").alias("node")))
    down = walk(start, parents(source).select(F.col("parent_id").alias("node"), F.col("source_id").alias("next")))
    older = up.select("root", "node", F.lit(True).alias("_up")).distinct()
    every = down.select("root", "node").distinct().join(older, ["root", "node"], "left")
    return every.where("root != node").select("root", F.col("node").alias("source_id"), F.col("_up").isNotNull().alias("older"))


def before_first(rows: DataFrame, holds: str, by: str = "source_id") -> DataFrame:
    """The rows (line, part) of each source before its first one that lacks `holds`."""
    stop = rows.groupBy(by).agg(F.min(F.when(~F.col(holds), F.struct("line", "part"))).alias("_stop"))
    place = F.struct(F.col("line"), F.col("part"))
    return rows.join(stop, by).where(F.col("_stop").isNull() | (place < F.col("_stop"))).drop("_stop")


def replayed(event: DataFrame, source: DataFrame, of: DataFrame) -> DataFrame:
    """Events at the start of the sources in `of` (source_id) that repeat any of their ancestors' events, up to the first that does not."""
    up = cut(ancestors(source, of))
    told = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    known = event.select(F.col("source_id").alias("ancestor_id"), told.alias("_told")).join(up, "ancestor_id").select("source_id", "_told", F.lit(True).alias("_known")).distinct()
    own = event.join(up.select("source_id").distinct(), "source_id", "left_semi").withColumn("_told", told)
    marked = own.join(known, ["source_id", "_told"], "left").withColumn("_known", F.col("_known").isNotNull())
    return before_first(marked, "_known").select(*event.columns)


def copies_of(event: DataFrame, source: DataFrame, doomed: DataFrame) -> DataFrame:
    """Events of other members of a doomed event's family with its role and text: all of an ancestor's, of others those within the replayed run."""
    named = cut(doomed.select(F.col("source_id").alias("root"), "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text")).distinct())
    family = cut(members(source, named.select(F.col("root").alias("source_id")).distinct()))
    asked = family.join(named, "root").select("source_id", "older", "role", "_text").distinct()
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    same = lambda rows, older: rows.withColumn("_text", digest).join(asked.where(F.col("older") == older), ["source_id", "role", "_text"], "left_semi").select(*event.columns)
    run = replayed(event, source, family.where("not older").select("source_id").distinct())
    return same(event, True).unionByName(same(run, False)).distinct()


def uncovered(event: DataFrame, source: DataFrame, tombstone: DataFrame) -> DataFrame:
    """(source_id, reason) of stored sources that keep a replay of tombstones from being complete.

    A source named by a thread or session tombstone goes whole and is no obstacle. Of the others: `copy`, it holds a
    copy of a tombstoned line that no line tombstone names; `history`, it descends from a tombstoned session or
    continues a tombstoned thread; `ancestor`, a tombstoned line is of an ancestor that is not stored, and none is its own.
    """
    mark = tombstone.select("provider", "level", "session_root", "thread_id", "line", "line_sha256")
    threads = mark.where("level = 'thread'").select("provider", "thread_id").distinct()
    sessions = mark.where("level = 'session'").select("provider", "session_root").distinct()
    going = source.join(threads, ["provider", "thread_id"], "left_semi").select("source_id").unionByName(source.join(sessions, ["provider", "session_root"], "left_semi").select("source_id")).distinct()
    left = cut(source.join(going, "source_id", "left_anti"))
    lines = mark.where("level = 'line'").select("provider", "thread_id", "line", "line_sha256").distinct()
    named = cut(event.join(source.select("source_id", "provider", "thread_id"), "source_id").join(lines.select("provider", "thread_id", "line").distinct(), ["provider", "thread_id", "line"], "left_semi").select(*event.columns))
    copies = copies_of(event, source, named).join(named.select("source_id", "line").distinct(), ["source_id", "line"], "left_anti").join(going, "source_id", "left_anti")
    up = ancestors(source, left.select("source_id"))
    of_session = up.join(source.join(sessions, ["provider", "session_root"], "left_semi").select(F.col("source_id").alias("ancestor_id")), "ancestor_id").select("source_id")
    continues = left.join(threads.withColumnRenamed("thread_id", "parent_thread_id"), ["provider", "parent_thread_id"], "left_semi").select("source_id")
    # the last stored ancestor (or the fork itself) names a parent that is not stored but has tombstoned lines
    stored = source.select("provider", F.col("thread_id").alias("forked_from_id"))
    absent = source.where("forked_from_id is not null").join(stored, ["provider", "forked_from_id"], "left_anti").join(lines.select("provider", F.col("thread_id").alias("forked_from_id")).distinct(), ["provider", "forked_from_id"], "left_semi").select("source_id")
    below = up.join(absent.withColumnRenamed("source_id", "ancestor_id"), "ancestor_id").select("source_id").unionByName(absent).distinct()
    orphans = left.select("source_id", "provider", "thread_id").join(below, "source_id", "left_semi").join(lines.select("provider", "thread_id").distinct(), ["provider", "thread_id"], "left_anti")
    why = lambda rows, reason: rows.select("source_id", F.lit(reason).alias("reason")).distinct()
    return why(copies, "copy").unionByName(why(of_session.unionByName(continues), "history")).unionByName(why(orphans, "ancestor")).distinct()


def replayable(event: DataFrame, source: DataFrame, tombstone: DataFrame) -> DataFrame:
    """(source_id, family, refused) of the families that tombstones touch: a family with an uncovered member is refused as a whole."""
    obstacles = cut(uncovered(event, source, tombstone))
    mark = tombstone.select("provider", "thread_id", "session_root")
    touched = source.join(mark.select("provider", "thread_id"), ["provider", "thread_id"], "left_semi").select("source_id").unionByName(source.join(mark.where("session_root is not null").select("provider", "session_root"), ["provider", "session_root"], "left_semi").select("source_id")).unionByName(obstacles.select("source_id")).distinct()
    up = parents(source)
    both = up.select(F.col("source_id").alias("node"), F.col("parent_id").alias("next")).unionByName(up.select(F.col("parent_id").alias("node"), F.col("source_id").alias("next")))
    reached = walk(touched.select(F.col("source_id").alias("root"), F.col("source_id").alias("node")), both)
    family = reached.groupBy(F.col("root").alias("source_id")).agg(F.min("node").alias("family"))
    refused = family.join(obstacles, "source_id").select("family").distinct().withColumn("refused", F.lit(True))
    return family.join(refused, "family", "left").select("source_id", "family", F.coalesce("refused", F.lit(False)).alias("refused"))
