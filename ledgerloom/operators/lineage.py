"""Walks over the fork and evidence graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.shared import cut

MOST_DEPTH = 128


def walk(start: DataFrame, edges: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(root, node, depth): everything reachable from start (root, node) over edges (node, next), or what lies within most_depth steps; loops end.

    Each level is a join of the newest nodes with the edges and an anti join with those
    already seen; levels go to the shared folder, so lineage stays short.
    """
    seen = cut(start.select("root", "node", F.lit(0).alias("depth")).distinct())
    newest = seen
    depth = 0
    while most_depth is None or depth < most_depth:
        depth += 1
        step = newest.join(edges, "node").select("root", F.col("next").alias("node")).distinct()
        newest = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not newest.take(1):
            return seen
        seen = cut(seen.unionByName(newest)) if depth % 8 == 0 else seen.unionByName(newest)
    return seen


def fork_edges(source: DataFrame) -> DataFrame:
    """(child, parent) thread ids; a missing parent stays a name."""
    return source.where("forked_from_id is not null").select("provider", F.col("thread_id").alias("child"), F.col("forked_from_id").alias("parent"))


def _starts(source: DataFrame, of: DataFrame | None) -> DataFrame:
    threads = source if of is None else of
    return threads.select(F.col("thread_id").alias("root"), F.col("thread_id").alias("node"))


def descendants(source: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(thread_id, descendant, depth) along forks, itself included; of all threads, or of those in `of` (thread_id)."""
    edges = fork_edges(source).select(F.col("parent").alias("node"), F.col("child").alias("next"))
    return walk(_starts(source, of), edges).select(F.col("root").alias("thread_id"), F.col("node").alias("descendant"), "depth")


def ancestors(source: DataFrame, of: DataFrame | None = None, most_depth: int | None = MOST_DEPTH) -> DataFrame:
    """(thread_id, ancestor, depth) along forks, itself included; a family has most_depth generations, None for all there are."""
    edges = fork_edges(source).select(F.col("child").alias("node"), F.col("parent").alias("next"))
    return walk(_starts(source, of), edges, most_depth).select(F.col("root").alias("thread_id"), F.col("node").alias("ancestor"), "depth")


def session_closure(source: DataFrame, session: str) -> DataFrame:
    """Threads to erase with a session: its threads, their forks, those forks' sessions, and so on."""
    fork = fork_edges(source).select(F.concat(F.lit("t:"), "parent").alias("node"), F.concat(F.lit("t:"), "child").alias("next"))
    own = source.select(F.concat(F.lit("s:"), "session_root").alias("node"), F.concat(F.lit("t:"), "thread_id").alias("next"))
    back = own.select(F.col("next").alias("node"), F.col("node").alias("next"))
    start = source.where(F.col("session_root") == session).select(F.lit(session).alias("root"), F.concat(F.lit("s:"), "session_root").alias("node")).distinct()
    got = walk(start, fork.unionByName(own).unionByName(back))
    return got.where(F.col("node").startswith("t:")).select(F.substr("node", F.lit(3)).alias("thread_id")).distinct()


def support_closure(start: DataFrame, support: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(node, depth) of labelled ids governed by start (node): evidence reaches the claims it supports, a version its unresolved items.

    Nothing leads on from an unresolved item or back to evidence, so two joins reach everything; each table of edges is read once.
    """
    begin = cut(start.select("node").distinct())
    at = lambda label: begin.where(F.col("node").startswith(label)).select("node", F.lit(0).alias("depth"))
    nearest = lambda rows: rows.groupBy("node").agg(F.min("depth").alias("depth"))
    versions = F.concat(F.lit("K:"), "knowledge_id", F.lit("@"), "revision")
    supported = support.join(begin.select(F.col("node").alias("_node")), F.concat(F.lit("E:"), "evidence_id") == F.col("_node"), "left_semi")
    version = cut(nearest(at("K:").unionByName(supported.select(versions.alias("node"), F.lit(1).alias("depth")))))
    affected = unresolved.select("unresolved_id", F.explode(F.array(F.struct(F.col("k1").alias("k"), F.col("r1").alias("r")), F.struct(F.col("k2").alias("k"), F.col("r2").alias("r")))).alias("a"))
    reached = affected.select("unresolved_id", F.concat(F.lit("K:"), "a.k", F.lit("@"), "a.r").alias("node")).join(version, "node")
    item = nearest(at("U:").unionByName(reached.select(F.concat(F.lit("U:"), "unresolved_id").alias("node"), (F.col("depth") + 1).alias("depth"))))
    other = begin.where(~F.coalesce(F.col("node").rlike("^[KU]:"), F.lit(False))).select("node", F.lit(0).alias("depth"))
    return other.unionByName(version).unionByName(item)
