"""Session lists, timelines, neighbours and point-in-time lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.filters import MARKER, from_key, joined

MOST_SESSIONS, MOST_TIMELINE, MOST_CONTEXT = 100, 200, 20
ORDER = ("_ts", "thread_id", "line", "part")
SESSION = ["provider", "session_root"]


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_ts", F.coalesce("ts", F.lit("")))


def sessions(event: DataFrame, source: DataFrame, scope: DataFrame, since: str | None = None, limit: int = 20) -> DataFrame:
    """Newest sessions first, one grouped pass over their primary events and one over all threads.

    A row beyond the limit tells that there are more, as column has_more.
    """
    limit = max(1, min(limit, MOST_SESSIONS))
    rows = _ordered(joined(event, source, scope).where("thread_class = 'primary'"))
    first = F.min_by(F.struct(X.preview(F.col("text"), 120, 500).alias("text"), (F.col("flags").bitwiseAND(MARKER) > 0).alias("marked")), F.when(F.col("kind") == "prompt", F.struct(*ORDER)))
    by = rows.groupBy(*SESSION).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"), F.min("label").alias("scope"), first.alias("_p"), F.count_if(F.col("kind") == "prompt").alias("prompts"))
    if since is not None:
        by = by.where(F.col("last_ts") >= since)
    top = by.orderBy(F.desc("last_ts"), "session_root", "provider").limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.desc("last_ts"), "session_root", "provider"))
    top = top.withColumn("_k", place).withColumn("has_more", F.max("_k").over(Window.partitionBy()) > limit).where(F.col("_k") <= limit)
    threads = source.groupBy(*SESSION).agg(F.count("*").alias("threads"), F.count("forked_from_id").alias("forks"), F.bool_or(F.col("status") == "active").alias("active"))
    return top.join(threads, SESSION).select(*SESSION, "first_ts", "last_ts", "events", "scope", "threads", "forks", F.when(F.col("active"), "active").otherwise("missing").alias("status"), F.when(F.col("prompts") > 0, F.col("_p.text")).alias("first_prompt"), F.when(F.col("prompts") > 0, F.col("_p.marked")).alias("marked"), "has_more")


def kind_histogram(event: DataFrame, source: DataFrame) -> DataFrame:
    """Events per kind of each session's primary threads, as a map."""
    n = joined(event, source).where("thread_class = 'primary'").groupBy(*SESSION, "kind").agg(F.count("*").alias("n"))
    return n.groupBy(*SESSION).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def thread_stats(source: DataFrame) -> DataFrame:
    return source.groupBy(*SESSION).agg(F.count("*").alias("threads"), F.count("forked_from_id").alias("forks"), F.count_if(F.col("status") == "active").alias("active"))


def timeline(event: DataFrame, source: DataFrame, session: str, limit: int = 50, after: list | None = None) -> DataFrame:
    """A session's events in order from a key (ts or '', thread, line, part) on, with the key of the next page."""
    limit = max(1, min(limit, MOST_TIMELINE))
    rows = _ordered(joined(event, source).where(F.col("session_root") == session))
    if after is not None:
        rows = rows.where(from_key(list(ORDER), after))
    top = rows.orderBy(*ORDER).limit(limit + 1)
    w = Window.orderBy(*ORDER)
    out = top.withColumn("_k", F.row_number().over(w)).withColumn("next_from", F.max(F.when(F.col("_k") > limit, F.format_string("%s|%s|%d.%d", *ORDER))).over(Window.partitionBy())).where(F.col("_k") <= limit)
    return out.select("id", "ts", "thread_id", "line", "part", "kind", X.preview(F.col("text"), 80, 500).alias("preview"), "next_from")


def neighbours(event: DataFrame, pivot: DataFrame, n: int = 3) -> DataFrame:
    """Up to n events before and after each pivot (pivot_id, source_id, line, part) with their signed distance.

    One ordered pass over both tells each pivot how many events come before it; the events near it
    are then an equi join on their place, so a source's pivots do not meet all of its events.
    """
    n = max(0, min(n, MOST_CONTEXT))
    order = Window.partitionBy("source_id").orderBy("line", "part")
    placed = event.withColumn("_r", F.row_number().over(order)).select("source_id", "_r", "id", "line", "part", "kind")
    both = event.select("source_id", "line", "part", F.lit(1).alias("_e"), F.lit(None).cast("long").alias("pivot_id")).unionByName(pivot.select("source_id", "line", "part", F.lit(0).alias("_e"), F.col("pivot_id").cast("long")))
    upto, here = F.sum("_e").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("_e").over(Window.partitionBy("source_id", "line", "part"))
    asked = both.withColumn("_upto", upto).withColumn("_before", upto - here).where("_e = 0")
    near = asked.select("source_id", "pivot_id", "_upto", "_before", F.explode(F.sequence(F.col("_before") - n + 1, F.col("_upto") + n)).alias("_r"))
    rel = F.when(F.col("_r") <= F.col("_before"), F.col("_r") - F.col("_before") - 1).when(F.col("_r") > F.col("_upto"), F.col("_r") - F.col("_upto")).otherwise(0)
    return near.join(placed, ["source_id", "_r"]).select("pivot_id", rel.cast("int").alias("rel"), "id", "line", "part", "kind")


def scope_as_of(event: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (source_id, at_line), the scope of the last event at or before it: one ordered pass over both."""
    marks = event.select("source_id", F.col("line").alias("_l"), F.lit(0).alias("_q"), F.col("part").cast("long").alias("_p"), "scope_id")
    asks = points.select("source_id", F.col("at_line").alias("_l"), F.lit(1).alias("_q"), F.lit(0).cast("long").alias("_p"), F.lit(None).cast("long").alias("scope_id"))
    last = F.last("scope_id", ignorenulls=True).over(Window.partitionBy("source_id").orderBy("_l", "_q", "_p").rowsBetween(Window.unboundedPreceding, 0))
    return marks.unionByName(asks).withColumn("scope_id", last).where("_q = 1").select("source_id", F.col("_l").alias("at_line"), "scope_id")


def longest_prefix(paths: DataFrame, scope: DataFrame) -> DataFrame:
    """For each cwd the scope with the longest key that is the directory itself or one above it."""
    up = paths.select("cwd").distinct().withColumn("_parts", F.split("cwd", "/"))
    above = up.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.array_join(F.slice("_parts", F.lit(1), n), "/"))))
    return above.join(scope.select("key", "scope_id"), "key").groupBy("cwd").agg(F.max_by("scope_id", F.length("key")).alias("scope_id"))


def resume_line(event: DataFrame, tombstone: DataFrame, source: DataFrame) -> DataFrame:
    """The last line of each source that is indexed or tombstoned."""
    erased = tombstone.where("line is not null").join(source, ["provider", "thread_id"]).select("source_id", "line")
    return event.select("source_id", "line").unionAll(erased).groupBy("source_id").agg(F.max("line").alias("line"))
