"""Sequence operators: turns, sizes, runs, interval folds, greedy window splits."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.shared import cut

MOST_LINES = 200


def turns(event: DataFrame) -> DataFrame:
    """A turn runs from a prompt to the line before the next prompt of its source (or the last line)."""
    w = Window.partitionBy("source_id").orderBy("line", "part")
    end = event.groupBy("source_id").agg(F.max("line").alias("_end"))
    starts = event.where("kind = 'prompt'").select("source_id", "line", "part")
    return starts.withColumn("_next", F.lead("line").over(w)).join(end, "source_id").select("source_id", F.col("line").alias("from_line"), F.coalesce(F.col("_next") - 1, "_end").alias("through_line"))


def line_sizes(event: DataFrame, end_offset: int | None = None) -> DataFrame:
    """Bytes of each line: the next indexed offset minus its own; the last one's is known only from the end offset."""
    rows = event.groupBy("source_id", "line").agg(F.min("byte_offset").alias("byte_offset"))
    after = F.lead("byte_offset").over(Window.partitionBy("source_id").orderBy("line"))
    return rows.withColumn("bytes", F.coalesce(after, F.lit(end_offset).cast("long")) - F.col("byte_offset"))


def forward_fill(event: DataFrame, column: str) -> DataFrame:
    """The last known value of a column along each source."""
    w = Window.partitionBy("source_id").orderBy("line", "part").rowsBetween(Window.unboundedPreceding, 0)
    return event.withColumn(column, F.last(column, ignorenulls=True).over(w))


def merge_ranges(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching integer ranges as one."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    island = marked.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(by, "_k").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_k")


def subtract_ranges(rows: DataFrame, gone: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """What the integer ranges of rows cover and those of gone do not, as disjoint ranges that do not touch.

    A sweep over the ends of all ranges: how many of either kind are open is a running sum, so ranges of a key never meet in
    pairs, and ends that share a place are summed before they travel. Ranges that are empty or lack an end cover nothing; rows with a null key go.
    """

    def ends(some: DataFrame, mine: int) -> DataFrame:
        real = some.where((F.col(start) <= F.col(end)) & F.col(by).isNotNull())
        edge = lambda at, way: F.struct(at.cast("long").alias("at"), F.lit(way * mine).alias("a"), F.lit(way * (1 - mine)).alias("g"))
        return real.select(by, F.inline(F.array(edge(F.col(start), 1), edge(F.col(end) + 1, -1))))

    w = Window.partitionBy(by).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = ends(rows, 1).unionByName(ends(gone, 0)).groupBy(by, "at").agg(F.sum("a").alias("a"), F.sum("g").alias("g"))
    opened = steps.select(by, F.col("at").alias(start), (F.lead("at").over(w) - 1).alias(end), F.sum("a").over(so_far).alias("a"), F.sum("g").over(so_far).alias("g"))
    return merge_ranges(opened.where("a > 0 and g = 0").select(by, start, end), by, start, end)


def within_ranges(rows: DataFrame, ranges: DataFrame, by: str, at: str, start: str, end: str) -> DataFrame:
    """rows whose `at` lies in one of its key's disjoint ranges, with that range's start. One ordered window over both, no pairs."""
    both = rows.select(by, at, F.struct(*rows.columns).alias("_row")).withColumn("_r", F.lit(None).cast(f"struct<a:{ranges.schema[start].dataType.simpleString()},b:{ranges.schema[end].dataType.simpleString()}>"))
    marks = ranges.select(by, F.col(start).cast(rows.schema[at].dataType).alias(at), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.struct(F.col(start).alias("a"), F.col(end).alias("b")).alias("_r"))
    w = Window.partitionBy(by).orderBy(at, F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.unionByName(marks).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return last.where(F.col("_row").isNotNull() & (F.col(at) <= F.col("_r.b"))).select("_row.*", F.col("_r.a").alias(start))


def advanced(rows: DataFrame, by: str, start: str, end: str, completed: int = 0) -> DataFrame:
    """How far each key is covered without a gap, counting from `completed`."""
    base = rows.select(by, start, end).unionByName(rows.select(by).distinct().select(by, F.lit(1).cast("long").alias(start), F.lit(completed).cast("long").alias(end)))
    return merge_ranges(base.where(F.col(end) >= completed), by, start, end).where(F.col(start) <= completed + 1).groupBy(by).agg(F.max(end).alias("completed"))


def scope_runs(event: DataFrame) -> DataFrame:
    """Maximal runs of successive lines with one scope; a run ends where the scope changes."""
    w = Window.partitionBy("source_id").orderBy("line", "part")
    marked = event.withColumn("_new", F.when(F.lag("scope_id").over(w).eqNullSafe(F.col("scope_id")) & (F.lag("flags").over(w).bitwiseAND(1) == F.col("flags").bitwiseAND(1)), 0).otherwise(1))
    runs = marked.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("source_id", "_k").agg(F.min("line").alias("from_line"), F.max("line").alias("through_line"), F.first("scope_id").alias("scope_id"), F.count("*").alias("events")).drop("_k")


def leading_run(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Events at a child's start that its parent also holds; the run ends at the first that it does not.

    child has child_id and parent_id, parent has source_id; `on` are the content columns.
    """
    known = parent.select(F.col("source_id").alias("parent_id"), *on).distinct().withColumn("_known", F.lit(True))
    marked = child.join(known, ["parent_id", *on], "left")
    first_new = F.min(F.when(F.col("_known").isNull(), F.struct("line", "part"))).over(Window.partitionBy("child_id"))
    return marked.withColumn("_stop", first_new).where(F.col("_stop").isNull() | (F.struct("line", "part") < F.col("_stop"))).drop("_known", "_stop")


def linked_outputs(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each output with the last call of the same id before it in its source."""
    both = calls.select("source_id", "call_id", "line", F.lit(1).alias("_out")).unionByName(outputs.select("source_id", "call_id", "line", F.lit(0).alias("_out")))
    # an output comes before calls of its own line
    earlier = F.max(F.when(F.col("_out") == 1, F.col("line"))).over(Window.partitionBy("source_id", "call_id").orderBy("line", "_out").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("call_line", earlier).where("_out = 0").select("source_id", "line", "call_id", "call_line").distinct()


def fit_from_end(lines: DataFrame, most_bytes: int, most_lines: int = MOST_LINES) -> DataFrame:
    """Per source, the first line from which everything to the end fits."""
    w = Window.partitionBy("source_id").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.withColumn("_b", F.sum("bytes").over(w)).withColumn("_n", F.count("*").over(w)).where((F.col("_b") <= most_bytes) & (F.col("_n") <= most_lines))
    return kept.groupBy("source_id").agg(F.min("line").alias("from_line"), F.count("*").alias("lines"), F.sum("bytes").alias("bytes"))


def followed(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, pos, step): the positions that pointers (by, pos, next) reach from position 1 of each key, step counting from 0.

    Pointers go forward. Joins double their reach, so that the rounds grow with the logarithm of the longest way.
    """
    jump = rows.where("next is not null").select(*by, "pos", "next")
    starts, reach = rows.where("pos = 1").select(*by, "pos", F.lit(0).cast("long").alias("step")), 1

    def led(left: DataFrame, column: str, *kept: Column) -> DataFrame:
        right = jump.select(*(F.col(c).alias(f"_{c}") for c in (*by, "pos", "next")))
        keys = reduce(and_, (left[c].eqNullSafe(right[f"_{c}"]) for c in by))
        return left.join(right, keys & (left[column] == right["_pos"])).select(*(left[c] for c in by), *kept)

    while True:
        new = cut(led(starts, "pos", F.col("_next").alias("pos"), (F.col("step") + reach).alias("step")))
        if not new.take(1):
            return starts
        starts = cut(starts.unionByName(new))
        jump, reach = cut(led(jump, "next", F.col("pos"), F.col("_next").alias("next"))), reach * 2


def split_windows(lines: DataFrame, most_bytes: int, most_lines: int = MOST_LINES, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Greedy windows of each source's lines (source_id, line, bytes, is_prompt), or of those of each key that `by` names.

    A window takes lines while both limits hold. Where it would cut a turn, it ends before the
    turn's prompt, if it holds an earlier one; the next window starts there. Where the next window
    starts depends on most_lines lines ahead only; these pointers are followed from each source's
    first line by joins that double their reach, so no task holds a source.
    """
    order = Window.partitionBy(*by).orderBy("line", "bytes", "is_prompt")
    line = F.struct("line", F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("b"), F.coalesce("is_prompt", F.lit(False)).alias("p"))
    rows = lines.select(*by, "line", F.row_number().over(order).cast("long").alias("pos"), F.collect_list(line).over(order.rowsBetween(0, most_lines)).alias("ahead"))
    more = lambda acc, x: acc["on"] & (acc["m"] < most_lines) & ((acc["m"] == 0) | (acc["used"] + x["b"] <= most_bytes))
    taken = F.aggregate(
        "ahead",
        F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("m"), F.lit(True).alias("on")),
        lambda acc, x: F.struct(F.when(more(acc, x), acc["used"] + x["b"]).otherwise(acc["used"]).alias("used"), F.when(more(acc, x), acc["m"] + 1).otherwise(acc["m"]).alias("m"), more(acc, x).alias("on")),
    )["m"]
    rows = rows.withColumn("m", taken)
    back = F.array_max(F.transform("ahead", lambda x, i: F.when(x["p"] & (i > 0) & (i < F.col("m")), i)))
    cuts_turn = (F.col("m") < F.size("ahead")) & ~F.try_element_at("ahead", F.col("m") + 1)["p"]
    rows = rows.withColumn("last", F.col("m") < F.size("ahead")).withColumn("m", F.when(cuts_turn, F.coalesce(back, "m")).otherwise(F.col("m")))
    size = F.aggregate(F.slice("ahead", 1, F.col("m")), F.lit(0).cast("long"), lambda acc, x: acc + x["b"])
    rows = cut(rows.select(*by, "pos", F.when(F.col("last"), F.col("pos") + F.col("m")).alias("next"), F.col("line").cast("long").alias("from_line"), F.element_at("ahead", F.col("m"))["line"].cast("long").alias("through_line"), F.col("m").cast("long").alias("lines"), size.alias("bytes")))

    starts = followed(rows, by)
    found = rows.select(*(F.col(c).alias(f"_{c}") for c in (*by, "pos")), "from_line", "through_line", "lines", "bytes")
    same = reduce(and_, (starts[c].eqNullSafe(found[f"_{c}"]) for c in (*by, "pos")))
    return starts.join(found, same).select(*(F.col(c).cast("long").alias(c) if c == "source_id" else c for c in by), F.col("step").alias("window"), "from_line", "through_line", "lines", "bytes")


def page_fill(items: DataFrame, order: list[str], size: str, most_bytes: int, most_items: int) -> DataFrame:
    """The leading items of a bounded, ordered answer that fit the budget; later ones are cut."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("_b", F.sum(size).over(w)).withColumn("_n", F.count("*").over(w)).where((F.col("_b") <= most_bytes) & (F.col("_n") <= most_items)).drop("_b", "_n")
