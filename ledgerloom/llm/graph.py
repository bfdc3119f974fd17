"""Connected components of an edge list as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut


ROWS_A_PARTITION = 200_000


HUBS, LEAST_HUB = 1_024, 1_000


def _star(pairs: DataFrame, large: bool, n_pairs: int) -> DataFrame:
    """One star step on rows (u, v): every considered neighbour of u, and u, is tied to the least of them.

    A hub is a vertex of more than n_pairs / HUBS (and LEAST_HUB) rows, so there are fewer than HUBS: their
    minima are broadcast, and their rows stay where they are. All others have few rows and meet theirs in a join.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n")).select("u", F.least("u", "_m").alias("_m"), "_n")
    is_hub = F.col("_n") > max(LEAST_HUB, n_pairs // HUBS)
    hubs = F.broadcast(low.where(is_hub).select("u", "_m"))
    marked = pairs.join(hubs, "u", "left")
    tied = marked.where(F.col("_m").isNotNull()).unionByName(marked.where(F.col("_m").isNull()).drop("_m").join(low.where(~is_hub).select("u", "_m"), "u"))
    if large:
        return tied.where((F.col("v") > F.col("u")) & (F.col("v") != F.col("_m"))).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    both = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("_m").alias("b")), F.struct(F.col("u").alias("a"), F.col("_m").alias("b"))))
    return tied.select(both.alias("p")).where("p.a != p.b").select(F.col("p.a").alias("u"), F.col("p.b").alias("v")).distinct()


def _unsettled(pairs: DataFrame) -> DataFrame:
    """Ids with two parents, or that are a parent and have one: none once every component is a star."""
    sides = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    n = pairs.select(sides.alias("s")).groupBy("s.id").agg(F.sum("s.up").alias("up"), F.sum("s.down").alias("down"))
    return n.where("up > 1 or up > 0 and down > 0").limit(1)


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge; component is the least id reachable.

    Alternating large-star and small-star steps; each is a grouped minimum and a join in which
    the rows of a vertex of high degree stay spread. Every round's edges go to the shared folder. Null ends are ignored; self loops yield their own component.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = pairs.where(F.col("u") == F.col("v")).select("u")
    now = cut(pairs.where(F.col("u") != F.col("v")))
    for _ in range(rounds):
        # few rows travel in few partitions, so that small graphs do not leave many tiny files
        n = now.count()
        now = now.coalesce(max(1, min(now.rdd.getNumPartitions(), -(-n // ROWS_A_PARTITION))))
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.*")
        now = cut(_star(_star(both, True, 2 * n), False, 2 * n))
        if not _unsettled(now).take(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("u")).unionByName(loops.join(now, "u", "left_anti")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.join(now.select("u").distinct(), "u", "left_anti").select(F.col("u").alias("id"), F.col("u").alias("component"))
    )
