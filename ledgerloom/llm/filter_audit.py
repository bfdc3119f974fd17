"""What each filter of a set does alone, after the others and over all orders of them.

A document's failures are a mask of five bits. Documents are counted by part and mask, once
all of them and once those of each label: a few rows of 32 numbers per part, the only
thing that is gathered. Every order of the filters and every step of it is a column of
a matrix (32 masks x 600 columns) for each outcome: kept, removed, redundant, unique. The
histograms times the matrices are the answer, so 120 orders cost what one does.

Texts that repeat are found by a digest (SHA-256): the least doc_id of each is a grouped
minimum, and digests of very many rows are told to all tasks, so that no task holds the copies of one
text.

Defined results: a null text counts as empty, a null part as the empty string; an empty
text fails A only (and E, if it repeats); a null doc_id is not smaller than any and no
doc_id is smaller than it; rows that share a doc_id count each and do not make each other
fail E; of several labels of a doc_id any 1 counts; an empty table gives an empty
result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, join_hot, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def matrices() -> dict[str, np.ndarray]:
    """For each outcome a matrix of 0 and 1: a row per mask, a column per order and step."""
    mask = np.arange(MASKS)[:, None]
    bit = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    own = bit.reshape(1, -1)
    before = (np.cumsum(bit, axis=1) - bit).reshape(1, -1)
    fails, free = (mask & own) > 0, (mask & before) == 0
    made = {"kept": free & ~fails, "removed": free & fails, "redundant": ~free & fails, "unique_fails": mask == own}
    return {k: v.astype(np.int64) for k, v in made.items()}


def text_failures(text: Column) -> Column:
    """The bits of A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    tests = [n < WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n, 100 * capitals > CAPITALS_PERCENT * F.char_length(text), text.rlike(SYMBOLS)]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def masked(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) per row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text_failures(text).alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = cut(narrow)  # texts are read once
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    both = join_hot(rows, least, "digest", "size")
    repeats = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return both.select("doc_id", "part", (F.col("bits") + F.when(repeats, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, counts of COUNTS): 600 rows per part."""
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    flags = masked(docs, part).join(told, "doc_id", "left")
    counted = flags.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    stacked = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matrices()
        steps = len(FILTERS)
        order, step = np.repeat(ORDERS, steps), np.tile(np.arange(1, steps + 1, dtype=np.int32), len(ORDERS))
        letter = np.array([FILTERS.index(f) for o in ORDERS for f in o])
        for batch in batches:
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.zeros((3, MASKS), np.int64)
                for h in held:
                    rows[:, h["mask"]] = h["n"], h["good"], h["toxic"]
                every = {k: rows[0] @ v for k, v in m.items()}
                _, every["good_lost"], every["toxic_lost"] = rows @ m["removed"]
                shares = np.zeros(steps, np.int64)
                np.add.at(shares, letter, every["removed"])
                every["shapley"] = shares[letter]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(order), pa.string()), pa.array(order.tolist(), pa.string()), pa.array(step), *(pa.array(every[c]) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS])

    return stacked.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a, x b, x d, x e, x g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, step, list_sum([1 << (ascii(y) - 65) for y in string_split(filter_order[1:step - 1], '') if y <> ''])::INT AS before, (1 << (ascii(filter_order[step]) - 65))::INT AS own
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & coalesce(before, 0) = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & coalesce(before, 0) > 0 AND mask & own > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & coalesce(before, 0) = 0 AND mask & own > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & coalesce(before, 0) = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
  FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
