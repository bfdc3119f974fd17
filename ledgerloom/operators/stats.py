"""Counts-only statistics and health predicates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def total(condition: Column) -> Column:
    """How many rows hold; 0 on no rows."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def flag_histogram(event: DataFrame) -> DataFrame:
    return event.agg(*(total(F.col("flags").bitwiseAND(bit) > 0).alias(name) for name, bit in (("marker", 1), ("redacted", 2), ("truncated", 4))))


def reread(source: DataFrame, version: int) -> DataFrame:
    """Active sources that an older classifier read, and all active ones."""
    return source.where("status = 'active'").agg(total(F.col("classifier_version") != version).alias("stale"), F.count("*").alias("active"))


def usage(calls: DataFrame, source_keys: list[str]) -> DataFrame:
    """Per key: calls, errors, last; the accumulate step of repeated passes."""
    return calls.groupBy(*source_keys).agg(F.count("*").alias("calls"), total(F.col("state") == "failed").alias("errors"), F.max("ts").alias("last_ts"))


def accumulate(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and maxima of two usage tables."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.max("last_ts").alias("last_ts"))


def usage_by_provider(used: DataFrame) -> DataFrame:
    return used.groupBy("provider").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.max("last_ts").alias("last_ts"), F.count_distinct("session_root").alias("sessions"))


def outcomes(calls: DataFrame) -> DataFrame:
    """Retrieval outcomes of the call log by command."""
    return calls.groupBy("cmd").agg(F.count("*").alias("calls"), total(F.col("matches") == 0).alias("none"), total((F.col("matches") > 0) & (F.col("returned") == 0)).alias("all_dropped"), F.sum("returned").alias("returned"))


def known_sum(value: Column) -> Column:
    """The sum if every row's value is known and there is one; else null."""
    return F.when((F.count("*") > 0) & (F.count_if(value.isNull()) == 0), F.sum(value))


def known_cost(cost: Column, currency: Column) -> Column:
    """The sum where all rows have one and the same known currency."""
    return F.when((F.count_if(currency.isNull() | cost.isNull()) == 0) & (F.count_distinct(currency) == 1), F.sum(cost))


def review_usage(calls: DataFrame, *by: str) -> DataFrame:
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), known_sum(F.col("input_tokens")).alias("input_tokens"), F.round(known_cost(F.col("value"), F.col("currency")), 4).alias("cost"))


def ages(requests: DataFrame, now: float) -> DataFrame:
    """Age of the oldest waiting request and of the last progress; null where there is none."""
    oldest, last = F.min(F.when(F.col("state") == "queued", F.col("created_at"))), F.max("created_at")
    return requests.agg(F.when(oldest.isNotNull(), F.greatest(F.lit(0.0), F.lit(now) - oldest)).alias("oldest_age"), F.when(last.isNotNull(), F.lit(now) - last).alias("progress_age"))


def logical_records(evidence: DataFrame) -> DataFrame:
    """One row per (source_id, line); its digest only if all parts agree."""
    return evidence.groupBy("source_id", "line").agg(F.when(F.count_distinct("sha") == 1, F.min("sha")).alias("sha"), F.count("*").alias("parts"))


def in_window(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records that a request's line range covers (semi join on thread and range)."""
    r = requests.select("provider", "thread_id", "from_line", "through_line")
    hit = (records["provider"] == r["provider"]) & (records["thread_id"] == r["thread_id"]) & records["line"].between(r["from_line"], r["through_line"])
    return records.join(r, hit, "left_semi")


def not_in_window(records: DataFrame, requests: DataFrame) -> DataFrame:
    r = requests.select("provider", "thread_id", "from_line", "through_line")
    hit = (records["provider"] == r["provider"]) & (records["thread_id"] == r["thread_id"]) & records["line"].between(r["from_line"], r["through_line"])
    return records.join(r, hit, "left_anti")


def coverage(records: DataFrame, requests: DataFrame) -> DataFrame:
    """eligible, receipted and gap counts of logical records, by provider."""
    done = in_window(records, requests.where("state = 'completed'")).groupBy("provider").agg(F.count("*").alias("receipted"))
    every = records.groupBy("provider").agg(F.count("*").alias("eligible"))
    return every.join(done, "provider", "left").select("provider", "eligible", F.coalesce("receipted", F.lit(0)).alias("receipted"), (F.col("eligible") - F.coalesce("receipted", F.lit(0))).alias("gap"))


def health(requests: DataFrame, now: float, deadline: float) -> DataFrame:
    """Counts by deadline and outcome."""
    age = F.lit(now) - F.col("created_at")
    return requests.agg(
        total((F.col("state") == "queued") & (age > deadline)).alias("late"), total((F.col("state") == "queued") & (F.coalesce("retry_at", F.lit(0.0)) > now)).alias("backing_off"),
        total(F.col("state") == "failed").alias("failed"), total((F.col("state") == "completed") & (F.col("trigger") == "history")).alias("history_done"), F.count("*").alias("requests"),
    )


def next_request(requests: DataFrame, now: float) -> DataFrame:
    """The queued request to claim: live before history, oldest first, retries only when due."""
    due = requests.where((F.col("state") == "queued") & (F.col("retry_at").isNull() | (F.col("retry_at") <= now)))
    return due.orderBy(F.when(F.col("trigger") == "history", 1).otherwise(0), "created_at", "request_id").limit(1)


def budget(charges: DataFrame, most_rounds: int, most_cost) -> DataFrame:
    """Exact sums per request; a call that did not complete counts its larger known charge."""
    cost = F.when(F.col("state") == "completed", F.coalesce("reported", "reserved")).otherwise(F.greatest("reserved", F.coalesce("reported", "reserved")))
    out = charges.groupBy("request").agg(F.count("*").alias("rounds"), F.sum(cost).cast("decimal(38,2)").alias("cost"), F.sum("seconds").alias("seconds"))
    return out.withColumn("verdict", F.when(F.col("rounds") > most_rounds, "rounds").when(F.col("cost") > F.lit(most_cost).cast("decimal(38,2)"), "cost").otherwise("ok"))


def recent_estimate(charges: DataFrame, most: int = 50) -> DataFrame:
    """Median duration and mean cost of the last completed calls."""
    last = charges.where("state = 'completed'").orderBy(F.desc("request"), F.desc("round")).limit(most)
    return last.agg(F.median("seconds").alias("median_seconds"), F.round(F.avg(F.coalesce("reported", "reserved").cast("double")), 6).alias("mean_cost"), F.count("*").alias("calls"))


def nearest_rank(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99), by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at rank ceil(p * n), from counts per distinct value."""
    by = by or []
    freq = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    at = freq.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    return at.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares), F.max(value).alias("max"))


def snapshot(rows: DataFrame, *columns: str, by: str) -> DataFrame:
    """A digest of each group's ordered rows: equal digests, equal content. Rows stream through the hash, so no task holds a group."""
    line = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))
    dealt = rows.select(F.col(by), line.alias("_line")).repartition(by).sortWithinPartitions(by, "_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([now, pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=[by, "digest", "n"])

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                key = batch.column(0).slice(i, 1)
                if now is None or key != now:
                    if now is not None:
                        yield done()
                    now, digest, n = key, hashlib.sha256(), 0
                digest.update(("\n" if n else "").encode() + text.as_py().encode())
                n += 1
        if now is not None:
            yield done()

    return dealt.mapInArrow(run, rows.select(by).schema.add("digest", "string").add("n", "long"))


def table_digest(rows: DataFrame) -> DataFrame:
    """Order-free check of a copy: row count and the sum of 60 bits of each row's SHA-256, over length-framed values."""
    framed = [F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in rows.columns]
    h = F.conv(F.left(F.sha2(F.concat_ws("|", *framed), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def ratings(reports: DataFrame, key: str, rating: str, values: list) -> DataFrame:
    """Counts of each rating by key, zero where none."""
    return reports.groupBy(key).pivot(rating, values).count().na.fill(0)


def doctor(event: DataFrame, source: DataFrame, version: int) -> DataFrame:
    """One row per data-derived check: name, level, ok, count."""
    checks = [
        ("missing_sources", "warning", source.where("status = 'missing'")),
        ("other_threads", "info", source.where("thread_class not in ('primary', 'subagent')")),
        ("reread_pending", "warning", source.where((F.col("status") == "active") & (F.col("classifier_version") < version))),
        ("orphan_events", "error", event.join(source, "source_id", "left_anti")),
        ("skipped_lines", "info", source.where("skipped_lines > 0")),
    ]
    out = None
    for name, level, found in checks:
        row = found.agg(F.lit(name).alias("name"), F.lit(level).alias("level"), (F.count("*") == 0).alias("ok"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def nearest_unique(reports: DataFrame, requests: DataFrame, within: float) -> DataFrame:
    """Reports matched to the only request of the same key whose time is within the band."""
    met = reports.join(requests, "key").where(F.abs(F.col("at") - F.col("created_at")) <= within)
    return met.withColumn("_k", F.count("*").over(Window.partitionBy("report_id"))).where("_k = 1").select("report_id", "request_id")


def first_after(requests: DataFrame, marks: DataFrame, stops: DataFrame) -> DataFrame:
    """For each request (key, at) the first mark after it that comes before the key's next stop."""
    kind = lambda df, code, ref: df.select("key", "at", F.lit(code).alias("what"), ref.cast("string").alias("ref"))
    rows = kind(stops, 0, F.lit(None)).unionByName(kind(requests, 1, F.col("id"))).unionByName(kind(marks, 2, F.col("id")))
    w = Window.partitionBy("key").orderBy("at", "what").rowsBetween(1, Window.unboundedFollowing)
    nxt = lambda k: F.first(F.when(F.col("what") == k, F.struct("at", "ref")), ignorenulls=True).over(w)
    got = rows.withColumn("mark", nxt(2)).withColumn("stop", nxt(0)).where("what = 1")
    return got.select("key", F.col("ref").alias("id"), F.when(F.col("stop").isNull() | (F.col("mark.at") < F.col("stop.at")), F.col("mark.ref")).alias("mark_id"))
