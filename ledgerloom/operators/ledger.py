"""The knowledge ledger: what is current, supported, applicable; and its state transitions.

Tables are frames; a transition returns the new rows of the tables it changes, so that a caller
publishes them together. Repeating a transition changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.filters import scope_applies, unexpired

KEY = ["knowledge_id", "revision"]
START_ORDER = {"decision": 0, "preference": 0, "constraint": 1, "procedure": 1, "fact": 2}


def current(knowledge: DataFrame, version: DataFrame) -> DataFrame:
    return version.join(knowledge.select("knowledge_id", F.col("current_revision").alias("revision"), "state"), KEY)


def affected(unresolved: DataFrame) -> DataFrame:
    """(unresolved_id, state, knowledge_id, revision): the versions an item names."""
    pair = lambda n: F.struct(F.col(f"k{n}").alias("knowledge_id"), F.col(f"r{n}").alias("revision"))
    return unresolved.select("unresolved_id", "state", F.explode(F.array(pair(1), pair(2))).alias("a")).select("unresolved_id", "state", "a.*").distinct()


def disputed(unresolved: DataFrame) -> DataFrame:
    return affected(unresolved).where("state = 'open'").select(*KEY).distinct()


def valid_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.where("state = 'live' and excerpt is not null")


def supported(version: DataFrame, support: DataFrame, evidence: DataFrame) -> DataFrame:
    """Versions all of whose claims rest on valid evidence only; decisions and preferences need an owner's."""
    good = valid_evidence(evidence).select("evidence_id", "authority", F.lit(True).alias("_ok"))
    claims = support.join(good, "evidence_id", "left").groupBy(*KEY).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_all"), F.coalesce(F.bool_or(F.col("authority") == "owner"), F.lit(False)).alias("_owner"), F.count_distinct("claim_key").alias("claims"))
    return version.join(claims, KEY).where(F.col("_all") & (F.col("_owner") | ~F.col("kind").isin("decision", "preference"))).drop("_all", "_owner")


def eligible(knowledge: DataFrame, version: DataFrame, support: DataFrame, evidence: DataFrame, unresolved: DataFrame, now: float, project: str | None = None, task: str | None = None, everywhere: bool = False) -> DataFrame:
    """Active current versions that apply, are not expired or disputed, and whose support is valid."""
    rows = current(knowledge, version).where(F.col("state") == "active").where(unexpired(now))
    if not everywhere:
        rows = rows.where(scope_applies(project, task))
    return supported(rows.join(disputed(unresolved), KEY, "left_anti"), support, evidence)


def expired_omitted(knowledge, version, support, evidence, unresolved, now: float) -> DataFrame:
    """How many would be eligible but for their expiry."""
    at_start = eligible(knowledge, version, support, evidence, unresolved, 0.0, everywhere=True)
    return at_start.where(~unexpired(now)).agg(F.count_distinct("knowledge_id").alias("expired_omitted"))


def shown_at(knowledge: DataFrame, version: DataFrame, revision: int | None = None) -> DataFrame:
    """Every item at a revision, or at its current one; items without that revision are absent."""
    wanted = F.coalesce(F.lit(revision).cast("long"), F.col("current_revision"))
    return version.join(knowledge, "knowledge_id").where(F.col("revision") == wanted).drop("current_revision")


def candidate_rows(knowledge: DataFrame, version: DataFrame, project: str, limit: int = 20) -> DataFrame:
    """Newest first with the number of candidates before the limit."""
    rows = current(knowledge, version).where((F.col("state") == "active") & F.col("project").eqNullSafe(F.lit(project)))
    n = rows.agg(F.count("*").alias("candidate_total"))  # one row
    return rows.orderBy(F.desc("created_at"), F.desc("knowledge_id")).limit(limit).join(F.broadcast(n))


def evidence_sources(support: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every support row with its evidence's authority if that is live."""
    return support.join(evidence.where("state = 'live'").select("evidence_id", "authority"), "evidence_id", "left")


def liveness(support: DataFrame, evidence: DataFrame) -> DataFrame:
    return support.join(evidence, "evidence_id").groupBy(*KEY).agg(F.count("*").alias("evidence"), F.count_if((F.col("state") == "live") & F.col("excerpt").isNotNull()).alias("live"))


def unresolved_view(unresolved: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Open items with how many of their affected versions are no longer current."""
    named = affected(unresolved).where("state = 'open'")
    stale = named.join(knowledge.select("knowledge_id", F.col("current_revision").alias("revision")), KEY, "left_anti").groupBy("unresolved_id").agg(F.count("*").alias("stale"))
    every = named.groupBy("unresolved_id").agg(F.count("*").alias("affected"))
    return every.join(stale, "unresolved_id", "left").select("unresolved_id", "affected", F.coalesce("stale", F.lit(0)).alias("stale"))


def unresolved_page(unresolved: DataFrame, after: str | None = None, limit: int = 20) -> DataFrame:
    rows = unresolved.where("state = 'open'")
    if after is not None:
        rows = rows.where(F.col("unresolved_id") > after)
    return rows.orderBy("unresolved_id").limit(max(1, min(limit, 100))).select("unresolved_id")


def claims(notes: DataFrame) -> DataFrame:
    """Keyed claims of bodies: content and each condition of a note, the parts and steps of a guide."""
    body = lambda key, text: F.array(F.struct(F.lit(key).alias("claim_key"), text.alias("text")))
    listed = lambda prefix, column: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda t, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")).alias("claim_key"), t.alias("text")))
    every = F.concat(body("content", F.col("content")), listed("condition.", F.col("conditions")), body("summary", F.col("summary")), listed("step.", F.col("steps")))
    return notes.select("knowledge_id", F.inline(every)).where("text is not null")


def claim_mismatch(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Claims that only one side has, or whose texts differ."""
    both = stored.alias("s").join(computed.alias("c"), ["knowledge_id", "claim_key"], "full_outer")
    return both.where(~F.col("s.text").eqNullSafe(F.col("c.text"))).select("knowledge_id", "claim_key", F.when(F.col("s.text").isNull(), "missing").when(F.col("c.text").isNull(), "extra").otherwise("changed").alias("problem"))


def apply_changes(knowledge: DataFrame, version: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(knowledge, version, refused) after changes (knowledge_id, expected_revision, content, created_at).

    Without expected_revision an item is added as revision 1; else it must be the current one
    of an active item, and the next follows. Of several changes to one item the first counts.
    """
    order = Window.partitionBy("knowledge_id").orderBy("created_at", "content")
    one = changes.withColumn("_k", F.row_number().over(order)).join(knowledge, "knowledge_id", "left")
    ok = (F.col("_k") == 1) & F.when(F.col("expected_revision").isNull(), F.col("current_revision").isNull()).otherwise(F.coalesce((F.col("current_revision") == F.col("expected_revision")) & (F.col("state") == "active"), F.lit(False)))
    judged = one.withColumn("_ok", ok)
    new = judged.where("_ok").select("knowledge_id", (F.coalesce("current_revision", F.lit(0)) + 1).cast("long").alias("revision"), "content", "created_at")
    kept = knowledge.join(new.select("knowledge_id"), "knowledge_id", "left_anti")
    after = kept.unionByName(new.select("knowledge_id", F.col("revision").alias("current_revision"), F.lit("active").alias("state")))
    return after, version.unionByName(new, allowMissingColumns=True), judged.where(~F.col("_ok")).select("knowledge_id", "expected_revision")


def withheld(knowledge: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Active items whose current revision an open unresolved item affects become withheld."""
    hit = disputed(unresolved).select("knowledge_id", F.col("revision").alias("current_revision"), F.lit(True).alias("_hit"))
    return knowledge.join(hit, ["knowledge_id", "current_revision"], "left").select("knowledge_id", "current_revision", F.when(F.col("_hit") & (F.col("state") == "active"), "withheld").otherwise(F.col("state")).alias("state"))


def retracted(knowledge: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items retracted at their expected current revision; others stay."""
    hit = wanted.select("knowledge_id", F.col("expected_revision").alias("current_revision"), F.lit(True).alias("_hit")).distinct()
    return knowledge.join(hit, ["knowledge_id", "current_revision"], "left").select("knowledge_id", "current_revision", F.when(F.col("_hit") & (F.col("state") != "erased"), "retracted").otherwise(F.col("state")).alias("state"))


def enqueue(requests: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Wanted requests whose key no request has yet, once each."""
    return wanted.dropDuplicates(key).join(requests.select(*key).distinct(), key, "left_anti")


def retry(attempts: DataFrame, backoff: list[float], now: float) -> DataFrame:
    """Next due time by the number of failed attempts; beyond the list a request fails."""
    n = F.col("failed")
    return attempts.select("request_id", "failed", F.when(n > len(backoff), "failed").otherwise("queued").alias("state"), F.when((n >= 1) & (n <= len(backoff)), F.lit(now) + F.try_element_at(F.array(*(F.lit(float(b)) for b in backoff)), n.cast("int"))).alias("retry_at"))


def recovered(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """Running requests without a receipt are queued again; with one they are completed."""
    done = receipts.select("request_id").distinct().withColumn("_done", F.lit(True))
    return requests.join(done, "request_id", "left").select("request_id", F.when(F.col("state") != "running", F.col("state")).when(F.col("_done"), "completed").otherwise("queued").alias("state"))


def latest_failure(attempts: DataFrame) -> DataFrame:
    """Each request's latest failed attempt with the number of attempts."""
    failed = F.max(F.when(F.col("state") == "failed", F.struct("round", "seconds")))
    return attempts.groupBy("request").agg(failed.alias("f"), F.count("*").alias("attempts")).where("f is not null").select("request", "f.round", "f.seconds", "attempts")


def start_rank() -> Column:
    return F.when(F.col("form") == "guide", 4).otherwise(F.coalesce(F.create_map(*(x for k, v in START_ORDER.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")], F.lit(3)))


def start_order(rows: DataFrame, limit: int = 200) -> DataFrame:
    """Decisions and preferences, constraints and procedures, facts, others; guides last; newest first."""
    keys = (start_rank(), F.desc("created_at"), F.desc("knowledge_id"))
    top = rows.orderBy(*keys).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys)))


def context(rows: DataFrame, most_bytes: int, scan: int = 200) -> DataFrame:
    """Newest items, each taken if it still fits: a fold over at most `scan` rows."""
    top = rows.orderBy(F.desc("created_at"), F.desc("knowledge_id")).limit(scan).agg(F.array_sort(F.collect_list(F.struct((-F.col("created_at")).alias("o"), "knowledge_id", F.octet_length("content").alias("bytes")))).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<knowledge_id:string,used:int>>").alias("out"))
    fold = F.aggregate(
        "items",
        start,
        lambda acc, x: F.when(acc["used"] + x["bytes"] <= most_bytes, F.struct((acc["used"] + x["bytes"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["knowledge_id"].alias("knowledge_id"), (acc["used"] + x["bytes"]).alias("used")))).alias("out"))).otherwise(acc),
    )["out"]
    return top.select(F.inline(fold))


def owner_proof(support: DataFrame, evidence: DataFrame) -> DataFrame:
    """Owner evidence texts of each version, ordered, in place of a model's wording."""
    owned = support.select(*KEY, "evidence_id").distinct().join(valid_evidence(evidence).where("authority = 'owner'"), "evidence_id")
    return owned.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("excerpt")), "\n").alias("proof"))


def gaps(points: DataFrame) -> DataFrame:
    """Line intervals between successive points of a source, from line 1 on."""
    w = Window.partitionBy("source_id").orderBy("line")
    return points.select("source_id", "line").distinct().select("source_id", (F.coalesce(F.lag("line").over(w), F.lit(0)) + 1).alias("from_line"), F.col("line").alias("through_line"))


def unsuppressed(windows: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Windows without the prefix that cancelled ones of the same thread cover; empty ones go."""
    key = ["provider", "thread_id", "from_line"]
    ends = cancelled.groupBy(*key).agg(F.max("through_line").alias("_t"))
    asked = windows.select(*key).distinct().withColumn("_t", F.lit(None).cast(ends.schema["_t"].dataType))
    reach = F.max("_t").over(Window.partitionBy("provider", "thread_id").orderBy("from_line"))  # of all that start at or before the line
    points = ends.unionByName(asked).where("provider is not null and thread_id is not null and from_line is not null").withColumn("_r", reach)
    cuts = points.where("_r >= from_line").groupBy(*key).agg((F.max("_r") + 1).alias("_c"))
    top = windows.select("request_id", *key, "through_line").distinct().join(cuts, key, "left")
    return top.select("request_id", F.greatest("from_line", F.coalesce("_c", "from_line")).alias("from_line"), "through_line").where("from_line <= through_line")


def with_receipts(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Requests with their attempts as an ordered list."""
    listed = attempts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("round", "state"))).alias("attempts"))
    return requests.join(listed, "request_id", "left").select("request_id", "state", F.coalesce(F.size("attempts"), F.lit(0)).alias("n_attempts"), F.element_at("attempts", -1)["state"].alias("last_attempt"))


def batch_problems(changes: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Why a batch is refused: unknown targets, or one target named twice."""
    twice = changes.groupBy("knowledge_id").agg(F.count("*").alias("n")).where("n > 1").select("knowledge_id", F.lit("duplicate_target").alias("problem"))
    unknown = changes.where("expected_revision is not null").join(knowledge, "knowledge_id", "left_anti").select("knowledge_id", F.lit("unknown_target").alias("problem")).distinct()
    return twice.unionByName(unknown)
