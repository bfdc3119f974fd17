"""Secret scanning over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. Each distinct blob
is scanned once per rule version: pairs of blob and rule version that the ledger already
holds are skipped, so a later run over more history, or with one changed rule, only scans
what is new. Findings, each with its rule's version, are then joined back to every path that
holds the blob; what only an earlier version of a rule found no longer counts.

Only DataFrame functions are used. Spans are exact: the text between matches (split) and
the matches (regexp_extract_all) alternate, so running sums of their lengths, in code
points, give every start and end.

Defined results: null text counts as empty; empty texts have no spans; a null path is
carried as is; repeated rows each get their findings; spans that start together come in the order
of their rules; an empty table gives an empty result; other columns, maps among them, are carried.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import cut, shared_dir, table


@dataclass(frozen=True)
class Rule:
    """kind names the finding; group's text must have at least `least` characters."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
# Fixed values of the base rules. Runs too short for access and hex cannot hold a longer one,
# so their least lengths stand in the patterns; an assignment that fails still uses up its text.
BASE_RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
# The opening line of a private key and a forge's token prefixes. A web token is, by its public format, base64url of a
# JSON header, of a JSON payload ('{"' opens them: eyJ) and of a signature of 16 bytes or more; {"alg":"x"} and {"a":1} are the least.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{12,}\\.eyJ[A-Za-z0-9_-]{7,}\\.[A-Za-z0-9_-]{22,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES
SALTS = 16
MOST_TOLD = 10_000  # identifiers of 64 characters that are broadcast
SPAN = "struct<start:long,rank:int,end:long,kind:string,version:int>"
LEDGER = f"blob string, rules array<string>, spans array<{SPAN}>"
RUN, PIECE = 512, 4_096  # matches, and characters of a text, that one pass over a growing value handles


def blob_id(content: Column) -> Column:
    return F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<SPAN> of one rule's matches in text."""
    pattern = F.lit(rule.pattern)
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    long = lambda x: F.char_length(x).cast("long")
    steps = F.filter(F.zip_with(gaps, F.arrays_zip(hits.alias("hit"), kept.alias("kept")), lambda gap, m: F.struct(long(gap).alias("gap"), long(m["hit"]).alias("hit"), (F.char_length(m["kept"]) >= rule.least).alias("ok"))), lambda x: x["hit"].isNotNull())
    none = F.array().cast(f"array<{SPAN}>")
    span = lambda a, b: F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")).cast(SPAN)

    def run(some: Column) -> Column:
        """Length and spans of a run of matches; a run is short, so that appending to its array costs little."""
        zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        return F.aggregate(
            some, zero,
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["hit"]).alias("at"),
                F.when(x["ok"], F.concat(acc["out"], F.array(span(acc["at"] + x["gap"], acc["at"] + x["gap"] + x["hit"])))).otherwise(acc["out"]).alias("out"),
            ),
        )

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda i: run(F.slice(steps, i * RUN + 1, F.lit(RUN))))
    placed = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")),
        lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(r["out"], lambda s: span(acc["at"] + s["start"], acc["at"] + s["end"])))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(text.rlike(rule.pattern), placed).otherwise(none)


def new_ledger(spark: SparkSession) -> DataFrame:
    """A ledger that has seen nothing: the rule versions a blob was scanned with, and the spans each of them found."""
    return spark.createDataFrame([], LEDGER)


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger kept as a table in a folder, which is made if it is not there."""
    new_ledger(spark).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def record(versions: DataFrame, folder: str, content: str = "content", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Scans what the ledger in folder lacks of these versions and rules, appends it there, and returns the ledger.

    The ledger is asked with identifiers alone. Up to MOST_TOLD missing blobs are told to all tasks, so that only their
    contents travel; if more are missing, all contents are dealt by blob and meet the ledger there.
    """
    spark, rules = versions.sparkSession, rules or RULES
    known = open_ledger(spark, folder)
    has = known.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("_seen"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    ids = versions.select(blob_id(text).alias("blob")).distinct()
    lacking = cut(ids.join(has, "blob", "left").where(F.size(F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>")))) > 0).select("blob"))
    n = lacking.count()
    if n:
        blobs = versions.select(text.alias("content"), blob_id(text).alias("blob"))
        if n <= MOST_TOLD:
            fresh = distinct_blobs(blobs.join(F.broadcast(lacking), "blob", "left_semi"), "content")
        else:  # contents are dealt by blob once, and the scan drops what the ledger knows
            fresh = distinct_blobs(versions, content)
        scan(fresh, known, rules).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def scan(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the unseen pairs of blob (blob, content) and rule version; none for blobs with no such pair."""
    seen = F.array().cast("array<string>")
    if ledger is not None:
        blobs = blobs.join(ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("_seen")), "blob", "left")
        seen = F.coalesce(F.col("_seen"), seen)
    fresh = blobs.select("blob", "content", F.array_except(F.array(*(F.lit(r.key) for r in rules)), seen).alias("rules")).where(F.size("rules") > 0)
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.when(F.array_contains("rules", r.key), _spans(F.col("content"), r, k)).otherwise(none) if ledger is not None else _spans(F.col("content"), r, k) for k, r in enumerate(rules)]
    return fresh.select("blob", "rules", F.concat(*found).alias("spans"))


def distinct_blobs(versions: DataFrame, content: str = "content") -> DataFrame:
    """(blob, content), each content once; copies meet before the shuffle."""
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    return versions.select(blob_id(text).alias("blob"), text.alias("content")).groupBy("blob").agg(F.any_value("content").alias("content"))


def _can_be_hashed(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_can_be_hashed(f.dataType) for f in kind.fields)
    return _can_be_hashed(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def findings(versions: DataFrame, ledger: DataFrame, content: str = "content", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions with `blob` and `spans`: what the ledger knows of each path's content under these rule versions.

    Columns of versions with these two names give way to them.
    """
    kinds, keys = F.array(*(F.lit(r.kind) for r in rules)), F.array(*(F.lit(r.key) for r in rules))
    now = lambda s: F.array_contains(keys, F.concat(s["kind"], F.lit("@"), s["version"].cast("string")))
    ranked = lambda s: F.struct(s["start"].alias("start"), (F.array_position(kinds, s["kind"]) - 1).cast("int").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["version"].alias("version"))
    known = ledger.where(F.arrays_overlap("rules", keys)).select("blob", F.transform(F.filter("spans", now), ranked).alias("spans")).where(F.size("spans") > 0)
    known = known.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    # a blob may stand at a third of all paths: its findings go to SALTS partitions, each path to one of them
    kept = [c for c in versions.columns if c not in ("blob", "spans")]
    salt = F.pmod(F.xxhash64(F.lit(0), *(f"`{c}`" for c in kept if c != content and _can_be_hashed(versions.schema[c].dataType))), F.lit(SALTS))
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = versions.select(F.struct(*(f"`{c}`" for c in kept)).alias("row"), blob_id(F.col(content)).alias("blob"), salt.alias("part"))
    out = rows.join(known, ["blob", "part"], "left")
    return out.select("row.*", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """text with every span, overlapping or touching ones as one, replaced by mark.

    The text is taken in pieces, each with the spans that reach it, so that no span is looked for from the text's start.
    """

    def piece(part: Column, number: Column) -> Column:
        low = number.cast("long") * PIECE
        high = low + F.char_length(part)
        cut = lambda a, b: F.substring(part, (a - low + 1).cast("int"), (b - a).cast("int"))
        opens = lambda acc, s: ~(acc["in"] & (s["start"] <= acc["at"]))
        return F.aggregate(
            F.filter(spans, lambda s: (s["end"] >= low) & (s["start"] < high)),
            F.struct(low.alias("at"), F.lit(False).alias("in"), F.lit("").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.lit(True).alias("in"),
                F.when((s["start"] >= low) & opens(acc, s), F.concat(acc["out"], cut(acc["at"], s["start"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: F.concat(acc["out"], F.when(acc["at"] < high, cut(acc["at"], high)).otherwise("")),
        )

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def scanned(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """docs with blob and spans; with a ledger, only what it lacks is scanned."""
    fresh = scan(distinct_blobs(docs, "text"), ledger)
    return findings(docs, fresh if ledger is None else ledger.unionByName(fresh), "text")


def op4_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds over a ledger table of its own: the base rules, then all rules, of which only the unseen ones are scanned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    record(docs, folder, "text", BASE_RULES)
    found = findings(docs, record(docs, folder, "text"), "text")
    base = F.filter("spans", lambda s: F.array_contains(F.array(*(F.lit(r.kind) for r in BASE_RULES)), s["kind"]))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = cut(found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def _sql(rules: tuple[Rule, ...]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = []
    for k, r in enumerate(rules):
        p = quote(r.pattern)
        kept = f"regexp_extract_all(t, {p}, {r.group})"
        kinds.append(f"""SELECT doc_id, {k} AS rank, {quote(r.kind)} AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'ok': length(h[i]) >= {r.least}}}), lambda x: x.ok)) AS x
  FROM (SELECT doc_id, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS m, {kept} AS h FROM d WHERE regexp_matches(t, {p}))""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(kinds)}),
s AS (SELECT doc_id, rank, kind, x.s::BIGINT AS s, concat(kind, ':', x.s::BIGINT, ':', (x.s + x.n)::BIGINT) AS label FROM f),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(label, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_RULES)}), '') AS base, string_agg(label, ',' ORDER BY s, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


SQL_OP4 = _sql(RULES)
