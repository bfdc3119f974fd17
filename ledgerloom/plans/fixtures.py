"""Event, source, scope and ledger tables derived from the driver's tables.

Each text is SQL that Spark and DuckDB read alike, with {table} for a base table, so a query and
its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_S = "CAST({} AS VARCHAR(20))"
EVENT = f"""SELECT conv_id*1000+turn AS id, conv_id AS source_id, turn+1 AS line, CAST(1 AS INT) AS part,
 CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'reply' ELSE 'harness' END AS kind,
 CASE WHEN role='assistant' THEN 'assistant' ELSE 'user' END AS role, conv_id % 7 AS scope_id,
 CASE WHEN (conv_id+turn) % 11 = 0 THEN 1 WHEN (conv_id+turn) % 13 = 0 THEN 2 ELSE 0 END AS flags,
 CASE WHEN (conv_id*7+turn) % 17 = 0 THEN NULL ELSE concat('2024-0', {_S.format('1+conv_id%9')}, '-1', {_S.format('turn%10')}, 'T0', {_S.format('conv_id%10')}, ':00:00Z') END AS ts,
 CASE WHEN conv_id % 19 = 0 THEN NULL ELSE concat('/work/p', {_S.format('conv_id%7')}, '/d', {_S.format('turn%3')}) END AS cwd,
 turn*700 + (conv_id % 5)*10*turn AS byte_offset,
 CASE WHEN turn % 4 = 2 THEN 'please continue with the thing' ELSE text END AS text FROM {{conversations}}"""
# the same events, with openings that forks share with their ancestors
REPLAY = EVENT.replace("CASE WHEN turn % 4 = 2", f"CASE WHEN turn < 1 + conv_id % 5 THEN concat('opening ', {_S.format('turn')}) WHEN turn % 4 = 2")
SOURCE = f"""SELECT DISTINCT conv_id AS source_id,
 CASE conv_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'cursor' END AS provider,
 concat('thr-', {_S.format('conv_id')}) AS thread_id, concat('ses-', {_S.format('CAST(floor(conv_id/3) AS BIGINT)')}) AS session_root,
 CASE WHEN conv_id % 10 = 9 THEN 'subagent' ELSE 'primary' END AS thread_class,
 CASE WHEN conv_id % 6 = 3 THEN concat('thr-', {_S.format('conv_id-3')}) WHEN conv_id % 12 = 6 THEN concat('thr-', {_S.format('conv_id-3')}) END AS forked_from_id,
 CASE WHEN conv_id % 14 = 5 THEN concat('thr-', {_S.format('conv_id-4')}) END AS parent_thread_id,
 CASE WHEN conv_id % 13 = 0 THEN 'missing' ELSE 'active' END AS status, 1 + conv_id % 3 AS classifier_version, conv_id % 4 AS skipped_lines
 FROM {{conversations}}"""
SCOPE = f"""SELECT DISTINCT conv_id % 7 AS scope_id, concat('/work/p', {_S.format('conv_id%7')}) AS key, concat('p', {_S.format('conv_id%7')}) AS label,
 CASE conv_id % 7 WHEN 0 THEN 'global' WHEN 6 THEN 'dir' ELSE 'git' END AS kind FROM {{conversations}}"""
TOMBSTONE = f"""SELECT DISTINCT CASE conv_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'cursor' END AS provider,
 CASE conv_id % 4 WHEN 1 THEN 'thread' ELSE 'line' END AS level, concat('thr-', {_S.format('conv_id')}) AS thread_id,
 CASE conv_id % 4 WHEN 1 THEN NULL ELSE turn+1 END AS line FROM {{conversations}} WHERE conv_id % 4 = 1 AND turn = 0 OR conv_id % 4 = 3 AND turn = 2"""
# tombstones of all levels; every other one of a line has its copies unnamed
MARK = f"""SELECT DISTINCT CASE conv_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'cursor' END AS provider,
 CASE conv_id % 8 WHEN 1 THEN 'thread' WHEN 2 THEN 'session' ELSE 'line' END AS level, CASE WHEN conv_id % 8 = 2 THEN concat('ses-', {_S.format('CAST(floor(conv_id/3) AS BIGINT)')}) END AS session_root,
 CASE WHEN conv_id % 8 <> 2 THEN concat('thr-', {_S.format('conv_id')}) END AS thread_id, CASE WHEN conv_id % 8 IN (3, 6) THEN turn+1 END AS line, CAST(NULL AS VARCHAR(64)) AS line_sha256
 FROM {{conversations}} WHERE conv_id % 40 IN (1, 2, 3, 6, 14, 30) AND (turn = 1 OR turn = 0 AND conv_id % 16 = 3) AND conv_id % 8 IN (1, 2, 3, 6)"""
CALL = """SELECT event_id AS id, event_type AS cmd, user_id AS actor, CAST(value AS DOUBLE) AS value, event_id % 97 AS matches, event_id % 5 AS returned,
 CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id % 11 END AS input_tokens, CASE WHEN event_id % 3 = 0 THEN 'EUR' WHEN event_id % 31 = 0 THEN NULL ELSE 'USD' END AS currency,
 CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'completed' END AS state, ts FROM {events}"""
KNOWLEDGE = f"""SELECT concat('K_', {_S.format('p_partkey')}) AS knowledge_id, 1 + p_partkey % 3 AS current_revision,
 CASE WHEN p_partkey % 11 = 0 THEN 'withheld' WHEN p_partkey % 17 = 0 THEN 'retracted' ELSE 'active' END AS state FROM {{part}}"""
VERSION = f"""SELECT concat('K_', {_S.format('p_partkey')}) AS knowledge_id, revision, p_brand AS project, CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('task-', {_S.format('p_size % 4')}) END AS task,
 CASE p_partkey % 4 WHEN 0 THEN 'guide' ELSE 'note' END AS form, CASE p_size % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'preference' WHEN 2 THEN 'constraint' WHEN 3 THEN 'procedure' ELSE 'fact' END AS kind,
 concat(p_name, ' ', p_type, ' rev ', {_S.format('revision')}) AS content, p_retailprice + revision AS created_at, CASE WHEN p_partkey % 9 = 0 THEN p_retailprice + 500 END AS expires_at
 FROM {{part}} CROSS JOIN (SELECT CAST(1 AS BIGINT) AS revision UNION ALL SELECT 2 UNION ALL SELECT 3) r WHERE revision <= 1 + p_partkey % 3"""
SUPPORT = f"""SELECT DISTINCT concat('K_', {_S.format('l_partkey')}) AS knowledge_id, CAST(1 + l_linenumber % 3 AS BIGINT) AS revision, concat('c', {_S.format('l_linenumber')}) AS claim_key,
 concat('E_', {_S.format('l_suppkey')}) AS evidence_id FROM {{lineitem}}"""
EVIDENCE = f"""SELECT concat('E_', {_S.format('s_suppkey')}) AS evidence_id, CASE WHEN s_suppkey % 7 = 0 THEN 'erased' ELSE 'live' END AS state,
 CASE WHEN s_suppkey % 19 = 0 THEN NULL ELSE s_name END AS excerpt, CASE s_suppkey % 3 WHEN 0 THEN 'owner' ELSE 'agent' END AS authority, s_nationkey AS nation FROM {{supplier}}"""
UNRESOLVED = f"""SELECT concat('U_', {_S.format('o_orderkey')}) AS unresolved_id, CASE WHEN o_orderkey % 40 = 0 AND o_orderkey % 3 <> 0 THEN 'open' ELSE 'closed' END AS state,
 concat('K_', {_S.format('1 + o_custkey % parts')}) AS k1, CAST(1 + o_orderkey % 3 AS BIGINT) AS r1, concat('K_', {_S.format('1 + o_orderkey % parts')}) AS k2, CAST(1 + o_custkey % 3 AS BIGINT) AS r2 FROM {{orders}} CROSS JOIN (SELECT count(*) AS parts FROM {{part}}) AS n"""
REQUEST = f"""SELECT concat('R_', {_S.format('o_orderkey')}) AS request_id, CASE o_custkey % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'cursor' END AS provider, concat('thr-', {_S.format('o_custkey % 100')}) AS thread_id,
 1 + o_orderkey % 5 AS from_line, 1 + o_orderkey % 5 + o_custkey % 4 AS through_line, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS state,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'history' ELSE 'live' END AS trigger, CAST(o_totalprice AS DOUBLE) AS created_at, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_totalprice AS DOUBLE) + 1000 END AS retry_at, o_custkey AS owner FROM {{orders}}"""
# threads of twenty conversations each, and requests to review their lines under two policies
THREAD = """SELECT CAST(floor(conv_id / 20) AS BIGINT) AS source_id, (conv_id % 20) * 8 + turn + 1 AS line, CAST(length(text) AS BIGINT) AS bytes, role = 'user' AS is_prompt FROM {conversations}"""
ASKED = """SELECT c_custkey AS request_id, CAST(floor(c_custkey / 300) AS BIGINT) AS source_id, c_mktsegment AS project, CASE c_custkey % 3 WHEN 0 THEN 'now' ELSE 'old' END AS policy,
 CASE WHEN c_nationkey % 9 = 5 THEN c_custkey END AS candidate_id, CASE c_nationkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'completed' ELSE 'pending' END AS state,
 CASE WHEN c_nationkey % 4 = 1 THEN CASE WHEN c_nationkey % 3 = 0 THEN 'asked' ELSE 'policy_replaced' END END AS cancel_code, 1 + (c_custkey * 37) % 160 AS from_line, 1 + (c_custkey * 37) % 160 + c_nationkey % 5 AS through_line FROM {customer}"""
# proposals of review batches: a batch per order, a change per line
BATCH = """SELECT o_orderkey AS batch, CASE WHEN o_orderkey % 11 <> 0 THEN concat('Brand#1', 1 + o_orderkey % 5) END AS project, concat('K_', 1 + o_custkey % 50) AS k1, 1 + o_custkey % 3 AS r1, concat('K_', 1 + o_orderkey % 50) AS k2, 1 + o_custkey % 2 AS r2 FROM {orders}"""
CHANGE = """SELECT l_orderkey AS batch, l_linenumber AS place, CASE WHEN l_suppkey % 7 = 0 THEN 'Brand#99' WHEN l_orderkey % 11 <> 0 THEN concat('Brand#1', 1 + l_orderkey % 5) END AS project, CASE l_suppkey % 4 WHEN 0 THEN 'decision' ELSE 'fact' END AS kind,
 CASE WHEN l_returnflag <> 'N' THEN concat('K_', 1 + l_partkey % 50) END AS knowledge_id, CASE WHEN l_returnflag <> 'N' THEN 1 + (1 + l_partkey % 50) % 3 + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END END AS expected_revision,
 concat('E_', l_suppkey) AS evidence_id, l_linestatus = 'F' OR l_partkey % 4 > 0 AS held, l_suppkey % 3 = 0 AS owner FROM {lineitem}"""
CHARGE = """SELECT l_orderkey AS request, l_linenumber AS round, CASE WHEN l_returnflag = 'R' THEN 'unknown' WHEN l_returnflag = 'A' THEN 'failed' ELSE 'completed' END AS state,
 CAST(l_tax AS DECIMAL(18,2)) AS reserved, CASE WHEN l_linestatus = 'F' THEN CAST(l_discount AS DECIMAL(18,2)) END AS reported, l_quantity AS seconds FROM {lineitem}"""
FIXTURES = {"event": EVENT, "replay": REPLAY, "source": SOURCE, "scope": SCOPE, "tombstone": TOMBSTONE, "mark": MARK, "call": CALL, "knowledge": KNOWLEDGE, "version": VERSION, "support": SUPPORT, "evidence": EVIDENCE, "unresolved": UNRESOLVED, "request": REQUEST, "thread": THREAD, "asked": ASKED, "batch": BATCH, "change": CHANGE, "charge": CHARGE}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Data:
    """Tables by attribute: base tables as they are stored, fixtures derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in FIXTURES:
            sql = FIXTURES[name]
            return self.spark.sql(sql, **{t: getattr(self, t) for t in TABLES if f"{{{t}}}" in sql})
        raise AttributeError(name)


def duck(name: str) -> str:
    """The fixture's text for DuckDB."""
    return FIXTURES[name].format(**{t: t for t in TABLES})


def with_fixtures(sql: str, *names: str) -> str:
    """DuckDB SQL with the named fixtures as common table expressions before it."""
    head = ", ".join(f"{n} AS ({duck(n)})" for n in names)
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql.lstrip()[len('WITH RECURSIVE'):]}"
    if sql.lstrip().upper().startswith("WITH"):
        return f"WITH {head}, {sql.lstrip()[len('WITH'):]}"
    return f"WITH {head} {sql}"
