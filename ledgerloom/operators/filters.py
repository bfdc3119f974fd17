"""Predicates over events joined with their sources."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import QueryError

PROVIDERS = ("codex", "claude", "cursor")
KINDS = ("prompt", "reply", "delegation", "agent_report", "harness", "tool_call", "tool_error")
DEFAULT_KINDS = ("prompt", "reply")
MARKER, REDACTED, TRUNCATED = 1, 2, 4  # flag bits
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?")


def joined(event: DataFrame, source: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Events with the columns of their source, and the scope's label."""
    out = event.join(source, "source_id")
    return out if scope is None else out.join(scope.select("scope_id", "label"), "scope_id", "left")


def kind_is(kinds: tuple[str, ...] | None = None, subagents: bool = False) -> Column:
    for k in kinds or ():
        if k not in KINDS:
            raise QueryError("bad_kind", k)
    wanted = list(kinds or (*DEFAULT_KINDS, *(("delegation", "agent_report") if subagents else ())))
    return F.col("kind").isin(wanted)


def day_bounds(since: str | None = None, until: str | None = None) -> Column:
    """ts between text bounds; a bare day as `until` includes that day; events without ts drop out if a bound is set."""
    for value in (since, until):
        if value is not None and not valid_date(value):
            raise QueryError("bad_date", value)
    out = F.lit(True)
    if since is not None:
        out = out & (F.col("ts") >= since)
    if until is not None:
        if len(until) == 10:
            following = (datetime.date.fromisoformat(until) + datetime.timedelta(days=1)).isoformat()
            out = out & (F.col("ts") < following)
        else:
            out = out & (F.col("ts") <= until)
    return out


def valid_date(value: str) -> bool:
    if not _DATE.fullmatch(value):
        return False
    try:
        datetime.date.fromisoformat(value[:10])
    except ValueError:
        return False
    return True


def eligible(kinds=None, subagents=False, provider=None, since=None, until=None, not_session=None, session=None, flagged=False) -> Column:
    """One predicate over joined(event, source); Catalyst pushes each part to the side it concerns."""
    if provider is not None and provider not in PROVIDERS:
        raise QueryError("bad_provider", provider)
    out = F.col("thread_class").isin(["primary", "subagent"]) if subagents else F.col("thread_class") == "primary"
    out = out & kind_is(kinds, subagents) & day_bounds(since, until)
    if not flagged:
        out = out & (F.col("flags").bitwiseAND(MARKER) == 0)
    if provider is not None:
        out = out & (F.col("provider") == provider)
    if session is not None:
        out = out & (F.col("session_root") == session)
    elif not_session is not None:
        out = out & (F.col("session_root") != not_session)
    return out


def in_scope(cwd: str | None = None, everywhere: bool = False, scope_ids: list[int] | None = None) -> Column:
    """Exact directory first, then everywhere, then the given scopes; none of them matches nothing."""
    if cwd is not None:
        return F.col("cwd") == cwd
    if everywhere:
        return F.lit(True)
    return F.col("scope_id").isin(list(scope_ids)) if scope_ids else F.lit(False)


def resolve_session(source: DataFrame, wanted: str) -> str:
    """The session root that equals the text, or the only one that starts with it."""
    roots = [r[0] for r in source.where(F.col("session_root").startswith(wanted)).select("session_root").distinct().orderBy(F.col("session_root") != wanted, "session_root").limit(2).collect()]
    if roots and (roots[0] == wanted or len(roots) == 1):
        return roots[0]
    raise QueryError("ambiguous_session" if roots else "unknown_session", wanted)


def contains(text: Column, needle: str) -> Column:
    """Exact substring; no wildcards."""
    return F.instr(text, needle) > 0


def ref() -> Column:
    return F.format_string("%s:%s:%d.%d", "provider", "thread_id", "line", "part")


_REF = re.compile(r"(?P<provider>\w+):(?P<thread>\S+):(?P<line>\d+)(?:\.(?P<part>\d+))?")


def locate(joined_events: DataFrame, text: str) -> DataFrame:
    """The event a reference names; an exact thread id wins over a prefix, which must be unambiguous."""
    m = _REF.fullmatch(text)
    if not m or m["provider"] not in PROVIDERS:
        raise QueryError("bad_ref", text)
    at = joined_events.where((F.col("provider") == m["provider"]) & (F.col("line") == int(m["line"])) & (F.col("part") == int(m["part"] or 1)))
    for match in (F.col("thread_id") == m["thread"], F.col("thread_id").startswith(m["thread"])):
        found = at.where(match)
        threads = [r[0] for r in found.select("thread_id").distinct().limit(2).collect()]
        if len(threads) > 1:
            raise QueryError("ambiguous_ref", text)
        if threads:
            return found.where(F.col("thread_id") == threads[0])
    raise QueryError("not_found", text)


def citable() -> Column:
    return (F.col("thread_class") == "primary") & F.col("kind").isin(list(DEFAULT_KINDS)) & (F.col("flags").bitwiseAND(MARKER) == 0)


def scope_applies(project: str | None, task: str | None) -> Column:
    """Same project (null-safe), and no task or the same task."""
    return F.col("project").eqNullSafe(F.lit(project)) & (F.col("task").isNull() | (F.col("task") == F.lit(task)))


def unexpired(now: float) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def from_key(columns: list[str], values: list) -> Column:
    """Rows at or after a key in lexicographic order."""
    return F.struct(*columns) >= F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, values, strict=True)))
