"""Text expressions: tokens, previews, redaction, error detection, digests."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import credentials

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
MARKS = "".join(map(chr, range(0x300, 0x370)))  # combining diacritics, which the index drops


def _plain_letters() -> dict[str, str]:
    """Small letters that are one letter with diacritics, and that letter."""
    split = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0xC0, 0x2100)) if c == c.lower()}
    return {c: d[0] for c, d in split.items() if len(d) > 1 and d[0].isalpha() and all(m in MARKS for m in d[1:])}


_LETTERS = _plain_letters()
ACCENTED, PLAIN = "".join(_LETTERS), "".join(_LETTERS.values())
FOLDED = str.maketrans(ACCENTED, PLAIN, MARKS)
# Words that a query does not search for.
STOPWORDS = tuple("a an and are as at be but by for from have how if in is it its of on or not that the this to was we were what when where which who will with you".split())
REDACTION = "[redacted:secret]"
MOST_EVENT_BYTES, MOST_CALL_BYTES = 65_536, 4_096
SLICE_BYTES = 1 << 20  # of a batch of texts, what is held as Python objects at a time
MARKER, REDACTED, TRUNCATED = 1, 2, 4


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED + MARKS, PLAIN)  # marks have no counterpart and go


def tokens(text: Column) -> Column:
    """Index tokens in order; '_' separates."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s]+", " "))


def preview(text: Column, length: int = 200, read: int = 1000) -> Column:
    return F.left(collapse(F.substr(text, F.lit(1), F.lit(read))), F.lit(length))


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "?")


def escape_delimiters(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def actor(name: Column) -> Column:
    """Lower-case letters, digits and dashes, at most 32 of them; empty becomes null."""
    return F.nullif(F.left(F.regexp_replace(F.lower(name), "[^a-z0-9-]+", "-"), F.lit(32)), F.lit(""))


def human_bytes(n: Column) -> Column:
    scaled = lambda unit, name: F.concat((F.floor(n / unit * 10 + 0.5) / 10).cast("string"), F.lit(name))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1024, " KiB")).when(n < 1024**3, scaled(1024**2, " MiB")).otherwise(scaled(1024**3, " GiB"))


def seconds_since(stamp: Column, now: float, future_ok: bool = False) -> Column:
    """Age of an epoch stamp; null for none and, unless future_ok, for one that lies ahead."""
    age = F.lit(now) - stamp
    return F.greatest(age, F.lit(0.0)) if future_ok else F.when(age >= 0, age)


def fresh(age: Column, interval: float) -> Column:
    return F.when(age.isNull(), "unknown").when(age <= 3 * interval, "ok").otherwise("stale")


def safe_limit(most_input_bytes: Column) -> Column:
    """Bytes of a transcript that may go into one request: three quarters, at least a KiB."""
    return F.greatest(F.floor(most_input_bytes * 3 / 4), F.lit(1024))


def record_hash(line: Column) -> Column:
    """Identity of a transcript line: its bytes without the line end."""
    return F.sha2(F.regexp_replace(line, r"[\r\n]+$", ""), 256)


def duplicate_key(*parts: Column) -> Column:
    """Digest of length-framed parts; null and empty differ."""
    framed = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *framed), 256)


_ERROR_LINES = (
    r"Traceback \(most recent call last\)", r"(?:[A-Za-z_.]*(?:Error|Exception)): ", r"(?:error|fatal|panic)(?:\[\w+\])?: ",
    r"(?:bash|sh|zsh): .*: command not found", r"npm ERR! ",
)


def is_error_text(text: Column) -> Column:
    """A failing exit code, or a line that starts like an error."""
    code = F.regexp_extract(text, r"(?im)^\s*(?:process exited with code|exit code:?)\s+(\d+)", 1)
    return (F.coalesce(F.try_to_number(F.nullif(code, F.lit("")), F.lit("999999999")), F.lit(0)) != 0) | text.rlike(r"(?m)^(?:" + "|".join(_ERROR_LINES) + ")")


def starting_tag(text: Column, tags: tuple[str, ...]) -> Column:
    """The first of the tags that the text, after white space, opens with."""
    out = F.lit(None).cast("string")
    body = F.ltrim(text)
    for tag in reversed(tags):
        out = F.when(body.startswith(f"<{tag}>") | body.startswith(f"<{tag} "), tag).otherwise(out)
    return out


def join_text(blocks: Column) -> Column:
    """Texts of array<struct<type,text>> blocks of type text, one per line."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")


def redact_text(text: str) -> str:
    return credentials.replaced(text, credentials.spans(text), REDACTION)


@F.pandas_udf(T.StringType())
def _redact(text: pd.Series) -> pd.Series:
    return text.map(redact_text, na_action="ignore")


def redact(text: Column | str) -> Column:
    """Text without its secrets; a text that holds nothing like one stays in the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_redact(F.when(text.rlike(credentials.MAY_HOLD), text)), text)


def by_slices(one, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """A value of `kind` per row of Arrow columns. A batch of long texts is turned into Python objects slice by slice, so that only its Arrow form is held whole."""
    n = len(columns[0])
    step = max(1, n * SLICE_BYTES // max(SLICE_BYTES, columns[0].nbytes))
    parts = [pa.array([one(*r) for r in zip(*(c.slice(at, step).to_pylist() for c in columns), strict=True)], kind) for at in range(0, n, step)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.StructType().add("text", "string").add("flags", "integer"))
def finish(text: pa.Array, limit: pa.Array) -> pa.Array:
    """Redacted text cut to limit UTF-8 bytes, with flag bits for what was done."""

    def one(t, most):
        if t is None:
            return {"text": None, "flags": 0}
        clean = redact_text(t)
        raw = clean.encode("utf-8", "replace")
        cut = raw[:most].decode("utf-8", "ignore") if len(raw) > most else clean
        return {"text": cut, "flags": REDACTED * (clean != t) | TRUNCATED * (len(raw) > most)}

    return by_slices(one, pa.struct([("text", pa.string()), ("flags", pa.int32())]), text, limit)


@F.arrow_udf(T.StringType())
def excerpt(text: pa.Array, side: pa.Array) -> pa.Array:
    """Head and tail of `side` bytes each where the text is longer than both."""

    def cut(t, n):
        raw = (t or "").encode("utf-8", "replace")
        return t if len(raw) <= 2 * n else raw[:n].decode("utf-8", "ignore") + "\n...\n" + raw[-n:].decode("utf-8", "ignore")

    return by_slices(cut, pa.string(), text, side)


@F.pandas_udf(T.StructType().add("page", "string").add("next_offset", "long"))
def text_page(text: pd.Series, offset: pd.Series, most: pd.Series) -> pd.DataFrame:
    """From a character offset, as many characters as `most` UTF-8 bytes hold, and where to go on (null at the end)."""
    pages, following = [], []
    for t, at, n in zip(text, offset, most, strict=True):
        rest = (t or "")[at:]
        page = rest.encode("utf-8", "replace")[:n].decode("utf-8", "ignore")
        pages.append(page)
        following.append(at + len(page) if len(page) < len(rest) else None)
    return pd.DataFrame({"page": pages, "next_offset": pd.Series(following, dtype="Int64")})


def opened(text: Column, offset: Column, most: Column) -> Column:
    """A page of text at a character offset: error (bad_offset, offset_past_end or null), page, next_offset and chars."""
    whole = F.coalesce(text, F.lit(""))
    error = F.when(offset < 0, "bad_offset").when(offset > F.char_length(whole), "offset_past_end")
    page = text_page(whole, F.when(error.isNull(), offset).otherwise(0).cast("long"), most)
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(error.alias("error"), good(page["page"]).alias("page"), good(page["next_offset"]).alias("next_offset"), F.char_length(whole).alias("chars"))


def content_tag(key: bytes):
    """Keyed digest of framed fields, so that a tombstone does not reveal what was erased."""

    @F.pandas_udf(T.StringType())
    def tag(provider: pd.Series, thread: pd.Series, role: pd.Series, text: pd.Series) -> pd.Series:
        rows = zip(provider, thread, role, text, strict=True)
        return pd.Series([hmac.new(key, b"\0".join((x or "").encode("utf-8", "replace") for x in r), hashlib.sha256).hexdigest() for r in rows])

    return tag


@F.pandas_udf(T.StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null where the text is no JSON."""

    def one(v):
        try:
            return json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return value.map(one)


@F.pandas_udf(T.StructType().add("start", "long").add("end", "long"))
def quote_span(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """Where a quote stands in the original text, white space compared loosely and case strictly."""
    rows = []
    for t, q in zip(text, quote, strict=True):
        words = (q or "").split()
        m = re.search(r"\s+".join(map(re.escape, words)), t or "") if words else None
        rows.append(m.span() if m else (None, None))
    return pd.DataFrame(rows, columns=["start", "end"]).astype("Int64")


def snippet(terms: list[str], width: int = 32):
    """The window of `width` tokens that holds most distinct terms, matches between « and »."""
    wanted = {t.translate(FOLDED) for t in terms}

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            at = [(m.start(), m.end(), m.group().lower().translate(FOLDED)) for m in re.finditer(r"[^\W_]+", t)]
            hit = [i for i, x in enumerate(at) if x[2] in wanted]
            if not at:
                return ""
            first = max(hit or [0], key=lambda i: (len({at[j][2] for j in hit if i <= j < i + width}), -i))
            last = min(first + width, len(at)) - 1
            out, pos = ["…" if first else ""], at[first][0] if first else 0
            for s, e, w in at[first : last + 1]:
                out += [t[pos:s], f"«{t[s:e]}»" if w in wanted else t[s:e]]
                pos = e
            return "".join([*out, "…" if last + 1 < len(at) else t[pos:]])

        return text.map(one)

    return run


def iso_date(value: Column) -> Column:
    """Whether text is an ISO day or instant of the calendar."""
    shape = value.rlike(r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    return F.coalesce(shape & F.left(value, F.lit(10)).try_cast("date").isNotNull(), F.lit(False))


@F.arrow_udf(T.ArrayType(T.StringType()))
def redact_parts(parts: pa.Array) -> pa.Array:
    """Fields redacted as one text, so that a key in one and its value in the next are seen together."""

    def one(fields):
        return None if fields is None else credentials.replaced_in_parts([f or "" for f in fields], REDACTION)

    return by_slices(one, pa.list_(pa.string()), parts)
