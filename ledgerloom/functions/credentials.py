"""Where a text holds credentials: a scanner with one small reader per kind of credential.

Readers look at the original text, so what one finds cannot hide what another would. Each moves
forward only, so the time grows with the text. A reader gives (start, end) spans:

* labelled values: a separator, a label right before it, a value after it; the label may be in quotes
  (escaped or not), then the value is too;
* authorization headers: a value, or the scheme Basic with what looks like base64 after it;
* bearer values: the word after one that ends in "bearer";
* vendors' tokens: a known prefix where a word may start, then so many characters of its alphabet;
* web tokens: three base64url segments with dots between them, the first two of JSON objects;
* addresses with a user part;
* private keys: from their first line to their last, or the encoded lines after the first if it was cut off.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import product

Span = tuple[int, int]

# Labels whose value is a secret; "_" may be "-" or missing.
LABELS = ("api_key", "access_token", "client_secret", "token", "bearer", "password", "passwd", "secret_access_key", "secret", "private_key")
QUOTED_LABELS = ("api_key", "access_token", "client_secret", "token", "auth", "authorization", "password", "passwd", "secret_access_key", "secret", "private_key")
HEADERS = ("auth", "authorization")
# Prefixes of vendors' tokens, the alphabet of what follows, how much of it, whether that is all of it, and whether case counts.
VENDORS = [
    ("sk-", "A-Za-z0-9_-", 20, False, False),
    ("ghp_", "A-Za-z0-9_", 20, False, False),
    ("gho_", "A-Za-z0-9_", 20, False, False),
    ("ghu_", "A-Za-z0-9_", 20, False, False),
    ("ghs_", "A-Za-z0-9_", 20, False, False),
    ("ghr_", "A-Za-z0-9_", 20, False, False),
    ("github_pat_", "A-Za-z0-9_", 20, False, False),
    ("AKIA", "A-Za-z0-9", 16, True, False),
    ("xoxa-", "A-Za-z0-9-", 10, False, True),
    ("xoxb-", "A-Za-z0-9-", 10, False, True),
    ("xoxp-", "A-Za-z0-9-", 10, False, True),
    ("xoxr-", "A-Za-z0-9-", 10, False, True),
    ("xoxs-", "A-Za-z0-9-", 10, False, True),
    ("xapp-", "A-Za-z0-9-", 10, False, True),
    ("AIza", "A-Za-z0-9_-", 35, True, True),
    ("sk_live_", "A-Za-z0-9", 16, False, True),
    ("sk_test_", "A-Za-z0-9", 16, False, True),
    ("rk_live_", "A-Za-z0-9", 16, False, True),
    ("rk_test_", "A-Za-z0-9", 16, False, True),
    ("whsec_", "A-Za-z0-9", 16, False, True),
    ("glpat-", "A-Za-z0-9_-", 20, False, True),
    ("npm_", "A-Za-z0-9", 36, True, True),
    ("hf_", "A-Za-z0-9", 30, False, True),
    ("ya29.", "A-Za-z0-9_-", 20, False, True),
    ("dop_v1_", "A-Za-z0-9", 40, False, True),
]
SCHEMES = ("http", "https", "postgres", "postgresql", "mysql", "mongodb", "mongodb+srv", "redis", "amqp")
MOST_KEY_BLOCK, LONGEST_KEY_NAME, LEAST_BASIC, LEAST_SEGMENT = 16_384, 128, 8, 8
# What every text with a span holds, so that other texts need not go to Python.
MAY_HOLD = "(?iu)" + "|".join(["api[_-]?key", "token", "secret", "passw", "private[_-]?key", "private key", "bearer", "auth", "://", "eyJ", *(re.escape(p) for p, *_ in VENDORS)])


def _spellings(labels: tuple[str, ...]) -> tuple[str, ...]:
    """Every label with each "_" as it is, as "-" and left out."""
    out = []
    for parts in (label.split("_") for label in labels):
        for gaps in product(("_", "-", ""), repeat=len(parts) - 1):
            out.append("".join(a + b for a, b in zip(parts, (*gaps, ""), strict=True)))
    return tuple(out)


_PLAIN, _QUOTED = _spellings(LABELS), _spellings(QUOTED_LABELS)
_LONGEST = max(map(len, (*_PLAIN, *_QUOTED, *SCHEMES))) + 1
_SPACE, _INK, _SEPARATOR = re.compile(r"\s*"), re.compile(r"\S+"), re.compile("[:=]")
_QUOTE = re.compile("[\"']")
_ENCODED = re.compile("[A-Za-z0-9+/=]*")


def _ends_with(text: str, end: int, names: tuple[str, ...], start: int = 0) -> bool:
    return text[max(start, end - _LONGEST) : end].casefold().endswith(names)


def _before_space(text: str, at: int) -> int:
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _in_quotes(text: str, end: int) -> bool:
    """Whether a quoted label ends (with its quote) at `end`."""
    if end < 2 or text[end - 1] not in "\"'":
        return False
    end -= 2 if text[end - 2] == "\\" else 1
    start = max(text.rfind('"', max(0, end - _LONGEST), end), text.rfind("'", max(0, end - _LONGEST), end))
    return start >= 0 and text[start + 1 : end].casefold() in _QUOTED


def labelled(text: str) -> Iterator[Span]:
    done = quoted = 0  # where the last value of each sort ended
    for m in _SEPARATOR.finditer(text):
        at = m.start()
        value = _SPACE.match(text, at + 1).end()
        label = _before_space(text, at)
        if at >= done and value < len(text):
            named = _ends_with(text, label, _PLAIN, done)
            header = not named and _ends_with(text, label, HEADERS, done)
            if named or header and not _is_basic(text, value):
                done = _INK.match(text, value).end()
                yield value, done
        if at >= quoted and m[0] == ":" and _in_quotes(text, label):
            start = value + 1 if text[value : value + 1] == "\\" else value
            if text[start : start + 1] in ("'", '"'):
                close = _QUOTE.search(text, start + 1)
                if close and close.start() > start + 1:
                    end = close.start()
                    quoted = end
                    yield start + 1, end - 1 if text[end - 1] == "\\" and end > start + 2 else end


def _is_basic(text: str, at: int) -> bool:
    return text[at : at + 5].casefold() == "basic" and text[at + 5 : at + 6] in (" ", "\t")


def basic(text: str) -> Iterator[Span]:
    """The scheme's name and what follows it, if that looks like base64 (a digit, a sign, padding, a capital within); the name alone if it is too short to tell, nothing before a plain word."""
    for m in _SEPARATOR.finditer(text):
        at = _SPACE.match(text, m.end()).end()
        if not _is_basic(text, at) or not _ends_with(text, _before_space(text, m.start()), HEADERS):
            continue
        start = at + 5
        while text[start : start + 1] in (" ", "\t") and start < len(text):
            start += 1
        word = _ENCODED.match(text, start)[0]
        if word[:1].isalpha() and word.isalpha() and word[1:] == word[1:].lower():
            continue
        encoded = len(word) >= LEAST_BASIC and (not word.isalpha() or any(a.islower() and b.isupper() for a, b in zip(word, word[1:], strict=False)))
        yield at, start + len(word) if encoded else at + 5


def bearer(text: str) -> Iterator[Span]:
    follows = False
    for m in _INK.finditer(text):
        if follows:
            yield m.span()
        follows = not follows and m[0][-6:].casefold() == "bearer"


_RUNS = {(alphabet, n, whole): re.compile(f"[{alphabet}]{{{n}}}" if whole else f"[{alphabet}]{{{n},}}") for _, alphabet, n, whole, _ in VENDORS}
_BY_PREFIX = {p.casefold(): (p, _RUNS[a, n, whole], exact) for p, a, n, whole, exact in VENDORS}
_PREFIX = re.compile("|".join(sorted(map(re.escape, _BY_PREFIX), key=len, reverse=True)), re.IGNORECASE | re.ASCII)


def _may_start(text: str, at: int) -> bool:
    """Not within a word; a written-out escape before a word is no part of it."""
    before = text[at - 1 : at]
    return not (before.isascii() and before.isalnum()) or at > 1 and text[at - 2] == "\\" and before in "nrtbf"


def vendors(text: str) -> Iterator[Span]:
    at = 0
    while m := _PREFIX.search(text, at):
        prefix, run, exact = _BY_PREFIX[m[0].casefold()]
        found = (not exact or m[0] == prefix) and _may_start(text, m.start()) and run.match(text, m.end())
        if found:
            yield m.start(), found.end()
        at = found.end() if found else m.start() + 1


def web_tokens(text: str) -> Iterator[Span]:
    for m in re.finditer("[A-Za-z0-9_.-]+", text):
        parts, at, free = m[0].split("."), m.start(), 0
        for k in range(len(parts) - 2):
            head = parts[k].find("eyJ")
            opened = head >= 0 and len(parts[k]) >= head + 3 + LEAST_SEGMENT
            if k >= free and opened and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) >= 3 + LEAST_SEGMENT and len(parts[k + 2]) >= LEAST_SEGMENT:
                yield at + head, at + sum(map(len, parts[k : k + 3])) + 2
                free = k + 3
            at += len(parts[k]) + 1


_USER = re.compile(r"([^/\s@]+)@\S")


def addresses(text: str) -> Iterator[Span]:
    at = text.find("://")
    while at >= 0:
        if _ends_with(text, at, SCHEMES) and (m := _USER.match(text, at + 3)):
            yield m.span(1)
        at = text.find("://", at + 3)


def _key_names(text: str, opening: str) -> Iterator[Span]:
    """Spans of the first (or last) lines of private keys."""
    at = text.find(opening)
    while at >= 0:
        start = at + len(opening)
        end = text.find("-----", start, start + LONGEST_KEY_NAME)
        words = text[start:end].split(" ") if end >= 0 else []
        if words[-1:] == ["BLOCK"]:
            words.pop()
        if words[-2:] == ["PRIVATE", "KEY"] and all(re.fullmatch("[A-Z0-9]+", w) for w in words):
            yield at, end + 5
        at = text.find(opening, start)


def private_keys(text: str) -> Iterator[Span]:
    starts, ends = list(_key_names(text, "-----BEGIN ")), list(_key_names(text, "-----END "))
    for k, (a, b) in enumerate(starts):
        last = min(b + MOST_KEY_BLOCK, starts[k + 1][0] if k + 1 < len(starts) else len(text))
        e = bisect_left(ends, (b, 0))
        if e < len(ends) and ends[e][0] <= last:
            yield a, ends[e][1]
            continue
        while True:  # a line break, real or written out, and encoded characters
            brk = next((n for n in ("\r\n", "\n", "\\n") if text.startswith(n, b)), None)
            line = _ENCODED.match(text, b + len(brk)).end() if brk else b
            if not brk or line == b + len(brk):
                break
            b = line
        yield a, b


READERS = (labelled, basic, bearer, vendors, web_tokens, addresses, private_keys)


def spans(text: str) -> list[Span]:
    """Spans of all readers in their order, overlapping ones as one."""
    out: list[Span] = []
    for a, b in sorted(s for read in READERS for s in read(text)):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


def replaced(text: str, found: list[Span], by: str) -> str:
    at, parts = 0, []
    for a, b in found:
        parts += [text[at:a], by]
        at = b
    return "".join([*parts, text[at:]])


def replaced_in_parts(fields: list[str], by: str) -> list[str]:
    """Fields as if they were lines of one text: a label in one and its value in the next are seen together."""
    found, out, start, k = spans("\n".join(fields)), [], 0, 0
    for field in fields:
        end = start + len(field)
        while k < len(found) and found[k][1] <= start:
            k += 1
        mine, j = [], k
        while j < len(found) and found[j][0] < end:
            a, b = max(found[j][0], start), min(found[j][1], end)
            if a < b:
                mine.append((a - start, b - start))
            j += 1
        out.append(replaced(field, mine, by))
        start = end + 1
    return out
