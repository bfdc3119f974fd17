"""Redaction: every reader on texts made from its table, what stays, hostile texts, fields, and the prefilter."""

import random
import re
import string
import time

import pytest

from ledgerloom.functions import credentials as C
from ledgerloom.functions import text as X

R = X.REDACTION
FILLER = "Wq7Lm2Xc9Vb4Nt6Rz1Ks8Pd3Hf5Jg0YaUeIo"
PEM = "Zm9yZ2V0dGhpc2xpbmU0Mg"


def letters(alphabet, n):
    allowed = [c for c in FILLER if re.match(f"[{alphabet}]", c)]
    return "".join(allowed[i % len(allowed)] for i in range(n))


@pytest.mark.parametrize("label", C.LABELS)
def test_a_value_after_its_label_goes(label):
    for name in (label, label.upper(), label.replace("_", "-"), label.replace("_", ""), f"STAGING_{label}"):
        for gap in ("=", ": ", ":\n  ") if label == "bearer" else ("=", ": ", " = ", "\t:", "\n=", ":\n  "):  # the word after "bearer " goes anyway
            assert X.redact_text(f"set {name}{gap}plum/77?! then") == f"set {name}{gap}{R} then"
    if label != "bearer":
        assert X.redact_text(f"the {label} is long; {label}s: two") == f"the {label} is long; {label}s: two"


@pytest.mark.parametrize("label", C.QUOTED_LABELS)
def test_a_quoted_value_goes_up_to_its_quote(label):
    for q in ('"', "'", '\\"'):
        text = f"{{{q}id{q}: 4, {q}{label}{q}: {q}two words, {q}, {q}z{q}: 1}}"
        assert X.redact_text(text) == f"{{{q}id{q}: 4, {q}{label}{q}: {q}{R}{q}, {q}z{q}: 1}}"
    assert X.redact_text(f'"my {label}": 12') == f'"my {label}": 12'


def test_headers_and_bearer_values():
    code = "bWFyYTpzdW5mbG93ZXI="
    assert X.redact_text(f"-H 'Authorization: Basic {code}' -v") == f"-H 'Authorization: {R}' -v"
    assert X.redact_text("Proxy-auth = BASIC abc1 end") == f"Proxy-auth = {R} abc1 end"  # too short to tell: the scheme's name only
    assert X.redact_text("authorization: basic access only") == "authorization: basic access only"
    assert X.redact_text("AUTH=q1w2 ok") == f"AUTH={R} ok" and X.redact_text("oauth: Digest x") == f"oauth: {R} x"
    assert X.redact_text("send Bearer\n pear.42 now") == f"send Bearer\n {R} now"
    assert X.redact_text("a bearer of news") == f"a bearer {R} news"  # any word after it


@pytest.mark.parametrize("prefix,alphabet,n,whole,exact", C.VENDORS)
def test_vendors_tokens_go_where_a_word_may_start(prefix, alphabet, n, whole, exact):
    token = prefix + letters(alphabet, n)
    for before in ("", "(", "_", "é", "/", "cut\\n", "cut\\t"):
        assert X.redact_text(f"{before}{token} end") == f"{before}{R} end"
    more = X.redact_text(f"<{token}{letters(alphabet, 5)}>")
    assert more == (f"<{R}{letters(alphabet, 5)}>" if whole else f"<{R}>")
    for text in (f"x{token}", f"9{token}", f"see {prefix}{letters(alphabet, n - 1)} here"):
        assert X.redact_text(text) == text
    other = token.swapcase()
    assert (X.redact_text(other) == other) == exact


def test_web_tokens_have_three_segments():
    head, body, sign = "eyJ" + letters("A-Za-z", 9), "eyJ" + letters("A-Za-z0-9_-", 14), letters("A-Za-z0-9_-", 12)
    assert X.redact_text(f"jwt {head}.{body}.{sign}, ok") == f"jwt {R}, ok"
    assert X.redact_text(f"pre-{head}.{body}.{sign}.tail") == f"pre-{R}.tail"
    for text in (f"{head}.{body}", f"{head}.{sign}.{body}", f"eyJshort.{body}.{sign}", f"{head}.{body}.tiny"):
        assert X.redact_text(text) == text


@pytest.mark.parametrize("scheme", C.SCHEMES)
def test_user_parts_of_addresses_go(scheme):
    assert X.redact_text(f"{scheme}://reader:pa55@db.example:1/x") == f"{scheme}://{R}@db.example:1/x"
    for text in (f"{scheme}://db.example/x@y", f"{scheme}://a b@c", f"{scheme}://@host", f"{scheme}://name@ "):
        assert X.redact_text(text) == text
    assert X.redact_text("gopher://who@where") == "gopher://who@where"


@pytest.mark.parametrize("name", ["PRIVATE KEY", "RSA PRIVATE KEY", "EC2 NEW PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])
@pytest.mark.parametrize("br", ["\n", "\r\n", "\\n"])
def test_private_keys(name, br):
    first, last = f"-----BEGIN {name}-----", f"-----END {name}-----"
    assert X.redact_text(f"file{br}{first}{br}{PEM}{br}{PEM}=={br}{last}{br}rest") == f"file{br}{R}{br}rest"
    assert X.redact_text(f"{first}{br}{PEM}{br}{PEM}{br}(lost)") == f"{R}{br}(lost)"  # cut off
    twice = f"{first}{br}{PEM}{br}{last} and {first}{br}{PEM}{br}{last}."
    assert X.redact_text(twice) == f"{R} and {R}."
    public = first.replace("PRIVATE", "PUBLIC")
    assert X.redact_text(f"{public}{br}{PEM}") == f"{public}{br}{PEM}"


def test_overlapping_spans_become_one_and_touching_ones_do_not():
    key = "AKIA" + letters("A-Z0-9", 16)
    assert X.redact_text(f"secret: {key}") == f"secret: {R}" and X.redact_text(f"{key}/{key}") == f"{R}/{R}"
    assert C.spans(f"token=passwd={key}") == [(6, 13 + len(key))]
    assert C.spans("") == C.spans("nothing to see") == []


@pytest.mark.parametrize("unit", ["eyJ", "eyJ.", "xoxp-", "\\", "AIza", "token=", "secret:\n", "passwd ", "bearer ", "auth: basic ", "https://", "https://u", '"token":"', "'auth': '", ":=", "-----BEGIN PRIVATE KEY-----", "-----BEGIN ", "-----END PRIVATE KEY-----", "\nQUJD", " ", "@"])
def test_hostile_texts_take_little_time(unit):
    for text in (unit * (100_000 // len(unit)), "token" + unit * 20_000, "-----BEGIN PRIVATE KEY-----" + unit * 20_000, '"password": "' + unit * 20_000, "http://" + unit * 20_000):
        began = time.time()
        X.redact_text(text)
        assert time.time() - began < 5


def test_fields_are_redacted_as_lines_of_one_text():
    assert C.replaced_in_parts(["my token:", "plum77 and more", "", "end"], R) == ["my token:", f"{R} and more", "", "end"]
    pem = f"-----BEGIN PRIVATE KEY-----\n{PEM}\n{PEM}\n-----END PRIVATE KEY-----"
    assert C.replaced_in_parts(["x", *pem.split("\n"), "y"], R) == ["x", R, R, R, R, "y"]
    rng = random.Random(4)
    for _ in range(300):
        fields = ["".join(rng.choice(["token", "=", " ", "a1", '"', ":", "auth", "é"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 6))]
        whole, at, want = C.spans("\n".join(fields)), 0, []
        for f in fields:
            want.append(C.replaced(f, [(max(a - at, 0), min(b - at, len(f))) for a, b in whole if max(a, at) < min(b, at + len(f))], R))
            at += len(f) + 1
        assert C.replaced_in_parts(fields, R) == want


def test_many_fields_take_one_pass():
    began = time.time()
    C.replaced_in_parts(["token: plum77", "no more"] * 5_000, R)
    assert time.time() - began < 1


def test_the_prefilter_lets_no_secret_through(spark):
    rng = random.Random(8)
    atoms = ["token", "Api-Key", "=", ":", " ", '"', "bearer", "auth", "basic", "x1y2z3w4", "://", "https", "u@h", "\n", "-----BEGIN ", "RSA PRIVATE KEY", "-----", *(p + letters(a, n) for p, a, n, *_ in C.VENDORS), *string.punctuation]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 12))) for _ in range(2_000)] + ["plain", "", None, "toKen=abc", "paſſword: x"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.redact("t").alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: t and X.redact_text(t) for i, t in enumerate(texts)}
    assert sum(bool(t and C.spans(t)) for t in texts) > 200
