import hashlib
import re

from frames import docs, odd_rows, prose, rows

from ledgerloom.llm import secrets

KEY = "A" + "KIA" + "ABCDEFGHIJKLMNOP"


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    label = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    return tuple(sum(f[2] == k for f in found) for k in ("assign", "access", "hex")), hashlib.sha256(label.encode()).hexdigest(), label


TEXTS = [
    "password = hunter22 and Token:'abcdef' secret=ab", f"{KEY} {KEY}Z AKIAshort", "deadbeef" * 3 + " " + "ab" * 11 + " " + "0" * 40, "é😀 api_key: \"x.y/z+q=\" 😀 APIKEY=1234567",
    "secret=token : abcdefg", "token=secret=abcdefgh", "password=\n passwd  =  longenough", "tokentokentoken=abcdefg0123456789abcdef0123456789abcdef", "",
]


def test_spans_equal_python_regexes(spark, monkeypatch):
    source = odd_rows() + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(500, (prose(50, 3) + f" secret: abcdef{KEY} ") * 40)]
    df = docs(spark, source)
    monkeypatch.setattr(secrets, "table", lambda *a: df)
    got = secrets.op4_blob_ledger_secrets(spark, "").collect()
    want = sorted(((k, *brute(t)[0], brute(t)[1]) for k, t in source), key=repr)
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=repr) == want


def test_only_unseen_pairs_are_scanned(spark):
    versions = docs(spark, [(1, TEXTS[0]), (2, TEXTS[1]), (3, TEXTS[0])])
    blobs = secrets.distinct_blobs(versions, "text")
    ledger = secrets.scan(blobs, None, secrets.BASE_RULES)
    assert ledger.count() == 2
    assert secrets.scan(blobs, ledger, secrets.BASE_RULES).count() == 0
    newer = (secrets.Rule("hex", "[0-9a-f]{8,}", version=2), *secrets.BASE_RULES[:2])
    again = secrets.scan(blobs, ledger, newer)
    assert [r.rules for r in again.collect()] == [["hex@2"]] * 2
    more = secrets.scan(secrets.distinct_blobs(docs(spark, [(9, "new text")]), "text"), ledger)
    assert more.count() == 1
    assert secrets.scan(blobs, secrets.new_ledger(spark)).count() == 2


def test_findings_reach_every_path_and_text_is_masked(spark):
    df = docs(spark, [(1, TEXTS[0]), (2, TEXTS[0]), (3, "fine"), (4, None)])
    found = secrets.scanned(df)
    got = {r.doc_id: r.t for r in found.select("doc_id", secrets.redacted(found["text"], found["spans"]).alias("t")).collect()}
    assert got == {1: "[redacted] and [redacted]' secret=ab", 2: "[redacted] and [redacted]' secret=ab", 3: "fine", 4: None}


def test_overlapping_spans_become_one_mask(spark):
    text = "x token=" + "ab" * 20 + " y"
    found = secrets.scanned(docs(spark, [(1, text), (2, "ab" * 20)]))
    got = dict(found.select("doc_id", secrets.redacted(found["text"], found["spans"])).collect())
    assert got == {1: "x [redacted] y", 2: "[redacted]"}


def test_empty_table(spark):
    assert rows(secrets.scanned(docs(spark, []))) == []


def test_findings_of_an_earlier_rule_version_do_not_count(spark, tmp_path):
    versions = docs(spark, [(1, "deadbeef00"), (2, "password=xyzxyz12"), (3, None)])
    folder = f"file://{tmp_path}/ledger"
    old, new = (secrets.Rule("hex", "[0-9a-f]{8,}"),), (secrets.Rule("hex", "[0-9a-f]{40,}", version=2),)
    kept = secrets.record(versions, folder, "text", old)
    seen = lambda ledger, rules: {r.doc_id: [s.kind for s in r.spans] for r in secrets.findings(versions, ledger, "text", rules).collect()}
    assert seen(kept, old) == {1: ["hex"], 2: [], 3: []}
    both = secrets.record(versions, folder, "text", new)
    assert both.count() == 6
    assert seen(both, new) == {1: [], 2: [], 3: []} and seen(both, old) == {1: ["hex"], 2: [], 3: []}
    assert secrets.record(versions, folder, "text", new).count() == 6  # nothing was left to scan


def test_clashing_and_unhashable_columns(spark):
    from pyspark.sql import functions as F

    df = docs(spark, [(1, TEXTS[0]), (2, None)]).withColumn("spans", F.lit(1)).withColumn("blob", F.lit("b")).withColumn("_part", F.lit(9)).withColumn("part", F.lit(8)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = {r.doc_id: r for r in secrets.scanned(df).collect()}
    assert len(got[1].spans) == 2 and got[2].spans == [] and got[1]._part == 9 and got[1].part == 8 and got[1].m == {"a": 1} and len(got[1].blob) == 64


def test_long_texts_with_many_secrets(spark):
    import re

    text = " ".join(f"é{i} token={i:08d}" + (" 😀" * 7 if i % 50 == 0 else "") for i in range(6_000))
    found = secrets.scanned(docs(spark, [(1, text), (2, "token=" + "x" * 9_000 + " z")]))
    got = {r.doc_id: (r.t, len(r.spans)) for r in found.select("doc_id", "spans", secrets.redacted(found["text"], found["spans"]).alias("t")).collect()}
    assert got == {1: (re.sub(r"token=\d{8}", "[redacted]", text), 6_000), 2: ("[redacted] z", 1)}


def test_a_ledger_table_scans_only_what_it_lacks(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/ledger"
    first = docs(spark, [(1, TEXTS[0]), (2, TEXTS[1]), (3, TEXTS[0]), (4, None)])
    assert secrets.record(first, folder, "text", secrets.BASE_RULES).count() == 3
    assert secrets.record(first, folder, "text", secrets.BASE_RULES).count() == 3  # nothing is lacking
    more = first.unionByName(docs(spark, [(5, "password=abcdefgh"), (6, "password=abcdefgh")]))
    assert secrets.record(more, folder, "text", secrets.BASE_RULES).count() == 4
    monkeypatch.setattr(secrets, "MOST_TOLD", 0)  # contents are found in a join
    every = secrets.record(more, folder, "text")
    assert every.count() == 8 and {len(r.rules) for r in every.collect()} == {3}
    found = {r.doc_id: [s.kind for s in r.spans] for r in secrets.findings(more, every, "text").collect()}
    assert found[5] == found[6] == ["assign"] and found[1] == found[3] and found[4] == []


def test_web_tokens_have_the_lengths_of_their_format(spark):
    import base64

    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    head, body, sign = part(b'{"alg":"HS256"}'), part(b'{"sub":"7"}'), part(bytes(range(32)))
    df = docs(spark, [(1, f"a {head}.{body}.{sign} b"), (2, f"{head}.{body}"), (3, f"{head}.{body}.short"), (4, f"{part(b'{}')}.{body}.{sign}")])
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scanned(df).collect()}
    assert got == {1: ["jwt"], 2: [], 3: [], 4: []}
