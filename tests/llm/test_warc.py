import base64
import glob
import gzip
import hashlib

from frames import prose, rows

from ledgerloom.llm import warc

PAGES = "page_id long, url string, html string, body string, sha1 int"


def pages(spark, source):
    return spark.createDataFrame([(i, u, h, "b", 1) for i, u, h in source], PAGES)


def trip(spark, tmp_path, source):
    out = warc.write(warc.chunked(pages(spark, source), chunk=100), f"file://{tmp_path}").cache()
    out.count()
    return warc.read(out)


def test_round_trip(spark, tmp_path):
    long = prose(2_000, 1) + "é😀\r\n\r\nWARC/1.1\r\n"
    source = [(1, "http://a/", "x"), (2, "http://b/ c\n", "x"), (3, None, None), (4, "u", ""), (5, "u", long), (9, "u", long), (7, "u", "own")]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(trip(spark, tmp_path, source)).collect()}
    for key, _, html in source:
        raw = (html or "").encode()
        same = [k for k, _, h in source if (h or "") == (html or "")]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if key == max(same) else "revisit", None if key == max(same) else max(same))
        assert got[key] == want


def test_payload_chunks_join_to_the_payload_and_files_are_gzip(spark, tmp_path):
    text = prose(1_000, 2)
    chunks = trip(spark, tmp_path, [(1, "u", text)])
    parts = chunks.orderBy("chunk_no").collect()
    assert b"".join(bytes(p.part) for p in parts) == text.encode() and [p.last for p in parts][-1] and sum(p.last for p in parts) == 1
    assert [p.bytes for p in parts][-1] == len(text)
    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/*.warc.gz"))
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and whole.endswith(b"\r\n\r\n")


def test_nulls_repeats_and_empty_table(spark, tmp_path):
    got = rows(warc.records(trip(spark, tmp_path, [(None, None, "a"), (3, "u", "a"), (3, "u", "a"), (None, "u", "b")])).select("page_id", "record_type", "refers_to"))
    assert got == sorted([(None, "revisit", 3), (3, "response", None), (3, "response", None), (None, "response", None)], key=repr)
    assert trip(spark, tmp_path, []).collect() == []


def test_torn_archives_are_refused(tmp_path):
    import io

    import pytest

    with pytest.raises(ValueError):
        list(warc.Records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 9"))))


def test_damage_is_an_error_and_not_a_shorter_result(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    chunks = trip(spark, tmp_path, [(1, "u", "same"), (2, "u", "same"), (3, "u", "other")])
    assert warc.records(chunks).count() == 3
    for bad in (chunks.withColumn("digest", F.when(F.col("page_id") == 3, "X").otherwise(F.col("digest"))), chunks.where("page_id != 2")):
        with pytest.raises(Exception, match="page"):
            warc.records(bad).collect()


def test_record_identifiers_are_unique(spark, tmp_path):
    trip(spark, tmp_path, [(None, None, "a"), (None, None, "a"), (None, "u", "b"), (3, "u", "a"), (3, "v", "a"), (3, "u", "c"), (4, None, "a")]).count()
    heads = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/*.warc.gz")).split(b"\r\n")
    ids = [h for h in heads if h.startswith(b"WARC-Record-ID")]
    assert len(ids) == 7 == len(set(ids))
    assert {h.split(b": ")[1] for h in heads if h.startswith(b"WARC-Refers-To")} <= {h.split(b": ")[1] for h in ids}
