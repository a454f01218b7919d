"""Round trips through archives, with magic in payloads and tiny splits."""

import base64
import hashlib

import pytest

from ledgerloom.llm import warc
from ledgerloom.llm.common import scratch_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few hundred bytes, so records and payloads cross them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def round_trip(spark, rows, payloads=True, files=1):
    path = scratch_path(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, value int")
    warc.write_warc(df.coalesce(files), path)
    return path, warc.read_warc(spark, path, payloads=payloads).toPandas()


PAGES = [
    (1, "http://a/", "plain", "x", 1),
    (2, None, None, None, None),
    (3, "http://b/?q= \r\nWARC/1.0", f"before\r\n\r\n{FAKE}after", "x", 1),
    (4, "http://c/", FAKE * 40, "x", 1),
    (5, "http://d/", "é😀" * 400 + "\r\n\r\nWARC/1.0\r\n", "x", 1),
    (6, "http://e/", "plain", "x", 1),
    (7, "http://f/", "", "x", 1),
    (8, "http://g/", "\n" * 700 + "WARC/1.1", "x", 1),
    (9, "http://h/", "\r\n\r\n", "x", 1),
    (10, "http://i/", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n" + "z" * 2000, "x", 1),
    (11, "http://j/", f"{FAKE}" + "tail " * 500, "x", 1),
    (None, "http://k/", "no id", "x", 1),
]


def check(pages, found):
    top = {}
    for r in pages:
        if r[0] is not None:
            top[r[2] or ""] = max(top.get(r[2] or "", r[0]), r[0])
    assert len(found) == len(pages)
    for i, _, html, *_ in pages:
        rec = found[found["record_id"] == f"<urn:page:{'null' if i is None else i}>"]
        assert len(rec) == 1
        rec = rec.iloc[0]
        assert rec["named_digest"] == "sha1:" + digest(html) and rec["named_bytes"] == len((html or "").encode())
        if top.get(html or "", i) == i:
            assert rec["record_type"] == "response" and rec["payload_digest"] == digest(html)
            assert rec["payload_bytes"] == len((html or "").encode())
            if rec["payload"] is not None:
                assert bytes(rec["payload"]) == (html or "").encode()
        else:
            assert rec["record_type"] == "revisit" and rec["refers_to"] == f"<urn:page:{top[html or '']}>"


@pytest.mark.parametrize("payloads", [True, False])
def test_round_trip(spark, payloads):
    check(PAGES, round_trip(spark, PAGES, payloads)[1])


@pytest.mark.parametrize("payloads", [True, False])
def test_round_trip_over_tiny_splits(spark, tiny_splits, payloads):
    check(PAGES, round_trip(spark, PAGES, payloads)[1])


def test_offsets_are_those_of_the_files(spark, tiny_splits):
    path, found = round_trip(spark, PAGES, files=2)
    for file, g in found.groupby("file"):
        with open(file.partition(":")[2].replace("///", "/"), "rb") as f:
            raw = f.read()
        for at in g["start"]:
            assert raw[at:at + 10] == b"WARC/1.0\r\n"


def test_archive_is_plain_warc(spark):
    path, _ = round_trip(spark, PAGES[:1])
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    head, _, rest = text.partition("\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    n = int(fields["Content-Length"])
    assert head.startswith("WARC/1.0\r\n") and rest[n:] == "\r\n\r\n" and rest[:n].endswith("\r\n\r\nplain")


def test_repeated_rows_and_small_payloads(spark):
    rows = [(1, "u", "same", "", 0), (1, "u", "same", "", 0), (2, "u", "x", "", 0), (3, "u", "x", "", 0)]
    found = round_trip(spark, rows)[1]
    assert sorted(found["record_type"]) == ["response"] * 3 + ["revisit"]
    path = scratch_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, value int"),
                    path, min_bytes=2)
    assert sorted(r.record_type for r in warc.read_warc(spark, path).collect()) == ["response"] * 4


def test_empty_table_and_files_that_are_no_archives(spark):
    assert round_trip(spark, [])[1].empty
    path = scratch_path(spark, "warc-test")
    spark.createDataFrame([("junk",), (FAKE,)], "value string").coalesce(1).write.text(path)
    assert warc.read_warc(spark, path).collect() == []


def test_broken_tail_ends_the_chain(spark):
    path = scratch_path(spark, "warc-test")
    broken = FAKE.replace("Content-Length: 5", "Content-Length: five")
    spark.createDataFrame([(FAKE + broken + FAKE,)], "value string").write.option("lineSep", "\n").text(path)
    assert [r.start for r in warc.read_warc(spark, path).collect()] == [0]
