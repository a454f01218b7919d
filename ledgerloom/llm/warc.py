"""WARC archives: writing records, and reading them by boundary chains.

Writing: one record per row, payload in UTF-8 behind a small HTTP header.
Of equal payloads of at least ``min_bytes`` bytes, the row with the largest
id is the ``response``; the others are ``revisit`` records that refer to it.
A record is a line of Spark's text writer whose line separator is the empty
lines that end a record, so files are plain, splittable WARC.

Reading: files are cut at every line that begins with the magic ``WARC/1.``,
in payloads too. Each such place is a candidate record; its header gives the
offset where the next must begin.

1. A task walks one split: it emits its candidates with their successor and
   the first offset their chain reaches behind the split. Sums of the split
   lengths turn offsets in a split into offsets in the file.
2. Pointer jumping over these split exits, from offset 0, doubles the chain
   each round: log2(splits of a file) joins of narrow rows.
3. From the entry so found, every split marks the candidates on its chain.
   The others (magic inside payloads, broken tails) are rejected.
4. A true record whose payload holds magic is put together from its parts.

Defined results: a null payload is empty; a null id is written as ``null``
and read as null; null ids are never the response if a copy has an id; rows
with the same id and payload are all responses; a file that does not begin
with the magic has no records; a chain that meets a broken header ends
there; an empty table or archive gives no records; other columns are not
written.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import stored

MAGIC = "WARC/1."
CUT = "\n" + MAGIC  # no proper prefix of it is a suffix, so a scan can't miss an overlapping match
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, by four 40-bit groups."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0) -> None:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    digest = base32_sha1(payload)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"),
                     payload.alias("payload"), digest.alias("digest"))
    copies = stored(df.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"),
                              F.octet_length(payload).alias("bytes"))
                    .groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"),
                                           F.max("bytes").alias("bytes"))
                    .filter(f"n > 1 AND bytes >= {int(min_bytes)}").select("digest", "winner"), "copies")
    revisit = F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(END))
    uri = F.regexp_replace("uri", r"[\x00-\x20\x7f]", "%20")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, c: F.concat(F.lit(f"{key}: "), c, F.lit("\r\n"))
    record = F.concat(
        F.lit(f"{MAGIC}0\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Bytes", F.octet_length("payload").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                 line("WARC-Refers-To", name(F.col("winner"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.when(revisit, "Content-Length: 0" + END)
        .otherwise(F.concat(F.lit("Content-Length: "),
                            (F.octet_length(http) + F.octet_length("payload")).cast("string"),
                            F.lit(END), http, F.col("payload"))))
    rows.join(copies, "digest", "left").select(record.alias("value")).write.option("lineSep", END).text(path)


_S, _L, _B = T.StringType(), T.LongType(), T.BinaryType()
_PARTS = T.StructType([T.StructField(n, t) for n, t in (
    ("file", _S), ("block", _L), ("rel", _L), ("next", _L), ("leave", _L), ("whole", T.BooleanType()),
    ("total", _L), ("record_type", _S), ("record_id", _S), ("target_uri", _S), ("date", _S), ("refers_to", _S),
    ("content_type", _S), ("named_digest", _S), ("named_bytes", _L), ("payload_bytes", _L),
    ("payload_digest", _S), ("payload", _B), ("part", _B))])
_HEADERS = {b"warc-type": "record_type", b"warc-record-id": "record_id", b"warc-target-uri": "target_uri",
            b"warc-date": "date", b"warc-refers-to": "refers_to", b"content-type": "content_type",
            b"warc-payload-digest": "named_digest", b"x-payload-bytes": "named_bytes"}


def _header(part: bytes) -> tuple[dict, int, int] | None:
    """Fields, length of the header (from behind the magic) and content length."""
    end = part.find(b"\r\n\r\n")
    if end < 0 or part[1:3] != b"\r\n" or part[:1] not in b"01":
        return None
    found, length = {}, None
    for line in part[3:end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == b"content-length":
            length = int(value) if value.isdigit() and len(value) < 19 else None
        elif key in _HEADERS:
            found[_HEADERS[key]] = value.decode("utf-8", "replace")
    if length is None:
        return None
    named = found.pop("named_bytes", "")
    if named.isdigit() and len(named) < 19:
        found["named_bytes"] = int(named)
    return found, end + 4, length


def _payload(found: dict, content: bytes, keep: bool) -> dict:
    if found.get("content_type", "").startswith("application/http"):
        head, gap, body = content.partition(b"\r\n\r\n")
        content = body if gap else content
    return {"payload_bytes": len(content), "payload_digest": base64.b32encode(hashlib.sha1(content).digest()).decode(),
            "payload": content if keep else None}


class _Split:
    """The candidates of one split, offsets counted from its first cut."""

    def __init__(self, file: str, block: int, payloads: bool, parts: bool):
        self.file, self.block, self.payloads, self.parts = file, block, payloads, parts
        self.at, self.covered, self.rows = 0, -1, []

    def add(self, part: bytes) -> None:
        at, size = self.at, len(part)
        self.at += size + len(CUT)
        if self.block == 0 and at == 0:  # before the first cut: the file's own start
            if not part.startswith(MAGIC.encode()):
                return
            part, at = part[len(MAGIC):], len(MAGIC)
        row = {"rel": at - len(MAGIC), "next": -1, "whole": False}
        head = _header(part)
        if head:
            found, begin, length = head
            row |= found
            row["next"] = at + begin + length + len(END)
            row["whole"] = begin + length <= len(part)
            if row["whole"]:
                row |= _payload(found, part[begin:begin + length], self.payloads)
            else:
                self.covered = max(self.covered, row["next"])
        if self.parts or row["rel"] < self.covered:
            row["part"] = part
        self.rows.append(row)

    def frame(self) -> pd.DataFrame:
        at = {r["rel"]: r for r in self.rows}
        last = self.rows[-1]["rel"] if self.rows else -1
        for r in reversed(self.rows):  # a successor in the split is already done
            after = at.get(r["next"])
            r["leave"] = after["leave"] if after else r["next"] if r["next"] > last else -1
        rows = [*self.rows, {"total": self.at}]
        out = pd.DataFrame(rows, columns=_PARTS.names).assign(file=self.file, block=self.block)
        for c in ("rel", "next", "leave", "total", "named_bytes", "payload_bytes"):
            out[c] = out[c].astype("Int64")
        out["whole"] = out["whole"].astype("boolean")
        return out.astype(object).where(out.notna(), None)


def _split_parts(payloads: bool, parts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for b in batches:
            for file, block, value in zip(b["file"], b["block"], b["value"], strict=True):
                if now is None or (now.file, now.block) != (file, block):
                    if now is not None:
                        yield now.frame()
                    now = _Split(file, block, payloads, parts)
                now.add(bytes(value))
        if now is not None:
            yield now.frame()
    return run


def _mark_chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split on the chain from its entry."""
    after = dict(zip(pdf["rel"], pdf["next"], strict=True))
    at, found = pdf["entry"].iloc[0], []
    while at in after:
        found.append(at)
        at = after[at] if after[at] > at else None
    return pd.DataFrame({"file": pdf["file"].iloc[0], "block": pdf["block"].iloc[0],
                         "rel": np.array(found, dtype=np.int64)})


@F.pandas_udf(T.StructType([T.StructField("payload_bytes", _L), T.StructField("payload_digest", _S),
                            T.StructField("payload", _B)]))
def _joined_payload(parts: pd.Series) -> pd.DataFrame:
    out = []
    for raw in parts:
        raw = bytes(raw)
        found, begin, length = _header(raw)
        out.append(_payload(found, raw[begin:begin + length], True))
    return pd.DataFrame(out, columns=["payload_bytes", "payload_digest", "payload"])


def _records(scan: DataFrame, payloads: bool, parts: bool) -> tuple[DataFrame, DataFrame]:
    """Records, and the files whose split records lack a part."""
    found = stored(scan.mapInPandas(_split_parts(payloads, parts), _PARTS), "warc-parts")
    totals = found.filter("total IS NOT NULL").select("file", "block", "total")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
                   .select("file", "block", "base"), "warc-splits")
    candidates = found.filter("total IS NULL").drop("total").join(bases, ["file", "block"])
    narrow = candidates.select("file", "block", "rel", "next", (F.col("rel") + F.col("base")).alias("start"),
                               F.when(F.col("leave") >= 0, F.col("leave") + F.col("base")).alias("leave"))

    # pointer jumping over the places where chains leave their split
    exits = narrow.select("file", F.col("leave").alias("start")).filter("start IS NOT NULL").distinct()
    jump = (exits.unionByName(bases.filter("block = 0").select("file", F.lit(0).cast("long").alias("start")))
            .distinct().join(narrow.select("file", "start", "leave"), ["file", "start"]))
    reached = bases.filter("block = 0").select("file", F.lit(0).cast("long").alias("start"))
    most = bases.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    span = 1
    while span < most:  # after this round, `reached` holds the first 2 * span entries of each file
        jump, reached = stored(jump, "warc-jumps"), stored(reached, "warc-reached")
        step = jump.filter("leave IS NOT NULL")
        reached = reached.unionByName(
            reached.join(step, ["file", "start"]).select("file", F.col("leave").alias("start"))).distinct()
        onward = jump.select("file", F.col("start").alias("leave"), F.col("leave").alias("further"))
        jump = (step.join(onward, ["file", "leave"], "left")
                .select("file", "start", F.col("further").alias("leave")))
        span *= 2
    entries = narrow.join(reached, ["file", "start"]).select("file", "block", F.col("rel").alias("entry"))
    chain = (narrow.select("file", "block", "rel", "next").join(entries, ["file", "block"])
             .groupBy("file", "block").applyInPandas(_mark_chain, "file string, block long, rel long"))
    true = stored(candidates.join(chain, ["file", "block", "rel"])
                  .withColumn("start", F.col("rel") + F.col("base")), "warc-records")
    columns = ["file", "start", "record_type", "record_id", "target_uri", "date", "refers_to", "named_digest",
               "named_bytes"]
    whole = true.filter("whole").select(*columns, "payload_bytes", "payload_digest", "payload")

    # records with magic in their payload: each part goes to the last true record before it
    owners = true.filter("NOT whole").select("file", "start", (F.col("next") + F.col("base")).alias("until"))
    pieces = candidates.filter("part IS NOT NULL").withColumn("start", F.col("rel") + F.col("base"))
    last = Window.partitionBy("file").orderBy("start", F.col("until").isNull())
    at = pieces.select("file", "start", F.lit(None).cast("long").alias("until")).unionByName(owners)
    owned = (at.withColumn("owner", F.last(F.when(F.col("until").isNotNull(), F.struct("start", "until")), True)
                           .over(last))
             .filter("until IS NULL AND start < owner.until")
             .select("file", "start", F.col("owner.start").alias("owner"), F.col("owner.until").alias("until")))
    joined = (pieces.select("file", "start", "part").join(owned, ["file", "start"])
              .groupBy("file", "owner", "until").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("p"))
              .withColumn("raw", F.reduce("p", F.lit(None).cast("binary"), lambda x, p: F.when(
                  x.isNull(), p["part"]).otherwise(F.concat(x, F.lit(CUT.encode()), p["part"]))))
              .withColumn("complete", F.col("owner") + len(MAGIC) + F.octet_length("raw") + 4 >= F.col("until")))
    ends = owners.join(joined.select("file", F.col("owner").alias("start"), "raw", "complete"), ["file", "start"],
                       "left")
    ends = stored(ends, "warc-joined")
    lacking = ends.filter("complete IS NULL OR NOT complete").select("file").distinct()
    whole_again = (true.filter("NOT whole").drop("payload_bytes", "payload_digest", "payload")
                   .join(ends.filter("complete").select("file", "start", _joined_payload("raw").alias("j")),
                         ["file", "start"])
                   .select(*columns, "j.payload_bytes", "j.payload_digest",
                           F.col("j.payload") if payloads else F.lit(None).cast("binary").alias("payload")))
    return whole.unionByName(whole_again), lacking


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """file, start, record_type, record_id, target_uri, date, refers_to,
    named_digest, named_bytes, payload_bytes, payload_digest, payload: one
    row per record, digests taken from the bytes read."""
    scan = (spark.read.option("lineSep", CUT).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").cast("binary").alias("value")))
    records, lacking = _records(scan, payloads, parts=False)
    if lacking.isEmpty():
        return records
    # parts that lie behind the end of a split: these files once more, with all their parts
    lacking = stored(lacking, "warc-again")
    again, _ = _records(scan.join(lacking, "file", "left_semi"), payloads, parts=True)
    return records.join(lacking, "file", "left_anti").unionByName(again)
