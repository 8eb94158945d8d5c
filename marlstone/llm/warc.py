"""WARC archives: writing with revisits, and a reader that salvages what is left of damaged files.

Writing is Spark's text sink: each row is a record's bytes, and the separator between rows is the blank line that ends a
record, so that part files are plain WARC files wherever Hadoop can write, and a lost executor's part is written again.
Of equal payloads of ``least`` bytes or more, the one of the largest id is a response; the others are revisits that refer
to it and leave out the payload.

The reader checks each record: version line, header block, length, the blank line after it, digest. After a failed
check it searches for the next version line or, in compressed files, the next gzip member, goes on from there, and logs
the bytes between as a gap with the reason. Every byte of a file is in a record or in a gap.

Nulls count as empty payloads and empty target URIs; rows without an id are responses; rows with equal payloads and ids
are written each, and are responses if that id is the largest; an empty table gives an empty archive; other columns are
ignored. A payload may have up to 2 GB less its headers, which is what a Spark string and the reader can hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Members, shared_dir, stored, table

LEAST, PROFILE = 1000, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload that a part file holds at most, unless one record alone has more.
PART_BYTES = 128_000_000
#: Payloads of up to so many bytes share files; the limit on records of a file follows. Larger ones have a file each.
SIZES = (64_000, 4_000_000)


def digests(pages: DataFrame, id_col: str, url_col: str | None, payload_col: str) -> DataFrame:
    text = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    url = [F.regexp_replace(F.coalesce(pages[url_col], F.lit("")), r"[\r\n]", " ").alias("url")] if url_col else []
    return pages.select(pages[id_col].alias("id"), *url, F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), text.alias("payload"))


def decide(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, digest, bytes, refers_to): refers_to is the response's id for revisits, else null."""
    own = stored(digests(pages, id_col, None, payload_col).drop("payload"), "warc-digests")
    return own.join(repeated(own, least), "digest", "left").select("id", "digest", "bytes", F.when((F.col("last") != F.col("id")) & (F.col("bytes") >= least), F.col("last")).alias("refers_to"))


def repeated(own: DataFrame, least: int) -> DataFrame:
    """(digest, last) of payloads of ``least`` bytes or more that rows of different ids share."""
    return own.where((F.col("bytes") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.max("id").alias("last"), F.min("id").alias("first")).where("last > first").drop("first")


def write(pages: DataFrame, path: str, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Plain WARC 1.1 files under ``path``, a record for each row.

    Payloads hardly move: rows whose digest is surely not repeated are written where they are read; of the rest, what is
    a revisit is decided on digests alone, and only rows that may be responses are joined with their payloads."""
    own = stored(digests(pages, id_col, None, payload_col).drop("payload"), "warc-digests")
    twice = stored(repeated(own, least), "warc-repeated")
    rows = digests(pages, id_col, url_col, payload_col)
    keys = stored(twice.select(F.xxhash64("digest").alias("k")), "warc-keys")
    if keys.limit(1).count():
        filter_of = Members(keys)
        may = (F.col("bytes") >= least) & F.col("id").isNotNull() & filter_of.maybe(F.xxhash64("digest"))
        slim = rows.drop("payload").where(may).join(twice.hint("shuffle_hash"), "digest", "left")
        again = F.coalesce(F.col("last") != F.col("id"), F.lit(False))
        revisits = slim.where(again).select("id", "url", "digest", "bytes", F.lit("").alias("payload"), F.col("last").alias("refers_to"))
        which = stored(own.where(may).join(twice.hint("shuffle_hash"), "digest", "left").where(~again).select("id", "digest").distinct(), "warc-responses")
        chosen = Members(stored(which.select(F.xxhash64("id", "digest").alias("k")), "warc-keys"))
        moved = rows.where(may & chosen.maybe(F.xxhash64("id", "digest"))).join(which.hint("shuffle_hash"), ["id", "digest"], "left_semi")
        none = F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to")
        cols = ["id", "url", "digest", "bytes", "payload"]
        rows = rows.where(~may | may.isNull()).select(*cols, none).unionByName(moved.select(*cols, none)).unionByName(revisits)
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast(rows.schema["id"].dataType))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    named = lambda c: F.concat(F.lit("<urn:row:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", named(F.col("id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", named(F.col("refers_to"))), F.lit("WARC-Truncated: length\r\n"))).otherwise(""),
        line("Content-Type", F.lit("text/html;charset=utf-8")), line("Content-Length", F.when(again, "0").otherwise(F.col("bytes").cast("string"))), F.lit("\r\n"),
    )
    size = F.when(again, 0).otherwise(F.col("bytes"))
    kind = F.lit(len(SIZES))
    for i, most in reversed(list(enumerate(SIZES))):
        kind = F.when(F.col("bytes") <= most, i).otherwise(kind)
    met = {r["kind"] for r in own.select(kind.alias("kind")).distinct().collect()} | {0}  # three values at most
    for i in sorted(met):
        low, high = ([-1, *SIZES][i], [*SIZES, None][i])
        part = rows.where((size > low) & (size <= high if high else F.lit(True)))
        record = part.select(F.concat(head, F.when(again, "").otherwise(F.col("payload"))).alias("value"))
        most = PART_BYTES // high if high else 1
        record.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(path)


_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_END = re.compile(rb"\r?\n\r?\n")


def digest_fails(value: str, payload: bytes) -> bool:
    """Of a digest header's value; algorithms other than SHA-1 are not checked."""
    kind, _, given = value.partition(":")
    if kind.lower() != "sha1":
        return False
    own = hashlib.sha1(payload)
    return given.lower() != own.hexdigest() and given.upper() != base64.b32encode(own.digest()).decode()


class Blanks:
    """Where the next blank line begins and ends; searched for once, as questions come in order."""

    def __init__(self, data: bytes):
        self.data, self.found, self.asked = data, None, -1

    def after(self, at: int):
        if self.asked < 0 or (self.found is not None and self.found.start() < at):
            self.found = _END.search(self.data, at)
        self.asked = at
        return self.found


def record_at(data: bytes, at: int, blanks: Blanks | None = None) -> tuple[dict | None, bytes, int, str]:
    """Headers, payload and end of the record that begins at ``at``; or null and what is wrong."""
    first = _VERSION.match(data, at)
    if not first:
        return None, b"", at, "no version line"
    blank = (blanks or Blanks(data)).after(first.end() - 2)
    if not blank:
        return None, b"", at, "headers don't end"
    headers: dict[str, str] = {}
    line = first.end()
    while line < blank.start():
        end = data.find(b"\n", line, blank.start())
        end = blank.start() if end < 0 else end
        colon = data.find(b":", line, end)
        if colon < 0:
            return None, b"", at, "header without colon"
        headers[data[line:colon].strip().lower().decode("latin-1")] = data[colon + 1 : end].strip().decode("utf-8", "replace")
        line = end + 1
    if not (length := headers.get("content-length", "")).isdecimal():
        return None, b"", at, "no length"
    end = blank.end() + int(length)
    if end > len(data):
        return None, b"", at, "cut off"
    if data[end : end + 4] != b"\r\n\r\n":
        return None, b"", at, "no blank line after the payload"
    payload = data[blank.end() : end]
    if headers.get("warc-type") != "revisit":
        if "warc-payload-digest" in headers and "http" not in headers.get("content-type", "") and digest_fails(headers["warc-payload-digest"], payload):
            return None, b"", at, "payload digest differs"
        if "warc-block-digest" in headers and digest_fails(headers["warc-block-digest"], payload):
            return None, b"", at, "block digest differs"
    return headers, payload, end + 4, ""


def salvage_plain(data: bytes):
    """Yields ("record", start, end, headers, payload) and ("gap", start, end, reason, b"") in order; they cover ``data``."""
    at, bad, why, blanks = 0, -1, "", Blanks(data)
    while at < len(data):
        headers, payload, end, wrong = record_at(data, at, blanks)
        if headers is not None:
            if bad >= 0:
                yield "gap", bad, at, why, b""
                bad = -1
            yield "record", at, end, headers, payload
            at = end
            continue
        if bad < 0:
            bad, why = at, wrong
        found = _VERSION.search(data, at + 1)
        at = found.start() if found else len(data)
    if bad >= 0:
        yield "gap", bad, len(data), why, b""


def member_at(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """What the gzip member that begins at ``at`` holds, its length, and what is wrong. No more of the file is looked at."""
    if data[at : at + 3] != b"\x1f\x8b\x08":
        return b"", 0, "no gzip member"
    d, out, fed = zlib.decompressobj(31), [], at
    try:
        while not d.eof and fed < len(data):
            out.append(d.decompress(data[fed : fed + step]))
            fed = min(fed + step, len(data))
    except zlib.error:
        return b"", 0, "member damaged"
    return (b"".join(out), fed - at - len(d.unused_data), "") if d.eof else (b"", 0, "member cut off")


def salvage_members(data: bytes):
    """The same for files of gzip members. Offsets are those of the compressed file; a member's own gaps give the member's."""
    at, bad, why = 0, -1, ""
    while at < len(data):
        out, used, wrong = member_at(data, at)
        if not wrong:
            if bad >= 0:
                yield "gap", bad, at, why, b""
                bad = -1
            for kind, _, _, what, payload in salvage_plain(out):
                yield kind, at, at + used, what, payload
            at += used
            continue
        if bad < 0:
            bad, why = at, wrong
        found = data.find(b"\x1f\x8b\x08", at + 1)
        at = found if found >= 0 else len(data)
    if bad >= 0:
        yield "gap", bad, len(data), why, b""


def salvage(data: bytes):
    """Compressed files are told by their first member, or, if that is damaged, by having no version line."""
    packed = data[:2] == b"\x1f\x8b" or (not _VERSION.search(data) and b"\x1f\x8b\x08" in data)
    return salvage_members(data) if packed else salvage_plain(data)


READ = "file string, kind string, start long, end long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, reason string"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record and each gap (kind) of the files under ``path``. A file is read by one task as a whole
    (2 GB at most); files are spread over tasks."""
    schema = pa.schema([("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), *((x, pa.string()) for x in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])

    def rows(file, data):
        for kind, a, b, h, payload in salvage(data):
            if kind == "gap":
                yield file, kind, a, b, None, None, None, None, None, None, None, h
            else:
                size = h.get("warc-payload-length", "")
                yield file, kind, a, b, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), int(size) if size.isdecimal() else len(payload), payload if with_payload else None, None

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                file, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                some = []
                for row in rows(file, data):
                    some.append(row)
                    if len(some) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    row = lambda c: F.regexp_extract(c, "^<urn:row:(-?[0-9]+)>$", 1)
    whole = F.when(F.col("kind") == "record", F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("gap in"), "file", "start", "reason")).cast("boolean"))
    back = read(spark, path, with_payload=False).where(whole)
    return back.select(row("record_id").cast("long").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.when(F.col("refers_to").isNotNull(), row("refers_to").cast("long")).alias("refers_to"))


OP3_SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
last AS (SELECT html, max(page_id) AS last FROM own WHERE n >= 1000 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(own.html) AS payload_digest,
       CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM own LEFT JOIN last ON own.html = last.html
"""
