"""WARC archives: write, read, and resolve revisits by payload digest.

What is grouped and joined by digest are headers; payloads only meet the plan
that says which records are revisits.  An archive holds about ``archive_bytes``
(so many records as make that at the mean size).  Archives are written by Spark's own text writer (the two line ends
that close a WARC record are its line separator), so the commit protocol covers
lost and repeated tasks, on any store that Spark can write.  They are plain
WARC/1.1 files, not compressed record by record.  Reading uses the binary-file
source, one bounded archive per row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_DUPLICATE_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _uuid(seed: Column) -> Column:
    h = F.md5(seed)
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.lit("-" if a > 1 else ""), F.substring(h, a, n)) for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))], F.lit(">"))


def _record_id(copy: Column) -> Column:
    return _uuid(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("-")), "digest", copy.cast("string")))


def _uri(c: Column) -> Column:
    """A header-safe target: control characters and blanks are escaped, null has a name of its own."""
    safe = F.regexp_replace(F.coalesce(c, F.lit("urn:x-missing")), r"[\x00-\x1F\x7F]", "%0A")
    return F.replace(safe, F.lit(" "), F.lit("%20"))


def records_of(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Capture rows as response records: key, uri, payload (text; null is
    empty), digest (bare hex SHA-1 of its UTF-8 bytes), n_bytes, given_type."""
    text = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    return pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{uri}`").alias("uri"), text.alias("payload"),
                        F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
                        F.lit("response").alias("given_type"))


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_DUPLICATE_BYTES) -> DataFrame:
    """join_key, digest, copies, original for every (key, digest) that repeats
    or shares its payload; ``original`` is the key of the response that holds
    the payload, null if the record itself must hold it.

    Of the responses with equal payloads of at least ``min_bytes`` the one with
    the largest key is the original.  Records given as revisits resolve to it by
    digest too, whatever the size.  Null keys are never originals.  Only headers
    are shuffled; the maximum is a partial aggregate, so a digest with a third
    of all rows costs one row per task there, and the join is split by AQE.
    """
    given = F.max(F.col("given_type") == "revisit")
    originals = headers.groupBy("digest").agg(
        F.max(F.when(F.col("given_type") == "response", F.col("key"))).alias("top"), F.count(F.lit(1)).alias("n"),
        F.max("n_bytes").alias("size")).where("n > 1 and top is not null").drop("n")
    one = headers.groupBy("join_key", "digest").agg(given.alias("was_revisit"), F.count(F.lit(1)).alias("copies"))
    found = F.when((F.col("size") >= min_bytes) | F.col("was_revisit"), F.col("top"))
    return one.join(originals, "digest", "left").select("join_key", "digest", "copies", found.alias("original")).where(
        "copies > 1 or original is not null")


def write_deduplicated(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z",
                       min_bytes: int = MIN_DUPLICATE_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the records with fresh headers: originals and small payloads as
    responses, the others as revisits that refer to their original.

    Rows that repeat both key and payload count as copies of one capture: the
    first is the response, the rest revisit it (small ones are all responses).
    An empty table writes an archive without records.  The plan is stored
    first: Spark then knows its size, and where that is below its broadcast
    threshold payloads go from the scan to the archive without a shuffle.
    """
    records = records.withColumn("join_key", F.coalesce(F.col("key").cast("string"), F.lit("-")))
    headers = records.select("key", "join_key", "digest", "n_bytes", "given_type")
    n, total = headers.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    plan = materialize(resolve_revisits(headers, min_bytes), "warc-plan")
    r = records.join(plan, ["join_key", "digest"], "left")
    order = F.row_number().over(Window.partitionBy("join_key", "digest").orderBy("given_type", "uri"))
    r = r.where("copies is null or copies = 1").withColumn("copy", F.lit(1)).unionByName(
        records.join(plan.where("copies > 1"), ["join_key", "digest"]).withColumn("copy", order))
    first = F.coalesce(F.col("original") == F.col("key"), F.lit(False)) & (F.col("copy") == 1) & (F.col("given_type") == "response")
    revisit = (F.col("given_type") == "revisit") | (F.col("original").isNotNull() & ~first)
    r = r.withColumn("revisit", revisit).withColumn("body", F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    r = r.withColumn("http", http)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    target = _uuid(F.concat_ws("|", F.col("original").cast("string"), "digest", F.lit("1")))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("copy"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("uri"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("key").isNull(), F.lit("")).otherwise(line("X-Capture-Key", F.col("key").cast("string"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), F.when(
            F.col("original").isNotNull(), line("WARC-Refers-To", target)).otherwise(F.lit("")))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", (F.octet_length("http") + F.octet_length("body")).cast("string")), F.lit(CRLF))
    # a value ends with its block; the writer's separator closes the record
    r.select(F.concat(head, "http", "body").alias("value")).write.option("lineSep", CRLF + CRLF).option(
        "maxRecordsPerFile", max(1, archive_bytes * n // (total + 600 * n)) if n else 1).text(path)


READ = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("key", pa.int64()), ("uri", pa.string()),
                  ("refers_to", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary())])


def parse_archive(data, with_payload: bool = True):
    """Yields one dict per record of an archive, by its Content-Length fields."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at:stop].split(b"\r\n")
        if stop < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        named = {k.strip().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        start, at = stop + 4, stop + 4 + int(named[b"content-length"])
        block = data[start:at]
        body = block[block.find(b"\r\n\r\n") + 4:] if named.get(b"content-type", "").startswith("application/http") else block
        held = named[b"warc-type"] != "revisit"
        yield {"record_id": named[b"warc-record-id"], "record_type": named[b"warc-type"], "uri": named.get(b"warc-target-uri"),
               "key": int(named[b"x-capture-key"]) if b"x-capture-key" in named else None,
               "refers_to": named.get(b"warc-refers-to"),
               "digest": hashlib.sha1(body).hexdigest() if held else named[b"warc-payload-digest"].removeprefix("sha1:"),
               "n_bytes": len(body) if held else None, "payload": body if held and with_payload else None}
        at += 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``.  Digest and length of a
    response are those of the payload read; a revisit has the digest its header
    names and no length."""
    def parsed(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse_archive(content.as_py(), with_payload):
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, READ)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(parsed, "record_id string, record_type string, key long, uri string, refers_to string, "
                                    "digest string, n_bytes long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Record headers with what a revisit takes from its response: key, digest,
    n_bytes, record_type, refers_to (the response's key)."""
    cols = ["key", "digest", "n_bytes", "record_type"]
    found = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("key").alias("_k"), F.col("n_bytes").alias("_n"))
    revisits = records.where("record_type = 'revisit'").select(*cols, "refers_to").join(found, "refers_to", "left")
    return records.where("record_type <> 'revisit'").select(*cols, F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("key", "digest", F.col("_n").alias("n_bytes"), "record_type", F.col("_k").alias("refers_to")))
