"""A content-addressed archive of WARC records.

Payload bytes are stored once, under their SHA-256; the exact header bytes of every record (WARC header,
blank line, HTTP header, blank line) are stored apart, with the digest of the payload that follows them. A
record's bytes come back by a join on the digest. When an archive is read, the stored bytes are hashed
again, and bytes that don't have their digest fail the read, as does a record without its payload.

The store is two Parquet tables, payloads in buckets of their digest. ``write_warc`` gives the same records as
ordinary WARC files, and ``read_warc`` reads such files from anywhere into rows that ``write_archive`` can take.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.storage import Scratch

LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
HEAD = 4096
#: Records with one payload that a task may join; those of a payload with more are dealt over several.
MANY = 4096


def _uuid(name) -> F.Column:
    """A record id that the page alone decides."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(name.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _hashed(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))


def contents(pages: DataFrame) -> DataFrame:
    """digest and payload of each row: every payload that the rows' records need, whichever of them are revisits."""
    return _hashed(pages).select("digest", "payload")


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, header, payload, digest (SHA-256), sha1, and of a revisit the page_id it refers to, for each row.

    The payload is the html in UTF-8, empty where it is null. Of equal payloads of at least ``least`` bytes
    the record of the largest page_id is the response, and the others revisit it; smaller payloads are all
    responses. Rows that repeat a page_id with the same payload are all responses if it is the largest.
    """
    rows = _hashed(pages)
    firsts = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
    # only digests that repeat need the join's second side
    firsts = firsts.filter("copies > 1").select("digest", "first_id")
    rows = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    revisit = F.col("refers_to").isNotNull()
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    http = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF)
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    warc = [
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF + "WARC-Record-ID: <urn:uuid:"), _uuid(F.col("page_id")),
        F.lit(">" + CRLF + f"WARC-Date: {DATE}" + CRLF + "WARC-Target-URI: "), clean,
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.lit(CRLF + "X-Payload-Length: "), F.col("n").cast("string"),
        F.lit(CRLF + "X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: <urn:uuid:"), _uuid(F.col("refers_to")), F.lit(">" + CRLF + "X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))).otherwise(F.lit("")),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), length.cast("string"),
        F.lit(CRLF + CRLF), http,
    ]
    return rows.select("page_id", F.concat(*warc).cast("binary").alias("header"), "payload", "digest", revisit.alias("revisit"))


def write_archive(scratch: Scratch, recs: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The two tables of the archive: payloads (digest, payload), headers (header, digest; null in a revisit).

    ``found`` has the payloads where they can be had without what it takes to tell the records, as from
    ``contents``; these are otherwise read from the responses.
    """
    headers = scratch.keep(recs.select("header", F.when(~F.col("revisit"), F.col("digest")).alias("digest")), "headers")
    found = recs.filter(~F.col("revisit")).select("digest", "payload") if found is None else found
    # the partial aggregate of each task drops copies before the only shuffle that payloads make
    payloads = found.groupBy("digest").agg(F.first("payload").alias("payload"))
    return scratch.keep(payloads, "payloads", by="digest"), headers


def read_archive(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """Every record's bytes: column record. Stored bytes that don't have their digest fail the read.

    Headers go to the buckets of the payloads. Those of a digest that more than ``MANY`` records have are dealt
    over several parts, each with a copy of its payload, so that no task gets them all.
    """
    bad = F.raise_error(F.concat(F.lit("payload without its digest: "), F.hex("digest"))).cast("binary")
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(bad).alias("payload")
    lost = F.raise_error(F.concat(F.lit("no payload of digest "), F.hex("digest"))).cast("binary")
    end = F.lit(CRLF + CRLF).cast("binary")
    full = headers.filter("digest IS NOT NULL")
    # at most one row for MANY records
    popular = full.groupBy("digest").agg(F.ceil(F.count("*") / MANY).cast("int").alias("parts")).filter("parts > 1")
    rare = full.join(F.broadcast(popular), "digest", "left_anti").join(payloads.select("digest", sound), "digest", "left")
    dealt = full.join(F.broadcast(popular), "digest").withColumn("part", F.pmod(F.monotonically_increasing_id(), "parts").cast("int")).drop("parts")
    copies = payloads.join(F.broadcast(popular), "digest").select("digest", sound, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = dealt.join(copies, ["digest", "part"], "left")
    whole = F.concat("header", F.coalesce("payload", lost), end).alias("record")
    return rare.select(whole).unionAll(dealt.select(whole)).unionAll(headers.filter("digest IS NULL").select(F.concat("header", end).alias("record")))


def parse_records(recs: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records (record: their bytes).

    A response's payload is measured and hashed from its own bytes, and must be what its header says. A
    revisit has no payload; it tells of the one that it refers to.
    """
    # both headers end in the first bytes; where they don't, as after a very long address, all bytes are searched
    recs = recs.select("record", F.decode(F.substring("record", 1, HEAD), "ISO-8859-1").alias("head"))
    recs = recs.select("record", F.when(F.substring_index("head", CRLF + CRLF, 2) != F.col("head"), F.col("head")).otherwise(F.decode("record", "ISO-8859-1")).alias("head"))
    recs = recs.withColumn("cut", F.instr("head", CRLF + CRLF)).withColumn("warc", F.substring("head", F.lit(1), F.col("cut")))
    part = F.substring(F.col("record"), F.col("cut") + 4, F.octet_length("record") - F.col("cut") - 7)
    field = lambda name: F.regexp_extract("warc", rf"\r\n{name}: ([^\r\n]*)", 1)
    revisit = F.regexp_extract("warc", r"\r\nWARC-Type: (\w+)", 1) == "revisit"
    recs = recs.withColumn("block", part).withColumn("http", F.instr(F.substring("head", F.col("cut") + 4, F.length("head")), CRLF + CRLF))
    body = F.substring(F.col("block"), F.col("http") + 4, F.octet_length("block") - F.col("http") - 3)
    recs = recs.withColumn("body", body).withColumn("said", field("WARC-Payload-Digest"))
    recs = recs.withColumn("found", F.when(revisit, F.concat(F.lit("sha1:"), F.element_at(F.split("said", ":"), -1))).otherwise(F.concat(F.lit("sha1:"), F.sha1("body"))))
    sound = (F.col("found") == F.col("said")) & (F.octet_length("block") == field("Content-Length").cast("long"))
    digest = F.when(sound, F.substring("found", 6, 40)).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), F.col("warc"))).cast("string"))
    number = lambda name: F.when(field(name) != "", field(name)).cast("long")
    size = F.when(revisit, number("X-Payload-Length")).otherwise(F.octet_length("body").cast("long"))
    return recs.select(number("X-Page-ID").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, number("X-Refers-To-Page-ID")).alias("refers_to"))


def write_warc(recs: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files of records (record: their bytes) under path; any store that Spark writes to."""
    # a record ends with CR LF CR LF, of which the writer's line separator is the last byte
    recs.select(F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 1).cast("string").alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (record: their bytes) of the WARC files under path, plain or gzip; lengths come from the headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for data in batch.column("content"):
                data = data.as_py()
                while data[:2] == b"\x1f\x8b":
                    plain, rest = [], data
                    while rest[:2] == b"\x1f\x8b":
                        unpack = zlib.decompressobj(31)
                        plain.append(unpack.decompress(rest) + unpack.flush())
                        rest = unpack.unused_data
                    data = b"".join(plain)
                at, out = 0, []
                while data.startswith(b"WARC/", at):
                    head = data.index(b"\r\n\r\n", at)
                    long = int(re.search(rb"\r\nContent-Length:\s*(\d+)", data[at : head + 2], re.I)[1])
                    out.append(data[at : head + 8 + long])
                    at = head + 8 + long
                if at < len(data):
                    raise ValueError(f"no WARC record at byte {at}")
                for k in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(out[k : k + 256], pa.binary())], ["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return parse_records(read_archive(*write_archive(Scratch(spark, "warc"), records(pages), contents(pages))))


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
  FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> last_id THEN last_id END AS refers_to
FROM p
"""
