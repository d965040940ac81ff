"""Content-addressed WARC archive.

Payload bytes are stored once per strong digest (SHA-256), record headers are kept apart exactly as written, and the
original records come back through a join on the digest. Only ids, lengths and digests are shuffled to decide which
record of a group of equal payloads is the response; payloads move once, from the scan to the store.

Defined cases: a null payload is an empty one; a null url is an empty target; rows with a null id are kept, with an
empty record id, and are the last choice for a response; repeated rows are records of their own, of which one is the
response; payloads under ``min_revisit`` bytes are always responses; an empty table gives an empty archive; extra
columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_dir

CRLF = "\r\n"
MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """Two Parquet tables: ``headers(record_id, page_id, digest, header)`` and ``payloads(digest, check, bytes)``."""

    path: str

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/headers")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/payloads")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def record_header(page_id: Column, url: Column, digest: Column, length: Column, refers_to: Column) -> Column:
    """The header block of a WARC/1.1 record, up to and with its blank line. A revisit names the record it refers to
    and has, as the profile for identical payloads wants, the payload's digest but no block of its own."""
    revisit = refers_to.isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), _text(page_id), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(_text(url), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Length", length.cast("string")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))),
        F.lit(CRLF),
    )


def header_field(header: Column, name: str) -> Column:
    """The value of a header line, null where there is none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(header.contains(f"{CRLF}{name}: "), found)


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> Archive:
    """Writes ``pages(page_id, url, html)``. The digest is verified against a second, independent one: two payloads
    that agreed in SHA-256 and differed in the other would stop the job rather than be merged."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    page = pages.select(
        "page_id", "url", payload.alias("bytes"), F.octet_length(payload).cast("long").alias("length"),
        F.sha2(payload, 256).alias("digest"), F.xxhash64(payload).alias("check"),
    )
    light = page.drop("bytes")
    first = light.groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n"),
        F.assert_true(F.min("check") == F.max("check"), "two payloads share a SHA-256").alias("same"),
    )
    again = first.where("n > 1 and same is null").select("digest", "first_id")
    kind = light.join(again, "digest", "left")
    refers = F.when((F.col("length") >= min_revisit) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    # several rows with the smallest id: the payload is stored once all the same, and each of those rows is a response
    kind.select(
        F.concat(F.lit("urn:page:"), _text(F.col("page_id"))).alias("record_id"), "page_id", "digest",
        F.encode(record_header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("length"), refers), "UTF-8").alias("header"),
    ).write.parquet(f"{path}/headers")
    # one row of each digest carries its bytes to the store: the row with the smallest id; of repeats of that row, any
    lone = page.join(again, "digest", "left").where(F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")))
    repeated = light.groupBy("digest", "page_id").count().where("count > 1").select("digest").distinct().withColumn("twice", F.lit(True))
    lone = lone.join(repeated, "digest", "left").select("digest", "check", "bytes", "twice")
    lone.where("twice is null").drop("twice").write.parquet(f"{path}/payloads")
    lone.where("twice").drop("twice").dropDuplicates(["digest"]).write.mode("append").parquet(f"{path}/payloads")
    return Archive(path)


def read_records(spark: SparkSession, archive: Archive, with_bytes: bool = True) -> DataFrame:
    """The original records. Every stored payload is hashed again; ``verified`` is false where it no longer has its
    digest or its length. Columns: page_id, record_type, refers_to, payload_digest, payload_bytes, verified, and with
    ``with_bytes`` the payload and the record as a WARC file would hold it."""
    stored = archive.payloads(spark).select(
        F.col("digest").alias("_digest"), F.sha2("bytes", 256).alias("_again"), F.octet_length("bytes").cast("long").alias("_length"),
        *(["bytes"] if with_bytes else []),
    )
    head = archive.headers(spark).withColumn("text", F.decode("header", "UTF-8"))
    joined = head.join(stored, head.digest == stored._digest, "left")
    revisit = header_field(F.col("text"), "WARC-Refers-To")
    digest = F.substring_index(header_field(F.col("text"), "WARC-Payload-Digest"), ":", -1)
    out = [
        "page_id",
        F.regexp_extract("text", r"\r\nWARC-Type: ([a-z]+)\r\n", 1).alias("record_type"),
        F.regexp_extract(revisit, r"<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
        digest.alias("payload_digest"),
        F.col("_length").alias("payload_bytes"),
        F.coalesce((F.col("_again") == digest) & (F.col("_length") == header_field(F.col("text"), "X-Payload-Length").cast("long")), F.lit(False)).alias("verified"),
    ]
    if with_bytes:
        block = F.when(revisit.isNull(), F.col("bytes")).otherwise(F.encode(F.lit(""), "UTF-8"))
        out += [F.col("bytes").alias("payload"), F.concat("header", block, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record")]
    return joined.select(*out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per row of ``pages``, written to an archive in the shared folder and read back from it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archive = write_archive(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    records = read_records(spark, archive, with_bytes=False)
    return records.select(
        "page_id", "payload_bytes", F.when(F.col("verified"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to"
    )


OP4_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.payload_bytes >= {MIN_REVISIT} AND p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.payload_bytes >= {MIN_REVISIT} AND p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
