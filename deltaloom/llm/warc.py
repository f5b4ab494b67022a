"""Content-addressed web archive: each payload once by digest, exact record headers apart.

An archive is two Parquet tables under one root of the shared file system:

* ``payloads`` (digest, payload): every distinct payload once. The digest is SHA-256; a second,
  independent hash and the length of all copies are compared while copies merge, so that two
  payloads under one digest stop the job rather than lose one of them.
* ``headers`` (page_id, digest, record_type, header): one WARC/1.1 header per record, byte for byte.

A record is its header, then its block (the payload; empty for a revisit), then CRLF CRLF. A join
by digest makes the original records again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import cut, new_path, release

#: Payloads under this length are never deduplicated into revisit records.
REVISIT_BYTES = 100
CRLF = "\r\n"


def _line_safe(value: Column) -> Column:
    """Header values stay on one line: CR and LF are percent-encoded."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def classify(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, digest, payload_bytes, refers_to) per row; refers_to is null for a response.

    Only digests and ids are shuffled here, never payloads. Among equal payloads of at least
    `revisit_bytes` the smallest page_id is the response; repeated rows of that id are responses
    too, and rows without an id are responses only if no equal payload has one. A null html is
    the empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    heads = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    first = heads.where(F.col("payload_bytes") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first_id IS NOT NULL").select("digest", "first_id")
    joined = heads.join(cut(first, "warc-first"), "digest", "left")
    return joined.select("page_id", "url", "digest", "payload_bytes", F.expr("CASE WHEN first_id IS NULL OR page_id <=> first_id THEN NULL ELSE first_id END").alias("refers_to"))


def headers(records: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The exact WARC header of each classified record."""
    revisit = F.col("refers_to").isNotNull()
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        _record_id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        _line_safe(F.col("url")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.lit(f"{CRLF}X-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _record_id(F.col("refers_to")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string")),
        F.lit(CRLF + CRLF),
    )
    return records.select("page_id", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), header.alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """Each distinct payload once; copies meet on the map side first. Unequal payloads under one digest raise."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.sha2(payload.cast("binary"), 256).alias("digest"), payload.alias("payload"), F.xxhash64(payload).alias("h"), F.octet_length(payload).alias("n"))
    merged = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    same = F.when((F.col("h0") == F.col("h1")) & (F.col("n0") == F.col("n1")), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads under digest "), F.col("digest"))))
    return merged.select("digest", same.cast("binary").alias("payload"))


def write_archive(pages: DataFrame, root: str | None = None, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Writes the archive of `pages` (page_id, url, html; other columns are left out) and returns its root."""
    root = root or new_path(pages.sparkSession, "warc")
    payloads(pages).write.option("compression", "zstd").parquet(f"{root}/payloads")
    release(pages.sparkSession)
    headers(classify(pages, revisit_bytes)).write.option("compression", "zstd").parquet(f"{root}/headers")
    release(pages.sparkSession)
    return root


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """Record headers with the fields that were parsed out of their bytes."""
    def number(name: str) -> Column:
        found = F.regexp_extract("header", rf"\r\n{name}: <urn:x-page:(-?\d+)>", 1)
        return F.when(found != "", found.cast("bigint"))

    return spark.read.parquet(f"{root}/headers").select(
        "header",
        number("WARC-Record-ID").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        F.substring(_field("WARC-Payload-Digest"), 8, 64).alias("digest"),
        _field("X-Payload-Length").cast("bigint").alias("declared_bytes"),
        number("WARC-Refers-To").alias("refers_to"),
    )


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """The records as written: header and block joined by digest; `record` holds the exact bytes."""
    stored = spark.read.parquet(f"{root}/payloads")
    joined = read_headers(spark, root).join(stored, "digest", "left")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")))


def verify_archive(spark: SparkSession, root: str) -> DataFrame:
    """One row per record, with digest and length computed anew from the bytes of the reconstructed records.

    A response's payload is cut out of its record, after the header and before the closing CRLF CRLF;
    a revisit's is that of the record it refers to. A payload that is missing, or differs from what
    its header declares, raises.
    """
    start, length = "octet_length(header)", "octet_length(record) - octet_length(header) - 4"
    payload = F.when(F.col("record_type") == "response", F.expr(f"substring(record, {start} + 1, {length})")).otherwise(F.col("payload"))
    read = read_records(spark, root).withColumn("whole", payload)
    found = read.select("page_id", "record_type", "refers_to", "digest", "declared_bytes", F.sha2("whole", 256).alias("payload_digest"), F.octet_length("whole").cast("bigint").alias("payload_bytes"))
    sound = F.col("payload_digest").eqNullSafe(F.col("digest")) & F.col("payload_bytes").eqNullSafe(F.col("declared_bytes"))
    return found.select("page_id", "payload_bytes", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("payload_digest"), "record_type", "refers_to")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all of `pages`, reads the records back, one row per page.

    A null html is the empty payload; rows without a page_id and repeated rows are records of their
    own. Of equal payloads of REVISIT_BYTES or more the smallest page_id is the response.
    """
    return verify_archive(spark, write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY html)
SELECT page_id, payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
