"""Operator 10: content-addressed WARC archive.

Each record is an exact header and a payload. Payload bytes are stored once under their SHA-256; headers are kept apart,
with the digest. Records are put together again by a join on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.llm.shared import col

CRLF = "\r\n"


def header_of(id: Column, url: Column, payload: Column) -> Column:
    """Header block of a response record, the blank line at its end included; absent fields are left out."""
    size = F.coalesce(F.octet_length(payload), F.lit(0)).cast("string")
    field = lambda name, x: F.coalesce(F.concat(F.lit(f"{name}: "), x.cast("string"), F.lit(CRLF)), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}"),
        F.coalesce(F.concat(F.lit("WARC-Record-ID: <urn:page:"), id.cast("string"), F.lit(f">{CRLF}")), F.lit("")),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256))),
        F.lit(f"Content-Type: text/html{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF),
    )


def archive(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers(id, header, digest), payloads(digest, payload, size, uses)), header and payload as bytes.

    header names a column of the records' exact headers, text or bytes, kept as they are (a null is an empty one); without
    one they are made by header_of. Payloads are any bytes, or text as UTF-8, of any length. Every row of pages has a header, repeated rows too. A null payload has a header without a digest; an empty one is a
    payload like others. Two payloads of one digest that differ in length or MD5 stop the job: the digest is verified
    before bytes are shared. Other columns are dropped. An empty table gives two empty ones.
    """
    raw = lambda name: col(pages, name) if dict(pages.dtypes)[name] == "binary" else F.encode(col(pages, name).cast("string"), "UTF-8")
    given = F.coalesce(raw(header), F.lit(b"")) if header else F.lit(None).cast("binary")
    rows = pages.select(col(pages, id).alias("id"), (F.lit(None) if header else col(pages, url)).alias("url"), raw(payload).alias("payload"), given.alias("given"))
    made = F.col("given") if header else F.encode(header_of(F.col("id"), F.col("url"), F.col("payload")), "UTF-8")
    headers = rows.select("id", made.alias("header"), F.sha2("payload", 256).alias("digest"))
    held = rows.where("payload is not null").select(F.sha2("payload", 256).alias("digest"), "payload", F.struct(F.octet_length("payload").alias("size"), F.md5("payload").alias("md5")).alias("proof"))
    stored = held.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("proof").alias("p"), F.max("proof").alias("q"), F.count(F.lit(1)).alias("uses"))
    same = F.when(F.col("p") == F.col("q"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payloads of one digest differ: "), F.col("digest"))).cast("binary"))
    return headers, stored.select("digest", same.alias("payload"), F.col("p.size").alias("size"), "uses")


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(id, digest, record) of every header: its bytes and its payload's. A payload that doesn't have its digest stops the job; so does a digest without a payload."""
    joined = headers.join(payloads.select("digest", "payload"), "digest", "left")
    right = F.col("digest").isNull() | (F.sha2("payload", 256) == F.col("digest"))
    body = F.when(F.coalesce(right, F.lit(False)), F.coalesce("payload", F.lit(b""))).otherwise(F.raise_error(F.concat(F.lit("payload missing or changed: "), F.col("digest"))).cast("binary"))
    return joined.select("id", "digest", F.concat("header", body).alias("record"))


def write_archive(pages: DataFrame, path: str, **columns: str) -> None:
    """Both tables of archive below path, which all executors share."""
    headers, payloads = archive(pages, **columns)
    payloads.write.mode("overwrite").parquet(f"{path}/payloads")
    headers.write.mode("overwrite").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive that write_archive wrote."""
    return records(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"))


SQL = r"""
SELECT page_id, sha256(html) AS digest,
  concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10),
    coalesce('WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10), ''),
    coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), ''),
    coalesce('WARC-Payload-Digest: sha256:' || sha256(html) || chr(13) || chr(10), ''),
    'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', coalesce(octet_length(encode(html)), 0), chr(13), chr(10), chr(13), chr(10),
    coalesce(html, '')) AS record
FROM pages
"""
