"""Content-addressed archive of WARC records.

An archive is two tables in one folder. ``payloads`` holds the bytes of each different payload once, under their SHA-256 digest. ``headers`` holds
for each record the exact bytes of its WARC and HTTP headers and the digest of its payload. Of the records with one payload one is a
``response``, the others are ``revisit`` records that refer to it. Joins on the digest give records back byte by byte. Digests are verified
both ways: rows that share one must agree in a second, independent hash and in length when they are written, and stored bytes are hashed again when
they are read; a job that finds a difference fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyscope.llm.common import save

#: Fixed values of the record format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_STATUS = "HTTP/1.1 200 OK"
CRLF = "\r\n"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a digest of 20 bytes, given in hexadecimal: four groups of 40 bits are eight digits each."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, digest: Column) -> Column:
    """The record's URI: a UUID (version 8) of its page and payload digest, so a rerun writes the same."""
    h = F.sha2(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), F.hex(digest)), 256)
    part = lambda start, n: F.substring(h, start, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))


def _lines(fields: list[tuple[str, Column | str]]) -> Column:
    """``name: value`` lines, those with null values left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{n}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)), F.lit("")) for n, v in fields])


def _http(size: Column) -> Column:
    return F.concat(F.lit(HTTP_STATUS + CRLF), _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size.cast("string"))]), F.lit(CRLF))


def _one_line(c: Column) -> Column:
    """A header value in one line: line ends are percent-encoded, so that a URL cannot add header fields."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html, any further columns) to the new folder ``path``; the payload is ``html`` in UTF-8.

    Null html counts as empty; a null or empty url reads back as null, and line ends in one are percent-encoded. Of the rows with one payload of at least ``min_bytes`` bytes, those with the
    largest page_id are responses (rows that repeat it too) and the others revisit it; if none has an id, all are responses. Payloads
    shorter than that are responses always. An empty table gives an empty archive. The payload bytes are shuffled once, each task's repeats of
    one payload counted before."""
    path = path.rstrip("/")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    src = src.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    size, check = F.length("payload").cast("long"), F.xxhash64("payload")
    aggs = [F.any_value("payload").alias("payload"), F.min(check).alias("low"), F.max(check).alias("high"), F.min(size).alias("least"), F.max(size).alias("most")]
    stored = src.groupBy("digest").agg(*aggs, F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    differ = F.raise_error(F.lit("different payloads share a digest")).cast("binary")
    stored = stored.select("digest", F.when((F.col("low") == F.col("high")) & (F.col("least") == F.col("most")), F.col("payload")).otherwise(differ).alias("payload"), "last_id", "n")
    stored = stored.select("*", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("sha1"))
    stored.write.parquet(f"{path}/payloads", compression="zstd")

    facts = pages.sparkSession.read.schema(stored.schema).parquet(f"{path}/payloads").drop("payload")
    rows = save(src.select("page_id", "url", "digest"))
    r = rows.join(facts, "digest")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    http = _http(F.col("payload_bytes"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("last_id"), F.col("digest")))),
        ("Page-ID", F.col("page_id").cast("string")),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", length.cast("string")),
    ]
    header = F.concat(F.lit(VERSION + CRLF), _lines(fields), F.lit(CRLF), http).cast("binary")
    r.select("digest", header.alias("header")).write.parquet(f"{path}/headers", compression="zstd")


def field(header: Column, name: str) -> Column:
    """The value of the header line ``name`` of the WARC part of ``header`` (text); null if there is none."""
    warc = F.substring_index(header, CRLF * 2, 1)
    return F.nullif(F.regexp_extract(warc, rf"(?md)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def verified_payloads(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The stored payloads' ``columns`` (digest, payload), their length as payload_bytes and SHA-1 as payload_digest, from the bytes read; bytes that
    do not have their digest fail the job."""
    p = spark.read.parquet(f"{path.rstrip('/')}/payloads")
    fine = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    wrong = F.raise_error(F.lit("a stored payload does not have its digest"))
    return p.select(*columns, F.when(fine, F.length("payload").cast("long")).otherwise(wrong.cast("long")).alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest (both of the full payload, a revisit's too), record_type, refers_to (a revisit's
    response, as its page_id), record_id. All but the payload's size and digest comes from the headers; a digest that a header does not confirm fails the
    job. Payload bytes are hashed where they lie, only their digests are joined."""
    h = spark.read.parquet(f"{path.rstrip('/')}/headers").select("digest", F.col("header").cast("string").alias("header"))
    names = {"page_id": "Page-ID", "url": "WARC-Target-URI", "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers": "WARC-Refers-To", "declared": "WARC-Payload-Digest"}
    h = save(h.select("digest", *[field(F.col("header"), n).alias(c) for c, n in names.items()]).withColumn("page_id", F.col("page_id").cast("long")))
    facts = save(verified_payloads(spark, path, ["digest"]))
    targets = h.where("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.max("page_id").alias("target_page"))
    # A response looks itself up, so that records without a reference do not all share the null key.
    out = h.join(facts, "digest").join(save(targets), F.coalesce("refers", "record_id") == F.col("target"), "left")
    out = out.withColumn("refers_to", F.when(F.col("refers").isNotNull(), F.col("target_page")))
    confirmed = F.col("declared") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    digest = F.when(confirmed, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header declares another payload digest")).cast("string"))
    return out.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "record_id")


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: record_id, record (exact bytes: headers, a response's payload, two line ends) and payload (the full one, of
    revisits too), by a join of the headers with the verified payloads. Each record carries its bytes, so this returns as much as was captured."""
    h = spark.read.parquet(f"{path.rstrip('/')}/headers")
    text = F.col("header").cast("string")
    h = h.select("digest", "header", field(text, "WARC-Record-ID").alias("record_id"), field(text, "WARC-Type").alias("record_type"))
    end, none = F.lit(CRLF * 2).cast("binary"), F.lit("").cast("binary")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(none)
    full = F.when(F.col("payload_bytes") >= 0, F.col("payload")).alias("payload")
    return h.join(verified_payloads(spark, path, ["digest", "payload"]), "digest").select("record_id", F.concat("header", body, end).alias("record"), full)
