"""WARC as a content-addressed archive: payload bytes once by digest, exact headers apart, records by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, scratch

#: A header of our own: the base64 form of a url that no header line can hold.
EXACT = "X-Exact-Target-URI"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """One header line; nothing where the value is null. CR and LF in a value are percent-encoded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _field(name: str) -> Column:
    pattern = rf"\r\n{name}: ([^\r\n]*)"
    return F.when(F.col("header").rlike(pattern), F.regexp_extract("header", pattern, 1))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """One WARC record per row of ``pages(page_id, url, html)``, as two tables below ``path``.

    ``payloads(digest, payload, first_id)`` holds each distinct payload once (html in UTF-8; null: empty),
    addressed by SHA-256, with the smallest page_id that has it; copies are combined before the shuffle, and
    rows of one digest are verified to agree in length and in SHA-512. ``records(header)`` holds the exact header
    block of each record; a url with CR or LF, which no header line can hold, stands there percent-encoded and
    once more, exactly, in base64. Of records with equal
    payloads of at least ``least_bytes`` the smallest page_id is the response and the others are revisits
    that refer to it; rows that share that page_id are responses too, as are all of a payload whose ids are
    all null (a null id beside others is a revisit). Shorter payloads are all responses. A null url has no
    target header. Extra columns are ignored; an empty table gives empty tables.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    second, size = F.sha2("payload", 512), F.length("payload")
    same = (F.min(size) == F.max(size)) & (F.min(second) == F.max(second))
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id"), same.alias("same"))
    sound = F.when(F.col("same"), F.col("first_id")).otherwise(F.raise_error(F.lit("digest collision")).cast("long"))
    stored.select("digest", "payload", sound.alias("first_id")).write.parquet(f"{path}/payloads")
    first = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id")
    light = rows.select("page_id", "url", "digest", F.length("payload").cast("long").alias("bytes"))
    again = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    marked = light.join(first, "digest").withColumn("again", again)  # equal payloads may be many: split as a skewed join
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line(EXACT, F.when(F.col("url").rlike(r"[\r\n]"), F.base64(F.encode("url", "UTF-8")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(F.col("again"), urn(F.col("first_id")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("again"), F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    marked.select(header.alias("header")).write.parquet(f"{path}/records")


def read_headers(records: DataFrame) -> DataFrame:
    """``header`` parsed into page_id, url, record_type, digest, refers_to and content_length."""
    page = lambda name: F.regexp_extract(_field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return records.select(
        "header",
        page("WARC-Record-ID").alias("page_id"),
        F.coalesce(F.decode(F.unbase64(_field(EXACT)), "UTF-8"), _field("WARC-Target-URI")).alias("url"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("digest"),
        page("WARC-Refers-To").alias("refers_to"),
        _field("Content-Length").cast("long").alias("content_length"),
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive with its exact bytes as ``record``, beside the parsed header.

    Responses get their content by a join on the digest. A revisit's record has no content, as in a WARC file,
    so copies of one payload, however many, bring their bytes once.
    """
    records = read_headers(spark.read.parquet(f"{path}/records"))
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    response = F.col("record_type") == "response"
    full = records.where(response).join(stored, "digest", "left").select(*records.columns, "payload")
    full = full.union(records.where(~response).withColumn("payload", F.lit(b"")))
    record = F.concat(F.encode("header", "UTF-8"), "payload", F.lit(b"\r\n\r\n"))
    return full.select(*records.columns, record.alias("record"))


def record_content(record: Column) -> Column:
    """The bytes after a record's header block, by its Content-Length; null where the record does not end there."""
    text = F.decode(record, "ISO-8859-1")  # a character for each byte
    head = F.instr(text, "\r\n\r\n") + 3
    size = F.regexp_extract(F.substring(text, F.lit(1), head), r"\r\nContent-Length: (\d+)\r\n", 1).try_cast("int")
    return F.when(F.length(record) == head + size + 4, F.substring(record, head + 1, size))


def page_records(pages: DataFrame, path: str | None = None, least_bytes: int = 100) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, from an archive written and read back.

    Length and digest are those of the content of the reconstructed response records; revisits take them from the
    response with their digest. A content that does not match its header's digest is an error. The archive stays
    below ``path``, or if none is given below the shared folder until the driver ends. See :func:`write_archive`
    for the cases.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archive(pages, path, least_bytes)
    names = ["page_id", "digest", "record_type", "refers_to"]
    content = record_content(F.col("record"))
    read = reconstruct(spark, path).where("record_type = 'response'").select(
        *names, F.length(content).cast("long").alias("payload_bytes"), F.sha2(content, 256).alias("payload_digest")
    )
    read = checkpoint(read)
    # one row for each payload, equal on all its responses
    known = read.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    headers = read_headers(spark.read.parquet(f"{path}/records"))
    again = headers.where("record_type = 'revisit'").select(*names).join(known, "digest", "left").select(*read.columns)
    sound = F.col("digest").eqNullSafe(F.col("payload_digest"))
    return read.union(again).select(
        "page_id",
        "payload_bytes",
        F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("archive is damaged")).cast("string")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
), r AS (
  SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
