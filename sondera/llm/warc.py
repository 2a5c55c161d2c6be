"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; each record's exact header bytes are kept apart, with
the digest of its payload. Original records come back through a join of the two tables.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Payloads of fewer bytes are always written as responses.
MIN_REVISIT = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(kind: Column, page: Column, url: Column, sha1: Column, refers: Column, size: Column) -> Column:
    """The record's header block, up to and with the empty line. CR and LF in a url are percent-encoded."""
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    revisit = F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(refers)))).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", name(page)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)), revisit, line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit(0)).otherwise(size).cast("string")), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, to: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive of pages(page_id, url, html) to `to`/payloads and `to`/records.

    Null html is an empty payload. Of records with one payload of min_revisit bytes or more, that with the
    largest page_id is the response and the others revisit it; rows that tie for the largest id (repeats of
    one row) are all responses, and so is a payload whose ids are all null. Grouping is by SHA-256 with
    partial maxima, so a payload that a third of the pages share is sent once per map task; records meet its digest and
    size, not its bytes. Long payloads are whole. Other columns, whatever their names, are ignored; an empty table gives
    an empty archive.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    store = p.groupBy("sha256").agg(F.max("page_id").alias("holder"), F.first("payload").alias("payload"))
    store.write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/payloads")
    spark = pages.sparkSession
    held = facts(spark, to)
    r = p.select("page_id", "url", "sha256").join(held, "sha256")
    r = r.withColumn("kind", F.when((F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("holder")), "revisit").otherwise("response"))
    head = _header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("holder"), F.col("size"))
    r.select("page_id", "sha256", F.col("kind") == "revisit", head.cast("binary")).toDF("page_id", "sha256", "revisit", "header").write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/records")


def facts(spark: SparkSession, at: str) -> DataFrame:
    """sha256, holder, sha1, size: what is known of each stored payload, found from its bytes. A payload whose bytes no longer
    give their digest raises."""
    pay = spark.read.parquet(f"{at}/payloads")
    whole = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    sha1 = F.when(whole, F.sha1("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")))
    return pay.select("sha256", "holder", sha1.alias("sha1"), F.octet_length("payload").cast("long").alias("size"))


def read_archive(spark: SparkSession, at: str) -> DataFrame:
    """Records rebuilt: page_id, record (the exact bytes: header, payload of a response, end mark), and the sha1 and size of
    the whole payload, which a revisit holds elsewhere.

    Headers meet the digests of their payloads by a join; the payloads themselves are joined with responses alone.
    """
    r = spark.read.parquet(f"{at}/records").join(facts(spark, at).drop("holder"), "sha256")
    end = F.lit(b"\r\n\r\n")
    pay = spark.read.parquet(f"{at}/payloads").select("sha256", "payload")
    full = r.where("NOT revisit").join(pay, "sha256").select("page_id", F.concat("header", "payload", end).alias("record"), "sha1", "size")
    return full.union(r.where("revisit").select("page_id", F.concat("header", end), "sha1", "size"))


def describe(records: DataFrame) -> DataFrame:
    """What each rebuilt record says, parsed from its bytes: payload size and SHA-1, type, target of a revisit.

    A block that is not as long as its header says, or whose SHA-1 is not the one claimed, raises.
    """
    text = F.col("record").cast("string")
    cut = F.instr(text, F.lit(f"{CRLF}{CRLF}"))
    r = records.withColumn("_head", F.substring(text, F.lit(1), cut + 1))
    field = lambda k, rx: F.regexp_extract("_head", rf"\r\n{k}: {rx}\r\n", 1)
    r = r.withColumns({"_n": field("Content-Length", "([0-9]+)").cast("int"), "_kind": field("WARC-Type", "([a-z]+)"), "_claimed": field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})")})
    at = F.octet_length("_head") + 3
    r = r.withColumn("_block", F.substring("record", at, F.col("_n")))
    whole = (F.octet_length("record") == at + F.col("_n") + 3) & (F.octet_length("_block") == F.col("_n"))
    found = F.when(F.col("_kind") == "revisit", F.col("sha1")).otherwise(F.sha1("_block"))
    fine = whole & (found == F.col("_claimed")) & (F.col("sha1") == F.col("_claimed"))
    size = F.when(F.col("_kind") == "revisit", F.col("size")).otherwise(F.col("_n")).cast("long")
    return r.select(
        "page_id", size.alias("payload_bytes"), F.when(fine, found).otherwise(F.raise_error(F.lit("record does not match its digest"))).alias("payload_digest"),
        F.col("_kind").alias("record_type"), F.when(F.col("_kind") == "revisit", field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long")).alias("refers_to"),
    )


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in the bytes of a .warc or .warc.gz file."""
    f = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        yield head, f.read(int(head["Content-Length"]))


def warc_gz(records: list[bytes]) -> bytes:
    """A .warc.gz file with a gzip member for each record."""
    return b"".join(gzip.compress(r, mtime=0) for r in records)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = Scratch(spark).path("warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), to)
    return describe(read_archive(spark, to))


#: refers_to and record_type as the contract states them, without an archive.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n FROM pages),
m AS (SELECT h, max(page_id) top FROM p GROUP BY h)
SELECT p.page_id, n::BIGINT payload_bytes, sha1(p.h) payload_digest,
  CASE WHEN n >= 1000 AND p.page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN n >= 1000 AND p.page_id IS DISTINCT FROM top THEN top END refers_to
FROM p JOIN m ON p.h = m.h
"""
