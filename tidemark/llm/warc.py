"""WARC archives as a chunked record table.

Writing: ``dedupe_payloads`` decides which record of equal payloads is the response and
which are revisits; only payloads whose digest may stand twice, by a Bloom filter of fixed
size, are shuffled for that. ``write_archives`` cuts payloads into chunk rows and lets Spark's
text writer put them, one WARC record a chunk (segments, where there is more than one), into
one gzip archive a task. Reading: Spark's text reader streams the archives, cut where a record
begins; ``read_chunks`` puts together what was cut within a payload, one record at a time, and
gives rows (record, chunk number, bytes, running SHA-1). No whole archive or payload is held.

Defined cases: a null payload is empty; equal payloads of fewer than ``min_bytes`` are all
responses; of repeated record ids each row is a record of its own; rows without an id are
left out; further columns are ignored; an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, in_bloom, scratch, small_batches, table, written

CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
BEGIN = b"\r\n\r\n" + VERSION
CHUNK_SCHEMA = "page_id long, chunk_no int, record_type string, payload_bytes long, payload_digest string, refers_to long, n_bytes long, running_sha1 string, last boolean"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 32 digits of five bits, 40 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), i, 10), 16, 32), 8, "0") for i in range(1, 41, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def dedupe_payloads(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, html and perhaps url) to page_id, url, payload, payload_bytes, payload_digest,
    refers_to: null for responses, else the largest page_id with an equal payload."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.filter("page_id is not null").select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")) \
        .withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    twice = rows.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    first = written(twice, "payloads")
    pages_of = bloom(first, "payload_digest")
    joined = in_bloom(rows, "payload_digest", pages_of).join(first, ["payload_digest", "payload_bytes"], "left").select(*rows.columns, "first_id")
    single = in_bloom(rows, "payload_digest", pages_of, inside=False).withColumn("first_id", F.lit(None).cast("long"))
    return joined.unionByName(single).select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when((F.col("payload_bytes") >= min_bytes) & (F.col("first_id") != F.col("page_id")), F.col("first_id")).alias("refers_to")
    )


def record_text(chunk: int) -> Column:
    """The record of one chunk row, to be followed by one more line end."""
    n = lambda c: F.col(c).cast("string")
    revisit, first = F.col("refers_to").isNotNull(), F.col("chunk_no") == 0
    segmented = F.col("payload_bytes") > chunk
    line = lambda name, value, when=None: F.concat(F.lit(name + ": "), value, F.lit("\r\n")) if when is None else F.when(when, F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")
    uri = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    # a header is one line, whatever the page's link holds; without one the record names itself
    target = F.nullif(F.regexp_replace("url", r"[\x00-\x20\x7F]", ""), F.lit(""))
    last = (F.col("chunk_no") + 1) * chunk >= F.col("payload_bytes")
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", uri(F.when(first, n("page_id")).otherwise(F.concat(n("page_id"), F.lit(":"), n("chunk_no"))))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.coalesce(target, F.concat(F.lit("urn:page:"), n("page_id")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("WARC-Payload-Length", n("payload_bytes")),
        line("WARC-Profile", F.lit(PROFILE), revisit), line("WARC-Refers-To", uri(n("refers_to")), revisit),
        line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), segmented & ~revisit), line("WARC-Segment-Origin-ID", uri(n("page_id")), segmented & ~revisit & ~first),
        line("WARC-Segment-Total-Length", n("payload_bytes"), segmented & ~revisit & last),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block").cast("string"), F.lit("\r\n"),
    )


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Chunk rows, then one gzip WARC file a task; a record's segments stand together."""
    payload = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length("payload") / F.lit(chunk)).cast("int") - 1, F.lit(0))
    chunks = records.withColumn("payload", payload).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))) \
        .withColumn("block", F.substr("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    chunks.select(record_text(chunk).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _records(cuts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, from an archive cut at every ``BEGIN``."""
    held = b""
    for cut in cuts:
        held = held + BEGIN + cut if held else cut.removeprefix(VERSION)
        head, found, block = held.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().strip().split("\r\n")) if found else {}
        size = int(fields.get("Content-Length", -1))
        if 0 <= size <= len(block):
            yield fields, block[:size]
            held = b""
    if held.strip():
        raise ValueError("an archive ends within a record")


def _chunk_rows(cuts: Iterator[bytes]) -> Iterator[tuple]:
    sha, seen = hashlib.sha1(), 0
    for head, block in _records(cuts):
        page, _, no = head["WARC-Record-ID"][len("<urn:page:") : -1].partition(":")
        revisit = head["WARC-Type"] == "revisit"
        if not no:
            sha, seen = hashlib.sha1(), 0
        sha.update(block)
        seen += len(block)
        total, digest = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
        refers = int(head["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None
        running = base64.b32encode(sha.digest()).decode()
        last = revisit or seen >= total
        if last and not revisit and running != digest:
            raise ValueError(f"the payload of page {page} doesn't have its digest")
        yield int(page), int(no or 0), "revisit" if revisit else "response", total, digest, refers, len(block), running, last


def read_chunks(spark: SparkSession, path: str, rows: int = 5000) -> DataFrame:
    """The chunk table of the archives: one row a chunk, with the SHA-1 of the payload up to
    and with it; a digest that doesn't match in the end is an error."""
    small_batches(spark, 64)
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for row in _chunk_rows(cut for part in parts for cut in part["value"]):
            held.append(row)
            if len(held) >= rows:
                yield _frame(held, names)
                held = []
        yield _frame(held, names)

    # gzip files aren't split: a partition has whole archives, their records in order
    cuts = spark.read.option("lineSep", BEGIN.decode()).option("pathGlobFilter", "*.gz").text(path)
    return cuts.select(F.col("value").cast("binary").alias("value")).mapInPandas(read, CHUNK_SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"refers_to": "Int64"})


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(dedupe_payloads(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return read_chunks(spark, path).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"))


OP7_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages where page_id is not null),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as h from p),
x as (select page_id, payload_bytes, h, cast('0x' || substr(h, 5 * i + 1, 5) as bigint) as v, i from d, range(8) t(i)),
b as (select page_id, payload_bytes, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(v // 32768 as int), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(v // 1024 % 32 as int), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(v // 32 % 32 as int), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(v % 32 as int), 1), '' order by i) as payload_digest
  from x group by page_id, payload_bytes),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from b)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when top = page_id then 'response' else 'revisit' end as record_type,
  case when top <> page_id then top end as refers_to, cast(case when top = page_id then greatest(1, ceil(payload_bytes / 1048576.0)) else 1 end as int) as n_chunks
from m
"""
