"""Operator 5: WARC archives with revisit records.

Archives are written by Spark's text sink: a record is one string, and the sink's line
separator is the blank line that ends every WARC record, so the files are plain WARC 1.1
(gzip or none). They are read back file by file, each record cut by its Content-Length.

Revisits are resolved on headers: the first capture of every payload digest that occurs
more than once is found by an aggregation, and a record that is not the first becomes a
revisit of it, with fresh headers and no payload.

Edge cases: a null payload is an empty one; a null or multi-line URI has its line breaks
percent-encoded (null: no URI header); rows that repeat a page_id are ordered by URI and
further ties are all responses; null page ids are written as an empty header and read back as
null; an empty table gives an empty archive folder and no rows; other columns are not archived.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base32_sha1, materialize, new_path, table

END = "\r\n\r\n"
#: Rows per archive file at most, so that a file can be read as one value.
FILE_ROWS = 20_000
#: A repeated payload of fewer bytes stays a response.
MIN_PAYLOAD = 0

RECORDS = (
    "page_id long, record_type string, record_id string, uri string, captured string, "
    "payload_digest string, refers_to_id string, payload string"
)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[
        F.concat(F.substring(h, a, n), F.lit(sep)) for a, n, sep in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))
    ])


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def as_captures(pages: DataFrame, page_id: str = "page_id", uri: str = "url", payload: str = "html", captured: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """One response capture per row, with digest and record id."""
    body = F.coalesce(F.col(payload), F.lit(""))
    clean = F.replace(F.replace(F.col(uri), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"), clean.alias("uri"), F.lit(captured).alias("captured"), body.alias("payload")
    ).withColumn("payload_digest", base32_sha1(F.encode("payload", "UTF-8"))).withColumn(
        "record_id", _urn(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("uri", F.lit("")), "payload_digest")
    ).withColumn("refers_to_id", F.lit(None).cast("string"))


def write_archives(captures: DataFrame, path: str, compression: str = "gzip", file_rows: int = FILE_ROWS) -> None:
    """Write one record per row: a revisit where `refers_to_id` is set, else a response."""
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    revisit = F.col("refers_to_id").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Date", F.col("captured")),
        _header("WARC-Target-URI", F.col("uri")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Refers-To", F.col("refers_to_id")),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    captures.select(record.alias("record")).write.option("lineSep", END).option("compression", compression).option(
        "maxRecordsPerFile", file_rows
    ).option("zlib.compress.level", "BEST_SPEED").text(path)


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def _plain(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:  # a file may be several gzip members
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def records_of(content: bytes) -> Iterator[tuple]:
    """The records of one archive file, cut by their Content-Length."""
    data, at = _plain(content), 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.decode() for k, v in _FIELD.findall(data, at, head_end + 2)}
        start = head_end + 4
        stop = start + int(fields[b"content-length"])
        body = data.find(b"\r\n\r\n", start, stop)
        payload = data[stop if body < 0 else body + 4 : stop].decode()
        page = fields.get(b"x-page-id") or None
        yield (
            int(page) if page else None, fields[b"warc-type"], fields[b"warc-record-id"], fields.get(b"warc-target-uri"),
            fields.get(b"warc-date"), fields[b"warc-payload-digest"].removeprefix("sha1:"), fields.get(b"warc-refers-to"), payload,
        )
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        at = stop + 4


def _read(batches: Iterator[pd.DataFrame], chunk: int = 500) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for row in records_of(content):
                rows.append(row)
                if len(rows) == chunk:
                    yield _frame(rows, names)
                    rows = []
            if rows:
                yield _frame(rows, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records below `path`; a task holds one file at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInPandas(_read, RECORDS)


def resolve_revisits(records: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """`records` with `refers_to_id` set on every capture that is not the first of its payload.

    Only digest, page id and record id are aggregated, with partial sums before the shuffle;
    digests that occur once are left out. The join back is one both sides of which Spark may
    split, so a payload that holds a third of all captures is dealt to several tasks.
    """
    long_enough = F.octet_length("payload") >= min_payload
    heads = records.where(long_enough).select("payload_digest", "page_id", "record_id")
    firsts = heads.groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"),
    ).where("n > 1").drop("n")
    firsts = materialize(firsts, "warc-firsts")
    first_ids = (
        records.select("payload_digest", "page_id", "record_id").join(firsts, "payload_digest")
        .where(F.col("page_id").eqNullSafe(F.col("first_page")))
        .groupBy("payload_digest", "first_page").agg(F.min("record_id").alias("first_id"))
    )
    first_ids = materialize(first_ids, "warc-originals")
    joined = records.drop("refers_to_id").join(first_ids, "payload_digest", "left")
    refers = F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_id"))
    return joined.withColumn("refers_to_id", refers).drop("first_page", "first_id")


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Read the archives below `source` and write them anew with revisit records."""
    write_archives(resolve_revisits(read_archives(spark, source), min_payload), target)


def report(records: DataFrame) -> DataFrame:
    """Per record what its full payload is, revisits looked up at their originals."""
    narrow = materialize(
        records.select(
            "page_id", "record_type", "record_id", "refers_to_id", "payload_digest",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            base32_sha1(F.encode("payload", "UTF-8")).alias("found_digest"),
        ),
        "warc-report",
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = narrow.where("record_type = 'response'").select(
        "page_id", "payload_bytes", F.col("found_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    originals = narrow.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        "payload_bytes", F.col("found_digest").alias("payload_digest"),
    ).dropDuplicates(["refers_to_id"])  # repeated rows of a first page share its record id, and all else
    revisits = narrow.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id")
    return responses.unionByName(revisits.join(originals, "refers_to_id").select(columns))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    raw, slim = new_path(spark, "warc-raw"), new_path(spark, "warc-slim")
    write_archives(as_captures(pages), raw)
    deduplicate_archives(spark, raw, slim)
    return report(read_archives(spark, slim))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP5_SQL = f"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
d as (select page_id, payload_bytes, hex,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}',
    (((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::bigint) >> (35 - 5 * (i % 8))::int) & 31)::int + 1, 1)), '') as payload_digest,
  min(page_id) over (partition by hex) as first_page from p)
select page_id, payload_bytes, payload_digest,
  case when page_id = first_page then 'response' else 'revisit' end as record_type,
  case when page_id <> first_page then first_page end as refers_to from d
"""
