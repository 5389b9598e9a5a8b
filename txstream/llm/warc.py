"""WARC archives with revisit resolution: write deduplicated archives with fresh headers, and read them back.

1. One scan writes the pages, with digest, length and a row number, into a table bucketed by the scan's split: every task
   writes files of its own and no row moves.
2. Headers (row, page, url, digest and length; never payloads) are shuffled by digest. The least page id of equal payloads
   is the response; the others revisit it. A digest that a large part of all pages has is looked up where its headers are.
3. The revisits, rows of headers, are dealt out by split; each bucket of pages meets its own. So payloads are written and
   read once, and never shuffled or sorted.
4. Archives are written by Spark's text writer (any file system, gzip files of up to ``RECORDS`` records) and read back as a
   stream of the parts between empty lines, each record by its length: a task holds one record and one Arrow batch.

A revisit record carries headers alone; reading resolves it to the response that its WARC-Refers-To names: revisits are
joined to the responses that they name, and responses go past that join.

Defined cases: a null html is an empty payload; a null url is written as ``urn:none``; line ends in urls become spaces;
very long pages are records like others (a task holds one); of equal payloads the least page id is the response, and rows
that repeat that id are responses each; a null page id is written without its header, revisits a page that has an id, and
is a response among null ids; repeated rows are records each; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import looked_up
from .common import removed, scratch, stored

#: Payloads of so many bytes or more are deduplicated.
LEAST_BYTES = 0
#: Records in one archive file at most.
RECORDS = 20_000
#: RFC 4648's base 32, and WARC's profile of revisits by digest.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _EMPTY = "\r\n", b"\r\n\r\n"
_RECORDS = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_id string, payload binary"


def base32(hex_digest: Column) -> Column:
    """40 hexadecimal digits as 32 base-32 letters: each ten digits are 40 bits, and eight letters."""
    letters = []
    for part in range(4):
        bits = F.conv(F.substring(hex_digest, 1 + 10 * part, 10), 16, 10).cast("long")
        letters += [F.substr(F.lit(ALPHABET), F.shiftright(bits, 35 - 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*letters)


def headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("urn:none")), "[\r\n]+", " ")
    return pages.select(F.col("page_id").cast("long"), url.alias("url"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.col("html").cast("string"))


def split_keys(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket an integer that Spark's hash deals into it."""
    own = F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets))
    found = {r.bucket: r.key for r in spark.range(40 * buckets).groupBy(own.alias("bucket")).agg(F.min("id").cast("int").alias("key")).collect()}
    return [found.get(k, k) for k in range(buckets)]


@contextmanager
def staged(pages: DataFrame) -> Iterator[DataFrame]:
    """The pages with row and split, as a table in buckets of splits; it goes when the context ends."""
    spark = pages.sparkSession
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's most
    keys = F.array(*[F.lit(k) for k in split_keys(spark, buckets)])
    rows = headers(pages).withColumn("row", F.monotonically_increasing_id()).withColumn("split", F.element_at(keys, F.spark_partition_id() % buckets + 1))
    name, path = f"txstream_{uuid.uuid4().hex}", scratch(spark, "pages")
    rows.write.bucketBy(buckets, "split").option("path", path).option("compression", "zstd").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(spark, path)


def revisits(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """split, row, refers_to, refers_to_url of the rows that revisit the response of their payload."""
    heads = heads.select("split", "row", "page_id", "url", "sha1", "payload_bytes").where(F.col("payload_bytes") >= least_bytes)
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = heads.groupBy("sha1").agg(F.min(known).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    shared = looked_up(heads, stored(first, "shared"), "sha1", how="inner").where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    return shared.select("split", "row", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_url"))


def record_id(page_id: Column, sha1: Column) -> Column:
    """A UUID-shaped name of a record, the same each time."""
    h = F.md5(F.concat_ws(":", F.lit("record"), F.coalesce(page_id.cast("string"), F.lit("null")), sha1).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(rows: DataFrame, date: str) -> DataFrame:
    """One record as text a row: headers, an empty line and the content."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END * 2))
    content = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit(""))))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    where = lambda condition, text: F.when(condition, text).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + _END),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("sha1"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        where(revisit, F.concat(
            field("WARC-Profile", F.lit(PROFILE)),
            field("WARC-Refers-To", record_id(F.col("refers_to"), F.col("sha1"))),
            field("WARC-Refers-To-Target-URI", F.coalesce("refers_to_url", F.lit("urn:none"))),
        )),
        where(F.col("page_id").isNotNull(), field("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(content).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(_END), content).alias("value"))


#: Joins by split and row use the buckets of splits that are there already.
_BY_SPLIT = "spark.sql.requireAllClusterKeysForCoPartition"


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str | None = None) -> None:
    """Write the pages' archives into the folder ``path``: gzip files of WARC records."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark = pages.sparkSession
    with staged(pages) as rows:
        found = stored(revisits(rows, least_bytes), "revisits")
        before = spark.conf.get(_BY_SPLIT)
        spark.conf.set(_BY_SPLIT, "false")
        try:
            made = records(rows.join(found.hint("shuffle_hash"), ["split", "row"], "left"), date)
            made.write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
        finally:
            spark.conf.set(_BY_SPLIT, before)


def _fields(head: bytes) -> dict[str, str]:
    version, *lines = head.decode("utf-8").split(_END)
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {version[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parsed(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and the content of each record of an archive that comes in parts."""
    held, fields, start, stop = bytearray(), None, 0, 0
    for part in parts:
        held += part
        while True:
            if fields is None:
                at = held.find(_EMPTY)
                if at < 0:
                    break
                if not at:  # what the reader adds to a file that ends within its separator
                    del held[:4]
                    continue
                fields, start = _fields(bytes(held[:at])), at + 4
                stop = start + int(fields["content-length"])
            if len(held) < stop + 4:
                break
            if held[stop : stop + 4] != _EMPTY:
                raise ValueError(f"the record {fields.get('warc-record-id')} isn't as long as it says")
            yield fields, bytes(held[start:stop])
            del held[: stop + 4]
            fields = None
    if fields is not None or held.strip():
        raise ValueError("the last record of an archive is cut off")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives (``.gz``, ``.warc``) in a folder, whoever wrote them, as long as payloads have digests.

    Digest and length of a response are taken from the payload as read. Files that aren't compressed are read whole.
    """
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def row(fields: dict[str, str], content: bytes) -> tuple:
        _, _, payload = content.partition(_EMPTY)
        kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        page = int(fields["x-page-id"]) if "x-page-id" in fields else None
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else named
        if found != named:
            raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have the digest of its header")
        whole = kind == "response"
        return fields["warc-record-id"], kind, page, fields["warc-target-uri"], found, len(payload) if whole else None, fields.get("warc-refers-to"), payload if with_payload and whole else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=names)
            out.clear()
            return made

        pieces = ((name, part) for batch in batches for name, part in zip(batch.column(0).to_pylist(), batch.column(1)))
        for _, own in itertools.groupby(pieces, lambda x: x[0]):
            for fields, content in parsed(part.as_py() for _, part in own):
                out.append(row(fields, content))
                size += len(content)
                if len(out) >= 1_000 or with_payload and size > 1 << 24:
                    yield given()
                    size = 0
        yield given()

    name = F.col("_metadata.file_path")
    lines = spark.read.option("lineSep", _END * 2).option("pathGlobFilter", "*.gz").text(path)
    lines = lines.select(name, F.concat(F.col("value").cast("binary"), F.lit(_EMPTY)).alias("part"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select(name, F.col("content").alias("part"))
    return lines.mapInArrow(run, _RECORDS).unionByName(plain.mapInArrow(run, _RECORDS))


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits joined to the responses they name."""
    own = found.where(F.col("record_type") == "response")
    asked = found.where(F.col("record_type") != "response").select("page_id", "payload_digest", "record_type", "refers_to_id")
    counts = asked.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    named = own.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes").join(counts, "refers_to_id")
    named = named.groupBy("refers_to_id").agg(F.min("refers_to").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"), F.max("n").alias("n"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = own.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(looked_up(asked, stored(named, "named"), "refers_to_id").select(columns))


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archives of ``pages`` into the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, least_bytes)
    return resolved(stored(read_archives(spark, path, with_payload=False).drop("payload"), "records"))


_LETTER = "substr('{a}', 1 + (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT) >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)".format(a=ALPHABET)
SQL = f"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, array_to_string([{_LETTER} for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
