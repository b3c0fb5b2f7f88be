"""WARC archives with revisit resolution (operator 3).

Headers are shuffled by payload digest; of equal payloads the one with the largest
id is written as a response and all others as revisits that refer to it, each with
fresh headers. Archives are written by Spark's own file writer, with its commit
protocol, on any store that Spark writes: a record a row, with the two line ends
that close a record as separator, gzip-compressed. They are read back a file at a
time, by content length, and revisits are joined to their responses.

Cost: payloads are shuffled once, to their group. A payload's response is chosen by a
pre-aggregated maximum, which is written before it is joined, so that Spark can split the
join where very many rows have one payload.
A file holds MAX_RECORDS at most, which bounds what a reading task holds.

Defined results: a null page is an empty payload; a null url is written as
about:blank; line ends in a url become spaces; rows that repeat both the largest id and
the payload are all responses; rows that share an id and not the payload are records of
their own, each with its own digest and size; a null id is below every other, a revisit if its payload
has a row with an id and a response otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm import storage

MAX_RECORDS = 2000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four letters for each five hexadecimal digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, digest: Column) -> Column:
    """Of a page and a payload, since one page may have several."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to and refers_to_url."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    heads = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    heads = heads.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.encode("payload", "UTF-8")).alias("payload_digest"))
    first = heads.groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.max_by("url", "page_id").alias("_url"))
    # a table of its own: above an aggregation in the same plan a hot payload's join can't be split
    joined = heads.join(storage.written(first, "warc-first"), "payload_digest")
    own = (F.col("payload_bytes") < min_bytes) | F.col("_first").isNull() | F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", F.when(own, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("_first")).alias("refers_to"), F.when(~own, F.col("_url")).alias("refers_to_url"),
    )


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the records of resolve_revisits() as gzip-compressed WARC files under ``path``."""
    uri = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("about:blank")), "[\r\n]+", " ")
    response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(response, F.col("payload")).otherwise(F.lit("")))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.when(~response, F.concat(F.lit("WARC-Refers-To-Target-URI: "), uri("refers_to_url"))),
        F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length("_block").cast("string")),
    )
    records = resolved.withColumn("_block", block).select(F.concat(lines, F.lit(END), F.col("_block")).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS).text(path)


class _Inflated(io.RawIOBase):
    """The bytes of gzip members, inflated a piece at a time."""

    def __init__(self, data: bytes):
        self.left, self.ready, self.inflate = memoryview(data), b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready:
            if self.inflate.eof:
                self.left = memoryview(self.inflate.unused_data + bytes(self.left))
                if not len(self.left):
                    return 0
                self.inflate = zlib.decompressobj(31)
            if not len(self.left):
                return 0
            self.ready, self.left = self.inflate.decompress(self.left[: 1 << 16]), self.left[1 << 16 :]
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one compressed archive."""
    stream = io.BufferedReader(_Inflated(data), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


_READ = "page_id long, record_id string, url string, record_type string, refers string, said_digest string, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record; payload_bytes and payload_digest are measured on what a response holds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = spark.createDataFrame([], _READ if payloads else _READ.rpartition(",")[0]).schema

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in parse_archive(content.as_buffer().to_pybytes()):
                    body = block.partition(b"\r\n\r\n")[2]
                    response = headers["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if response else None
                    page = headers["x-page-id"]
                    rows.append((int(page) if page else None, headers["warc-record-id"], headers["warc-target-uri"], headers["warc-type"], headers.get("warc-refers-to"), headers["warc-payload-digest"].removeprefix("sha1:"), len(body) if response else None, digest, body if response else None))
                    held += len(body)
                    if held > 8 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                yield _batch(rows, schema)

    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(len(arrow))], schema=arrow)


def join_revisits(records: DataFrame) -> DataFrame:
    """Each record with the payload's size and digest, which revisits take from the response they refer to."""
    originals = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_id"))
    originals = originals.agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))  # all rows of one record id are equal
    # a table of its own, so that the join can be split where very many revisits refer to one response;
    # responses, which refer to nothing, are dealt by their own id
    originals = storage.written(originals, "warc-originals")
    keyed = records.withColumn("_key", F.coalesce("refers", F.concat(F.lit("own:"), F.col("record_id"))))
    joined = keyed.join(originals, F.col("_key") == F.col("_id"), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write deduplicated archives of the pages, read them and return what they say of each page."""
    spark = pages.sparkSession
    place = storage.mark()
    path = storage.new_path(spark, "warc")
    write_archives(resolve_revisits(pages, min_bytes), path)
    return storage.tidy(join_revisits(storage.written(read_archives(spark, path, payloads=False), "warc-records")), place)


ORACLE = """
WITH h AS (SELECT page_id, sha1(coalesce(html, '')) AS x, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
     d AS (SELECT page_id, payload_bytes, x,
                  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      (1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest FROM h),
     f AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to FROM f
"""
