"""WARC writing with revisit resolution.

Headers (not payloads) are shuffled by payload digest to find each payload's original; then
archives are written in which only originals carry their payload, with fresh headers. Reading
joins revisit records to their originals by record id.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import new_folder, small_batches

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, record_type string, page_id string, target_uri string, digest string, "
    "refers_to_id string, content_length long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: 20 bits (five hex digits) give four characters."""
    digest = F.sha1(payload)
    characters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        characters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*characters)


def _record_id(page_id: Column, digest: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id, F.lit("null")), digest, row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def numbered(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Every row of ``pages`` with a number of its own, its digest and size, stored: row, page_id,
    target_uri, digest, payload_bytes, body. A null payload is empty, a null url is written empty."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]+", " ").alias("target_uri"),
        base32_sha1(F.encode(body, "UTF-8")).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"), body.alias("body"),
    )
    path = new_folder(pages.sparkSession, "pages")
    rows.write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(rows.schema).parquet(path)


def resolve(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The headers of all records, one per row of ``numbered`` pages: row, page_id, target_uri,
    digest, payload_bytes, record_id, record_type and, for revisits, refers_to_id. Of the records
    with one payload the largest page id is the response, the first of its rows if it is repeated,
    and the others revisit it; a null page id is the smallest. Payloads under ``least_bytes`` are
    all responses."""
    heads = rows.drop("body")
    originals = heads.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(
        F.max(F.struct("page_id", (-F.col("row")).alias("back"))).alias("original")
    )
    joined = heads.join(originals, ["digest", "payload_bytes"], "left")
    revisit = F.col("original").isNotNull() & (F.col("row") != -F.col("original.back"))
    return joined.select(
        "row", "page_id", "target_uri", "digest", "payload_bytes", _record_id(F.col("page_id").cast("string"), F.col("digest"), F.col("row")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, _record_id(F.col("original.page_id").cast("string"), F.col("digest"), -F.col("original.back"))).alias("refers_to_id"),
    )


def write_archives(
    rows: DataFrame, headers: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 500,
) -> None:
    """Writes the records as gzipped WARC 1.1 files of at most ``records_per_file`` records. The
    payload meets its fresh header by the row's number; revisits are written without it."""
    full = headers.where("record_type = 'response'").join(rows.select("row", "body"), "row").select(*headers.columns, "body")
    bare = headers.where("record_type = 'revisit'").withColumn("body", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("target_uri"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.col("refers_to_id"))).otherwise(""),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(END),
    )
    full.union(bare).select(F.concat(head, F.col("body")).alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", records_per_file
    ).option("compression", "gzip").text(path)


def _parse(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8").split(CRLF)[1:])
        size = int(fields["Content-Length"])
        yield (
            fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("X-Page-Id"), fields["WARC-Target-URI"],
            fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields.get("WARC-Refers-To"), size, data[end + 4 : end + 4 + size],
        )
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path`` (one task reads whole files; a file holds a
    bounded number of records)."""
    def records(batches):
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = list(_parse(gzip.decompress(content.as_py())))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                types = [pa.string()] * 6 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    small_batches(spark, rows=16)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, RECORDS)


def joined_revisits(records: DataFrame) -> DataFrame:
    """Each record with its original: page_id, payload_bytes, digest, record_type, refers_to
    (the original's page id, for revisits)."""
    heads = records.select(
        "record_id", "record_type", F.col("page_id").cast("long").alias("page_id"), "digest", "refers_to_id", "content_length"
    )
    originals = heads.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("content_length").alias("original_bytes")
    )
    responses = heads.where("record_type = 'response'").select(
        "page_id", F.col("content_length").alias("payload_bytes"), "digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    revisits = heads.where("record_type = 'revisit'").join(originals, "refers_to_id").select(
        "page_id", F.col("original_bytes").alias("payload_bytes"), "digest", "record_type", "refers_to"
    )
    return responses.union(revisits)
