"""Content-addressed WARC archive (operator 8).

``store`` writes two things: ``headers``, a table with the exact WARC header of
every record and the SHA-256 address of its payload, and ``warc``, gzipped WARC
files with a record per header, in which each payload's bytes stand once, in its
response.  Of the records with equal payloads that with the largest id is the
response; the others are revisits that refer to it.  Payloads under ``min_bytes``
are all responses.  ``read_warc`` parses any WARC files; ``stored`` recomputes the
SHA-256 of every response read; ``records`` gives the original records back:
responses as they stand in the files, revisits by a join of their headers with the
payload at their address.  Only payloads that a response's header says are
revisited take part in that join, and adaptive execution splits it where one
address has most of the records.

Payloads move once, to meet their copies; what else is shuffled are headers and
digests.  A null html is an empty payload, a null url leaves its header line out.
Null ids are revisits of a record with an id, or responses where none has one.
Repeated rows share one WARC record and are given back as often as they occur;
rows of the elected id with other urls are responses too, and then hold the bytes again.
An empty table gives an archive without records and no rows.  Of a table with more
columns, id, url and html are taken, whatever the others are called.  A payload is
worked on in memory as a whole, and so is a file of at most ``FILE_RECORDS`` records.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkshelf.llm.ragged import small_batches
from sparkshelf.session import scratch

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648
END, VERSION = "\r\n", "WARC/1.1"
MIN_BYTES, DATE = 0, "1970-01-01T00:00:00Z"
FILE_RECORDS = 1000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 8 times 20 bits, each 4 signs."""
    digest = F.sha1(payload)
    signs = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        signs += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*signs)


def _record_id(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def addressed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("address", F.sha2("payload", 256))


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """page_id, address, stored (whether the record is a response), header and n (how many rows the record stands for)."""
    named = addressed(pages, id_col, url_col, html_col).select("page_id", "url", "address", base32_sha1(F.col("payload")).alias("digest"), F.length("payload").cast("long").alias("size"))
    named = named.groupBy("address", "page_id", "url", "digest", "size").agg(F.count(F.lit(1)).alias("n"))
    elected = named.groupBy("address").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("n").alias("copies"))
    both = named.join(elected, "address").withColumn("first", F.col("top.page_id"))
    holder = F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("top.url"))
    response = (F.col("size") < min_bytes) | F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20")
    header = F.concat(
        F.lit(VERSION + END),
        line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("address")))).otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("first"))), line("X-Refers-To-Page", F.col("first").cast("string")))),
        F.when(holder & (F.col("copies") > 1), line("X-Records-Of-Payload", F.col("copies").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.coalesce(line("X-Page", F.col("page_id").cast("string")), F.lit("")),
        line("Content-Length", F.when(response, F.col("size").cast("string")).otherwise("0")),
    )
    return both.select("page_id", "address", response.alias("stored"), header.alias("header"), "n")


def store(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Writes ``path``/headers and ``path``/warc."""
    spark = pages.sparkSession
    headers(pages, id_col, url_col, html_col, min_bytes).write.parquet(f"{path}/headers")
    held = spark.read.parquet(f"{path}/headers")
    once = addressed(pages, id_col, url_col, html_col).groupBy("address").agg(F.first("payload").alias("payload"))
    responses = once.join(held.where("stored").select("address", "header"), "address").select("header", F.col("payload").cast("string").alias("body"))
    both = responses.unionByName(held.where("NOT stored").select("header", F.lit("").alias("body")))
    both.select(F.concat("header", F.lit(END), "body").alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(f"{path}/warc")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header, payload of all records in the WARC files, plain or gzipped, under ``path``, by their Content-Length."""
    small_batches(spark)

    def work(batches):
        for b in batches:
            for blob in b.column("content"):
                raw, at, heads, bodies = blob.as_py(), 0, [], []
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                while at < len(raw):
                    cut = raw.index(b"\r\n\r\n", at)
                    head = raw[at : cut + 2].decode()
                    size = int(next(x.split(":")[1] for x in head.split(END) if x.lower().startswith("content-length:")))
                    heads.append(head)
                    bodies.append(raw[cut + 4 : cut + 4 + size])
                    at = cut + 4 + size + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(bodies, pa.binary())], ["header", "payload"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(work, "header string, payload binary")


def field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """header, payload, address, copies of the responses in the files; one whose bytes don't give its address raises."""
    said = F.regexp_replace(field("WARC-Block-Digest"), "^sha256:", "")
    right = F.when(F.sha2("payload", 256) == said, said).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.coalesce(said, F.lit("without address")))))
    found = read_warc(spark, f"{path}/warc").where(field("WARC-Type") == "response")
    return found.select("header", "payload", right.alias("address"), F.coalesce(field("X-Records-Of-Payload").cast("long"), F.lit(1)).alias("copies"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload of every record, revisits with the payload that they refer to; a record without its payload raises."""
    found = stored(spark, path)
    # all but the responses themselves: revisits, and repeated rows
    more = F.col("n") - F.col("stored").cast("long")
    rest = spark.read.parquet(f"{path}/headers").where(more > 0).select("page_id", "address", "header", F.explode(F.sequence(F.lit(1).cast("long"), more))).drop("col")
    rest = rest.join(found.where("copies > 1").select("address", "payload"), "address", "left")
    payload = F.coalesce(F.col("payload"), F.raise_error(F.concat(F.lit("no payload "), F.col("address"))).cast("binary"))
    return found.select(field("X-Page").cast("long").alias("page_id"), "header", "payload").unionByName(rest.select("page_id", "header", payload.alias("payload")))


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archive, reads it back, and gives page_id, payload_bytes, payload_digest, record_type, refers_to of every page."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    store(pages, path, id_col, url_col, html_col, min_bytes)
    said = records(spark, path).select(
        field("X-Page").cast("long").alias("page_id"), field("WARC-Type").alias("record_type"), field("X-Refers-To-Page").cast("long").alias("refers_to"), field("WARC-Payload-Digest").alias("said"), field("Content-Length").cast("long").alias("length"),
        base32_sha1(F.col("payload")).alias("digest"), F.length("payload").cast("long").alias("payload_bytes"),
    )
    # each reconstructed record is held against its own header
    fits = (F.col("said") == F.concat(F.lit("sha1:"), F.col("digest"))) & (F.col("length") == F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0)))
    right = F.when(fits, F.col("digest")).otherwise(F.raise_error(F.lit("a record's header does not fit its payload")))
    return said.select("page_id", "payload_bytes", right.alias("payload_digest"), "record_type", "refers_to")


#: The same for DuckDB, with min_bytes 0.
ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1) FOR s IN [15, 10, 5, 0]] FOR i IN range(8)]), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
