"""WARC archives and revisit resolution.

Pages are written as WARC/1.1 response records. To deduplicate, the record
headers (without payloads) are shuffled by payload digest and the group's
original is found by an aggregate. Revisit records are joined to it, and new
archives are written with fresh headers, in which a revisit holds no payload
but refers to the original's record.

Archives are written by Spark's text writer: the two line ends that close
every WARC record are its line separator. Any store that Spark writes to
works. A task starts a new archive every ``ARCHIVE_BYTES``, so that an archive
can be read as one binary row. Reading goes by Content-Length, so a payload
may hold anything, even a WARC record.

Payloads are only ever shuffled by record id, which is unique: equal payloads
don't gather in one task, however many there are.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.llm.common import bounded_batches, materialize, table
from fleetcast.session import scratch_path

ARCHIVE_BYTES = 16 << 20           # of records; one record more may be in it
LEAST_REVISIT = 1000               # bytes of payload; shorter ones always stay responses
CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
#: Fixed by the WARC/1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("record_id string, record_type string, page_id string, url string, refers_to_id string, "
          "payload_digest string, payload_bytes long, payload binary")
FIELDS = [x.split()[0] for x in RECORD.split(", ")]


def _header(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line ends in a value are escaped."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def record_text(date: str) -> Column:
    """The text of one record, without the line ends that close it, from the
    columns record_id, record_type, page_id, url, refers_to_id,
    payload_digest, payload_bytes and html (null for a revisit)."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.coalesce("html", F.lit(""))))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        F.lit(f"WARC-Date: {date}{CRLF}"), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), "refers_to_id", F.lit(">")))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_archives(records: DataFrame, name: str, date: str) -> str:
    """Writes ``records`` (the columns of ``record_text``) as gzipped WARC
    files under the shared folder; returns the folder."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = size = 0
        for batch in batches:
            of = []
            for n in batch.column(1).to_pylist():
                if size >= ARCHIVE_BYTES:
                    archive, size = archive + 1, 0
                of.append(archive)
                size += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int32())], names=["value", "archive"])

    spark = records.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    text = records.select(record_text(date).alias("value")).select("value", F.octet_length("value").cast("long").alias("n"))
    (text.mapInArrow(number, "value string, archive int")
     .write.partitionBy("archive").option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path))
    return path


def parse(archive: bytes) -> Iterator[tuple]:
    """The records of one archive (gzipped or not), as rows of RECORD. A
    response's digest and length are those of the payload that is there."""
    if archive[:2] == b"\x1f\x8b":
        try:
            archive = gzip.decompress(archive)
        except (EOFError, zlib.error) as e:
            raise ValueError(f"broken archive: {e}") from e
    at = 0
    while at < len(archive):
        head_end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:head_end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        length = int(head["content-length"])
        block = archive[head_end + 4:head_end + 4 + length]
        at = head_end + 4 + length + 4
        kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
        payload = None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4:]
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"digest of record {head['warc-record-id']} differs")
        refers = head.get("warc-refers-to")
        yield (head["warc-record-id"][1:-1], kind, head.get("x-page-id"), head.get("warc-target-uri"),
               refers and refers[1:-1], digest, None if payload is None else len(payload), payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of all archives under ``path``."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for row in parse(archive.as_py()):
                    rows.append(row)
                    size += row[6] or 0
                    if size > ARCHIVE_BYTES // 4:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=FIELDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=FIELDS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def new_id(*columns: str) -> Column:
    """A record id (a URN) from what makes the record what it is."""
    h = F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns]))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def pages_to_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One response record per page. Rows that repeat get ids of their own."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        F.sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"),
                        F.monotonically_increasing_id().alias("_row"))
    return rows.select(new_id("page_id", "payload_digest", "_row").alias("record_id"), F.lit("response").alias("record_type"),
                       "page_id", "url", F.lit(None).cast("string").alias("refers_to_id"), "payload_digest", "payload_bytes", "html")


def resolve_revisits(spark: SparkSession, path: str, least: int = LEAST_REVISIT) -> DataFrame:
    """The records of the archives under ``path``, each as response or revisit.

    Of the responses with equal payloads of at least ``least`` bytes, the one
    with the largest page id (as a number; then the largest record id) stays;
    the others become revisits that refer to it.
    """
    heads = materialize(read_archives(spark, path).filter("record_type = 'response'")
                        .select("record_id", F.col("page_id").cast("long").alias("page"), "payload_digest", "payload_bytes"), "warc-heads")
    originals = (heads.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
                 .agg(F.max(F.struct("page", "record_id")).alias("first"), F.count("*").alias("n"))
                 .filter("n > 1").select(F.col("payload_digest").alias("_digest"), F.col("first.record_id").alias("refers_to_id")))
    revisits = (heads.join(originals, F.col("payload_digest") == F.col("_digest"))
                .filter("record_id <> refers_to_id").select(F.col("record_id").alias("_id"), "refers_to_id"))
    all_ = read_archives(spark, path).drop("refers_to_id", "record_type")
    return (all_.join(revisits, F.col("record_id") == F.col("_id"), "left")
            .select("record_id", F.when(F.col("_id").isNull(), "response").otherwise("revisit").alias("record_type"),
                    "page_id", "url", "refers_to_id", "payload_digest", "payload_bytes",
                    F.when(F.col("_id").isNull(), F.col("payload").cast("string")).alias("html")))


def index_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of deduplicated archives: page_id, payload_bytes,
    payload_digest, record_type and refers_to (page id of the original). What
    a revisit lacks comes from the response that it refers to."""
    heads = materialize(read_archives(spark, path).drop("payload"), "warc-index")
    originals = heads.filter("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"))
    return (heads.join(originals, F.col("refers_to_id") == F.col("_id"), "left")
            .select(F.col("page_id").cast("long").alias("page_id"),
                    F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
                    F.coalesce("_digest", "payload_digest").alias("payload_digest"), "record_type",
                    F.col("_page").cast("long").alias("refers_to")))


def deduplicate(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> tuple[str, str]:
    """Writes ``pages`` as archives, reads them back and writes deduplicated
    ones; returns both folders.

    A null html is an empty payload. A null url or page id has no header, and
    a null page id is smaller than all others. Rows that repeat are records of
    their own. An empty table gives empty folders.
    """
    spark = pages.sparkSession
    first = write_archives(pages_to_records(pages, key, url, html), "warc", date)
    return first, write_archives(resolve_revisits(spark, first, least), "warc-deduplicated", date)


def op9_warc_revisits(spark, sf_dir: str) -> DataFrame:
    return index_pages(spark, deduplicate(table(spark, sf_dir, "pages"))[1])


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
o AS (SELECT digest, max(page_id) AS page_id FROM h WHERE n >= {LEAST_REVISIT} GROUP BY digest HAVING count(*) > 1)
SELECT h.page_id, CAST(h.n AS BIGINT) AS payload_bytes, h.digest AS payload_digest,
       CASE WHEN o.page_id <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.page_id <> h.page_id THEN o.page_id END AS refers_to
FROM h LEFT JOIN o ON o.digest = h.digest AND h.n >= {LEAST_REVISIT}"""
