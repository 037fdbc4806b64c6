"""WARC archives with revisit records.

Only headers are grouped and joined by payload digest: the first record of a digest is a response and the others are
revisits that refer to it. Payloads stay where they are read; those of revisits are left out by the revisits' ids. Spark's
text writer makes the archive files (each record ends with two line ends, which is its line separator), so they can lie in
any store that Spark reaches. Reading them back parses one record after another of files bounded in bytes, and joins the
headers of revisits to those of the responses.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import IO
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, materialize, scratch_dir

LEAST_BYTES = 100
#: Payloads up to so many bytes lie so many to a file, so that no file of several records exceeds 128 MB before compression.
FILE_CLASSES = ((1 << 17, 1000), (1 << 21, 64), (None, 1))
#: Most revisits that are broadcast (about 150 bytes each); beyond it payloads are shuffled by page_id and digest.
BROADCAST_REVISITS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes and payload_digest of ``pages``."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", "url", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest")
    )


def revisits(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The headers that are revisits, with refers_to.

    Of records with equal payloads of at least ``least_bytes`` the smallest page_id is the response. Rows that
    repeat it are responses too; null ids come last, and where all are null all are responses.
    """
    long = heads.where(F.col("payload_bytes") >= least_bytes)
    firsts = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return long.join(firsts.drop("n"), "payload_digest").where(
        F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    )


def record(kind: str, date: str) -> Column:
    """A WARC record of a header row of that type (a response's with html), without the two line ends after it."""

    def line(name: str, value) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_END))).otherwise("")

    def urn(*parts) -> Column:
        h = F.md5(F.concat_ws("|", *parts))
        dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))

    def one_line(text: Column) -> Column:
        return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def escaped(key: Column) -> Column:
        return one_line(F.replace(key.cast("string"), F.lit("%"), F.lit("%25")))

    revisit = kind == "revisit"
    page, nothing = F.col("page_id").cast("string"), F.lit(None).cast("string")
    first = F.col("refers_to").cast("string") if revisit else nothing
    return F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", F.lit(kind)),
        line("WARC-Record-ID", urn(F.coalesce(page, F.lit("")), "payload_digest")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Page-ID", escaped(page)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Profile", F.lit(PROFILE) if revisit else nothing),
        line("WARC-Refers-To", urn(first, "payload_digest") if revisit else nothing),
        line("WARC-Refers-To-Page", escaped(first)),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.lit("0") if revisit else F.col("payload_bytes").cast("string")),
        F.lit(_END),
        F.lit("") if revisit else F.coalesce("html", F.lit("")),
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_classes: tuple = FILE_CLASSES) -> None:
    """Writes the archives of ``pages`` (page_id, url, html) as gzipped WARC files into ``path``.

    One pass over the payloads makes the headers, and one for each of ``file_classes`` that any payload falls into.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = materialize(headers(pages), "warc-heads")
    again = materialize(revisits(heads, least_bytes), "warc-revisits")

    def write(rows: DataFrame, records: int) -> None:
        rows.write.mode("append").option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)

    write(again.select(record("revisit", date).alias("value")), file_classes[0][1])
    ids = again.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"))
    if again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS:
        ids = F.broadcast(ids)
    own = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d"))
    size, over = F.octet_length(F.coalesce("html", F.lit(""))), -1
    for most, records in file_classes:
        n = F.col("payload_bytes")
        if not heads.where((n > over) & (n <= most) if most else n > over).isEmpty():
            rows = pages.where((size > over) & (size <= most) if most else size > over)
            digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
            rows = rows.select("page_id", "url", "html", size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"))
            write(rows.join(ids, own, "left_anti").select(record("response", date).alias("value")), records)
        over = most


def parse(archive: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an unpacked archive, one after another."""
    while first := archive.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"no record at {first[:40]!r}")
        lines = iter(archive.readline, b"\r\n")
        heads = dict(x.decode().removesuffix(_END).split(": ", 1) for x in lines)
        n = int(heads["Content-Length"])
        block = archive.read(n)
        if len(block) != n or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record {heads['WARC-Record-ID']} doesn't end where it says")
        yield heads, block


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    for batch in batches:
        for i in range(batch.num_rows):
            rows = []
            for heads, block in parse(gzip.open(io.BytesIO(batch.column("content")[i].as_py()))):
                whole = heads["WARC-Type"] == "response"
                digest = heads["WARC-Payload-Digest"].removeprefix("sha256:")
                if whole and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"a payload differs from its digest {digest}")
                page, first = (unquote(x) if (x := heads.get(h)) else x for h in ("WARC-Page-ID", "WARC-Refers-To-Page"))
                rows.append((page, len(block) if whole else None, digest, heads["WARC-Type"], first))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["page_id", "own_bytes", "payload_digest", "record_type", "refers_to"],
            )


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in ``path``.

    Payload digests of responses are checked; a revisit's payload is the response it refers to, found by a join of
    headers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    heads = map_arrow(
        files, _headers, "page_id string, own_bytes long, payload_digest string, record_type string, refers_to string"
    )
    heads = materialize(heads.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")}), "headers")
    wanted = heads.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    origin = (
        heads.where("record_type = 'response'")
        .join(wanted.select(F.col("refers_to").alias("page_id"), "payload_digest"), ["page_id", "payload_digest"], "left_semi")
        .groupBy("page_id", "payload_digest")
        .agg(F.max("own_bytes").alias("origin_bytes"))
        .select(F.col("page_id").alias("o"), F.col("payload_digest").alias("od"), "origin_bytes")
    )
    return heads.join(origin, (F.col("refers_to") == F.col("o")) & (F.col("payload_digest") == F.col("od")), "left").select(
        "page_id",
        F.coalesce("own_bytes", "origin_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives into the shared folder and reads the records back, one row per page.

    Null html is an empty payload, a null url leaves its header out. Payloads under LEAST_BYTES are never
    revisits. An empty table gives no records; other columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())
