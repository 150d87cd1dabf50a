"""WARC archives: an index of byte ranges first, then sorted, coalesced range reads.

Tasks write archive files as they meet the records, each under a name of its own, and give the index: file, offset,
length, URL and digest of every record. Only files that the index names count, so what a lost or repeated task leaves
behind is never read. Bodies move at most once, to the ids that their digests refer to, and not at all where those ids
are few enough for Spark to broadcast; a digest that very many records share is split by Spark's skew join.

Archives are written and read through Arrow's file systems (local, S3, GCS, Azure, and HDFS with its client library).

Duplicates: of the records with one payload of at least ``least`` bytes the largest id is the ``response``, the others
are ``revisit`` records (headers only, identical-payload-digest profile). Smaller payloads are always stored.

Defined results: null html is an empty payload; a null or odd URL is written with its control characters and blanks
percent-encoded (null: none); rows repeated under one id stay separate records, and if that id is the largest of its
payload each of them is a response; a null id is stored and returned as null and refers to the largest id that is not
null, or is a response where all are null; an empty table gives no archives and no rows; other columns take no part;
archives may be of any length.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\r\n\r\n"
LEAST = 1000
#: A file is closed once it holds so much.
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Bytes of records that one reading task takes.
TASK_BYTES = 64 << 20
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
INDEX = "page_id bigint, url string, digest string, archive string, offset bigint, length bigint"


def _facts(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha1(F.encode(body, "UTF-8")).alias("digest"),
    )


def _kept_ids(facts: DataFrame, least: int) -> DataFrame:
    """digest -> the id that keeps the payload, for payloads that occur more than once."""
    large = facts.filter(F.col("payload_bytes") >= least)
    return large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND kept IS NOT NULL").select("digest", "kept")


def _records(facts: DataFrame, kept: DataFrame) -> DataFrame:
    """(page_id, url, digest, head, body): a record's head is all before its body; the body of a revisit is null."""
    out = facts.join(kept, "digest", "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    safe = F.regexp_replace(F.col("url"), r"%", "%25")
    for code in (*range(0x21), 0x7F):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    plain = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), safe).otherwise(F.col("url"))
    crlf, http = F.lit("\r\n"), F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    stored = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), crlf,
        F.lit("WARC-Record-ID: "), name(F.col("page_id")), crlf, F.lit("WARC-Date: 2024-01-01T00:00:00Z"), crlf,
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), plain, crlf)).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), crlf,
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("kept")), crlf, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), stored.cast("string"), F.lit(END), http,
    )
    return out.select("page_id", "url", "digest", head.alias("head"), F.when(~again, F.col("body")).alias("body"))


def write(pages: DataFrame, path: str, *, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``path/archives`` and ``path/index``; gives the index."""
    spark = pages.sparkSession
    facts = _facts(pages)
    kept = common.materialise(_kept_ids(facts.select("page_id", "payload_bytes", "digest"), least), "warc-kept")
    base = f"{common.qualified(spark, path)}/archives"

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    names, places, sizes = [], [], []
                    for head, body in zip(part.column(3), part.column(4), strict=True):
                        if out is not None and at >= archive_bytes:
                            out.close()
                            out = None
                        if out is None:
                            name, at = f"part-{uuid.uuid4().hex}.warc", 0
                            store.create_dir(root, recursive=True)
                            out = store.open_output_stream(f"{root}/{name}")
                        record = head.as_py().encode() + (body.as_py() or "").encode() + END.encode()
                        out.write(record)
                        names.append(name)
                        places.append(at)
                        sizes.append(len(record))
                        at += len(record)
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["page_id", "url", "digest", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    common.arrow(_records(facts, kept), run, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names; ``http-`` before those of the block) and payload of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at this place: {lines[0][:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    if len(block) < int(headers["content-length"]):
        raise ValueError("record is cut off")
    inner, _, payload = block[: int(headers["content-length"])].partition(b"\r\n\r\n")
    headers |= {"http-" + k.lower(): v for k, _, v in (x.partition(": ") for x in inner.decode("utf-8").split("\r\n")[1:])}
    if "warc-target-uri" in headers and re.search(r"%(25|[01][0-9A-F]|20|7F)", headers["warc-target-uri"]):
        headers["warc-target-uri-decoded"] = unquote(headers["warc-target-uri"])
    return headers, payload


def _number(urn: str | None) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "none"
    return None if value == "none" else int(value)


def facts_of(record: bytes) -> tuple:
    """A row of RESULT, with stored payloads checked against their digest and length."""
    headers, payload = parse(record)
    kind, digest, n = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["http-content-length"])
    if kind == "response":
        n, digest = len(payload), (found := hashlib.sha1(payload).hexdigest())
        if found != headers["warc-payload-digest"].removeprefix("sha1:"):
            raise ValueError(f"digest of {headers['warc-record-id']} doesn't match")
    return _number(headers["warc-record-id"]), n, digest, kind, _number(headers.get("warc-refers-to"))


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(spark: SparkSession, path: str, selected: DataFrame, *, range_bytes: int = RANGE_BYTES, gap: int = GAP_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows of RESULT of the ``selected`` index rows.

    They are sorted by archive and offset; neighbours less than ``gap`` apart are read in one range of up to
    ``range_bytes`` (a longer record is a range of its own). A task takes about ``task_bytes`` of records.
    """
    base = f"{common.qualified(spark, path)}/archives"

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        held: list[tuple[str, int, int]] = []
        rows: list[tuple] = []
        name, source = None, None

        def fetch():
            nonlocal name, source
            archive, start = held[0][0], held[0][1]
            if archive != name:
                if source is not None:
                    source.close()
                name, source = archive, store.open_input_file(f"{root}/{archive}")
            data = memoryview(source.read_at(held[-1][1] + held[-1][2] - start, start))
            rows.extend(facts_of(bytes(data[o - start : o - start + n])) for _, o, n in held)
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (row[0] != held[-1][0] or row[1] - held[-1][1] - held[-1][2] > gap or row[1] + row[2] - held[0][1] > range_bytes):
                    fetch()
                held.append(row)
                if len(rows) >= 5_000:
                    yield _columns(rows)
                    rows.clear()
        if held:
            fetch()
        if rows:
            yield _columns(rows)
        if source is not None:
            source.close()

    total = selected.agg(F.sum("length")).first()[0] or 0
    ordered = selected.select("archive", "offset", "length").withColumn("__block", F.floor(F.col("offset") / range_bytes))
    ordered = ordered.repartition(max(1, -(-total // task_bytes)), "archive", "__block").sortWithinPartitions("archive", "offset").drop("__block")
    return common.arrow(ordered, run, RESULT)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write every page, read the archives back and give one row of RESULT a page."""
    spark = pages.sparkSession
    path = path or common.scratch(spark, "warc")
    return read(spark, path, write(pages, path))
