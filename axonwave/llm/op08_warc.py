"""WARC as a chunked record table, written to and read back from real WARC files.

Writing: a page becomes rows (record, chunk number, bytes of the chunk, its digest); oversized payloads are
continuation segments (WARC-Segment-Number, each with its WARC-Block-Digest), cut in one pass, and no chunk row holds more than its chunk. A row is one complete WARC segment and Spark's text writer ends each with CRLF, so the files
are plain WARC 1.1 (gzip), on any file system that Spark writes to, with its commit protocol.

Reading: a file is streamed line by line (CRLF), segments are cut by Content-Length, and a
SHA-256 is carried from chunk to chunk; a chunk or a response whose digest or length differs from its
header is an error.

Equal payloads (SHA-256 and length, at least least_bytes long) have one response, that of the smallest
page_id; the others are revisits that refer to it. Only the list of copies is joined to the pages.

Edge cases: null html is an empty payload (a response); rows with a null page_id are always responses;
rows that repeat the smallest page_id are responses each, others that repeat are revisits each; CR, LF and record markers inside a payload
are data. A null url leaves the target header out. Empty input gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import shared_dir, small_side, table, written

RECORD = "urn:axonwave:page:"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, n_chunks int"


def copies_of(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, refers_to: the pages whose payload an earlier page (smaller page_id) has."""
    p = pages.where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("sha")).where(F.col("n") >= least_bytes)
    p = written(p, "digests")
    first = p.groupBy("n", "sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    return p.join(first, ["n", "sha"]).where("page_id != refers_to").select("page_id", "refers_to").distinct()


def segments(pages: DataFrame, least_bytes: int = 100, chunk_chars: int = 1 << 18) -> DataFrame:
    """The chunked record table: page_id, chunk (from 1), value (the whole WARC segment as text)."""
    copies = small_side(written(copies_of(pages, least_bytes), "copies"))
    html, crlf = F.coalesce(F.col("html"), F.lit("")), F.lit("\r\n")
    p = pages.select("page_id", F.regexp_replace("url", "[\r\n]", "").alias("url"), html.alias("html")).join(copies, "page_id", "left")
    revisit = F.col("refers_to").isNotNull()
    cut = F.when(F.length("html") <= chunk_chars, F.array("html")).otherwise(F.regexp_extract_all("html", F.lit(f"(?s)(.{{1,{chunk_chars}}})"), F.lit(1)))
    p = p.withColumns({"n": F.octet_length("html"), "sha": F.sha2("html", 256), "parts": F.when(revisit, F.array(F.lit(""))).otherwise(cut)}).drop("html")
    p = p.withColumn("chunks", F.size("parts"))
    p = p.select("page_id", "url", "refers_to", "n", "sha", "chunks", F.posexplode("parts").alias("chunk", "part")).withColumn("chunk", F.col("chunk") + 1)
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), crlf)).otherwise("")
    first, many = F.col("chunk") == 1, F.col("chunks") > 1
    only_first = lambda c: F.when(first, c)
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    record = F.concat(F.lit(RECORD), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", kind),
        field("WARC-Record-ID", F.concat(F.lit("<"), record, F.when(first, "").otherwise(F.concat(F.lit(":"), F.col("chunk"))), F.lit(">"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), field("WARC-Target-URI", only_first(F.col("url"))),
        field("WARC-Payload-Digest", only_first(F.concat(F.lit("sha256:"), F.col("sha")))),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("part", 256))), field("WARC-Payload-Length", only_first(F.col("n"))),
        field("WARC-Refers-To", only_first(F.concat(F.lit(f"<{RECORD}"), F.col("refers_to"), F.lit(">")))),
        field("WARC-Profile", F.when(first & revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        field("WARC-Segment-Number", F.when(many, F.col("chunk"))),
        field("WARC-Segment-Origin-ID", F.when(~first, F.concat(F.lit("<"), record, F.lit(">")))),
        field("WARC-Segment-Total-Length", F.when(F.col("chunk") == F.col("chunks"), F.when(many, F.col("n")))),
        F.lit("Content-Type: text/html;charset=utf-8\r\n"), field("Content-Length", F.octet_length("part")), crlf, F.col("part"), crlf)
    return p.select("page_id", "chunk", head.alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    """Each task's segments as one WARC file; a record's chunks stand one after another."""
    records.select("value").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parsed(lines: Iterator[tuple[str, str]]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """(file, line without CRLF) of whole files -> (headers, chunks of the content), one segment after another.

    The content must be consumed before the next segment is taken; it is never held whole.
    """
    for _, line in lines:
        if line == "":
            continue
        if not line.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        for _, line in lines:
            if line == "":
                break
            name, _, value = line.partition(": ")
            head[name] = value
        left = int(head["Content-Length"])

        def content(left=left):
            fresh = True
            while left > 0 or fresh:
                line = next(lines)[1].encode()
                if not fresh:
                    line = b"\r\n" + line
                fresh = False
                if len(line) > left:
                    raise ValueError("content is longer than its Content-Length")
                left -= len(line)
                yield line

        body = content()
        yield head, body
        for _ in body:
            pass


def records_of(lines: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    """One row of SCHEMA for each record, its segments joined by an incremental digest."""
    now = sha = None
    n = chunks = 0

    def closed():
        if now["WARC-Type"] == "response" and (f"sha256:{sha.hexdigest()}" != now["WARC-Payload-Digest"] or n != int(now["WARC-Payload-Length"])):
            raise ValueError(f"digest or length of {now['WARC-Record-ID']} differs")
        number = lambda v: int(v[1:-1].removeprefix(RECORD)) if v and not v.endswith("none>") else None
        return (
            number(now["WARC-Record-ID"]), now.get("WARC-Target-URI"), int(now["WARC-Payload-Length"]), now["WARC-Payload-Digest"].removeprefix("sha256:"),
            now["WARC-Type"], number(now.get("WARC-Refers-To")), chunks)

    for head, body in parsed(lines):
        if head["WARC-Type"] != "continuation":
            if now is not None:
                yield closed()
            now, sha, n, chunks = head, hashlib.sha256(), 0, 0
        elif now is None or head["WARC-Segment-Origin-ID"] != now["WARC-Record-ID"] or int(head["WARC-Segment-Number"]) != chunks + 1:
            raise ValueError(f"segment out of order: {head['WARC-Record-ID']}")
        chunks, block = chunks + 1, hashlib.sha256()
        for piece in body:
            sha.update(piece)
            block.update(piece)
            n += len(piece)
        if head.get("WARC-Block-Digest", digest := f"sha256:{block.hexdigest()}") != digest:
            raise ValueError(f"digest of segment {chunks} of {now['WARC-Record-ID']} differs")
    if now is not None:
        yield closed()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA. A gzip file is read by one task from its start to its end, as a stream of lines."""

    def rows(batches):
        import itertools

        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        lines = ((f.as_py(), v.as_py()) for b in batches for f, v in zip(b.column(0), b.column(1), strict=True))
        for _, own in itertools.groupby(lines, key=lambda x: x[0]):
            records = records_of(own)
            while some := list(itertools.islice(records, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("_metadata.file_path").alias("f"), "value")
    return lines.mapInArrow(rows, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/axonwave-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_archives(segments(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY n, sha) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha AS payload_digest, CASE WHEN page_id IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id != first THEN first END AS refers_to FROM f
"""
