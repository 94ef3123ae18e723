"""WARC archives: writing, reading, and assembling each capture from its records.

A page gives three records: the request, the response (or a revisit of one with the same payload) and the metadata.
Request and metadata name the response in WARC-Concurrent-To; assembly joins along these identifiers.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.llm.common import join_hot, materialise, scratch

VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads below this many bytes are never revisited; what the pages of one archive hold at most, if no page is larger.
LEAST_REVISITED, ARCHIVE_BYTES = 1000, 1 << 28
#: Archives are written by classes of pages, by bytes of payload up to these and beyond, so that a number of records bounds an archive's bytes.
PAGE_BYTES = (1 << 16, 1 << 20, 1 << 24)
#: Bytes of an entry of payloads that are revisited, and of all entries if they are to be broadcast.
ENTRY_BYTES, BROADCAST_BYTES = 1 << 9, 1 << 26

RECORD_SCHEMA = (
    "record_id string, warc_type string, concurrent_to string, target_uri string, warc_date string, refers_to string, refers_to_uri string, "
    "payload_digest string, digest_ok boolean, payload_bytes long, http_line string, fields map<string,string>, payload binary"
)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends behind it. Headers with a null value are left out."""
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # concat_ws leaves nulls out
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7F<>]", "%20"), F.lit("urn:page")).alias("uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size"))


def revisited(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """(digest, first_id, first_uri, alone): payloads of at least `least` bytes that several rows have, and the row that the others revisit; alone: no other has its page_id.

    Only digests are shuffled, not payloads.
    """
    rows = _pages(pages).where(F.col("size") >= least).groupBy("digest", "page_id").agg(F.min("uri").alias("uri"), F.count("*").alias("n"))
    first = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uri", "n"))).alias("first")
    some = rows.groupBy("digest").agg(F.sum("n").alias("n"), first).where("n > 1 and first is not null")
    return some.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.uri").alias("first_uri"), (F.col("first.n") == 1).alias("alone"))


def page_records(pages: DataFrame, least: int = LEAST_REVISITED, same: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html): a `value` for each record, three for each page. Null html is empty; a null url becomes urn:page.

    same: revisited(pages), written. A response that is the only row of its page has an id by page and digest, which
    revisits name in WARC-Refers-To; others have ids by row. Pages meet `same` by digest: it is broadcast if it is small,
    else they are shuffled, but for those too short to be in it.
    """
    same = materialise(revisited(pages, least), "revisited") if same is None else same
    base = _pages(pages).withColumn("row", F.monotonically_increasing_id().cast("string"))
    if same.count() * ENTRY_BYTES <= BROADCAST_BYTES:
        full = base.join(F.broadcast(same), "digest", "left")
    else:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in same.schema.fields if f.name != "digest"]
        full = base.where(F.col("size") >= least).join(same, "digest", "left").unionByName(base.where(F.col("size") < least).select("*", *none))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    is_first = F.coalesce(F.col("alone") & (F.col("page_id") == F.col("first_id")), F.lit(False))
    told = F.when(is_first, F.lit("first")).otherwise(F.col("row"))
    own = {kind: _uuid(F.lit(kind), page, F.col("digest"), told) for kind in ("response", "request", "metadata")}
    first = F.when(F.col("alone"), _uuid(F.lit("response"), F.col("first_id").cast("string"), F.col("digest"), F.lit("first")))
    uri, date, digest = F.col("uri"), F.lit(DATE), F.concat(F.lit("sha1:"), F.col("digest"))
    revisit = F.coalesce(F.col("first_id") != F.coalesce(F.col("page_id"), F.col("first_id") - 1), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    head = [("WARC-Record-ID", own["response"]), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    message = [("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", head + message, F.concat(http, F.col("html")))
    refers = [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", first), ("WARC-Refers-To-Target-URI", F.col("first_uri")), ("WARC-Refers-To-Date", date)]
    again = _record("revisit", head + message + refers, http)
    beside = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Concurrent-To", own["response"])]
    request = _record(
        "request",
        [("WARC-Record-ID", own["request"]), *beside, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n")),
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", own["metadata"]), *beside, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), page, F.lit("\r\n")),
    )
    return full.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISITED, page_bytes: tuple[int, ...] = PAGE_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the records of pages as gzipped archives, whose pages hold at most archive_bytes, or one page if that is larger."""
    same = materialise(revisited(pages, least), "revisited")
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    largest = pages.agg(F.max(size)).first()[0] or 0
    below = -1
    for limit in (*(x for x in page_bytes if x < largest), largest):
        some = pages.where((size > below) & (size <= limit))
        write_records(page_records(some, least, same), f"{path}/to-{limit}", 3 * max(1, archive_bytes // max(limit, 1)) if limit > page_bytes[0] else 3 * archive_bytes // page_bytes[0])
        below = limit


def write_records(records: DataFrame, path: str, per_archive: int) -> None:
    """Writes `value`s as gzipped archives; the writer's line separator is the two line ends that close a record."""
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


def parse(stream: io.BufferedIOBase, with_payload: bool) -> Iterator[dict]:
    """The records of one archive, by their Content-Length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        out = {
            "record_id": headers.get("warc-record-id"), "warc_type": kind, "concurrent_to": headers.get("warc-concurrent-to"),
            "target_uri": headers.get("warc-target-uri"), "warc_date": headers.get("warc-date"),
            "refers_to": headers.get("warc-refers-to"), "refers_to_uri": headers.get("warc-refers-to-target-uri"), "payload_digest": digest, "digest_ok": None,
            "payload_bytes": None, "http_line": None, "fields": [], "payload": None,
        }
        if kind in ("request", "response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            first, *rest = head.decode("utf-8", "replace").split("\r\n")
            fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in rest)}
            out |= {"http_line": first, "fields": list(fields.items())}
            if kind == "response":
                found = hashlib.sha1(body).hexdigest()
                out |= {"payload_bytes": len(body), "payload_digest": found, "digest_ok": digest in (None, found), "payload": body if with_payload else None}
            elif kind == "revisit":
                out["payload_bytes"] = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
        elif kind == "metadata":
            lines = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if x)
            out["fields"] = list({n.strip(): v.strip() for n, _, v in lines}.items())
        yield out


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the gzipped archives below path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORD_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held: list[dict] = []
                size = 0
                for record in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())), with_payload):
                    held.append(record)
                    size += len(record["payload"] or b"")
                    if len(held) >= 4096 or size >= 1 << 24:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: (capture_id, target_uri, response, requests, metadata).

    Requests and metadata belong to the response that WARC-Concurrent-To names: a capture's records meet once, by that id or,
    the response, by its own. requests and metadata are lists in the order of record ids, empty where a capture has none.
    Records that name an absent response make no capture; of several responses with one id the first is taken.
    """
    kind = F.col("warc_type")
    main = F.struct("target_uri", F.struct("warc_type", "warc_date", "refers_to", "refers_to_uri", "payload_digest", "digest_ok", "payload_bytes", "http_line", "payload").alias("response"))
    beside = F.struct("record_id", "http_line", F.array_sort(F.map_entries("fields")).alias("fields"))
    is_main = kind.isin("response", "revisit")
    own = records.where(is_main | (kind.isin("request", "metadata") & F.col("concurrent_to").isNotNull()))
    held = own.groupBy(F.when(is_main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id")).agg(
        F.first(F.when(is_main, main), ignorenulls=True).alias("main"),
        F.sort_array(F.collect_list(F.when(kind == "request", beside))).alias("requests"),
        F.sort_array(F.collect_list(F.when(kind == "metadata", beside))).alias("metadata"),
    )
    return held.where("main is not null").select("capture_id", "main.target_uri", "main.response", "requests", "metadata")


def round_trip(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """Writes the archives of pages(page_id, url, html, ...) to the shared folder and reads the captures back.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, digest_ok), a row for each page.
    Null and empty html have an empty payload. Of equal payloads of at least `least` bytes those with the largest
    page_id are responses (repeated rows all of them, a null page_id never, unless no row has one: all are), the others
    revisit it. refers_to follows the record id that the archive holds; a revisit without, where the response's page_id
    repeats, goes by its payload's digest. Other columns are ignored. Archives are parsed once, payloads digested there.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, least)
    records = materialise(read_archives(spark, path, with_payload=False), "records")
    page = F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda e: e["key"] == "pageId")
    flat = materialise(
        assemble(records).select(
            "capture_id",
            F.get(page, F.lit(0))["value"].try_cast("long").alias("page_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            F.col("response.warc_type").alias("record_type"),
            F.col("response.refers_to").alias("target"),
            "target_uri",
            F.col("response.digest_ok").alias("digest_ok"),
        ),
        "captures",
    )
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "digest_ok"]
    is_revisit = F.col("record_type") == "revisit"
    plain = flat.where(~is_revisit).withColumn("refers_to", F.lit(None).cast("long")).select(*out)
    again = flat.where(is_revisit)
    named = again.groupBy("target").agg(F.count("*").alias("n")).join(flat.select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to")), "target")
    found = join_hot(again.where("target is not null"), named, "target", "n").select(*out)
    counts = again.where("target is null").groupBy("payload_digest").agg(F.count("*").alias("n"))
    first = flat.where(~is_revisit & (F.col("payload_bytes") >= least)).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"))
    rest = join_hot(again.where("target is null"), counts.join(first, "payload_digest"), "payload_digest", "n").select(*out)
    return plain.unionByName(found).unionByName(rest)
