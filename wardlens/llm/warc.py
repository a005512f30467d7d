"""WARC records in ZIP packages: written by Spark tasks, read back by byte ranges."""

from __future__ import annotations

import json
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from uuid import uuid4
from zlib import compressobj, decompressobj

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import stored
from .zip_archive import Writer, members

DATA, INDEX = "archive/records.warc.gz", "indexes/index.jsonl"
# Bytes of records that a reading task row covers.
RANGE_BYTES = 8 << 20
# Bytes that a reading task is given at most on average.
TASK_BYTES = 128 << 20

_MANIFEST = "path string, n_records long"
_RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, " \
    "payload_digest string, payload binary"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The shared store of a path: a URI of any scheme that Arrow opens, or an absolute path."""
    return fs.FileSystem.from_uri(path)


def _record(page_id: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """One gzip member: a response with the payload, or a revisit whose HTTP head alone tells the full length."""
    digest = b32encode(sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if response is None else b"")
    uri = "".join(c if c.isprintable() and c not in "<>" else f"%{ord(c):02X}" for c in url) if url else ""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if uri:
        head.append(f"WARC-Target-URI: {uri}")
    if response is not None:
        head.append(f"WARC-Refers-To: <urn:page:{response}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    packer = compressobj(1, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into ZIP packages below ``path``; returns (path, n_records).

    The payload is the html in UTF-8, empty for null. Among rows with equal payloads of at least ``least_bytes`` the one
    with the largest page_id is the response and the others are revisits of it; smaller payloads are all responses.
    Equal payloads are found by their SHA-256 with one narrow row each; pages themselves are shuffled by page_id only.
    A row without page_id is a response unless a row with one has its payload. Of rows that repeat a page_id with the
    same payload all are written alike: responses if that page is the response.

    Each task writes one package under a name of its own attempt, and only packages in the returned table count, so a
    task that is lost or runs twice leaves nothing behind that is read. An empty table gives no record.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("_sum", F.sha2("html", 256))
    sums = rows.select("page_id", "_sum", F.octet_length("html").alias("_size"))
    first = (
        sums.filter(F.col("_size") >= least_bytes).groupBy("_sum")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    )
    revisits = (
        sums.join(first, "_sum").filter(~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull())
        .select(F.col("page_id").alias("_page"), F.col("_sum").alias("_same"), "response").distinct()
    )
    marked = rows.join(
        revisits, rows["page_id"].eqNullSafe(revisits["_page"]) & (rows["_sum"] == revisits["_same"]), "left"
    ).select("page_id", "url", "html", "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = package = None
        index: list[str] = []
        try:
            for batch in batches:
                for page_id, url, html, response in zip(*batch.columns):
                    if package is None:
                        store, folder = _filesystem(path)
                        store.create_dir(folder, recursive=True)
                        name = f"package-{uuid4().hex}.zip"
                        sink = store.open_output_stream(f"{folder}/{name}")
                        package = Writer(sink)
                        package.start(DATA)
                    record = _record(page_id.as_py(), url.as_py(), html.as_py().encode(), response.as_py())
                    index.append(json.dumps({"page": page_id.as_py(), "offset": package.size, "length": len(record)}))
                    package.append(record)
            if package is not None:
                package.finish()
                package.start(INDEX)
                package.append("".join(line + "\n" for line in index).encode())
                package.finish()
                package.close()
        finally:
            if sink is not None:
                sink.close()
        if package is not None:
            yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "n_records": [len(index)]})

    return stored(marked.mapInArrow(run, _MANIFEST), "packages")


def record_ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, length): byte ranges of whole records in the packages of ``packages`` (path).

    Reads each package's directory and its index members, nothing else. Neighbouring records share a range of at most
    ``range_bytes`` (a longer record has its own). A data member without an index is one range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = _filesystem(path)
                ranges: list[tuple[int, int]] = []
                with store.open_input_file(place) as source:
                    found = {m.name: m for m in members(source, source.size())}
                    for name, member in found.items():
                        if not name.startswith("archive/"):
                            continue
                        listed = found.get(INDEX) if name == DATA else None
                        if listed is None:
                            ranges.append((member.offset, member.size))
                            continue
                        source.seek(listed.offset)
                        for line in source.read(listed.size).splitlines():
                            entry = json.loads(line)
                            start, length = member.offset + entry["offset"], entry["length"]
                            if ranges and sum(ranges[-1]) == start and ranges[-1][1] + length <= range_bytes:
                                ranges[-1] = (ranges[-1][0], ranges[-1][1] + length)
                            else:
                                ranges.append((start, length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(ranges), pa.string()), pa.array([r[0] for r in ranges], pa.int64()),
                     pa.array([r[1] for r in ranges], pa.int64())], ["path", "offset", "length"])

    return packages.select("path").mapInArrow(run, "path string, offset long, length long")


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The gzip members of a range one after another."""
    view, at = memoryview(data), 0
    while at < len(data):
        opened, parts = decompressobj(wbits=31), []
        while not opened.eof:
            if at >= len(data):
                raise ValueError("a record ends early")
            chunk = view[at : at + 8192]
            parts.append(opened.decompress(chunk))
            at += len(chunk) - len(opened.unused_data)
        yield b"".join(parts)


def _parse(data: bytes) -> tuple:
    """The columns of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    size, digest = len(payload), b32encode(sha1(payload).digest()).decode()
    if kind == "revisit":
        told = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(told[0]) if told else None
        digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
        payload = None
    return (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), size,
            digest, payload)


def read_records(spark: SparkSession, packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the packages: ids, type, URI, full payload length and digest (SHA-1 in base32), payload.

    The payload of a revisit is null; its length is the one its HTTP head tells and its digest the one it was written
    with. A response's length and digest are those of the bytes read. Ranges are dealt out before they are read, so a
    large package is many tasks; a range is held in memory, its records are passed on one by one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = _filesystem(path)
                with store.open_input_file(place) as source:
                    source.seek(offset)
                    data = source.read(length)
                rows, held = [], 0
                for record in _unpacked(data):
                    rows.append(_parse(record))
                    held += len(record)
                    if held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    # A row of a range is small but stands for much to read: the number of tasks follows the bytes, not the rows' size.
    ranges = stored(record_ranges(packages, range_bytes), "ranges")
    count, total = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-total // TASK_BYTES))
    return ranges.repartition(tasks, "path", "offset").mapInArrow(run, _RECORD)
