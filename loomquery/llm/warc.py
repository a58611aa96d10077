"""WARC archives with an index written first-class: write, index, then read by coalesced byte ranges.

Each record is a gzip member of its own, so any record can be read from its
offset and length alone.  Archives and the index live in the shared folder;
their file system is reached through ``pyarrow.fs`` on the executors.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, shared_path

INDEX_SCHEMA = (
    "page_id long, url string, archive string, offset long, length long, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long"
)
READ_SCHEMA = (
    "page_id long, url string, archive string, offset long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary, intact boolean"
)
#: An archive is closed once it holds this many bytes.
ROLL_BYTES = 1 << 30
#: Reads join records at most this far apart, into ranges of at most this size.
GAP_BYTES, RANGE_BYTES = 64 << 10, 4 << 20


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    clean = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    return clean or f"urn:page:{page_id}"


def _urn(page_id: int | None, digest: str) -> str:
    """The record id of a page with this payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def make_info(name: str) -> bytes:
    """The record that opens an archive, as a gzip member."""
    block = b"software: loomquery\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member.  A revisit carries the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{_urn(page_id, digest)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if is_revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_urn(refers_to, digest)}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return _member("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one decompressed record.  Raises ``ValueError`` where it isn't one."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "declared": declared}


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    out, name, at = None, "", 0
    try:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload = r["html"].encode("utf-8", "replace") if r["html"] is not None else b""
                digest = digest32(payload)
                revisit = r["refers_to"] is not None
                record = make_record(r["page_id"], r["url"], payload, digest, r["refers_to"], revisit)
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    # A name of its own for each attempt: a lost attempt's file is never in the index.
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)  # the members are compressed already
                    info = make_info(name)
                    out.write(info)
                    at = len(info)
                out.write(record)
                rows.append(
                    (r["page_id"], r["url"], f"{folder}/{name}", at, len(record), len(payload), digest, "revisit" if revisit else "response", r["refers_to"])
                )
                at += len(record)
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "url", "archive", "offset", "length", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    finally:
        if out is not None:
            out.close()


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, folder: str | None = None
) -> DataFrame:
    """Write a record for every row and return the index, one row per record (``INDEX_SCHEMA``).

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, the
    one with the largest id is the response and the others revisit it.  Equal
    payloads are found by (SHA-1, length); the largest id is aggregated before
    the shuffle, and the join on the digest is one Spark may split where a
    payload is hot.

    Null html is the empty payload.  Null ids never win over others; where all
    are null, each is a response.  Repeated rows (same id and payload) are all
    responses if they hold the largest id.  Null or unprintable urls are
    replaced or percent-encoded in the record, not in the index.  An empty
    table gives an empty index.  Other columns are ignored.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).withColumns({"sha": F.sha1(body), "bytes": F.octet_length(body)})
    largest = own.groupBy("sha", "bytes").agg(F.max("page_id").alias("keeper"))
    placed = own.join(largest, ["sha", "bytes"], "left").select(
        "page_id", "url", "html",
        F.when((F.col("bytes") >= min_revisit_bytes) & (F.coalesce(F.col("page_id") != F.col("keeper"), F.col("keeper").isNotNull())), F.col("keeper")).alias("refers_to"),
    )
    where = folder or shared_path(spark, "warc")
    # Written at once: evaluating this plan again would write the archives again.
    return durable(placed.mapInArrow(lambda it: _write(it, where, ROLL_BYTES), INDEX_SCHEMA), "warc-index")


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Rows sorted by (archive, offset), joined where they lie close together."""
    held: list[dict] = []
    for r in rows:
        end = held[-1]["offset"] + held[-1]["length"] if held else 0
        if held and (
            r["archive"] != held[0]["archive"] or r["offset"] - end > GAP_BYTES or r["offset"] + r["length"] - held[0]["offset"] > RANGE_BYTES
        ):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    name, file = None, None
    try:
        for batch in batches:
            for span in _ranges(batch.to_pylist()):
                if span[0]["archive"] != name:
                    if file is not None:
                        file.close()
                    name = span[0]["archive"]
                    files, path = fs.FileSystem.from_uri(name)
                    file = files.open_input_file(path)
                first = span[0]["offset"]
                data = file.read_at(span[-1]["offset"] + span[-1]["length"] - first, first)
                rows = []
                for r in span:
                    got = parse_record(zlib.decompress(data[r["offset"] - first : r["offset"] - first + r["length"]], 31))
                    revisit = got["warc-type"] == "revisit"
                    digest = got["warc-payload-digest"].removeprefix("sha1:")
                    payload = got["payload"]
                    intact = revisit or (digest32(payload) == digest and len(payload) == got["declared"])
                    refers = got.get("x-refers-to-page-id", "")
                    rows.append(
                        (int(got["x-page-id"]) if got["x-page-id"] else None, got["warc-target-uri"], name, r["offset"], got["warc-type"], int(refers) if refers else None,
                         got["declared"] if revisit else len(payload), digest if revisit else digest32(payload), None if revisit or not with_payload else payload, intact)
                    )
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
                names = ["page_id", "url", "archive", "offset", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "intact"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    finally:
        if file is not None:
            file.close()


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the records of ``index`` (any selection of its rows) back from the archives (``READ_SCHEMA``); ``url`` is the record's target.

    Rows are dealt by (archive, 64 MB stretch) and sorted by offset, so a task
    reads forwards, and close records share one read of at most 4 MB.  A
    revisit has no payload; its size and digest are those of its target, as
    declared in the record.  ``intact`` tells whether a response's bytes have
    the declared digest and length.
    """
    return (
        index.withColumn("stretch", F.expr("offset div 67108864"))
        .repartition("archive", "stretch")
        .sortWithinPartitions("archive", "offset")
        .select("archive", "offset", "length")
        .mapInArrow(lambda it: _read(it, with_payload), READ_SCHEMA)
    )


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write every page, then read every record back without its payload."""
    return read_records(write_archives(pages, min_revisit_bytes=min_revisit_bytes), with_payload=False)
