"""WARC archives: writing with revisits, segments and chunked framing, and segment reassembly.

``write_archive`` turns rows into WARC/1.1 records and ``read_archive`` reads any such files
back. A response block longer than ``segment_bytes`` is cut into a first record and
``continuation`` records; reading groups these by origin identifier, orders them by segment
number, checks the total length and decodes the chunked transfer framing.

Only narrow rows (key, digest) meet by digest, pre-aggregated, so a group of equal payloads of
any size stays distributed; the payloads themselves are dealt by key, and reassembly groups only
the segments of one record.

Defined results: a null payload is the empty payload; a null key writes no key header and reads
back as null; among rows that share both key and payload all are responses if that key is the
smallest of its payload; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends a record; the text writer puts it after each row.
RECORD_END = "\r\n\r\n"
_PIECES = "origin string, seg int, total long, kind string, page string, uri string, refers string, digest string, block binary"
_PAGES = "page string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, segments int, status string, payload binary"


def chunked(body: bytes, size: int) -> bytes:
    """``body`` in chunked transfer framing, ``size`` bytes a chunk."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message; ValueError where the framing is broken."""
    at, parts = 0, []
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        parts.append(data[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block


def page_records(name: str, page: str | None, uri: str | None, body: bytes, refers: str | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, a whole response, or a segmented response."""
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()  # noqa: S324
    uri = None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    shared = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-Key", page)]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        block = f"{head}Content-Length: {len(body)}\r\n\r\n".encode()
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *shared], block)]
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(body, chunk_bytes)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), *shared]
    if len(block) <= segment_bytes:
        return [_record(first, block)]
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    records = [_record([*first, ("WARC-Segment-Number", 1)], cuts[0])]
    for n, cut in enumerate(cuts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{n}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", f"<urn:page:{name}>"), ("WARC-Segment-Number", n)]
        records.append(_record([*fields, ("WARC-Segment-Total-Length", len(block) if n == len(cuts) else None)], cut))
    return records


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, by Content-Length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its Content-Length")
        yield fields, block


def write_archive(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = 8192, chunk_bytes: int = 4096, records_per_file: int = 20_000) -> None:
    """Write a gzip'd WARC record per row (more where it is cut into segments) below ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes that with the smallest
    key becomes a response and the others revisits that refer to it.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("k"), F.col(uri).cast("string").alias("u"), body.alias("body"), F.sha1(body).alias("h"))
    narrow = rows.filter(F.octet_length("body") >= min_revisit_bytes).select("k", "h")
    firsts = narrow.groupBy("h").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = narrow.join(firsts, "h").filter("k > first").select("k", "h", "first").distinct()
    rows = rows.join(revisits, ["k", "h"], "left").select(F.col("k").cast("string").alias("k"), "u", "body", F.col("first").cast("string").alias("first"), F.spark_partition_id().alias("p"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            k, u, b, f, p = (batch.column(i) for i in range(5))
            step = max(1, int(len(k) * 8e6 / max(1, batch.nbytes)))
            for i in range(0, len(k), step):
                out: list[bytes] = []
                for j in range(i, min(len(k), i + step)):
                    n += 1
                    page = k[j].as_py()
                    out += page_records(f"{page}:{p[j].as_py()}-{n}", page, u[j].as_py(), b[j].as_py(), f[j].as_py(), segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    built = rows.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    built.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below ``path``: its fields and its block.

    A task holds one archive file in memory at a time and its records in batches of 4 MB, so the
    size of a file is the bound; ``write_archive`` keeps files small.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PIECES.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer().to_pybytes() if hasattr(content, "as_buffer") else content.as_py()
                stream = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                rows, held = [], 0
                for f, block in parse_records(stream):
                    seg, kind = f.get("warc-segment-number"), f.get("warc-type", "")
                    origin = f["warc-segment-origin-id"] if kind == "continuation" else f.get("warc-record-id", "")
                    total, refers = f.get("warc-segment-total-length"), f.get("warc-refers-to")
                    rows.append((origin, seg and int(seg), total and int(total), kind, f.get("x-page-key"), f.get("warc-target-uri"), refers, f.get("warc-payload-digest"), block))
                    held += len(block)
                    if held > 4_000_000:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _PIECES)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"seg": pa.int32(), "total": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def _decode(kind: str, digest: str | None, total: int | None, blocks: list[bytes], segs: list[int | None]) -> tuple[int | None, str | None, str, bytes | None]:
    """Payload size, digest, status and payload of a reassembled record."""
    block = b"".join(blocks)
    if segs != [None]:
        if segs != list(range(1, len(segs) + 1)) or total is None:
            return None, None, "incomplete", None
        if total != len(block):
            return None, None, "length_mismatch", None
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    told = digest.removeprefix("sha1:") if digest else None
    if kind == "revisit":
        return int(http.get("content-length", 0)), told, "ok", None
    try:
        body = unchunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else body
    except ValueError:
        return None, None, "bad_framing", None
    own = base64.b32encode(hashlib.sha1(body).digest()).decode()  # noqa: S324
    return len(body), own, "ok" if told in (None, own) else "digest_mismatch", body


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit below ``path``, reassembled, unframed and verified.

    ``status`` is ok, incomplete, length_mismatch, bad_framing or digest_mismatch; faulty records
    are kept, with null payload fields. Records without segments pass with no shuffle.
    """
    pieces = read_pieces(spark, path).filter("kind in ('response', 'revisit', 'continuation')")
    meta = F.struct("kind", "page", "uri", "refers", "digest")
    part = F.struct("seg", "total", meta.alias("meta"), "block")
    whole = pieces.filter("seg is null and kind != 'continuation'").select(F.array(part).alias("parts"))
    cut = pieces.filter("seg is not null").groupBy("origin").agg(F.array_sort(F.collect_list(part)).alias("parts")).select("parts")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PAGES.split(", ")]
        kinds = {"payload_bytes": pa.int64(), "segments": pa.int32(), "payload": pa.binary()}
        for batch in batches:
            step = max(1, int(batch.num_rows * 8e6 / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                out = []
                for parts in batch.column(0).slice(i, step).to_pylist():
                    m = parts[0]["meta"]
                    n, d, status, body = _decode(m["kind"], m["digest"], parts[-1]["total"], [x["block"] for x in parts], [x["seg"] for x in parts])
                    out.append((m["page"], m["kind"], m["uri"], m["refers"] and m["refers"][len("<urn:page:") : -1], n, d, len(parts), status, body if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names, zip(*out, strict=True), strict=True)], names)

    return whole.unionAll(cut).mapInArrow(decode, _PAGES)
