"""Web archives: a converter of legacy ARC files to WARC, and WARC files written and read by Spark.

ARC files of version 1 and 2 are parsed by the field names that their version calls for
and by declared lengths. Each record becomes a WARC record with an identifier, timestamp, type
and digests made from what the ARC header says. Records whose payload an earlier page
has become revisits.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import mapped, new_path, spread_join, stored

#: Header fields of an ARC record, by the version in the file's first block.
ARC_FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
#: Payloads below so many bytes are never revisits; bytes (by the mean page) and records in one file of an archive.
LEAST_REVISIT, FILE_BYTES, FILE_RECORDS = 100, 64_000_000, 20_000
#: Pages and characters of one legacy archive on the way.
ARC_PAGES, ARC_CHARS = 256, 4_000_000
#: Repeated payloads up to which their list is broadcast (some 100 bytes each).
BROADCAST_PAYLOADS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """A WARC record: header fields in order, and its block."""

    fields: dict[str, str]
    block: bytes = b""

    def to_bytes(self) -> bytes:
        """The record without the two line ends that close it."""
        head = "".join(f"{k}: {v}\r\n" for k, v in self.fields.items())
        return f"WARC/1.1\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes = field(repr=False, default=b"")


def write_arc(pages: Iterable[tuple[str, str, bytes]], version: int, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An ARC file of (url, mime, body) triples; blanks in urls are percent-encoded, since fields are parted by blanks."""
    info = f"{version} 0 quire\n{ARC_NAMES[version]}\n\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(info)}\n".encode() + info]
    at = len(out[0])
    for url, mime, body in pages:
        more = f" 200 {hashlib.md5(body).hexdigest()} - {at + 1} {name}" if version == 2 else ""
        head = f"\n{_one_word(url)} 0.0.0.0 {date} {mime}{more} {len(body)}\n".encode()
        out += [head, body]
        at += len(head) + len(body)
    return b"".join(out)


def _one_word(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url) or "urn:none"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the file's own block first; the version in it decides how header lines are read.

    Raises ValueError for an unknown version, a header line with another number of
    fields, or a declared length that goes beyond the file.
    """
    version, at = None, 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r") and version:
            at += 1
        if at >= len(data):
            return
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError("ARC header line without end")
        parts = data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        size = int(parts[-1]) if parts[-1].isdigit() else -1
        body = data[stop + 1 : stop + 1 + size]
        if size < 0 or len(body) != size:
            raise ValueError(f"ARC record of {parts[-1]} bytes at {at} goes beyond the file")
        if version is None:
            number = body.split(b" ", 1)[0].strip()
            version = int(number) if number.isdigit() else 0
            if version not in ARC_FIELDS or not parts[0].startswith("filedesc://"):
                raise ValueError("no ARC file of version 1 or 2")
        names = ARC_FIELDS[version]
        if len(parts) != len(names):
            raise ValueError(f"ARC header line at {at} has {len(parts)} fields, version {version} has {len(names)}")
        yield ArcRecord(dict(zip(names, parts)), body)
        at = stop + 1 + size


def _timestamp(date: str) -> str:
    """ISO time of an ARC date, 14 digits or fewer (missing ones are the least)."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head, with the empty line that ends it, and its payload; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(END)
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def record_id(*parts: str) -> str:
    """An identifier made from a record's facts, so that a repeated conversion gives it again."""
    return f"<{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5).urn}>"


def to_warc(arc: ArcRecord, refers_to: str | None = None) -> Record:
    """The WARC record of an ARC record: warcinfo for the file's own block, else response, resource (no HTTP message) or revisit.

    ``refers_to`` is the identifier of the record that has the same payload; a revisit
    keeps the HTTP head only, with the digest and (in Content-Length there) size of the full payload.
    """
    f = arc.fields
    when = _timestamp(f["date"])
    if f["url"].startswith("filedesc://"):
        info = arc.body.replace(b"\r\n", b"\n").strip()
        block = b"format: WARC File Format 1.1\r\nconvertedFrom: ARC " + info.split(b" ", 1)[0] + b"\r\n"
        return Record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(f["url"], when, str(len(info))), "WARC-Date": when, "WARC-Filename": f["url"][11:], "Content-Type": "application/warc-fields"}, block)
    head, payload = http_parts(arc.body)
    digest = hashlib.sha256(payload).hexdigest()
    kind = "resource" if not head else "revisit" if refers_to else "response"
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(f["url"], when, hashlib.sha256(arc.body).hexdigest()), "WARC-Date": when, "WARC-Target-URI": f["url"]}
    if f["ip"] not in ("-", "0.0.0.0"):
        fields["WARC-IP-Address"] = f["ip"]
    block = head if kind == "revisit" else arc.body
    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}
    return Record(fields | {"Content-Type": "application/http;msgtype=response" if head else f["mime"]}, block)


def read_warc(stream: io.BufferedIOBase) -> Iterator[Record]:
    """Records of an uncompressed stream, by their declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k] = v.strip()
        size = int(fields.pop("Content-Length"))
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("WARC record shorter than declared")
        yield Record(fields, block)


def _page_records(pages: list[tuple], version: int) -> Iterator[Record]:
    """A run of pages (page_id, url, html, first_id) as one legacy archive, converted record by record. A record's HTTP head carries the page's number and size."""
    bodies = [html.encode("utf-8", "replace") for _, _, html, _ in pages]
    heads = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{'' if p[0] is None else f'X-Page-Id: {p[0]}' + chr(13) + chr(10)}\r\n".encode() for p, body in zip(pages, bodies)]
    archive = write_arc(((url or "", "text/html", head + body) for (_, url, _, _), head, body in zip(pages, heads, bodies)), version)
    records = read_arc(archive)
    next(records)  # the archive's own block
    for (page_id, _, _, first_id), body, arc in zip(pages, bodies, records, strict=True):
        revisit = first_id is not None and first_id != page_id
        # the first page of a payload has a name that those which refer to it can tell
        shared = record_id("payload", hashlib.sha256(body).hexdigest(), str(first_id)) if first_id is not None else None
        out = to_warc(arc, shared if revisit else None)
        if first_id is not None and not revisit:
            out.fields["WARC-Record-ID"] = shared
        elif page_id is not None:
            out.fields["WARC-Record-ID"] = record_id("page", str(page_id), out.fields["WARC-Record-ID"])
        if revisit:
            out.fields["WARC-Refers-To-Page"] = str(first_id)
        yield out


def convert_archives(spark: SparkSession, source: str, folder: str) -> None:
    """Convert all ARC files below ``source`` (``*.arc`` and ``*.arc.gz``, by version) to WARC files in ``folder``.

    A file is one task's row and is parsed record by record; a damaged one stops the job with its path and place.
    Repeated payloads stay responses: files are converted independently of each other. No file gives an empty archive.
    """

    def convert(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                raw = data.as_buffer().to_pybytes()
                try:
                    for arc in read_arc(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                        yield pa.RecordBatch.from_arrays([pa.array([to_warc(arc).to_bytes()], pa.binary())], ["record"])
                except ValueError as wrong:
                    raise ValueError(f"{path}: {wrong}") from wrong

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.arc{,.gz}").load(source).select("path", "content")
    # a cast keeps all bytes, and the text writer writes them as they are
    records = mapped(files, convert, "record binary").select(F.col("record").cast("string").alias("record"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").text(folder)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Convert all pages, by way of ARC archives of both versions, and write WARC files into ``folder``.

    Files are gzip text parts of about FILE_BYTES (by the mean page; FILE_RECORDS records at most);
    ``\\r\\n\\r\\n`` after each row is what closes a WARC record. One aggregation over payload digests finds repeated payloads
    (the hot one costs a row for each task); it is broadcast if it is small, else joined by digest.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    size = F.octet_length("html").cast("long")
    payloads = stored(rows.groupBy("digest").agg(F.min(F.when(size >= LEAST_REVISIT, F.col("page_id"))).alias("first_id"), F.count("*").alias("n"), F.sum(size).alias("bytes")))
    total = payloads.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    again = payloads.where("n > 1 and first_id is not null").drop("bytes")
    if again.count() <= BROADCAST_PAYLOADS:
        joined = rows.join(F.broadcast(again.drop("n")), "digest", "left")
    else:
        some = spread_join(rows, again, ["digest"], "n", total["n"])
        joined = some.unionByName(rows.join(again, "digest", "left_anti"), allowMissingColumns=True)

    def convert(batches):
        run = 0
        for b in batches:
            held, size = [], 0

            def out(held):
                records = [r.to_bytes().decode("utf-8", "replace") for r in _page_records(held, 1 + run % 2)]
                return pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["record"])

            for page in zip(*(b.column(c) for c in ("page_id", "url", "html", "first_id"))):
                held.append(tuple(x.as_py() for x in page))
                size += len(held[-1][2])
                if size > ARC_CHARS or len(held) == ARC_PAGES:
                    yield out(held)
                    run, held, size = run + 1, [], 0
            if held:
                yield out(held)
                run += 1

    records = max(1, min(FILE_RECORDS, FILE_BYTES * (total["n"] or 1) // max(total["bytes"] or 1, 1)))
    mapped(joined.select("page_id", "url", "html", "first_id"), convert, "record string").write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", int(records)).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archives in ``folder``: type, page number (as text), full payload's size and digest, and the page referred to.

    A file is streamed record by record; responses' digests are computed from what is
    read and must equal the declared ones. Records without an HTTP message (warcinfo, resource) have their block's size.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id", "warc_date"]
    types = [pa.string(), pa.int64(), *[pa.string()] * 6]

    def parse(batches):
        for b in batches:
            for data in b.column("content"):
                rows = []
                with gzip.open(io.BytesIO(data.as_buffer()), "rb") as stream:
                    for r in read_warc(stream):
                        head, payload = http_parts(r.block)
                        told = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                        digest = r.fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                        kind = r.fields["WARC-Type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {r.fields['WARC-Record-ID']} differs from its digest")
                        size = int(told["Content-Length"]) if kind == "revisit" else len(payload)
                        rows.append((told.get("X-Page-Id"), size, digest, kind, r.fields.get("WARC-Refers-To-Page"), r.fields.get("WARC-Target-URI"), r.fields["WARC-Record-ID"], r.fields["WARC-Date"]))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return mapped(files, parse, ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder, read them back, and return a row per page.

    Columns: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Of rows with equal
    payloads of LEAST_REVISIT bytes or more, those with the smallest page_id are responses and the others revisits.
    Null html: empty payload; null url: ``urn:none``; null page_id: never referred to. Page ids of any type that casts
    to and from text come back as they were. An empty table writes an empty archive and gives no rows.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder, page_id, url, html)
    kind = pages.schema[page_id].dataType
    return read_archives(spark, folder).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
