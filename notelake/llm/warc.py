"""WARC records in Zstandard archives: a dictionary in a leading skippable frame, one frame per record."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise, partitions, scratch_path
from .files import new_file, open_file

#: Fixed values of the format: frame magics, little-endian.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
_HEADER_END = b"\r\n\r\n"
_RECORD_END = b"\r\n\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    http: bytes
    payload: bytes


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+|none)>", uri or "")
    if not m:
        raise ValueError(f"not a page id: {uri}")
    return None if m[1] == "none" else int(m[1])


def render(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of a record: a response with its payload, or a revisit of page ``refers_to`` without it."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {_REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + _HEADER_END + block + _RECORD_END


def parse(raw: bytes) -> Record:
    """Reads a record; raises ValueError if its version, headers, lengths or digests are wrong."""
    head, mark, rest = raw.partition(_HEADER_END)
    version, *lines = head.decode("utf-8").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", version):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in headers:
            raise ValueError(f"bad header line: {line!r}")
        headers[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing or not headers["content-length"].isdigit():
        raise ValueError(f"no valid {missing or 'content-length'}")
    n = int(headers["content-length"])
    if len(rest) != n + len(_RECORD_END) or rest[n:] != _RECORD_END:
        raise ValueError("the block isn't as long as its header tells")
    block = rest[:n]
    _match("warc-block-digest", headers, block)
    http, mark, payload = block.partition(_HEADER_END)
    if not mark:
        raise ValueError("no HTTP header")
    kind = headers["warc-type"]
    length = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if kind == "response":
        _match("warc-payload-digest", headers, payload)
        if not length or int(length[1]) != len(payload):
            raise ValueError("the payload isn't as long as its header tells")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in headers or "warc-profile" not in headers or not length:
            raise ValueError("bad revisit")
    else:
        raise ValueError(f"unknown record type {kind}")
    return Record(kind, headers, http + mark, payload)


def _match(name: str, headers: dict[str, str], data: bytes) -> None:
    if name in headers and headers[name] != "sha256:" + hashlib.sha256(data).hexdigest():
        raise ValueError(f"{name} doesn't match")


def payload_length(record: Record) -> int:
    """Bytes of the full payload, also of a revisit's."""
    return int(re.search(rb"(?im)^content-length: *(\d+)\r?$", record.http)[1])


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The records' bytes of an archive, frame by frame, in bounded reads.

    Raises ValueError if the dictionary, a frame or the end of the file is damaged or cut short.
    """

    def exactly(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ValueError("the archive is cut short")
        return data

    magic, size = struct.unpack("<II", exactly(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary in the leading frame")
    raw = exactly(size)
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    left = b""
    while True:
        while len(left) < 4:
            more = stream.read(step)
            if not more:
                break
            left += more
        if not left:
            return
        if left[:4] != struct.pack("<I", FRAME_MAGIC):
            raise ValueError("not a frame")
        frame, out = decompressor.decompressobj(), []
        data = left
        while True:
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ValueError(f"damaged frame: {e}") from e
            if frame.eof:
                left = frame.unused_data
                break
            data = stream.read(step)
            if not data:
                raise ValueError("the last frame is cut short")
        yield b"".join(out)


def train_dictionary(pages: DataFrame, sample: int = 400, sample_bytes: int = 16384, size: int = 65536) -> bytes:
    """A compression dictionary from at most ``sample`` pages, of each its first ``sample_bytes`` bytes; b'' when
    they are too few to train one. It bears on the archives' size only, never on what is read back."""
    rows = pages.select(F.substring(F.col("html").cast("binary"), 1, sample_bytes).alias("h")).filter("length(h) > 200").limit(sample).collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r["h"]) for r in rows]).as_bytes() if len(rows) >= 50 else b""
    except zstandard.ZstdError:
        return b""


def first_copies(pages: DataFrame, least: int) -> DataFrame:
    """(digest, first): of payloads of at least ``least`` bytes on more than one page, the smallest page_id."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    meta = pages.select("page_id", F.sha2(html, 256).alias("digest")).filter(F.octet_length(html) >= least)
    meta = meta.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    return meta.filter("first <> last").select("digest", "first")


def write_archives(pages: DataFrame, least: int = 100, level: int = 3) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) and returns the archives: (path, n_records).

    Of equal payloads of at least ``least`` bytes the row with the smallest page_id is a response and the others
    are revisits of it; rows that repeat that page_id are responses too. A null html is an empty payload, a null
    url leaves the target out, a null page_id has the id ``none`` and is always a response. Each
    task writes the rows it reads, in one archive; payloads are shuffled only when the table of repeated
    payloads is too large to broadcast. An empty table gives no archive.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    firsts = materialise(first_copies(rows, least), "warc-firsts")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    marked = rows.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    marked = marked.join(bounded_broadcast(firsts, firsts.count(), 128), "digest", "left")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    marked = marked.select("page_id", "url", "html", refers.alias("refers_to"))
    folder, dictionary = scratch_path(spark, "warc"), train_dictionary(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_dict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=with_dict, write_content_size=True)
        context, out, n = None, None, 0
        for b in batches:
            for i in range(b.num_rows):
                if context is None:
                    context = new_file(folder, ".warc.zst")
                    path, out = context.__enter__()
                    out.write(dictionary_frame(dictionary))
                page_id, url, body, refers_to = (b.column(k)[i].as_py() for k in range(4))
                out.write(compressor.compress(render(page_id, url, body, refers_to)))
                n += 1
        if context:
            context.__exit__(None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "n_records"])

    return materialise(marked.mapInArrow(run, "path string, n_records long"), "warc-manifest")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null of revisits) of every
    record; fails on an archive that is damaged or has not the records it was written with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, rows, size = 0, [], 0
                with open_file(path) as f:
                    for raw in read_archive(f):
                        r = parse(raw)
                        n, size = n + 1, size + len(r.payload)
                        revisit = r.kind == "revisit"
                        digest = r.headers["warc-payload-digest"].removeprefix("sha256:")
                        refers = _page(r.headers["warc-refers-to"]) if revisit else None
                        rows.append((_page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), r.kind, refers, payload_length(r), digest, None if revisit else r.payload))
                        if size >= 1 << 22 or len(rows) >= 4096:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)
                if n != expected:
                    raise ValueError(f"{path} has {n} records, {expected} were written")

    spark = archives.sparkSession
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return archives.repartition(max(1, min(partitions(spark) * 4, 10_000)), "path").mapInArrow(run, schema)
