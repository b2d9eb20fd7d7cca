"""WARC archives compressed with a Zstandard dictionary.

The dictionary is built from a bounded sample of the records that are archived. Each archive begins with a skippable
frame that holds it; every record follows as a frame of its own, so a reader can start at any record.

Of records with equal payloads only one is stored with its payload, as a response; the others are revisit records that
refer to it. Archives are closed at a size, written under a name of their own attempt and renamed when they are whole,
so a task that is run again leaves no half archive among the ones its row names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, HOT_ROWS, left_join_unique, materialize

SKIPPABLE = 0x184D2A5D
LEVEL = 6
DICTIONARY_BYTES = 65_536
#: The dictionary is built from so many records and bytes of whole payloads at most.
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 16_384_000
ARCHIVE_BYTES = 64 << 20
#: Fixed, so that the same records give the same archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """A URL on one line of ASCII: controls, spaces and other characters as percent escapes."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the digest and length of the full payload in its headers, and no payload."""
    block = _HTTP + (b"" if is_revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_uri(url)}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of too few or too uniform records, their own bytes as a plain one."""
    try:
        return zstandard.train_dictionary(size, records, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(records)[-size:] or b"WARC/1.1\r\n"


class ArchiveWriter:
    """Writes records to one archive in memory: the dictionary in a skippable frame, then a frame for each."""

    def __init__(self, dictionary: bytes):
        loaded = zstandard.ZstdCompressionDict(dictionary)
        loaded.precompute_compress(level=LEVEL)
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded)
        self._head = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
        self.reset()

    def reset(self) -> None:
        self.out, self.records = io.BytesIO(), 0
        self.out.write(self._head)

    def add(self, data: bytes) -> None:
        self.out.write(self._zstd.compress(data))
        self.records += 1


def read_records(archive: io.BufferedIOBase, read_size: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, one frame at a time; memory holds one record and one piece of the file."""
    magic, size = struct.unpack("<II", archive.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame leads the archive")
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive.read(size)))
    left = b""
    while left or (left := archive.read(read_size)):
        frame, parts = zstd.decompressobj(), []
        while not frame.eof:
            if not left and not (left := archive.read(read_size)):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the HTTP payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its header")
    return headers, block.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame, min_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds sha1 (hex) of the payload and refers_to: the largest page_id with that payload, null for that page itself
    and for payloads of fewer than min_bytes bytes. Only payloads that repeat are joined, up to a checked size by
    broadcast; beyond it that holds for the hot ones, as the empty payload, and pages with others are shuffled."""
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", "html", F.sha1(data).alias("sha1"), (F.octet_length(data) >= min_bytes).alias("_large"))
    repeated = hashed.where("_large").groupBy("sha1").agg(F.max("page_id").alias("_of"), F.count("*").alias("_n")).where("_n > 1").select("sha1", "_of")
    joined = left_join_unique(hashed, materialize(repeated, "payloads"), "sha1", broadcast_rows, hot_rows)
    refers = F.when(F.col("_large") & ~F.col("page_id").eqNullSafe(F.col("_of")), F.col("_of"))
    return joined.select("page_id", "url", "html", "sha1", refers.alias("refers_to"))


def _sample(pages: DataFrame, records: int = SAMPLE_RECORDS, size: int = SAMPLE_BYTES) -> list[bytes]:
    """Whole payloads in the order of a hash, equal ones together, as long as they are within both bounds; only one that
    is larger than all of them may be, or of more equal ones than that, is passed over."""
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    hashed = pages.select(F.xxhash64("page_id", data).alias("h"), F.octet_length(data).alias("n"), data.alias("data"))
    fits = hashed.where(F.col("n") <= size)
    # First the hash up to which they are within the bounds, from the sizes alone; then those payloads.
    total, last, groups = 0, None, groupby(fits.select("h", "n").orderBy("h", "n").limit(records + 1).collect(), lambda r: r["h"])
    count = 0
    for h, same in groups:
        sizes = [r["n"] for r in same]
        count, total = count + len(sizes), total + sum(sizes)
        if count > records or total > size:
            break
        last = h
    if last is None:
        return []
    return [bytes(r["data"]) for r in fits.where(F.col("h") <= last).orderBy("h", "n").limit(records).collect()]


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) to `.warc.zst` archives in the folder path; returns the
    manifest (path, records, bytes), a row per archive, already written.

    path is a URI that driver and executors reach by pyarrow's file systems (file, hdfs, s3, gs). A null html is an
    empty payload, a null url leaves out the target header; a null page_id is written as None and is smallest. Rows
    that repeat a page_id and payload are each a response if they hold the largest id, else each a revisit. Other
    columns are left out. No rows give no archive. The dictionary is built from at most SAMPLE_RECORDS records with whole
    payloads of SAMPLE_BYTES bytes together, in the order of a hash of id and payload; all pages are archived.
    """
    marked = with_revisits(pages, min_bytes, broadcast_rows)
    sample = _sample(pages)
    dictionary = build_dictionary([record(k, "", x, payload_digest(x), None, False) for k, x in enumerate(sample)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(path)
        writer, closed = ArchiveWriter(dictionary), []

        def close() -> None:
            name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{name}.open", compression=None) as f:
                f.write(writer.out.getbuffer())
            store.move(f"{name}.open", name)
            closed.append((name, writer.records, writer.out.tell()))
            writer.reset()

        for f in frames:
            for page_id, url, html, refers_to in zip(f["page_id"], f["url"], f["html"], f["refers_to"], strict=True):
                ids = [None if pd.isna(x) else int(x) for x in (page_id, refers_to)]
                payload = (html or "").encode()
                writer.add(record(ids[0], url, payload, payload_digest(payload), ids[1], ids[1] is not None))
                if writer.out.tell() >= archive_bytes:
                    close()
        if writer.records:
            close()
        yield pd.DataFrame(closed, columns=["path", "records", "bytes"])

    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]  # whole as strings, where nulls make floats
    return materialize(marked.select(ids[0], "url", "html", ids[1]).mapInPandas(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record of the archives.

    A response's length and digest are computed from its payload, which must agree with its header; a revisit's are
    those that its headers give for the full payload.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(path)
        number = lambda urn: None if urn.endswith(":None>") else int(urn[len("<urn:x-page:") : -1])
        for f in frames:
            for name in f["path"]:
                rows = []
                with store.open_input_file(name) as archive:
                    for data in read_records(archive):
                        h, payload = parse_record(data)
                        digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                        if h["warc-type"] == "response" and (payload_digest(payload), len(payload)) != (digest, size):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), size, digest, h["warc-type"], number(h["warc-refers-to"]) if "warc-refers-to" in h else None))
                        if len(rows) == 10_000:
                            yield _typed(rows)
                            rows = []
                yield _typed(rows)

    parts = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return manifest.select("path").repartition(int(parts), "path").mapInPandas(run, schema)


def _typed(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return f.astype({"page_id": "Int64", "refers_to": "Int64"})
