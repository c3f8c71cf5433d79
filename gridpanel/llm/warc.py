"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of which holds whole records, and
behind them a skippable frame with the sizes of all frames (the public seekable format), so a
reader finds the frame of an offset from the file's end, and any Zstandard tool reads the file.
The catalogue maps each record to its bundle, its frame and its offset in that frame.

Payloads are digested where they are (SHA-1 over all bytes). Digests that occur more than once,
of payloads of at least 1000 bytes, keep the largest page_id as the response; the others become
revisit records, which name the response and the payload's digest and length and hold no
payload. Only rows (digest, page_id) meet for that.

A task writes its bundle under a name of its own and returns the catalogue rows, which Spark
commits; what a lost or repeated task left is in no catalogue and is not read.

Defined results: a null html is an empty payload; a null url becomes a URN of the page; control
characters and other bytes in a url are percent-encoded; of equal payloads all rows that bear
the largest page_id are responses; a null page_id is kept as such and never is the response that
others refer to unless every page_id of the group is null (then all are responses).
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.scratch import materialise, new_path

LEAST_REVISIT = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "2026-01-01T00:00:00Z"


def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, refers_to) with refers_to for revisits only."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").select(
        "*", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )
    repeated = materialise(
        named.where(F.col("payload_bytes") >= LEAST_REVISIT)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "repeated",
    )
    return named.join(repeated, ["payload_digest", "payload_bytes"], "left").select(
        "page_id",
        "url",
        "html",
        "payload_digest",
        "payload_bytes",
        F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"),
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, html, digest, size, refers_to) -> bytes:
    """One WARC 1.1 record. The fields X-Page-ID and X-Payload-Bytes are extensions."""
    uri = urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=%-._~") if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (html or "").encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {size}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames of at least FRAME_BYTES and writes the seek table at the end."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.frames: list[tuple[int, int]] = []
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in the frame's content and length of the record."""
        place = len(self.frames), self.pending_bytes, len(data)
        self.pending.append(data)
        self.pending_bytes += len(data)
        if self.pending_bytes >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.pending:
            frame = self.compressor.compress(b"".join(self.pending))
            self.stream.write(frame)
            self.frames.append((len(frame), self.pending_bytes))
            self.written += len(frame)
            self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset in the file, compressed size, content size) of each frame of an open bundle."""
    file.seek(file.size() - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x7F:
        raise ValueError("not a seekable bundle")
    per = 12 if flags & 0x80 else 8
    file.seek(file.size() - 9 - count * per)
    raw = file.read(count * per)
    frames, at = [], 0
    for i in range(count):
        packed, content = struct.unpack_from("<II", raw, i * per)
        frames.append((at, packed, content))
        at += packed
    return frames


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields and block of the record at an offset of a frame's content, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(fields["Content-Length"])
    return fields, data[start:stop], stop + 4


_CATALOGUE = "bundle string, frame int, frame_offset int, length int, page_id bigint"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        names = ["bundle", "frame", "frame_offset", "length", "page_id"]
        writer, name, rows = None, None, []

        def finished() -> pa.RecordBatch:
            writer.close()
            columns = list(zip(*rows))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if writer is None:
                    name, rows = f"{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None))
                rows.append((name, *writer.add(record(*row)), row[0]))
                if writer.written >= BUNDLE_BYTES:
                    yield finished()
                    writer = None
        if writer is not None:
            yield finished()

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages into bundles below `folder`; the committed catalogue, one row per record."""
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return materialise(decisions(pages).mapInArrow(_write(folder), _CATALOGUE), "catalogue")


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, base = _open(folder)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, wanted in zip(*(column.to_pylist() for column in batch.columns)):
                with store.open_input_file(f"{base}/{name}") as file:
                    table = seek_table(file)
                    for number in sorted(wanted):
                        at, packed, content = table[number]
                        file.seek(at)
                        data = unpack.decompress(file.read(packed), max_output_size=content)
                        yield _rows(data)

    return run


def _rows(data: bytes) -> pa.RecordBatch:
    rows, at = [], 0
    while at < len(data):
        fields, block, at = parse(data, at)
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(fields["X-Payload-Bytes"])
        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        intact = kind == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
        rows.append(
            (
                None if page is None else int(page),
                size if kind == "revisit" else len(payload),
                digest if kind == "revisit" else hashlib.sha1(payload).hexdigest(),
                kind,
                None if refers is None else int(refers),
                intact,
            )
        )
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def read(catalogue: DataFrame, folder: str) -> DataFrame:
    """All records of the catalogue's bundles, read frame by frame through the seek tables.

    A bundle's frames are read in lots of 256, so a large bundle is shared among tasks.
    """
    frames = (
        catalogue.select("bundle", "frame")
        .distinct()
        .groupBy("bundle", F.floor(F.col("frame") / 256).alias("lot"))
        .agg(F.collect_set("frame").alias("frames"))
        .select("bundle", "frames")
    )
    return frames.mapInArrow(_read(folder), _READ)


def lookup(catalogue_row, folder: str) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record, from its catalogue row alone: one seek, one frame."""
    import zstandard

    store, base = _open(folder)
    with store.open_input_file(f"{base}/{catalogue_row['bundle']}") as file:
        at, packed, content = seek_table(file)[catalogue_row["frame"]]
        file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=content)
    return parse(data, catalogue_row["frame_offset"])[:2]


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and return what the records say."""
    folder = new_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
