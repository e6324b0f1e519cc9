"""WARC archives with records compressed one by one under a Zstandard dictionary built from them."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.llm.common import BROADCAST_KEYS, attach, keep

#: The skippable frame that holds a dictionary (fixed value of the format).
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive ends at about this many bytes of records; its dictionary, and the sample that trains it.
ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES = 8 << 20, 16 << 10, 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, uri: str, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """A response record, or a revisit record, whose block keeps the HTTP head but not the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records spread over the archive, up to SAMPLE_BYTES; raw content where there are too few to train."""
    step, sample, size = max(1, sum(map(len, records)) // SAMPLE_BYTES), [], 0
    for r in records[::step]:
        sample.append(r[: 64 << 10])
        size += len(sample[-1])
    try:
        if len(sample) < 16 or size < 8 * DICT_BYTES:
            raise zstandard.ZstdError("too little to train on")
        return zstandard.train_dictionary(DICT_BYTES, sample, k=256, d=8, f=18, accel=8, split_point=1.0)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes], level: int = 3) -> tuple[bytes, list[int]]:
    """(archive, place of each record's frame): the dictionary in a leading skippable frame, then a frame a record."""
    words = dictionary(records)
    raw = words.as_bytes()
    compressor = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True)
    parts, at, places = [struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw], 8 + len(raw), []
    for r in records:
        parts.append(compressor.compress(r))
        places.append(at)
        at += len(parts[-1])
    return b"".join(parts), places


def _decompressor(archive: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME:
        return zstandard.ZstdDecompressor(), 0
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size])), 8 + size


def read_record(archive: bytes, place: int) -> bytes:
    """One record by the place of its frame."""
    return _decompressor(archive)[0].decompressobj().decompress(archive[place:])


def read_archive(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record."""
    opened, at = _decompressor(archive)
    with opened.stream_reader(memoryview(archive)[at:], read_across_frames=True) as reader:
        data = reader.read()
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to names the smallest page_id with an equal payload of at least least_bytes, where it is another.

    Pages stay where they are: only digests that occur more than once are looked up, in a
    broadcast of up to BROADCAST_KEYS of them. Beyond that, pages of frequent digests still stay,
    and the others meet theirs in a shuffle. A null html is an empty payload. Pages without an id
    refer to the smallest id of their payload, and are never referred to; rows that are equal,
    or share an id, each keep a record, and those of the smallest id are all responses.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    first = own.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("sha", "s")
    first = keep(first, "digests")
    met = own.join(F.broadcast(first), F.col("sha") == F.col("s"), "left") if first.count() <= BROADCAST_KEYS else attach(own, first, {"sha": "s"}, how="left")
    refers = F.when((F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return met.select("page_id", "url", "html", refers.alias("refers_to"))


def archives(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, places): pages as archives of about ARCHIVE_BYTES of records each, one binary a row, so that Spark stores them wherever the table goes.

    A task holds one archive at a time; a page larger than that is an archive of its own. A null
    url is replaced by the record's name, a null html by nothing. An empty table gives no archive;
    other columns, whatever their names, are not read. For null and repeated ids see planned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            data, places = write_archive(records)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([places], pa.list_(pa.int64()))], names=["archive", "places"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                name, to = f"urn:page:{page.as_py()}", refers.as_py()
                uri = (url.as_py() or name).replace("\r", "%0D").replace("\n", "%0A")
                records.append(record("response" if to is None else "revisit", name, uri, html.as_py().encode(), date, f"urn:page:{to}"))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    return planned(pages, least_bytes).mapInArrow(run, "archive binary, places array<long>")


def records(archive_table: DataFrame) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to, payload) read from archives; a revisit has no payload.

    A row for each record, page_id null where the page had none. A record whose bytes are not
    those of its digest is an error. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None or x.endswith(":None>") else int(x.strip("<>").rpartition(":")[2])
        for batch in batches:
            for value in batch.column(0):
                rows: list[tuple] = []
                for head, block in read_archive(value.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    whole = head["WARC-Type"] == "response"
                    if whole and (len(payload) != size or f"sha1:{digest(payload)}" != head["WARC-Payload-Digest"]):
                        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                    rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number(head.get("WARC-Refers-To")), payload if whole else None))
                for i in range(0, len(rows), 512):
                    cols = list(zip(*rows[i : i + 512], strict=True))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return archive_table.select("archive").mapInArrow(run, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
