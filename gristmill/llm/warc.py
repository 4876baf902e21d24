"""WARC archives in Zstandard: one frame per record, a dictionary in front.

An archive starts with a skippable frame that holds the dictionary; each
record follows as a frame of its own, so any record can be decoded alone.
Equal payloads are stored once: the response with the smallest page_id holds
it, the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import store

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed once it holds this many bytes.
ARCHIVE_BYTES = 16 << 20
#: A dictionary of this size is trained on the first so many payload bytes of an archive.
DICTIONARY_BYTES, TRAINING_BYTES = 16 << 10, 512 << 10
LEVEL = 3


class BadArchive(ValueError):
    """An archive that does not hold what its headers say."""


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response, or a revisit of page ``first`` (its block has no payload)."""
    name = b"" if page_id is None else b"%d" % page_id
    target = " ".join((url or "").split()).encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = first is not None and first != page_id
    lines = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%s>" % name,
             b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + target, b"Content-Type: application/http; msgtype=response",
             b"WARC-Payload-Digest: sha1:" + digest(payload).encode()]
    if revisit:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%d>" % first]
    else:
        block += payload
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def _fields(head: bytes, where: str) -> dict[bytes, bytes]:
    found = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadArchive(f"{where}: header line without a colon")
        found[name.strip().lower()] = value.strip()
    return found


def _page(value: bytes | None, where: str) -> int | None:
    if value is None or not value.startswith(b"<urn:page:") or not value.endswith(b">"):
        raise BadArchive(f"{where}: no page in the record id")
    return int(value[10:-1]) if len(value) > 11 else None


def read_record(record: bytes, where: str = "record") -> dict:
    """The checked parts of one record; raises BadArchive where it contradicts itself."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap or not head.startswith(VERSION + b"\r\n"):
        raise BadArchive(f"{where}: no WARC/1.1 header")
    fields = _fields(head, where)
    kind = fields.get(b"warc-type")
    if kind not in (b"response", b"revisit"):
        raise BadArchive(f"{where}: record type {kind!r}")
    if not fields.get(b"content-length", b"").isdigit() or len(rest) != int(fields[b"content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"{where}: length of the block")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = _fields(http, where).get(b"content-length", b"")
    if not gap or not http.startswith(b"HTTP/1.1 ") or not length.isdigit():
        raise BadArchive(f"{where}: HTTP header")
    named = fields.get(b"warc-payload-digest", b"")
    if not named.startswith(b"sha1:"):
        raise BadArchive(f"{where}: no payload digest")
    if kind == b"response" and (len(payload) != int(length) or digest(payload).encode() != named[5:]):
        raise BadArchive(f"{where}: payload differs from its length or digest")
    if kind == b"revisit" and (payload or b"warc-refers-to" not in fields or fields.get(b"warc-profile") != PROFILE):
        raise BadArchive(f"{where}: revisit with a payload or without a target")
    return {
        "page_id": _page(fields.get(b"warc-record-id"), where), "payload_bytes": int(length), "payload_digest": named[5:].decode(),
        "record_type": kind.decode(), "refers_to": _page(fields[b"warc-refers-to"], where) if kind == b"revisit" else None,
        "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "surrogatepass"), "payload": payload,
    }


def train(payloads: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from sample payloads; too few to train on serve as raw content."""
    joined = b"".join(payloads)
    if len(payloads) >= 16 and len(joined) >= 4 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, payloads)
        except zstandard.ZstdError:  # samples too alike to learn from
            pass
    return zstandard.ZstdCompressionDict(joined[:DICTIONARY_BYTES] or b"<html>\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    """The leading skippable frame."""
    data = dictionary.as_bytes()
    return struct.pack("<II", DICTIONARY_FRAME, len(data)) + data


def unpack(data: memoryview, where: str) -> tuple[zstandard.ZstdCompressionDict, int]:
    """The dictionary of the leading frame and where the records start."""
    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != DICTIONARY_FRAME:
        raise BadArchive(f"{where}: no dictionary frame")
    size = struct.unpack("<I", data[4:8])[0]
    if len(data) < 8 + size:
        raise BadArchive(f"{where}: dictionary frame cut off")
    found = bytes(data[8:8 + size])
    if found[:4] == FRAME:  # the dictionary may itself be compressed
        found = zstandard.ZstdDecompressor().decompress(found)
    kind = zstandard.DICT_TYPE_FULLDICT if found[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(found, dict_type=kind), 8 + size


def frame_end(data: memoryview, start: int, where: str) -> int:
    """The end of the frame at ``start``, found from its block headers."""
    if bytes(data[start:start + 4]) != FRAME:
        raise BadArchive(f"{where}: no frame at byte {start}")
    at = start + zstandard.frame_header_size(data[start:start + 18])
    while True:
        head = bytes(data[at:at + 3])
        if len(head) < 3:
            raise BadArchive(f"{where}: frame at byte {start} cut off")
        value = int.from_bytes(head, "little")
        at += 3 + (1 if value >> 1 & 3 == 1 else value >> 3)
        if value & 1:
            break
    at += 4 if zstandard.get_frame_parameters(data[start:start + 18]).has_checksum else 0
    if at > len(data):
        raise BadArchive(f"{where}: frame at byte {start} cut off")
    return at


def read_archive(data: bytes, where: str = "archive") -> Iterator[dict]:
    """Every record of an archive in order, one frame decoded at a time."""
    view = memoryview(data)
    dictionary, at = unpack(view, where)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        end = frame_end(view, at, where)
        try:
            record = decoder.decompress(view[at:end])
        except zstandard.ZstdError as error:
            raise BadArchive(f"{where}: frame at byte {at}: {error}") from error
        yield read_record(record, f"{where}, byte {at}")
        at = end


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages' archives under ``folder``; their names and record counts.

    ``folder`` is a URI that all executors see. An archive gets its name when
    it is complete, by a rename, so a task that runs again replaces its own
    archives and leaves no half-written one under a final name.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
                        F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha"))
    # copies are counted by digest; only classes of several pages come back
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = rows.join(firsts.select("sha", "first"), "sha", "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        part, count = TaskContext.get().partitionId(), 0
        waiting: list[tuple] = []
        out = None

        def close() -> pa.RecordBatch:
            nonlocal out, count
            stream, temporary, records, _, _ = out
            stream.close()
            name = f"part-{part:05d}-{count:05d}.warc.zst"
            place.move(temporary, f"{root}/{name}")
            count, out = count + 1, None
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["archive", "records"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out
            for row in waiting:
                if out is None:
                    dictionary = train([r[2] for r in waiting])
                    temporary = f"{root}/.part-{part:05d}-{uuid.uuid4().hex}.tmp"
                    front = pack(dictionary)
                    stream = place.open_output_stream(temporary)
                    stream.write(front)
                    out = [stream, temporary, 0, len(front), zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)]
                frame = out[4].compress(make_record(*row))
                out[0].write(frame)
                out[2], out[3] = out[2] + 1, out[3] + len(frame)
                if out[3] >= ARCHIVE_BYTES:
                    yield close()
            waiting.clear()

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))):
                waiting.append(row)
                size += len(row[2])
                if size >= TRAINING_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()
        if out is not None:
            yield close()

    return store.stash(marked.mapInArrow(run, "archive string, records long"), "warc-manifest")


_COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the named archives, one row each, with their payloads.

    ``payload`` of a revisit is empty: it is that of the page it refers to.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                with place.open_input_file(f"{root}/{name}") as stream:
                    data = stream.read()
                rows, size, found = [], 0, 0
                for record in read_archive(data, name):
                    rows.append(record)
                    found, size = found + 1, size + len(record["payload"])
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if found != expected:
                    raise BadArchive(f"{name}: {found} records of {expected}")
                yield _batch(rows)

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return archives.select("archive", "records").repartition("archive").mapInArrow(run, kinds)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = (*_COLUMNS, "url", "payload")
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds)], names=list(names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back.

    A null html is an empty payload, a null url an empty target, a null page_id
    stays null. Rows that repeat the response's page_id are responses too. An
    empty table writes no archive. Other columns are not read.
    """
    store.bound_batches(pages.sparkSession)
    folder = store.new_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
