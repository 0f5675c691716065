"""Web archives with one Zstandard frame per record and a shared dictionary.

Writing: every task writes its pages into archives of bounded size.  The dictionary of an
archive is trained on its first records and stands in a leading skippable frame.  Pages with
equal payloads are found by digest first, on narrow rows; all but the one with the smallest
page id become revisit records.

Reading: the dictionary is loaded from the leading skippable frame, each frame is decoded on
its own and must hold exactly one record whose version line, header fields, lengths and
digests are right.  Archives are streamed, never held whole.

Archives lie in the shared folder (any address that pyarrow's file systems open); a task
writes under a name of its own and renames, so a repeated task replaces its own archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import arrow_schema, batches, record_batch, scratch_path, written

#: Fixed values of the archive formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ARCHIVE_BYTES = 32 << 20
_SAMPLE_BYTES = 1 << 20
_DICTIONARY_BYTES = 32 << 10
_NAMESPACE = uuid.UUID("5e4c6f0a-0a3c-5d4e-9a55-3f0d5a7d1c11")


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


@dataclass(frozen=True)
class Page:
    """One record, written or read back."""

    page_id: int | None
    url: str | None
    payload: bytes | None  # None for a revisit that was read
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str, copy: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{payload_digest}/{copy}')}>"


def record_bytes(page: Page, date: str, copy: int | str = 0) -> bytes:
    """A whole record: header, block and the two closing line ends.

    ``copy`` tells records of one page and payload apart; a revisit refers to copy 0.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page.payload_bytes}\r\n\r\n"
    revisit = page.record_type == "revisit"
    block = http.encode() + (b"" if revisit else page.payload)
    head = [
        VERSION,
        f"WARC-Type: {page.record_type}",
        f"WARC-Record-ID: {_record_id(page.page_id, page.payload_digest, copy)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{page.payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if page.url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', page.url)}")
    if page.page_id is not None:
        head.append(f"X-Page-ID: {page.page_id}")
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {_record_id(page.refers_to, page.payload_digest, 0)}", f"X-Refers-To-Page: {page.refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(raw: bytes) -> Page:
    """The page of one record's bytes; ArchiveError if a header, length or digest is wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "strict").split("\r\n")
    if not mark or first != VERSION:
        raise ArchiveError(f"no {VERSION} header")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in fields:
            raise ArchiveError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ArchiveError(f"{name} is missing")
    if not fields["content-length"].isdigit():
        raise ArchiveError("Content-Length is no number")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("the block is not as long as Content-Length says")
    if fields.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ArchiveError("the block digest differs")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"^Content-Length: (\d+)$", http.replace(b"\r\n", b"\n"), re.M)
    if not mark or not http.startswith(b"HTTP/1.1 ") or not length:
        raise ArchiveError("the block is no HTTP response")
    kind, said = fields["warc-type"], fields["warc-payload-digest"]
    if kind not in ("response", "revisit") or not said.startswith("sha1:"):
        raise ArchiveError(f"record type {kind} or its payload digest is not supported")
    refers = None
    if kind == "revisit":
        if payload or fields.get("warc-profile") != SAME_PAYLOAD or "x-refers-to-page" not in fields:
            raise ArchiveError("a revisit record with a payload or without its target")
        refers = int(fields["x-refers-to-page"])
    elif len(payload) != int(length[1]) or said != f"sha1:{digest(payload)}":
        raise ArchiveError("the payload's length or digest differs")
    page_id = fields.get("x-page-id")
    return Page(
        int(page_id) if page_id is not None else None, fields.get("warc-target-uri"),
        None if kind == "revisit" else payload, int(length[1]), said[5:], kind, refers,
    )


def archive_frames(records: Iterable[bytes], level: int = 3) -> Iterator[bytes]:
    """The frames of one archive: the dictionary, then one frame per record."""
    it, samples, size = iter(records), [], 0
    for record in it:
        samples.append(record)
        size += len(record)
        if size >= _SAMPLE_BYTES:
            break
    if not samples:
        return
    parts = [s[i : i + 4096] for s in samples for i in range(0, len(s), 4096)]
    try:
        trained = zstandard.train_dictionary(min(_DICTIONARY_BYTES, max(256, size // 8)), parts).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples to train on
        trained = b"".join(samples)[:_DICTIONARY_BYTES]
    yield struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
    coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    yield from map(coder.compress, samples)
    yield from map(coder.compress, it)


def archive_records(stream) -> Iterator[bytes]:
    """The records of an archive, one frame each, from a binary stream."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise ArchiveError("no dictionary frame at the start")
    size = struct.unpack("<I", head[4:])[0]
    raw = stream.read(size)
    if len(raw) != size:
        raise ArchiveError("the dictionary frame is cut off")
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be a frame
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = b""
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            return
        frame, out = decoder.decompressobj(), []
        while rest:
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(1 << 20)
            if frame.eof:
                break
        if not frame.eof:
            raise ArchiveError("the last frame is cut off")
        yield b"".join(out)


def first_of_equal_payloads(pages: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """(digest, first) of payloads that several ids have; null ids never count."""
    return (
        pages.where(F.col(id_col).isNotNull()).groupBy(digest_col)
        .agg(F.min(id_col).alias("first"), F.max(id_col).alias("last"))
        .where("first < last").select(digest_col, "first")
    )


def write_archives(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", folder: str | None = None,
) -> DataFrame:
    """Write ``pages`` and return the manifest: archive (address), n_records.

    The payload is the html in UTF-8, null being empty.  Of records with equal payloads of
    at least ``least_bytes`` bytes the one with the smallest id is a response and the others
    are revisits; equal ids with equal payloads are alike.  A row without an id is always a
    response and never referred to.  An empty table writes no archive.
    """
    folder = folder or scratch_path(pages.sparkSession, "archives")
    address = folder if ":/" in folder else f"file://{folder}"
    plain = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")
    )
    narrow = plain.where(F.octet_length("html") >= least_bytes).select("id", F.sha1(F.encode("html", "UTF-8")).alias("sha"))
    revisits = (
        narrow.join(first_of_equal_payloads(narrow, "id", "sha"), "sha").where("id > first")
        .select(F.col("id").cast("string").alias("again"), F.col("sha").alias("again_sha"), "first").distinct()
    )
    # ids are as good as unique, so the wide rows have no hot key; records of one id and payload
    # meet in one task, which numbers them, and rows without an id go anywhere.  The join has
    # the same keys, so it does not move the rows again
    place = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id()))
    wide = plain.withColumns({"place": place, "sha": F.sha1(F.encode("html", "UTF-8"))}).repartition("place", "sha")
    rows = wide.join(revisits, (wide.place == revisits.again) & (wide.sha == revisits.again_sha), "left").select("id", "url", "html", "first")

    def work(it: Iterator[pa.RecordBatch]):
        task, counter, copies = TaskContext.get(), [0], {}

        def records():
            for batch in it:
                for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = html.encode()
                    page = Page(page_id, url, payload, len(payload), digest(payload), "response" if first is None else "revisit", first)
                    counter[0] += 1
                    if page_id is None:
                        copy = f"{task.partitionId()}-{counter[0]}"
                    else:
                        key = page_id, page.payload_digest
                        copy = copies[key] = copies.get(key, -1) + 1
                    yield record_bytes(page, date, copy)

        store, base = fs.FileSystem.from_uri(address)
        store.create_dir(base, recursive=True)
        stream, number = records(), 0
        for first in stream:
            name = f"{base}/part-{task.partitionId():05d}-{number:04d}.warc.zst"
            mine, written_bytes, before = f"{name}.{task.taskAttemptId()}", 0, counter[0] - 1
            with store.open_output_stream(mine, compression=None) as out:
                for frame in archive_frames(_until(first, stream, lambda: written_bytes >= _ARCHIVE_BYTES)):
                    out.write(frame)
                    written_bytes += len(frame)
            store.move(mine, name)
            number += 1
            yield {"archive": [f"{address}/{name.rsplit('/', 1)[1]}"], "n_records": [counter[0] - before]}

    return written(batches(rows, "archive string, n_records long", work), "manifest")


def _until(first, rest: Iterator, full) -> Iterator:
    """``first`` and then ``rest`` until ``full()``; what isn't taken stays in ``rest``."""
    yield first
    while not full():
        try:
            yield next(rest)
        except StopIteration:
            return


def read_archives(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, if asked for, payload (null for revisits).

    Stops on an archive that breaks the format or holds another number of records.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" * with_payload
    names = [f.name for f in arrow_schema(schema)]

    def work(it: Iterator[pa.RecordBatch]):
        for batch in it:
            for address, expected in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = fs.FileSystem.from_uri(address)
                n, pages = 0, []
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in archive_records(stream):
                        pages.append(parsed_record(raw))
                        n += 1
                        if len(pages) == 500:
                            yield {c: [getattr(p, c) for p in pages] for c in names}
                            pages = []
                if n != expected:
                    raise ArchiveError(f"{address} has {n} records, {expected} were written")
                yield {c: [getattr(p, c) for p in pages] for c in names}

    archives = manifest.select("archive", "n_records")
    tasks = max(1, archives.count())
    return batches(archives.repartition(tasks, "archive"), schema, work)
