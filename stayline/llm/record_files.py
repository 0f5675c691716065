"""Token ids in length-delimited binary record files, with an offset index beside each file.

A record file is a row of frames: the payload's length (8 bytes), its masked CRC-32C, the
payload, the payload's masked CRC-32C; all integers little-endian.  This is the framing that
TFRecord readers take.  A payload is a head of 12 bytes (id width, whether there is a
document id, two spare bytes, the document id) and the ids in 2 or 4 bytes each.  The index
file holds offset and payload length of every frame (16 bytes a frame) and ends with its own
masked CRC-32C, so a reader can fetch any record without passing the ones before it.

Files are numbered in ascending order of document ids: rows are dealt to files by ranges of
(document id, text hash), so one id that many rows share still spreads over files.  A task
writes under a name of its own and renames, so a repeated task replaces its own file.

CRC-32C is linear: a block's value follows from those of its two halves.  Whole batches are
reduced that way, halves against halves, with table look-ups on arrays.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stayline.llm.common import batches, once, scratch_path, written
from stayline.llm.packing import TextIds

#: Fixed values of the framing and of CRC-32C.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
_FRAME = struct.Struct("<QI")
_AROUND = _FRAME.size + 4  # bytes of a frame besides its payload
_HEAD = struct.Struct("<BBxxq")
_ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8")])
_BLOCK = 64
_ZEROS = bytes(_BLOCK)
_CHUNK = 4 << 20
_FILE_BYTES = 256 << 20


class RecordError(ValueError):
    """A record file or index that breaks the format."""


def _tables() -> list[np.ndarray]:
    """For 1, 2, 4, ... words: what each byte of a register becomes after that many words of
    zeros (four tables of 256 values)."""
    one = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ POLYNOMIAL, one >> 1)
    one = one.astype(np.uint32)
    unit = [np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]
    for _ in range(4):
        unit = [(x >> np.uint32(8)) ^ one[x & np.uint32(255)] for x in unit]
    out = [np.stack(unit)]
    while len(out) < 40:
        last = out[-1]
        out.append(np.stack([_moved(last, part) for part in last]))
    return out


def _moved(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 4)
    return table[0][raw[:, 0]] ^ table[1][raw[:, 1]] ^ table[2][raw[:, 2]] ^ table[3][raw[:, 3]]


_AFTER = _tables()


def masked_crc32c(messages: list[bytes]) -> np.ndarray:
    """The masked CRC-32C of every message, unsigned 32-bit."""
    sizes = np.array([len(m) for m in messages], dtype=np.int64)
    if not len(sizes):
        return np.zeros(0, dtype=np.uint32)
    room = -(-np.maximum(sizes, 4) // _BLOCK) * _BLOCK
    ends = np.cumsum(room)
    starts = ends - sizes
    # zeros in front of a message change nothing once the first register is folded into it
    padded = (part for m, n in zip(messages, (room - sizes).tolist()) for part in (_ZEROS[:n], m))
    raw = np.frombuffer(bytearray().join(padded), dtype=np.uint8)
    short = sizes < 4
    for i in range(4):
        raw[starts[~short] + i] ^= 0xFF
    value = raw.view("<u4")
    level = 0
    while level < _BLOCK.bit_length() - 3:
        value = _moved(_AFTER[level], value[0::2]) ^ value[1::2]
        level += 1
    counts = room // _BLOCK
    while counts.max() > 1:
        wide = counts + (counts & 1)
        spread = np.zeros(int(wide.sum()), dtype=np.uint32)
        shift = np.cumsum(wide) - np.cumsum(counts)  # a message stays at the right of its room
        spread[np.arange(len(value)) + np.repeat(shift, counts)] = value
        value = _moved(_AFTER[level], spread[0::2]) ^ spread[1::2]
        counts, level = wide // 2, level + 1
    crc = _moved(_AFTER[0], value) ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(short):
        crc[i] = _few_bytes(messages[i])
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def _few_bytes(message: bytes) -> int:
    register = 0xFFFFFFFF
    for byte in message:
        register ^= byte
        for _ in range(8):
            register = register >> 1 ^ POLYNOMIAL * (register & 1)
    return register ^ 0xFFFFFFFF


def framed(payloads: list[bytes]) -> list[bytes]:
    """Each payload in its frame."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked_crc32c(lengths).tolist(), masked_crc32c(payloads).tolist()
    return [b"".join((n, struct.pack("<I", a), p, struct.pack("<I", b))) for n, a, p, b in zip(lengths, heads, payloads, tails)]


def checked(frames: list[tuple[int, int, bytes, int]]) -> list[bytes]:
    """The payloads of (length, length checksum, payload, payload checksum); stops on a wrong one."""
    heads = masked_crc32c([struct.pack("<Q", n) for n, _, _, _ in frames])
    tails = masked_crc32c([p for _, _, p, _ in frames])
    for (n, head, payload, tail), want_head, want_tail in zip(frames, heads.tolist(), tails.tolist()):
        if head != want_head or tail != want_tail or n != len(payload):
            raise RecordError("a frame's checksum or length is wrong")
    return [p for _, _, p, _ in frames]


def payload_of(doc: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(width, doc is not None, doc or 0) + ids.astype(f"<u{width}").tobytes()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids (unsigned 4-byte) of a payload."""
    if len(payload) < _HEAD.size:
        raise RecordError("a payload is shorter than its head")
    width, known, doc = _HEAD.unpack_from(payload)
    if width not in (2, 4) or (len(payload) - _HEAD.size) % width:
        raise RecordError("a payload's ids are cut off")
    return (doc if known else None), np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype("<u4")


def _chunks(items: Iterable, size_of) -> Iterator[list]:
    held, size = [], 0
    for item in items:
        held.append(item)
        size += size_of(item)
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def write_records(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken", end_id: int = 2, folder: str | None = None, file_bytes: int = _FILE_BYTES,
) -> DataFrame:
    """Write the ids of every text, closed by ``end_id``, and return the manifest, a row per
    file: file (number, ascending with the document ids), records, index (addresses),
    n_records, n_ids.

    ``id_col`` holds integers.  A null text counts as empty: ``end_id`` alone.  Rows without
    an id come last; rows of equal ids stand in the order of their texts' hashes, and repeated
    rows give repeated records.  An empty table writes no file.  Other columns are not read.
    Files hold about ``file_bytes`` of text, fewer if the session's number of shuffle
    partitions asks for more files; they are even in rows, not in bytes.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    address = folder if ":/" in folder else f"file://{folder}"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")

    def work(it: Iterator[pa.RecordBatch]):
        encoder = once(
            ("text_ids", vocabulary, ranks),
            lambda: TextIds(public_tokenizers.path(vocabulary), ranks and public_tokenizers.path(ranks)),
        )
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        n_ids = [0]

        def payloads():
            for batch in it:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.append(encoder.encode(text), np.uint32(end_id))
                    n_ids[0] += len(ids)
                    yield payload_of(doc, ids, width)

        chunks = _chunks(payloads(), len)
        if (first := next(chunks, None)) is None:
            return
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(address)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}"
        mine, lengths = f"{base}/{name}.{task.taskAttemptId()}", []
        with store.open_output_stream(f"{mine}.records", compression=None) as out:
            chunk: list | None = first
            while chunk:
                lengths.extend(map(len, chunk))
                for frame in framed(chunk):
                    out.write(frame)
                chunk = next(chunks, None)
        with store.open_output_stream(f"{mine}.index", compression=None) as out:
            out.write(index_bytes(lengths))
        for kind in ("records", "index"):
            store.move(f"{mine}.{kind}", f"{base}/{name}.{kind}")
        yield {
            "file": [task.partitionId()], "records": [f"{address}/{name}.records"], "index": [f"{address}/{name}.index"],
            "n_records": [len(lengths)], "n_ids": [n_ids[0]],
        }

    return written(batches(dealt, "file long, records string, index string, n_records long, n_ids long", work), "manifest")


def index_bytes(lengths: list[int]) -> bytes:
    entries = np.zeros(len(lengths), dtype=_ENTRY)
    entries["length"] = lengths
    sizes = entries["length"] + np.uint64(_AROUND)
    entries["offset"] = np.cumsum(sizes) - sizes
    raw = entries.tobytes()
    return raw + masked_crc32c([raw]).astype("<u4").tobytes()


def read_index(address: str) -> np.ndarray:
    """Offset and payload length of every frame, in file order."""
    store, path = fs.FileSystem.from_uri(address)
    with store.open_input_stream(path, compression=None) as stream:
        raw = stream.read()
    if len(raw) % _ENTRY.itemsize != 4 or masked_crc32c([raw[:-4]]).astype("<u4").tobytes() != raw[-4:]:
        raise RecordError(f"{address}: the index is cut off or its checksum is wrong")
    return np.frombuffer(raw[:-4], dtype=_ENTRY)


def _frame_parts(raw: bytes, offset: int) -> tuple[int, int, bytes, int]:
    if len(raw) < _AROUND:
        raise RecordError(f"no whole frame at {offset}")
    return *_FRAME.unpack_from(raw), raw[_FRAME.size : -4], struct.unpack("<I", raw[-4:])[0]


def _in_order(address: str, index: np.ndarray) -> Iterator[tuple[int, int, bytes, int]]:
    """The frames of a whole file, which must end with the last one."""
    store, path = fs.FileSystem.from_uri(address)
    at = 0
    with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
        for offset, length in index.tolist():
            if offset != at:
                raise RecordError(f"{address}: the index has a gap at {offset}")
            at += length + _AROUND
            yield _frame_parts(stream.read(length + _AROUND), offset)
        if stream.read(1):
            raise RecordError(f"{address} is longer than its index says")


def read_records(manifest: DataFrame, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every record of the manifest's files, checked: ``id_col``, start (ids of all records
    before it, over all files), n_tokens, ids_crc32 (of the ids as unsigned 4-byte integers)
    and, if asked for, ids.

    Stops on a frame, index or count that is wrong.  A file's records are read in one task;
    where each file starts is a running total over one row per file.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def work(it: Iterator[pa.RecordBatch]):
        for batch in it:
            for row in batch.to_pylist():
                index, start, seen = read_index(row["index"]), row["start"], 0
                for frames in _chunks(_in_order(row["records"], index), lambda f: f[0]):
                    out: dict[str, list] = {k: [] for k in (id_col, "start", "n_tokens", "ids_crc32", "ids")}
                    for payload in checked(frames):
                        doc, ids = parsed(payload)
                        values = (doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None)
                        for column, value in zip(out.values(), values):
                            column.append(value)
                        start, seen = start + len(ids), seen + 1
                    if not with_ids:
                        del out["ids"]
                    yield out
                if seen != row["n_records"] or start - row["start"] != row["n_ids"]:
                    raise RecordError(f"{row['records']} has {seen} records, {row['n_records']} were written")

    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    spread = files.repartition(max(1, manifest.count()))
    return batches(spread.select("records", "index", "n_records", "n_ids", "start"), schema, work)


def shuffled_records(manifest: DataFrame, *, seed: int = 0, id_col: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """All records once, in an order that depends on ``seed`` alone: task, place (inside the
    task), ``id_col``, ids.

    Only the indexes are shuffled: a task gets the offsets of its records in hash order and
    fetches each from its file.  ``tasks`` is the number of readers (default: as many as the
    session's shuffle partitions).
    """
    readers = tasks or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def entries(it: Iterator[pa.RecordBatch]):
        for batch in it:
            for row in batch.to_pylist():
                index = read_index(row["index"])
                for a in range(0, len(index), 10_000):
                    part = index[a : a + 10_000]
                    yield {
                        "records": [row["records"]] * len(part), "file": [row["file"]] * len(part), "number": list(range(a, a + len(part))),
                        "offset": part["offset"].tolist(), "length": part["length"].tolist(),
                    }

    listed = batches(
        manifest.repartition(max(1, manifest.count())).select("file", "records", "index"),
        "records string, file long, number long, offset long, length long", entries,
    )
    draw = F.xxhash64(F.lit(seed), "file", "number")
    dealt = listed.repartition(readers, draw).sortWithinPartitions(draw, "file", "number")

    def fetch(it: Iterator[pa.RecordBatch]):
        task, place, opened = TaskContext.get().partitionId(), 0, {}
        for batch in it:
            frames, out = [], {"task": [], "place": [], id_col: [], "ids": []}
            for address, offset, length in zip(*(batch.column(c).to_pylist() for c in ("records", "offset", "length"))):
                if address not in opened:
                    if len(opened) >= 64:  # a reader keeps few files open
                        opened.pop(next(iter(opened))).close()
                    store, path = fs.FileSystem.from_uri(address)
                    opened[address] = store.open_input_file(path)
                file = opened[address]
                file.seek(offset)
                frames.append(_frame_parts(file.read(length + _AROUND), offset))
            for payload in checked(frames):
                doc, ids = parsed(payload)
                for column, value in zip(out.values(), (task, place, doc, ids.tolist())):
                    column.append(value)
                place += 1
            yield out

    return batches(dealt, f"task long, place long, {id_col} long, ids array<long>", fetch)
