"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without blanks at both ends and with A-Z in lower case.  Keys are
held as 128-bit hashes.  The distinct hashes are dealt to shards; each shard is a minimal
perfect hash (levels of bit arrays, about three bits a key) that numbers its keys from 0,
and three arrays in that order: fingerprints, counts and the smallest document.  Documents
are read in blocks; a block sends each of its distinct hashes once, packed by shard, and
probes the arrays there.  No line is joined with another, and a line that a third of all
documents hold costs one probe per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import BLANKS, arrow_schema, batches, record_batch, require_free, written

_NO_ID = (1 << 63) - 1
_KEYS_A_BLOCK = 100_000
_KEYS_A_SHARD = 200_000
_LEAST_SHARDS = 16


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    """One 16-byte hash per line, None for keys of fewer than ``least`` code points."""
    raw = (text or "").encode()
    # 65-90 only: bytes.lower() leaves everything beyond ASCII alone
    keys = [line.strip(BLANKS) for line in raw.lower().split(b"\n")]
    return [
        xxhash.xxh3_128_digest(k) if len(k) >= least and (len(k) >= 4 * least or len(k.decode()) >= least) else None
        for k in keys
    ]


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 * np.uint64(2 * level + 0x9E3779B97F4A7C15) + (h2 ^ np.uint64(level * 0xD1342543DE82EF95 & (1 << 64) - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Numbers n distinct 128-bit keys from 0 to n-1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits) - bits

    @classmethod
    def built(cls, h1: np.ndarray, h2: np.ndarray) -> "PerfectHash":
        sizes, parts, level = [], [], 0
        while len(h1):
            size = 2 * len(h1) + 1
            at = _mixed(h1, h2, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            parts.append(alone)
            sizes.append(size)
            rest = ~alone[at]
            h1, h2, level = h1[rest], h2[rest], level + 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, dtype=bool))

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for keys it was not built from."""
        out, left, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], raw: bytes) -> "PerfectHash":
        return cls(sizes, np.unpackbits(np.frombuffer(raw, np.uint8), count=sum(sizes)).astype(bool))


def _halves(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _joined(h1: np.ndarray, h2: np.ndarray) -> bytes:
    return np.stack([h1, h2], axis=1).astype("<u8").tobytes()


def line_blocks(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """One row per block of documents: their ids, marks (hashes of the texts), distinct keys
    per document, and the keys."""

    def work(it: Iterator[pa.RecordBatch]):
        block, ids, marks, sizes, keys = TaskContext.get().partitionId() << 32, [], [], [], []
        for batch in it:
            for doc, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
                own = {k for k in line_keys(text, least) if k}
                ids.append(_NO_ID if doc is None else doc)
                marks.append(mark)
                sizes.append(len(own))
                keys.extend(own)
                if len(keys) >= _KEYS_A_BLOCK:
                    yield {"block": [block], "ids": [ids], "marks": [marks], "sizes": [sizes], "keys": [b"".join(keys)]}
                    block, ids, marks, sizes, keys = block + 1, [], [], [], []
        if ids:
            yield {"block": [block], "ids": [ids], "marks": [marks], "sizes": [sizes], "keys": [b"".join(keys)]}

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    return batches(source, "block long, ids array<long>, marks array<long>, sizes array<int>, keys binary", work)


def _distinct(ids: list[int], sizes: list[int], raw: bytes):
    """The distinct keys of a block with their smallest and largest document and row count."""
    h1, h2 = _halves(raw)
    doc = np.repeat(np.array(ids, dtype=np.int64), sizes)
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc = h1[order], h2[order], doc[order]
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h1)) - 1 if len(first) else first
    return h1[first], h2[first], doc[first], doc[last], last - first + 1


def _rows(it: Iterator[pa.RecordBatch]):
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def line_index(blocks: DataFrame) -> DataFrame:
    """The shards: perfect hash, fingerprints (4 bytes), counts (4 bytes, saturating) and
    smallest documents (8 bytes) of all distinct keys of ``line_blocks``."""
    total = blocks.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 16
    shards = max(_LEAST_SHARDS, math.ceil(total / _KEYS_A_SHARD))

    def keys(it: Iterator[pa.RecordBatch]):
        for _, ids, _, sizes, raw in _rows(it):
            h1, h2, low, _, n = _distinct(ids, sizes, raw)
            if len(h1):
                yield {
                    "shard": pa.array((h1 % np.uint64(shards)).astype(np.int64)), "h1": pa.array(h1.view(np.int64)),
                    "h2": pa.array(h2.view(np.int64)), "low": pa.array(low), "n": pa.array(n.astype(np.int64)),
                }

    distinct = (
        batches(blocks, "shard long, h1 long, h2 long, low long, n long", keys)
        .groupBy("shard", "h1", "h2").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    )
    schema = "shard long, shards long, sizes array<int>, bits binary, fingerprints binary, counts binary, lows binary"
    arrow = arrow_schema(schema)

    def build(group: pa.Table) -> pa.Table:
        h1 = group["h1"].to_numpy().astype(np.int64).view(np.uint64)
        h2 = group["h2"].to_numpy().astype(np.int64).view(np.uint64)
        hashed = PerfectHash.built(h1, h2)
        at = hashed.numbers(h1, h2)
        marks, counts, lows = np.empty(len(h1), "<u4"), np.empty(len(h1), "<u4"), np.empty(len(h1), "<i8")
        marks[at] = h2 & np.uint64(0xFFFFFFFF)
        counts[at] = np.minimum(group["n"].to_numpy(), 0xFFFFFFFF)
        lows[at] = group["low"].to_numpy()
        row = {
            "shard": [group["shard"][0].as_py()], "shards": [shards], "sizes": [hashed.sizes], "bits": [hashed.packed()],
            "fingerprints": [marks.tobytes()], "counts": [counts.tobytes()], "lows": [lows.tobytes()],
        }
        return pa.Table.from_batches([record_batch(row, arrow)])

    return distinct.groupBy("shard").applyInArrow(build, schema)


def probed(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(id, mark, key): the keys that each text loses, because a smaller document holds them.

    Rows of one id share the decision on a key, but a text is told only of its own keys.
    """
    shards = (index.agg(F.max("shards")).first()[0]) or _LEAST_SHARDS
    ask = arrow_schema("shard long, block long, keys binary, highs binary")

    def questions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, _, sizes, raw in _rows(it):
            h1, h2, _, high, _ = _distinct(ids, sizes, raw)
            shard = h1 % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.diff(shard[order])) + 1
            parts = [p for p in np.split(order, cut) if len(p)]
            yield record_batch({
                "shard": [int(shard[p[0]]) for p in parts], "block": [block] * len(parts),
                "keys": [_joined(h1[p], h2[p]) for p in parts], "highs": [high[p].astype("<i8").tobytes() for p in parts],
            }, ask)

    asked = blocks.mapInArrow(questions, "shard long, block long, keys binary, highs binary")
    told = arrow_schema("block long, keys binary, lows binary")

    def answer(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "keys": [], "lows": []}
        if index.num_rows and asked.num_rows:
            part = index.to_pylist()[0]
            hashed = PerfectHash.unpacked(part["sizes"], part["bits"])
            marks, lows = np.frombuffer(part["fingerprints"], "<u4"), np.frombuffer(part["lows"], "<i8")
            counts = np.frombuffer(part["counts"], "<u4")
            for block, raw, highs in zip(*(asked[c].to_pylist() for c in ("block", "keys", "highs"))):
                h1, h2 = _halves(raw)
                at = hashed.numbers(h1, h2)
                held = (at >= 0) & (marks[at] == (h2 & np.uint64(0xFFFFFFFF)))
                shared = held & (counts[at] > 1) & (lows[at] < np.frombuffer(highs, "<i8"))
                if shared.any():
                    out["block"].append(block)
                    out["keys"].append(_joined(h1[shared], h2[shared]))
                    out["lows"].append(lows[at[shared]].tobytes())
        return pa.Table.from_batches([record_batch(out, told)])

    answers = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, "block long, keys binary, lows binary")
    lost = arrow_schema("id long, mark long, key binary")

    def decide(block: pa.Table, answers: pa.Table) -> pa.Table:
        first = {
            raw[i : i + 16]: low
            for raw, lows in zip(answers["keys"].to_pylist(), answers["lows"].to_pylist())
            for i, low in zip(range(0, len(raw), 16), np.frombuffer(lows, "<i8").tolist())
        }
        out: dict[str, list] = {"id": [], "mark": [], "key": []}
        for row in block.to_pylist() if first else []:
            at, raw = 0, row["keys"]
            for doc, mark, n in zip(row["ids"], row["marks"], row["sizes"]):
                for i in range(at, at + 16 * n, 16):
                    if first.get(raw[i : i + 16], doc) < doc:
                        out["id"].append(doc)
                        out["mark"].append(mark)
                        out["key"].append(raw[i : i + 16])
                at += 16 * n
        return pa.Table.from_batches([record_batch(out, lost)])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(decide, "id long, mark long, key binary")


def without_repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, and two counts.

    Keys of at least ``least`` code points that two documents hold stay in the smallest of
    them (all their lines there) and go from the others.  All columns of ``docs`` stay; the
    counts of lines before and of dropped lines get the names given (other columns may not
    have them).  A null or empty text is one empty line and comes back as an empty text.
    Rows of equal ids are one document; rows without an id are one document after all
    others; the lost keys are gathered per id and text, never over all rows of an id.  An
    empty table gives an empty result.
    """
    require_free(docs, n_lines, n_dropped)
    blocks = written(line_blocks(docs, id_col, text_col, least), "line-blocks")
    index = written(line_index(blocks), "line-index")
    lost = probed(blocks, index).groupBy("id", "mark").agg(F.collect_set("key").alias("lost"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    lost = lost.select(F.col("id").alias("lost_id"), F.col("mark").alias("lost_mark"), "lost")
    plain = docs.toDF(*names).withColumns({
        "own_id": F.coalesce(F.col(names[docs.columns.index(id_col)]).cast("long"), F.lit(_NO_ID)),
        "own_mark": F.xxhash64(names[docs.columns.index(text_col)]),
    })
    joined = plain.join(lost, (F.col("own_id") == F.col("lost_id")) & (F.col("own_mark") == F.col("lost_mark")), "left").select(*names, "lost")
    kinds = dict(docs.dtypes) | {text_col: "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns) + f", `{n_lines}` long, `{n_dropped}` long"
    arrow, text_at = arrow_schema(schema), docs.columns.index(text_col)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist()):
                text = text or ""
                n = lost_here = 0
                if gone:
                    gone, split = set(gone), text.split("\n")
                    kept = [x for x, key in zip(split, line_keys(text, least)) if key not in gone]
                    n, lost_here, text = len(split), len(split) - len(kept), "\n".join(kept)
                texts.append(text)
                lines.append(n or text.count("\n") + 1)
                dropped.append(lost_here)
            columns = {c: batch.column(i) for i, c in enumerate(docs_columns)}
            yield record_batch(columns | {text_col: texts, n_lines: lines, n_dropped: dropped}, arrow)

    docs_columns = docs.columns
    return joined.mapInArrow(work, schema)
