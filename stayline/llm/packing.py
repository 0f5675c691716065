"""Packing documents into token sequences of a fixed length: bounded-space online best-fit.

Tokenising and packing are two steps.  ``token_pieces`` cuts every document into pieces of
at most one sequence.  ``packed`` deals the pieces (a few numbers each) by a hash to tasks;
each task is one online packer with a fixed number of open bins.  A bitset keyed by free
space finds the open bin that a piece fills best; when a piece fits nowhere and all bins
are open, the fullest is closed.  Tasks hold about ``per_task`` pieces at every input size,
so what their last open bins leave unused stays the same small share.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import arrow_schema, batches, once, record_batch, require_free, written

#: The two libraries are known to agree on these characters; texts with others take the slower one.
_COMMON = re.compile("[^\x00-\uffff]")


class TextIds:
    """Ids of whole texts as the tokenizers library gives them for a byte-level vocabulary.

    The same vocabulary as ranks goes several times faster through tiktoken.  A text that
    holds a special token's string, or a character beyond the common ones (where the two
    might know other letters), goes through the tokenizers library itself.
    """

    def __init__(self, file: str, rank_file: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = None
        if rank_file is not None:
            import tiktoken

            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding(
                rank_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if self.ranked is None or any(s in text for s in self.special) or _COMMON.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.ranked.encode_ordinary(text), dtype="<u4")


def token_pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken", length: int = 2048, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is the ids of its whole text (null: none) and then ``end_id``.  One longer
    than ``length`` is cut into pieces of that length, the first taking what is left over.
    ``ranks`` names the same vocabulary as a rank file, if there is one.
    Null ids stay null, repeated rows give repeated pieces, an empty table none.
    """

    def work(it: Iterator[pa.RecordBatch]):
        encoder = once(
            ("text_ids", vocabulary, ranks),
            lambda: TextIds(public_tokenizers.path(vocabulary), ranks and public_tokenizers.path(ranks)),
        )
        for batch in it:
            out: dict[str, list] = {k: [] for k in (id_col, "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder.encode(text), np.uint32(end_id))
                n = len(ids)
                first = n % length or length
                cuts = [0, *range(min(first, n), n + 1, length)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[a:b]
                    values = (doc, piece, a, b - a, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None)
                    for k, v in zip(out, values):
                        out[k].append(v)
            if not with_ids:
                del out["ids"]
            yield out

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long"
    return batches(docs.select(id_col, text_col), schema + ", ids array<long>" * with_ids, work)


class OpenBins:
    """A fixed number of open bins; bit f of ``free`` is set while some bin has f left."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.made, self.free = size, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        if not 0 < length <= self.size:
            raise ValueError(f"a piece of {length} does not fit into {self.size}")
        above = self.free >> length
        if above:
            left = length + (above & -above).bit_length() - 1  # the fullest that has room
            bin_ = self._take(left)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.open -= 1
            bin_, left = self.made, self.size
            self.made += 1
            self.open += 1
        if rest := left - length:
            self.by_free[rest].append(bin_)
            self.free |= 1 << rest
        else:
            self.open -= 1
        return bin_, self.size - left

    def _take(self, left: int) -> int:
        bins = self.by_free[left]
        bin_ = bins.pop()
        if not bins:
            self.free ^= 1 << left
        return bin_


def packed(
    pieces: DataFrame, *, length_col: str = "length", size: int = 2048, open_bins: int = 1024, per_task: int = 100_000
) -> DataFrame:
    """``pieces`` with sequence_id and offset: pieces of one sequence_id stand gaplessly
    from 0 and add up to at most ``size``.

    Pieces may repeat; each row is placed on its own.  Rows reach a task in hash order, so
    a repeated task packs them the same way.  An empty table gives an empty result; columns
    of the two new names must not exist.
    """
    require_free(pieces, "sequence_id", "offset")
    tasks = max(1, math.ceil(pieces.count() / per_task))
    spread = F.xxhash64(*pieces.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    at = pieces.columns.index(length_col)
    arrow = arrow_schema(schema)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in it:
            placed = [bins.place(n) for n in batch.column(at).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns |= {"sequence_id": [base + b for b, _ in placed], "offset": [o for _, o in placed]}
            yield record_batch(columns, arrow)

    dealt = pieces.repartition(tasks, spread).sortWithinPartitions(spread, *pieces.columns)
    return dealt.mapInArrow(work, schema)


def packed_documents(docs: DataFrame, *, size: int = 2048, **kinds) -> DataFrame:
    """``token_pieces`` and then ``packed``."""
    return packed(written(token_pieces(docs, length=size, **kinds), "pieces"), size=size)
