"""Token counts of a sentence-piece BPE vocabulary without making identifiers.

Heap and linked list: the symbols of a text form a linked list, a heap holds every adjacent
pair that is a piece, the pair of the lowest rank (then leftmost) is merged until none is
left.  The count is the initial symbols minus the merges, plus the extra bytes of symbols
that the vocabulary does not hold (byte fallback).

Two exact cuts keep the heaps short.  A merge can never cross two neighbouring characters
that stand next to each other in no piece, so the text is cut there; and as no piece has a
word mark after another character, words can be counted one by one and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stayline.llm.common import Memo, batches, once

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


class PieceCounter:
    """Counts as the library's ``encode`` gives them, for models with identity
    normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        if any(model.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces re-split tokens; they are not supported")
        if model.encode("ﬁ  x", out_type=str)[:1] != [MARK] or not model.encode("", out_type=str) == []:
            raise ValueError("the model normalises its input")
        self.ranks = {
            model.id_to_piece(i): -model.get_score(i)
            for i in ids
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        }
        self.joins = {(a, b) for p in self.ranks for a, b in zip(p, p[1:])}
        self.by_word = not any(b == MARK and a != MARK for a, b in self.joins)
        self._segments = Memo(self._merged)
        self._words = Memo(self._word, 600_000)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; none for a missing or empty one."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if not self.by_word:
            return self._word(marked)
        if MARK * 2 not in marked and not marked.startswith(MARK):
            return sum(map(self._words.__getitem__, marked.split(MARK)))
        return sum(self._words[w[1:]] for w in _WORDS.findall(MARK + marked))

    def _word(self, word: str) -> int:
        """Tokens of one word with its mark, cut where no piece can reach across."""
        word = MARK + word
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.joins]
        if not cuts:
            return self._merged(word)
        return sum(self._segments[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)]))

    def _merged(self, text: str) -> int:
        symbols = list(text)
        n, ranks, merges = len(symbols), self.ranks, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left, j = symbols[i], after[i]
            if not left or j == n or len(left) + len(symbols[j]) != size:
                continue  # one of the two was merged meanwhile
            merges += 1
            symbols[i], symbols[j] = left + symbols[j], ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(symbols[i] + symbols[k])) is not None:
                    heappush(heap, (r, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0 and (r := ranks.get(symbols[h] + symbols[i])) is not None:
                heappush(heap, (r, h, len(symbols[h]) + size))
        return n - merges + sum(len(s.encode()) - 1 for s in symbols if len(s) == 1 and s not in ranks)


def token_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str = "piece_bpe_32k.model", limit: int = 4096,
) -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty: 0 bytes, 0 tokens.  A null id stays null.  Repeated rows
    give repeated results, an empty table none.  Only the two named columns are read, so
    other columns cannot clash.  Long texts are counted whole.
    """

    def work(it: Iterator[pa.RecordBatch]):
        counter = once(("pieces", vocabulary), lambda: PieceCounter(public_tokenizers.path(vocabulary)))
        for batch in it:
            tokens = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield {
                id_col: batch.column(0),
                "n_bytes": pc.fill_null(pc.binary_length(batch.column(1)), 0).cast("int64"),
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"
    return batches(docs.select(id_col, text_col), schema, work)
