"""Byte-level BPE through a lexicon transducer, and back.

The frequent words of the corpus are compiled, with their token ids, into a minimal acyclic
automaton (states with equal futures are one state).  The outputs on the arcs of a word's
path add up to its number, which indexes a table of id sequences: so suffixes stay shared
although every word has ids of its own.  The automaton is one flat file image; each Python
worker maps it into memory and walks it byte by byte.  Words it does not hold are merged
exactly, pair of lowest rank first.  The lexicon only saves time: its size is a parameter
and never changes a result.

Texts are cut where the pre-tokenizer always starts a new token: where white space begins,
and before the last character of longer white space.  So every text, however it is spaced,
goes through the automaton word by word, and equal words are encoded once per worker
generation.
"""

from __future__ import annotations

import base64
import hashlib
import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import Memo, batches, once, written

#: White space as the pre-tokenizer knows it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]+")
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: White space to some libraries only; a text that holds any is pre-tokenized whole.
_DISPUTED = re.compile("[\x1c-\x1f]")
#: From here on, the letters that the tokenizers library knows differ from those of ``regex``.
_UNSURE = re.compile("[^\x00-\u0557]")
_FLUSH = 200_000
_NEVER = 1 << 60


class Lexicon:
    """A minimal acyclic transducer in one block of bytes.

    Layout: a header of six counts, then first arc of each state, arc targets, arc outputs,
    first id of each word, ids (all 4 bytes), then final flags and arc labels (1 byte).
    """

    _HEADER = struct.Struct("<6I")

    def __init__(self, image):
        self.image = image
        states, arcs, words, ids, _, _ = self._HEADER.unpack_from(image, 0)
        at = self._HEADER.size

        def ints(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return memoryview(image)[at - 4 * n : at].cast("I")

        self.first, self.target, self.output = ints(states + 1), ints(arcs), ints(arcs)
        self.id_start, self.ids = ints(words + 1), ints(ids)
        self.final = memoryview(image)[at : at + states]
        self.labels = at + states
        self.states, self.words = states, words

    def find(self, word: bytes) -> bytes | None:
        """The ids of ``word`` as little-endian 4-byte integers, None if it isn't held."""
        state, number, find, first, labels = 0, 0, self.image.find, self.first, self.labels
        for i in range(len(word)):
            arc = find(word[i : i + 1], labels + first[state], labels + first[state + 1])
            if arc < 0:
                return None
            number += self.output[arc - labels]
            state = self.target[arc - labels]
        if not self.final[state]:
            return None
        return self.ids[self.id_start[number] : self.id_start[number + 1]].tobytes()

    @classmethod
    def compiled(cls, entries: dict[bytes, Iterable[int]]) -> bytes:
        """The image of ``entries``; built word by word in sorted order, so no more than the
        minimal automaton and one open path is ever held."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        reach: list[int] = []  # words from each state on
        path: list[list] = [[False, []]]  # open states: final, arcs

        def close(depth: int, word: bytes) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if (state := register.get(key)) is None:
                    state = register[key] = len(states)
                    states.append(key)
                    reach.append(final + sum(reach[t] for _, t in arcs))
                path[-1][1].append((word[len(path) - 1], state))

        before = b""
        ordered = sorted(entries)
        for word in ordered:
            same = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
            close(same, before)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            before = word
        close(0, before)
        root = (path[0][0], tuple(path[0][1]))

        order = [root, *reversed(states)]  # the root first
        place = {s: len(states) - s for s in range(len(states))}
        first, target, output, labels, final = [0], [], [], bytearray(), bytearray()
        for is_final, arcs in order:
            passed = int(is_final)
            for label, state in arcs:
                labels.append(label)
                target.append(place[state])
                output.append(passed)
                passed += reach[state]
            final.append(is_final)
            first.append(len(labels))
        ids = [list(entries[w]) for w in ordered]
        id_start = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        flat = [i for x in ids for i in x]
        head = cls._HEADER.pack(len(order), len(labels), len(ordered), len(flat), 0, 0)
        parts = [np.asarray(x, dtype="<u4").tobytes() for x in (first, target, output, id_start, flat)]
        return b"".join([head, *parts, bytes(final), bytes(labels)])

    @classmethod
    def mapped(cls, image: bytes) -> "Lexicon":
        """The image from an unnamed file, so that the system pages it as it pages a library."""
        with tempfile.TemporaryFile() as file:
            file.write(image)
            file.flush()
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


class ByteBpe:
    """Encoding and decoding with a byte-level BPE vocabulary file of the tokenizers library.

    Words that the lexicon does not hold are merged exactly, pair of lowest rank first: by
    tiktoken if the vocabulary is also there as ranks, else (and for letters that libraries
    may class differently) by the merges here, on the tokenizers library's pre-tokens.
    """

    def __init__(self, file: str, lexicon: Lexicon | None = None, rank_file: str | None = None):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["model"]["ignore_merges"]:
            raise ValueError("only vocabularies without normaliser and with all merges are supported")
        self._pre = Tokenizer.from_file(file).pre_tokenizer
        vocabulary = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.vocabulary = vocabulary
        #: neighbours inside some token; no merge reaches across any other two
        self.joins = {pair for token in vocabulary for pair in zip(token, token[1:])}
        self.atoms = set(_alphabet())
        self._shown = dict(enumerate(_alphabet()))
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take neighbours along are not supported")
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.byte_of = {c: b for b, c in enumerate(_alphabet())}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in [*vocabulary.items(), *self.special.items()]:
            self.pieces[i] = bytes(self.byte_of[c] for c in token) if all(c in self.byte_of for c in token) else token.encode()
        self.lexicon, self.ranked = lexicon, None
        if rank_file is not None:
            import tiktoken

            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding(
                rank_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
        self._words = Memo(self._word, 600_000)
        self._others = Memo(self._exact, 50_000)
        self._tokens = Memo(self._token, 300_000)
        self._segments = Memo(self._segment, 200_000)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 4-byte integers."""
        if not text:
            return b""
        if self._cut and any(s in text for s in self.special):
            parts = self._cut.split(text)
            return b"".join(
                struct.pack("<I", self.special[p]) if p in self.special else self._plain(p) for p in parts if p
            )
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")

    def _plain(self, text: str) -> bytes:
        if _DISPUTED.search(text):
            return self._exact(text)
        if not uneven(text):
            first, *rest = words_of(text)
            return b"".join([self._others[first], *map(self._words.__getitem__, rest)])
        words, others = self._words, self._others
        return b"".join([words[key] if key is not None else others[unit] for unit, key in units_of(text)])

    def _word(self, word: str) -> bytes:
        text = word if word[:1] == "\n" else " " + word
        if self.lexicon is not None and (found := self.lexicon.find(text.encode())) is not None:
            return found
        return self._exact(text)

    def _exact(self, text: str) -> bytes:
        """Pre-tokens and merges without the lexicon."""
        if self.ranked is None or _UNSURE.search(text):
            return self._run(text)
        return np.array(self.ranked.encode_ordinary(text), dtype="<u4").tobytes()

    def _run(self, text: str) -> bytes:
        return b"".join(map(self._tokens.__getitem__, self.pre_tokens(text)))

    def pre_tokens(self, text: str) -> list[str]:
        if _UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self._pre.pre_tokenize_str(text)]
        return self._pattern.findall(text)

    def _token(self, token: str) -> bytes:
        return np.array(self.merged(token.encode()), dtype="<u4").tobytes()

    def merged(self, raw: bytes) -> list[int]:
        """The ids of one pre-token: lowest rank merged first, then leftmost."""
        word = raw.decode("latin-1").translate(self._shown)
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.joins]
        if not cuts:
            return self._segments[word]
        return [t for a, b in zip([0, *cuts], [*cuts, len(word)]) for t in self._segments[word[a:b]]]

    def _segment(self, word: str) -> list[int]:
        if word in self.atoms:
            return [self.vocabulary[word]]
        symbols = self._few(list(word)) if len(word) <= 40 else self._many(list(word))
        return [self.vocabulary[s] for s in symbols]

    def _few(self, symbols: list[str]) -> list[str]:
        """Short words: look at all pairs for every merge."""
        rank = self.ranks.get
        while len(symbols) > 1:
            found = [rank(p, _NEVER) for p in zip(symbols, symbols[1:])]
            if (best := min(found)) == _NEVER:
                break
            i = found.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _many(self, symbols: list[str]) -> list[str]:
        """Long words: a linked list of symbols and a heap of pairs."""
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(p)) is not None]
        heapify(heap)
        while heap:
            _, i, (a, b) = heappop(heap)
            j = after[i]
            if symbols[i] != a or j == n or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(p := (symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i, p))
            h = before[i]
            if h >= 0 and (r := ranks.get(p := (symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h, p))
        return [s for s in symbols if s]


def uneven(text: str) -> bool:
    """Whether there is white space other than single blanks and line ends between words.
    Plain substring tests cost a tenth of one regular expression."""
    return (
        text[0] in " \n" or text[-1] in " \n" or any(c in text for c in ("\t", "\r", "\x0b", "\x0c", "  ", "\n\n", " \n", "\n "))
        or not text.isascii() and bool(_ODD_SPACE.search(text))
    )


def units_of(text: str) -> Iterator[tuple[str, str | None]]:
    """The units of any text, each beginning where a pre-token begins: words with the white
    space before them, longer white space but for its last character, white space at the end.
    Beside each its key among the words (as in ``words_of``), None if it is none."""
    at = 0
    for run in _RUN.finditer(text):
        start, end = run.span()
        if start > at:
            yield text[at:start], _key(text[at:start])
        if end == len(text):
            yield text[start:], None
            return
        if end - start > 1:
            yield text[start : end - 1], None
        at = end - 1
    if at < len(text):
        yield text[at:], _key(text[at:])


def _key(unit: str) -> str | None:
    return unit[1:] if unit[0] == " " else unit if unit[0] == "\n" else None


def words_of(text: str) -> list[str]:
    """The words of an even text: each but the first begins where a pre-token begins, at a
    blank that is left out or at a line end that is kept."""
    return text.replace("\n", " \n").split(" ")


def _alphabet() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def word_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, words as in ``words_of``; counted in the tasks first."""

    def work(it: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()
        for batch in it:
            for text in batch.column(0).to_pylist():
                if text:
                    words = words_of(text)[1:] if not uneven(text) else (k for _, k in units_of(text) if k)
                    counts.update(w for w in words if len(w) <= 64)
                if len(counts) >= _FLUSH:
                    yield {"word": list(counts), "n": list(counts.values())}
                    counts.clear()
        yield {"word": list(counts), "n": list(counts.values())}

    return batches(docs.select(text_col), "word string, n long", work).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(
    docs: DataFrame, *, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken", words: int = 200_000,
) -> bytes:
    """The automaton image of the most frequent words, at most ``words`` of them.

    The counts are over all texts.  How many words have which count gives the least count
    whose words still fit; all words with that count or more are taken, so no task sorts
    words and only this bounded list reaches the driver.  Words of more than 64 characters
    are never listed.
    """
    counts = written(word_counts(docs, text_col=text_col).where("word != ''"), "word-counts")
    classes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("n")).limit(words).collect()
    least, room = None, words
    for r in classes:
        if (room := room - r["size"]) < 0:
            break
        least = r["n"]
    top = counts.where(F.col("n") >= least).select("word").toArrow()["word"].to_pylist() if least else []
    bpe = ByteBpe(public_tokenizers.path(vocabulary), rank_file=ranks and public_tokenizers.path(ranks))
    texts = [w if w[0] == "\n" else " " + w for w in top]
    return Lexicon.compiled({t.encode(): np.frombuffer(bpe.encode(t), "<u4").tolist() for t in texts})


def encoded(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", words: int = 200_000,
) -> DataFrame:
    """Per row: ``id_col``, ids (array of long), decoded (string).

    A null text counts as empty: no ids, empty decoded text.  Null ids stay null, repeated
    rows give repeated results, an empty table none.  Only the two columns are read.
    """

    def columns(ids: list[bytes], bpe: ByteBpe) -> dict:
        return {"ids": [np.frombuffer(x, "<u4").tolist() for x in ids], "decoded": list(map(bpe.decode, ids))}

    return _through(docs, id_col, text_col, vocabulary, ranks, words, "ids array<long>, decoded string", columns)


def encoding_digests(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", words: int = 200_000,
) -> DataFrame:
    """As ``encoded``, but n_tokens and the SHA-256 of the ids (little-endian unsigned 4-byte
    integers) and of the decoded text instead of both."""

    def columns(ids: list[bytes], bpe: ByteBpe) -> dict:
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
        }

    return _through(docs, id_col, text_col, vocabulary, ranks, words, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _through(docs, id_col, text_col, vocabulary, ranks, words, schema, columns) -> DataFrame:
    image = build_lexicon(docs, text_col=text_col, vocabulary=vocabulary, ranks=ranks, words=words)
    key = hashlib.sha256(image).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(image)  # bounded by ``words``

    def work(it: Iterator[pa.RecordBatch]):
        bpe = once(
            ("byte_bpe", vocabulary, ranks, key),
            lambda: ByteBpe(
                public_tokenizers.path(vocabulary), Lexicon.mapped(shared.value), ranks and public_tokenizers.path(ranks)
            ),
        )
        for batch in it:
            yield {id_col: batch.column(0)} | columns(list(map(bpe.encode, batch.column(1).to_pylist())), bpe)

    return batches(docs.select(id_col, text_col), f"{id_col} {dict(docs.dtypes)[id_col]}, {schema}", work)
