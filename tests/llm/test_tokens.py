import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm_cases import EDGES, by_row, edge_docs

from stayline.llm import byte_bpe, packing, piece_counts


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def noise(seed, parts, times):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.choice((1, 5, 40)))) for _ in range(times)]


def test_piece_counter_equals_the_library(piece):
    counter = piece_counts.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    parts = [" ", "  ", "▁", "\n", "\t", "the", "ing", "a", ".", ",", "é", "ß", "中", "\x00", "😀", "<s>", "</s>", "12", "ﬁ", "࡟"]
    for text in noise(3, parts, 1500):
        assert counter.count(text) == len(piece.encode(text)), text


def test_byte_bpe_equals_the_library(byte):
    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    words = {w.encode(): bpe.merged(w.encode()) for w in (" the", " there", " thing", "ing", " sing", " a")}
    lexicon = byte_bpe.Lexicon.mapped(byte_bpe.Lexicon.compiled(words))
    held = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), lexicon)
    ranked = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), lexicon, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text_ids = packing.TextIds(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    parts = ["'s", "'ll", " ", "  ", "\n", "\t", "a", "The", " the", " thing", "é", "中文", "\x00", "😀", "<|endoftext|>",
             "<|endof", "1", "42", "՘", "࡟", "\x1c", "\x85", "\xa0", " ", "!", ".,", "_"]
    for text in noise(4, parts, 3000):
        ids = byte.encode(text, add_special_tokens=False).ids
        assert text_ids.encode(text).tolist() == ids, text
        for tried in (bpe, held, ranked):
            got = tried.encode(text)
            assert np.frombuffer(got, "<u4").tolist() == ids, text
            assert tried.decode(got) == byte.decode(ids, skip_special_tokens=False), text


def test_every_spacing_goes_through_the_words():
    for text in ("a  b", "\n\na b\r\n c", " a", "a ", "a\t\tb\u3000c", "  ", "a \n b"):
        units = list(byte_bpe.units_of(text))
        assert "".join(u for u, _ in units) == text
        assert all(k is None or ("" if k[0] == "\n" else " ") + k == u for u, k in units)
    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []
    bpe.lexicon = type("Asked", (), {"find": lambda self, w: asked.append(w)})()
    bpe.encode("one  two\r\nthree\n\nfour five\t six ")
    assert asked == [b" two", b"\nthree", b"\nfour", b" five", b" six"]


def test_lexicon_is_minimal_and_exact():
    words = {b"tops": [1, 2], b"top": [3], b"stops": [4], b"stop": [5, 6, 7], b"t": [8], b"zz": []}
    lexicon = byte_bpe.Lexicon.mapped(byte_bpe.Lexicon.compiled(words))
    for word, ids in words.items():
        assert np.frombuffer(lexicon.find(word), "<u4").tolist() == ids
    assert [lexicon.find(w) for w in (b"", b"to", b"stopss", b"x")] == [None] * 4
    # "top(s)" and "stop(s)" share their ends: root, t, to, top, s, st, sto, z and one last
    futures = {w[i:]: {x[i:] for x in words if x.startswith(w[:i])} for w in words for i in range(len(w) + 1)}
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    states = {frozenset(x[len(p):] for x in words if x.startswith(p)) for p in prefixes}
    assert lexicon.states == len(states) and futures
    assert byte_bpe.Lexicon(byte_bpe.Lexicon.compiled({})).find(b"a") is None


def test_token_counts(session, documents, piece):
    for docs, rows in ((documents, documents.collect()), (edge_docs(session), EDGES)):
        got = piece_counts.token_counts(docs, limit=100)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        texts = [(r[0], r[1] or "") for r in rows]
        want = {(i, len(t.encode()), n := len(piece.encode(t)), n > 100) for i, t in texts}
        assert set(by_row(got, *got.columns)) == want and got.count() == len(rows)
    assert piece_counts.token_counts(documents.limit(0)).count() == 0


def test_encoding_digests(session, documents, byte):
    for docs, rows in ((documents, documents.collect()), (edge_docs(session), EDGES)):
        got = byte_bpe.encoding_digests(docs, words=500)
        want = set()
        for r in rows:
            ids = byte.encode(r[1] or "", add_special_tokens=False).ids
            text = byte.decode(ids, skip_special_tokens=False)
            want.add((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert set(by_row(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want and got.count() == len(rows)
    full = byte_bpe.encoded(edge_docs(session).where("doc_id = 8"), words=10).first()
    assert full.decoded == EDGES[9][1] and full.ids == byte.encode(EDGES[9][1], add_special_tokens=False).ids
    assert byte_bpe.encoding_digests(documents.limit(0)).count() == 0


def check_packing(got, rows, byte, size):
    import zlib

    from collections import defaultdict

    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got.collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for r in rows:
        ids = [*byte.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % size or size
        starts = [0, *range(min(first, len(ids)), len(ids), size)]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[r[0]].append((n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    tokens = sum(n for spans in bins.values() for _, n in spans)
    return len(bins), -(-tokens // size)


def test_packing(session, documents, byte):
    made, least = check_packing(packing.packed_documents(documents), documents.collect(), byte, 2048)
    assert made <= 1.03 * least + 1
    check_packing(packing.packed_documents(edge_docs(session), size=64), EDGES, byte, 64)
    assert packing.packed_documents(documents.limit(0)).count() == 0
    ids = packing.token_pieces(documents.limit(3), with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in ids)


def test_open_bins_stay_few_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 9)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 was fuller and closed
    assert bins.place(4) == (0, 6) and bins.place(1) == (2, 9)
    assert bins.open == 0 and bins.free == 0
    with pytest.raises(ValueError):
        bins.place(11)
    rng, bins = random.Random(1), packing.OpenBins(100, 5)
    for _ in range(3000):
        bins.place(rng.randint(1, 100))
        assert bins.open == sum(map(len, bins.by_free)) <= 5
        assert bins.free == sum(1 << f for f, b in enumerate(bins.by_free) if b)
