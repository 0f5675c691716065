"""Ranked search, spelling variants and record files against brute force."""

import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_cases import EDGES, edge_docs

from stayline.llm import fp_search, record_files, spelling

# ---- ranked search -----------------------------------------------------------------------


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def brute_ranking(docs, items, k=10):
    """[(item, rank, doc, score)] of rows of (id, text)."""
    terms = lambda t: re.findall("[0-9A-Za-z\x80-\U0010ffff]+", lower(t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank, i, -score] += 1
    return out


def as_rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def random_docs(seed=3, n=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice((1, 5, 30, 120))))) for i in range(n)]
    docs += [(n + i, docs[7][1] + " w250 w251") for i in range(200)]  # copies: equal scores
    return docs


def test_ranking_by_brute_force(session):
    docs, rng = random_docs(), random.Random(9)
    items = [(i, " ".join(f"W{rng.randrange(300)}" for _ in range(rng.choice((1, 4, 20))))) for i in range(25)]
    items += [(100, "w250 w251, w250"), (101, "nothing here"), (102, None), (103, ""), (None, "w3 w290"), (104, "w0")]
    d = session.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = session.createDataFrame(items, "item_id long, text string")
    want = brute_ranking(docs, items)
    for most_items, most_terms in ((1000, 8192), (16, 8192), (1000, 150)):
        got = fp_search.ranked(d, q, most_items=most_items, most_terms=most_terms)
        assert as_rows(got, "item_id", "rank", "doc_id", "score") == want


def test_ranking_edges(session):
    docs = edge_docs(session)
    items = session.createDataFrame(
        [(1, "one TWO", 5), (1, "one TWO", 5), (2, "aaaa 中文字符", 5), (3, "a text without an id", 5)], "item_id long, text string, score int"
    )
    rows = [(r[0], r[1]) for r in EDGES]
    want = brute_ranking(rows, [(r[0], r[1]) for r in items.collect()])
    assert as_rows(fp_search.ranked(docs, items), "item_id", "rank", "doc_id", "score") == want
    assert fp_search.ranked(docs.limit(0), items).count() == 0
    empty = fp_search.ranked(docs, items.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_tree_bounds_and_prunes():
    rng = np.random.default_rng(2)
    n, terms = 3000, 40
    vectors = []
    for _ in range(n):
        held = np.flatnonzero(rng.random(terms) < 0.9 / (np.arange(terms) + 1) ** 0.7)
        pairs = np.empty(len(held), dtype=fp_search._PAIR)
        pairs["term"], pairs["tf"] = held, rng.integers(1, 9, len(held))
        vectors.append(pairs)
    measures = rng.integers(20, 300, n).tolist()
    tree = fp_search.DocumentTree(vectors, measures, list(range(n)), np.arange(terms))
    for node, (low, high) in enumerate(tree.spans):
        assert (tree.caps[:, node] >= tree.parts[:, low:high].max(axis=1)).all()
        assert ((tree.caps[:, node] > 0) == (tree.parts[:, low:high] > 0).any(axis=1)).all()
        a, b = tree.children[node]
        assert a == b or [tree.spans[a][0], tree.spans[b - 1][1]] == [low, high]
        assert a < b or high - low <= 8
    asked, weights = np.array([0, 20, 35, 39]), np.array([50, 3000, 5000, 9000])
    best: list = []
    scored = tree.search(asked, weights, best, 10)
    want = sorted(((int(s), -int(i)) for s, i in zip(weights @ tree.parts[asked].astype(np.int64), tree.ids)), reverse=True)[:10]
    assert sorted(best, reverse=True) == want
    assert scored < n / 2


# ---- spelling variants -------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, ratio):
    out = {}
    forms = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [forms[w], n, len(near), words[forms[w]] if forms[w] else None]
    for w, row in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def brute_words(docs, least=7, times=2, noise=31):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            if noise and (h := zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())) % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def crowded_words(seed=1):
    """Few letters, so nearly everything is near; long words, one-letter runs and prefixes."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(900)}
    words |= {"a" * n for n in range(1, 30)} | {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149, "÷ÿ×àáâã", "÷ÿ×àáâ"}
    return {w: rng.choice((2, 3, 25, 400, 7000)) for w in words}


def test_near_words_in_one_list():
    words = sorted(w for w in crowded_words() if len(w) in (6, 7))
    for start, end in ((0, 6), (0, 3), (3, 6), (2, 3)):
        groups = defaultdict(list)
        for w in words:
            groups[w[:start], w[len(w) - (6 - end) :]].append(w)
        for held in groups.values():
            def parts(a, b):
                at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 6)
                return start <= at and (at < end or end == 6)

            want = {
                (a, b) for a in held for b in held
                if len(a) == 6 and one_edit(a, b) and parts(a, b)
            }
            got = [(held[i], held[j]) for i, j in spelling.near_in_list(held, 6, start, end)]
            assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("most", [2, 256])
def test_forms_by_brute_force(session, most):
    words = crowded_words()
    got = spelling.grouped(session.createDataFrame(list(words.items()), "word string, n long"), ratio=5, most=most)
    assert {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in got.collect()} == brute_forms(words, 5)
    with pytest.raises(ValueError):
        spelling.grouped(got, ratio=1)


def test_variants_of_documents(session, documents):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeé") for _ in range(8)) for _ in range(30)]
    own = [(i, " ".join(rng.choices(stems, [1 / (j + 1) for j in range(30)], k=200))) for i in range(60)]
    for docs, rows in (
        (documents, [(r.doc_id, r.text) for r in documents.collect()]),
        (edge_docs(session), [(r[0], r[1]) for r in EDGES]),
        (session.createDataFrame(own, "doc_id long, text string"), own),
    ):
        got = spelling.spelling_variants(docs)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        want = brute_forms(brute_words(rows), 10)
        assert {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in got.collect()} == want
        assert docs is documents or len(want) < 3 or any(r[0] for r in want.values())
    assert spelling.spelling_variants(documents.limit(0)).count() == 0


# ---- record files ------------------------------------------------------------------------


def crc32c(data):
    register = 0xFFFFFFFF
    for byte in data:
        register ^= byte
        for _ in range(8):
            register = register >> 1 ^ 0x82F63B78 * (register & 1)
    return register ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283
    rng = random.Random(5)
    messages = [rng.randbytes(n) for n in (0, 1, 3, 4, 5, 8, 12, 63, 64, 65, 200, 1000, 1027, 5000, 64, 0, 128)]
    masked = [((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF for c in map(crc32c, messages)]
    assert record_files.masked_crc32c(messages).tolist() == masked
    assert record_files.masked_crc32c([]).tolist() == []


@pytest.fixture(scope="module")
def byte():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_records_of_documents(session, documents, byte, tmp_path):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    manifest = record_files.write_records(documents, folder=str(tmp_path / "own"))
    files = manifest.orderBy("file").collect()
    want, at, ids_of = {}, 0, {}
    for i, t in rows:
        ids_of[i] = [*byte.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids_of[i]), zlib.crc32(np.array(ids_of[i], "<u4").tobytes()))
        at += len(ids_of[i])
    got = record_files.read_records(manifest, with_ids=True).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.ids for r in got} == ids_of
    # the files hold plain frames in ascending id order
    seen = []
    for f in files:
        raw, place = open(f.records.removeprefix("file://"), "rb").read(), 0
        for offset, length in record_files.read_index(f["index"]).tolist():
            assert offset == place and struct.unpack_from("<Q", raw, place)[0] == length
            crc = crc32c(raw[place : place + 8])
            assert struct.unpack_from("<I", raw, place + 8)[0] == (((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF)
            seen.append(record_files.parsed(raw[place + 12 : place + 12 + length])[0])
            place += length + 16
        assert place == len(raw)
    assert seen == [i for i, _ in rows]
    shuffles = []
    for seed in (1, 1, 2):
        drawn = record_files.shuffled_records(manifest, seed=seed, tasks=3).orderBy("task", "place").collect()
        assert {r.doc_id: r.ids for r in drawn} == ids_of and len(drawn) == len(rows)
        shuffles.append([r.doc_id for r in drawn])
    assert shuffles[0] == shuffles[1] != shuffles[2] and shuffles[0] != sorted(shuffles[0])


def test_records_edges(session, byte):
    docs = edge_docs(session)
    for ranks in ("byte_bpe_50k.tiktoken", None):
        got = record_files.read_records(record_files.write_records(docs, ranks=ranks, file_bytes=100)).collect()
        counts = Counter((r.doc_id, r.n_tokens) for r in got)
        assert counts == Counter((r[0], len(byte.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in EDGES)
        ordered = sorted(got, key=lambda r: r.start)
        assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
        assert [r.doc_id for r in ordered] == sorted((r[0] for r in EDGES if r[0] is not None)) + [None]
    none = record_files.write_records(docs.limit(0))
    assert none.count() == 0 and record_files.read_records(none).count() == record_files.shuffled_records(none).count() == 0


@pytest.mark.parametrize("kind, at", [("records", 20), ("records", 9), ("records", -1), ("index", 3)])
def test_a_changed_byte_is_found(session, tmp_path, kind, at):
    docs = session.createDataFrame([(1, "some text here"), (2, "and some more")], "doc_id long, text string")
    manifest = record_files.write_records(docs, folder=str(tmp_path / "own"))
    path = manifest.first()[kind].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[at] ^= 1
    os.chmod(path, 0o644)
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="checksum|frame|index"):
        record_files.read_records(manifest).collect()
