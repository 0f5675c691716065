from collections import Counter

import numpy as np
import pytest
from llm_cases import EDGES, by_row, edge_docs, jaccard_components, kept_lines, near_copy_docs, smallest_reachable

from pyspark.sql import functions as F

from stayline.llm import bottom_k, line_index, rotation_codes
from stayline.llm.components import components


def test_components_by_brute_force(session):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(200, 260)]
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + chain + [(0, i) for i in range(300, 400)]
    got = {r.node: r.component for r in components(session.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for p in links if p[0] != p[1] for x in p}
    assert got == smallest_reachable(ids, [p for p in links if p[0] != p[1]])
    assert components(session.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("short", [4, 48])
def test_near_copies_by_brute_force(session, short):
    texts = near_copy_docs()
    docs = session.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes, reach = jaccard_components(texts, 3, 85)
    got = {r.doc_id: r for r in bottom_k.near_duplicates(docs, shingle=3, percent=85, short=short).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == reach
    assert all(r.kept == (i == reach[i]) for i, r in got.items())


def test_near_copies_of_the_documents(session, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for size, percent in ((3, 85), (5, 80)):
        _, reach = jaccard_components(texts, size, percent)
        got = bottom_k.near_duplicates(documents, shingle=size, percent=percent)
        assert {r.doc_id: r.component_id for r in got.collect()} == reach


def test_near_copies_edges(session):
    got = bottom_k.near_duplicates(edge_docs(session), shingle=3, percent=85)
    rows = by_row(got, "doc_id", "n_shingles", "component_id", "kept")
    assert sum(rows.values()) == len(EDGES)
    assert rows[(1, 0, 1, True)] == rows[(2, 0, 2, True)] == rows[(3, 0, 3, True)] == 1
    assert rows[(5, 1, 5, True)] == 2 and rows[(6, 1, 5, False)] == 1  # lower case is the same
    assert [r for r in rows if r[0] is None][0][2:] == (None, True)
    assert bottom_k.near_duplicates(edge_docs(session).limit(0)).count() == 0


def test_runs_and_estimates():
    rng = np.random.default_rng(4)
    for _ in range(300):
        union = np.unique(rng.integers(0, 1 << 63, rng.integers(7, 400)).astype(np.uint64))
        part = rng.random(len(union))
        a, b = union[part > 0.05], union[part < 0.95]
        both = len(np.intersect1d(a, b)) / len(union)
        if both >= 0.85:
            assert len(np.intersect1d(bottom_k.run_keys(a[:64]), bottom_k.run_keys(b[:64])))
        assert abs(bottom_k.estimate(a[:64], b[:64], 64) - both) < 0.25
        if len(union) < 64:
            assert bottom_k.estimate(a, b, 64) == pytest.approx(both)


def test_lines_by_brute_force(session, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = line_index.without_repeated_lines(documents)
    assert got.columns == [*documents.columns, "n_lines", "n_dropped"]
    want = kept_lines(texts)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == want
    assert any(n for _, n, _ in want.values())


def test_lines_edges(session):
    docs = edge_docs(session)
    got = line_index.without_repeated_lines(docs)
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()}
    assert got.count() == len(EDGES) and got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert rows[1] == rows[2] == (1, 0, "")
    assert rows[10] == (4, 0, EDGES[11][1]) and rows[11] == (3, 2, "something else")
    assert line_index.without_repeated_lines(docs.limit(0)).count() == 0
    # rows without an id come after all others and are one document
    lines = session.createDataFrame([(None, "only those without id"), (None, "only those without id"), (3, "with a number"), (None, "with a number")], "doc_id long, text string")
    assert by_row(line_index.without_repeated_lines(lines), "doc_id", "n_dropped", "text") == {
        (None, 0, "only those without id"): 2, (3, 0, "with a number"): 1, (None, 1, ""): 1,
    }


def test_lines_of_many_rows_without_id_or_with_one_id(session):
    # every text is told of its own keys only, whatever shares its id
    texts = [f"line number {i} of this text\nshared by everything\nonly here {i % 7} and there" for i in range(300)]
    rows = [(1, "\n".join(f"only here {i} and there" for i in range(5)))] + [(None, t) for t in texts] + [(9, t) for t in texts[:50]]
    docs = session.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first: dict[str, int] = {}
    order = lambda doc: 1 << 62 if doc is None else doc
    for doc, text in rows:
        for line in text.split("\n"):
            first[line] = min(first.get(line, 1 << 62), order(doc))
    want = Counter()
    for doc, text in rows:
        kept = [x for x in text.split("\n") if first[x] == order(doc)]
        want[(doc, len(text.split("\n")) - len(kept), "\n".join(kept))] += 1
    assert by_row(line_index.without_repeated_lines(docs), "doc_id", "n_dropped", "text") == want
    blocks = line_index.line_blocks(docs, "doc_id", "text", 10)
    lost = line_index.probed(blocks, line_index.line_index(blocks)).groupBy("id", "mark").agg(F.count_distinct("key").alias("n"))
    assert max(r.n for r in lost.collect()) <= 3


def test_line_keys():
    keys = line_index.line_keys("ÄÖÜ  ABCDEFG \n\tÄÖÜ  abcdefg\nähnlich\n1234567890\n123456789", 10)
    assert keys[0] == keys[1] is not None and keys[2] is None and keys[3] is not None and keys[4] is None


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 5000):
        h1, h2 = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in "ab")
        hashed = line_index.PerfectHash.built(h1, h2)
        assert sorted(hashed.numbers(h1, h2).tolist()) == list(range(n))
        again = line_index.PerfectHash.unpacked(hashed.sizes, hashed.packed())
        assert (again.numbers(h1, h2) == hashed.numbers(h1, h2)).all()


def brute_vectors(rows, cosine=0.98):
    good = [(i, np.array(v, np.float32).astype(np.float64), g) for i, v, g in rows if i is not None and g is not None and rotation_codes.usable(v)]
    units = [v / np.linalg.norm(v) for _, v, _ in good]
    links = [
        (a, b) for a in range(len(good)) for b in range(a)
        if good[a][2] == good[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine
    ]
    return good, links


def test_vectors_of_the_table(session):
    vectors = session.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    good, links = brute_vectors(rows)
    reach = smallest_reachable([i for i, _, _ in good], [(good[a][0], good[b][0]) for a, b in links])
    count = {i: 0 for i, _, _ in good}
    for a, b in links:
        count[good[a][0]] += 1
        count[good[b][0]] += 1
    got = rotation_codes.near_duplicates(vectors).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (count[i], reach[i]) for i in count}


@pytest.mark.parametrize("bits", [0, 3])
def test_vectors_by_brute_force(session, monkeypatch, bits):
    if bits:
        monkeypatch.setattr(rotation_codes, "plan", lambda c: [(bits, rotation_codes.tables_needed(bits, c), 0.0)])
        monkeypatch.setattr(rotation_codes, "_BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = []
    for g in range(25):
        base = rng.standard_normal(48)
        for _ in range(rng.integers(1, 9)):
            near = base + rng.standard_normal(48) * rng.choice([0, 0.08, 0.13, 0.2])
            rows.append((len(rows), (near * rng.choice([0.5, 1, 4])).astype(np.float32).tolist(), int(g % 3)))
    same = rng.standard_normal(48).astype(np.float32).tolist()
    rows += [(len(rows) + i, same, 1) for i in range(40)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 48, 1), (903, [1.0, None], 1), (904, [float("nan")] * 48, 1),
             (905, same, None), (906, [1.0, 2.0], 1), (907, [float("inf")] * 48, 1), (None, same, 1)]
    good, links = brute_vectors(rows)
    reach = smallest_reachable([i for i, _, _ in good], [(good[a][0], good[b][0]) for a, b in links])
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[good[a][0]] += 1
        count[good[b][0]] += 1
    schema = "vec_id long, embedding array<float>, label int, n_links int, rep int"
    got = rotation_codes.near_duplicates(session.createDataFrame([(*r, 1, 2) for r in rows], schema)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == (count[r.vec_id], reach.get(r.vec_id, r.vec_id)), r
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)
    empty = session.createDataFrame([], schema)
    assert rotation_codes.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dim", [64, 100, 768])
def test_estimates_are_unbiased_and_bounded(dim):
    errors = []
    for seed in range(10):
        rng = np.random.default_rng(seed)
        units = rng.standard_normal((400, dim))
        units[200:] = units[:200] + rng.standard_normal((200, dim)) * rng.choice([0.05, 0.2, 0.5, 1], (200, 1))
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        made = rotation_codes.Codes.of(units)
        codes = rotation_codes.Codes.read(made.rows(), dim)
        assert all((a == b).all() for a, b in ((codes.code, made.code), (codes.planes, made.planes), (codes.numbers, made.numbers)))
        assert len(made.rows()[0]) <= dim * 5 / 8 + 52
        true = units @ units.T
        errors.append((codes.estimates(codes) - true)[~np.eye(400, dtype=bool)].mean())
        for cosine in (0.3, 0.7, 0.95, 0.98):
            assert codes.possible(codes, cosine)[true >= cosine].all()
        assert codes.possible(codes, 0.98)[true < 0.3].mean() < 1e-3
    assert abs(np.mean(errors)) < 0.001  # three standard errors


def test_double_vectors_are_not_rounded(session):
    a = np.array([1.0, 0.0, 0.0])
    cosine = lambda x: [x, (1 - x * x) ** 0.5, 0.0]
    rows = [(1, a.tolist(), 1), (2, cosine(0.98 + 1e-10), 1), (3, cosine(0.98 - 1e-10), 2), (4, a.tolist(), 2), (5, [1e300, 0.0, 0.0], 2)]
    got = rotation_codes.near_duplicates(session.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


def test_clashing_names_stop_before_any_job(session):
    from stayline.llm import ordinal_quality, packing

    docs = session.createDataFrame([(1, "a line")], "doc_id long, text string")
    for names, run in (
        (("n_lines", "N_Dropped"), line_index.without_repeated_lines),
        (("offset", "sequence_id"), lambda df: packing.packed(df.withColumn("length", df.doc_id))),
        (("kept", "expected_grade"), lambda df: ordinal_quality.scored(df, None)),
    ):
        for name in names:
            with pytest.raises(ValueError, match="columns exist already"):
                run(docs.withColumn(name, docs.doc_id))
