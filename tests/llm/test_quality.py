import numpy as np
import pytest
from llm_cases import EDGES, SCHEMA, by_row, edge_docs

from stayline.llm import fertility, ordinal_quality
from stayline.llm.queries import grades


def base_counts(text):
    text = text or ""
    blanks = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blanks:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(blanks):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    where = {}
    for i, w in enumerate(windows):
        where.setdefault(w, []).append(i)
    repeated = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_base_rules(session, documents):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for docs, rows in ((documents, documents.collect()), (edge_docs(session), EDGES)):
        got = fertility.judged(docs)
        assert set(by_row(got, *names)) == {(r[0], *base_counts(r[1])) for r in rows}
        assert got.count() == len(rows)
        assert got.where("base_failed AND kept").count() == 0
    assert fertility.judged(documents.limit(0)).count() == 0


def test_bands_reject_other_scripts_and_noise(session):
    import base64
    import random

    rng = random.Random(2)
    common = "the house and garden of our old friend was near a river with many boats on it every summer day".split()
    rows = [(i, " ".join(rng.choice(common) for _ in range(rng.randint(60, 90))), "en", "s", 0) for i in range(200)]
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(60))
    strange = " ".join("".join(chr(rng.randint(0x1F300, 0x1F5FF)) for _ in range(6)) for _ in range(40))
    rows += [(1000, noise, "en", "s", 0), (1001, strange, "en", "s", 0), (1002, "q " * 7 + "z x c v b n m l k j h g f d s", "en", "s", 0)]
    got = {r.doc_id: r.kept for r in fertility.judged(session.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(200))
    assert not got[1000] and not got[1001]


def test_bands_hold_against_a_third_of_junk(session):
    import base64
    import random

    rng = random.Random(4)
    common = "the house and garden of our old friend was near a river with many boats on it every summer day".split()
    rows = [(i, " ".join(rng.choice(common) for _ in range(rng.randint(60, 90))), "en", "s", 0) for i in range(180)]
    rows += [(i, " ".join(rng.choice(common) for _ in range(22)), "en", "s", 0) for i in range(180, 200)]  # short ones
    rows += [(i, " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(60)), "en", "s", 0) for i in range(1000, 1100)]
    rows += [(i, "zq " * 7, "en", "s", 0) for i in range(2000, 2400)]  # fail the base rules, so they have no say
    rows += [(i, rows[0][1], "en", "s", 0) for i in range(3000, 3400)]  # copies count once
    # a script mixes languages: a fifth in another one stays
    other = "das haus und der garten unseres alten freundes lag nahe an einem fluss mit vielen booten".split()
    rows += [(i, " ".join(rng.choice(common if i % 5 else other) for _ in range(80)), None, "s", 0) for i in range(4000, 4100)]
    got = {r.doc_id: r.kept for r in fertility.judged(session.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i, kept in got.items() if kept] == [i for i in got if i < 1000 or i >= 3000]


def test_bands_reject_labelled_junk_of_the_tables(session):
    from pyspark.sql import functions as F

    docs, labels = (session.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    gone = fertility.judged(docs).where("NOT base_failed AND NOT kept").select("doc_id").join(labels, "doc_id", "left")
    found = {r.quality: r["count"] for r in gone.groupBy(F.col("quality")).count().collect()}
    assert found.get(0, 0) >= 30 and found.get(1, 0) <= 0.05 * found[0]


def test_percentiles_by_brute_force(session):
    rng = np.random.default_rng(8)
    rows = [("en", float(v), int(w)) for v, w in zip(rng.normal(5, 1, 777), rng.integers(1, 9000, 777))]
    rows += [("de", 0.0, 0), ("fr", None, 7), ("fr", 2.5, 7), ("fr", -2.5, 8), ("fr", 2.5, 7)]
    df = session.createDataFrame(rows, "band string, v double, w long")
    got = {}
    for parts in (1, 7):
        found = fertility.percentiles(df.repartition(parts), "band", {"w": None, "v": 1 << 30}).collect()
        got[parts] = {r.band: (r.w, r.v, r.rows_) for r in found}
    assert got[1] == got[7] and set(got[1]) == {"en", "de", "fr"}
    for band, (w, v, n) in got[1].items():
        exact = sorted(r[1] for r in rows if r[0] == band and r[1] is not None)
        words = sorted(r[2] for r in rows if r[0] == band)
        assert n == len(words) and len(v) == len(w) == 101
        assert v == [exact[max(0, -(-i * len(exact) // 100) - 1)] for i in range(101)]
        for i, found in enumerate(w):  # the least value of the cell of the exact one
            true = words[max(0, -(-i * n // 100) - 1)]
            assert found in words and true / 2 ** (1 / 256) <= found <= true
    assert fertility.percentiles(df.limit(0), "band", {"v": 4}).count() == 0


def test_script_of():
    assert fertility.script_of("the house 12") == "LATIN" and fertility.script_of("дом и сад") == "CYRILLIC"
    assert fertility.script_of("中文字符") == "CJK" and fertility.script_of("12 !") == "NONE"


def test_groups_come_from_whole_texts_and_whole_subtags(session):
    assert fertility.script_of("дab" * 1000) == "LATIN"  # every third letter is another script's
    assert fertility.script_of("a" * 2000 + "д" * 2001) == "CYRILLIC"
    tags = {"es": "es", "est": "est", "fil": "fil", "fi": "fi", " EN-us": "en", "pt_BR": "pt", "zh-Hant-TW": "zh"}
    rows = [(i, "one two", tag, "s", 0) for i, tag in enumerate([*tags, "und", "x", "", "english", "12", None])]
    got = {r.doc_id: r.band for r in fertility.measured(session.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(rows))] == [*tags.values(), *["LATIN"] * 6]


def test_accepted_keeps_rows_as_they_are(session, documents):
    good = fertility.judged(documents).where("kept").select("doc_id")
    got = fertility.accepted(documents)
    assert got.columns == documents.columns
    assert by_row(got, *got.columns) == by_row(documents.join(good, "doc_id"), *got.columns)
    assert fertility.accepted(edge_docs(session)).columns == edge_docs(session).columns


def test_fit_separates_held_out_rows():
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(300)]

    def text(grade):
        words = list(rng.choice(plain, 60))
        if grade < 2:
            words += list(rng.choice([f"g{grade}x{i}" for i in range(8)], 6))
        return " ".join(words)

    true = rng.integers(0, 3, 1500)
    features = [np.sort(np.fromiter(ordinal_quality.text_features(text(g)), dtype="<u8")) for g in true]
    model = ordinal_quality.fitted(features, true)
    assert (np.diff(model.thresholds) > 0).all()
    score = model.scorer()
    held = rng.integers(0, 3, 400)
    tails = model.tail(np.array([score(text(g)) for g in held]))
    assert ((tails > 0.5).sum(axis=1) == held).mean() > 0.95


def test_classifier_on_the_tables(session, documents):
    labels = session.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = session.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rated = grades(labels)
    train, test = rated.where("doc_id % 4 != 0"), rated.where("doc_id % 4 = 0")
    got = ordinal_quality.scored(docs, ordinal_quality.fit(docs, train)).join(test, "doc_id").select("grade", "kept").collect()
    good = [r.kept for r in got if r.grade == 2]
    bad = [r.kept for r in got if r.grade != 2]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4  # a few hundred rated rows only


def test_classifier_edges(session):
    docs = edge_docs(session)
    rated = session.createDataFrame([(4, 0), (5, 2), (9, 2), (None, 1), (7, None), (11, 1), (11, 2)], "doc_id long, grade int")
    model = ordinal_quality.fit(docs, rated)
    names = {"expected": "e", "tail": "t", "kept": "k"}
    got = ordinal_quality.scored(docs, model, **names)
    assert got.columns == [*docs.columns, "e", "t", "k"] and got.count() == len(EDGES)
    assert got.where("e IS NULL OR t < 0 OR t > 1").count() == 0
    assert ordinal_quality.fit(docs, rated.limit(0)) is None
    unknown = ordinal_quality.scored(docs, None, **names)
    assert unknown.where("k AND e IS NULL AND t IS NULL").count() == len(EDGES)
    assert ordinal_quality.scored(docs.limit(0), model, **names).count() == 0


def test_word_features_ignore_edges():
    a, b = ordinal_quality.word_features("moron,"), ordinal_quality.word_features("Moron")
    assert a[0] == b[0] and a[1] == b[1] and a[2] != b[2]
    assert ordinal_quality.text_features(None) == ordinal_quality.text_features("")
    assert pytest.approx(1.0) == ordinal_quality.OrdinalModel(np.zeros(0, "u8"), np.zeros(0), np.array([-60.0])).tail(np.zeros(1))[0, 0]
