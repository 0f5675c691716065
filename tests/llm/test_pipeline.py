import os

import pytest

from llm_cases import ascii_words, jaccard_components, kept_lines

import corpus_pipeline
from stayline.llm import fertility
from stayline.llm.common import table
from stayline.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_each_other(session):
    docs = table(session, SMALL, "documents")
    columns, texts, results = docs.columns, {r.doc_id: r.text for r in docs.collect()}, []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(session, docs, SMALL)
        if at < 4:
            assert docs.columns == columns, name
            docs = session.createDataFrame(docs.toArrow()) if hasattr(docs, "toArrow") else docs
        results.append({r.doc_id: r.text for r in docs.collect()} if at < 4 else docs.collect())
    rules, graded, lined, unique, packed = results
    good = {r.doc_id for r in fertility.judged(table(session, SMALL, "documents")).where("kept").collect()}
    assert rules == {i: texts[i] for i in good}
    assert set(graded) < set(rules)
    assert lined == {i: t for i, (_, n, t) in kept_lines(graded).items() if not n or ascii_words(t)}
    _, reach = jaccard_components(lined, 5, 80)
    assert unique == {i: t for i, t in lined.items() if reach[i] == i}
    assert {r.doc_id for r in packed} == set(unique)


def test_copies_leave_no_empty_documents(session):
    """Exact copies and documents made of others' lines go; what was blank before stays."""
    a = "\n".join(f"the {w} line of the first document" for w in ("one", "two", "three"))
    b = "\n".join(f"the {w} line of the second document" for w in ("four", "five", "six"))
    mixed = a.split("\n")[1] + "\n \n" + b.split("\n")[2]
    rows = [(1, a), (2, b), (3, a), (4, a.upper()), (5, mixed), (6, mixed + "\nand a line of its own here"), (7, ""), (8, None), (9, " \n\t"), (10, b + "\n")]
    docs = session.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lined = session.createDataFrame(corpus_pipeline.line_dedup(session, docs, SMALL).toArrow())
    assert {r.doc_id: r.text for r in lined.collect()} == {1: a, 2: b, 6: " \nand a line of its own here", 7: "", 8: "", 9: " \n\t"}
    packed = corpus_pipeline.best_fit_packing(session, lined, SMALL).collect()
    assert {r.doc_id for r in packed if r.length == 1} == {7, 8}


def test_no_piece_is_an_end_token_alone(session):
    assert corpus_pipeline.run(session, SMALL).where("length = 1").count() == 0


def test_empty_documents(session):
    docs = table(session, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(session, docs, SMALL).count() == 0


def test_run_and_registration(session):
    assert corpus_pipeline.run(session, SMALL).count() > 0
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert corpus_pipeline.ORACLE_SQL is None and os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"


def test_every_query_runs_on_the_small_tables(session):
    for name, bound in QUERIES.items():
        assert bound.run(session, SMALL).count() > 0, name


@pytest.mark.parametrize("name", [n for n, bound in QUERIES.items() if bound.sql])
def test_queries_equal_their_sql(session, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    bound = QUERIES[name]
    rel = con.execute(bound.sql)
    names = [d[0] for d in rel.description]
    got = bound.run(session, SMALL)
    assert sorted(got.columns) == sorted(names)
    in_order = lambda rows: sorted(rows, key=lambda row: [(v is None, v) for v in row])
    assert in_order(rel.fetchall()) == in_order(tuple(r[c] for c in names) for r in got.collect())
