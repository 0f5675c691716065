import glob
import hashlib
import json

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from helpers import records
from stayline.operators.checks import ContractError
from stayline.sources import sinks, tables as src


def test_model_outputs_as_array_and_lines(spark, tmp_path):
    rows = [
        {"task_id": "a", "extraction_status": "ok", "normalized_extraction": {"suspected_sepsis": True, "confidence": 0.5}},
        {"task_id": "b", "extraction_status": "parse_error", "normalized_extraction": None},
    ]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    for name, array in (("array", True), ("lines", False)):
        got = records(src.model_outputs(spark, str(tmp_path / f"{name}.json"), array=array), "task_id")
        assert [(r["task_id"], r["extraction_status"]) for r in got] == [("a", "ok"), ("b", "parse_error")]
        assert got[0]["normalized_extraction"]["suspected_sepsis"] is True
        assert got[1]["normalized_extraction"] is None


@pytest.mark.parametrize("indent", [None, 1])
def test_an_array_file_is_read_in_many_splits(spark, tmp_path, indent):
    import random

    rng = random.Random(2)
    odd = ['{', '}', '"', "\\", '\\"', "},{", "[", "é", "\n", " plain text "]
    rows = [{"task_id": f"t{i}", "raw_response_text": "".join(rng.choice(odd) for _ in range(rng.randrange(30))),
             "normalized_extraction": {"suspected_sepsis": True, "infection_source": "}{"} if i % 3 else None} for i in range(3000)]
    (tmp_path / "a.json").write_text(" " + json.dumps(rows, indent=indent) + "\n")
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text(json.dumps([{"task_id": "last", "raw_response_text": "}"}]))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        scan = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json"))
        assert scan.rdd.getNumPartitions() > 10
        got = src.model_outputs(spark, str(tmp_path), array=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert len(got) == 3001
    texts = {r.task_id: r.raw_response_text for r in got}
    assert texts == {r["task_id"]: r["raw_response_text"] for r in rows} | {"last": "}"}
    assert sum(r.normalized_extraction is not None and r.normalized_extraction.infection_source == "}{" for r in got) == 2000
    (tmp_path / "d.json").write_text('[{"task_id": "cut')
    with pytest.raises(Exception):
        src.model_outputs(spark, str(tmp_path / "d.json"), array=True).collect()


def test_rows_are_numbered_per_file(spark, tmp_path):
    for name, n in (("x", 5000), ("y", 1), ("z", 700)):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{name}{i},{'w' * (i % 40)}\n" for i in range(n)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        scan = spark.read.option("header", True).csv(str(tmp_path))
        assert scan.rdd.getNumPartitions() > 8
        got = src.numbered(scan, first=2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert len(got) == 5701 and all(r.row_number == int(r.k[1:]) + 2 and r.source_path.endswith(f"{r.k[0]}.csv") for r in got)


def test_first_tasks_in_file_order(spark, tmp_path):
    for name, ids in (("a", (5, 3)), ("b", (1, 2))):
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(json.dumps({"task_id": f"t{i}"}) for i in ids))
    assert {r.task_id for r in src.task_bundles(spark, str(tmp_path), first=3).collect()} == {"t5", "t3", "t1"}


def test_task_bundles_and_blank_lines(spark, tmp_path):
    lines = [json.dumps({"task_id": f"t{i}", "notes": [{"note_id": "n", "charttime": None, "text": "x"}]}) for i in (3, 1, 2)]
    (tmp_path / "t.jsonl").write_text("\n\n".join(lines))
    assert src.task_bundles(spark, str(tmp_path)).count() == 3


def test_label_files_with_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('task_id,reviewer_id,evidence_span\n1,r,"two\nlines, ""quoted"""\n')
    (tmp_path / "b.csv").write_text("reviewer_id,task_id,extra\nq,2,x\n")
    got = records(src.label_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["task_id", "reviewer_id"]), "task_id")
    assert got[0]["evidence_span"] == 'two\nlines, "quoted"' and got[0]["extra"] is None
    assert got[0]["row_number"] == got[1]["row_number"] == 2
    assert got[1]["reviewer_id"] == "q" and got[1]["source_path"].endswith("b.csv")
    with pytest.raises(ContractError):
        src.text_table(spark, str(tmp_path / "a.csv"), ["nope"])


def test_csv_lists_times_and_order(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a", "b"], "2024-01-01 10:00:00.5"), (1, [], None)], "k int, v array<string>, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    sinks.write_csv(df, str(tmp_path / "out"), ["t", "k", "v"], order=["k"])
    back = src.text_table(spark, str(tmp_path / "out"))
    assert back.columns == ["t", "k", "v"] and src.column_set(back) == {"t", "k", "v"}
    assert [tuple(r) for r in back.orderBy("k").collect()] == [(None, "1", None), ("2024-01-01 10:00:00", "2", "a|b")]


def test_one_folder_per_key(spark, tmp_path):
    df = spark.createDataFrame([("dr a/b", 1), ("dr c", 2)], "who string, n int")
    sinks.write_per_key(df, "who", str(tmp_path / "k"))
    assert sorted(p.name for p in (tmp_path / "k").iterdir() if p.is_dir()) == ["who_folder=dr_a_b", "who_folder=dr_c"]


def test_silver_is_complete(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("stay_id"), F.col("id").alias("itemid"))
    sinks.to_silver(df, str(tmp_path / "s"), ["stay_id"], ["itemid"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1000


def test_empty_placeholder_keeps_its_types(spark):
    df = src.empty_table(spark, "stay_id bigint, at timestamp_ntz")
    assert df.count() == 0 and dict(df.dtypes)["at"] == "timestamp_ntz"


def test_array_files_are_written_without_holding_a_file(spark, tmp_path, monkeypatch):
    from stayline.bindings import artifacts

    ids = [*range(200), 7, 7, 16, None, None]
    texts = [None if i % 50 == 3 else f'}} "{i}" [,\n' for i in range(len(ids))]
    docs = [(d, t, "en" if i % 2 else None, "web") for i, (d, t) in enumerate(zip(ids, texts))]
    schema = "doc_id bigint, text string, lang string, source string"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    plans, folders, write = [], [], DataFrameWriter.text

    def text(self, path, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        folders.append(path)
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "text", text)
    got = artifacts.array_outputs(spark, str(tmp_path)).collect()
    want = [(d if d is None else str(d), t and hashlib.md5(t.encode()).hexdigest(), None if not i % 2 else True, "web")
            for i, (d, t) in enumerate(zip(ids, texts))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    files = glob.glob(f"{folders[0]}/**/*.txt", recursive=True)
    arrays = [json.load(open(f, encoding="utf-8")) for f in files]
    assert len(arrays) == 17 and sum(map(len, arrays)) == len(ids)
    for rows in arrays:
        assert len({r.get("task_id") and int(r["task_id"]) % 16 for r in rows}) == 1
    assert len(plans) == 1 and "Exchange" in plans[0]
    assert "Window" not in plans[0] and "Sort" not in plans[0].replace("SortAggregate", "")
