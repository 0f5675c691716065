from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import frame
from stayline.functions import lists, text, times, typing
from stayline.plans import fixed_values as fv


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, parsed, label",
    [
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "2024-01-02 03:04:05+00:00"),
        ("2024-01-02 03:04:05.999+02:00", "2024-01-02 01:04:05", "2024-01-02 01:04:05+00:00"),
        ("2024-01-02 03:04:05-0530", "2024-01-02 08:34:05", "2024-01-02 08:34:05+00:00"),
        (" 2024-01-02 ", "2024-01-02 00:00:00", "2024-01-02 00:00:00"),
        ("2024-1-5 3:04", "2024-01-05 03:04:00", "2024-01-05 03:04:00"),
        ("2024-01-05T10", "2024-01-05 10:00:00", "2024-01-05 10:00:00"),
        ("2024-02-30 00:00:00", None, None),
        ("2024-1-5", None, None),
        ("yesterday", None, None),
        ("", None, None),
    ],
)
def test_lenient_time(spark, raw, parsed, label):
    assert one(spark, times.time_text(times.lenient_time(F.lit(raw)))) == parsed
    assert one(spark, times.label_time_text(F.lit(raw))) == label


def test_as_time_needs_a_full_date(spark):
    for raw in ("2150", "2150-01", "10:00", "x"):
        assert one(spark, typing.as_time(F.lit(raw))) is None
    assert one(spark, typing.as_time(F.lit("2150-01-02"))) == datetime(2150, 1, 2)


def test_ids_exported_as_decimals(spark):
    assert one(spark, typing.as_long(F.lit("5.0"))) == 5
    assert one(spark, typing.as_long(F.lit("5.5"))) == 6
    assert one(spark, typing.as_long(F.lit("9007199254740993"))) == 9007199254740993
    assert one(spark, typing.as_long(F.lit("a"))) is None


@pytest.mark.parametrize("word, value", [(" YES ", True), ("0", False), ("f", False), ("maybe", None), ("", None)])
def test_lenient_bool(spark, word, value):
    assert one(spark, typing.lenient_bool(F.lit(word))) is value


def test_confidence_range(spark):
    assert one(spark, typing.confidence(F.lit(" 1 "))) == 1.0
    assert one(spark, typing.confidence(F.lit("1.01"))) is None


@pytest.mark.parametrize(
    "drug, route, kept",
    [
        ("Vancomycin ophth", "IV", False),
        ("Vancomycin", "OD", False),
        ("Vancomycin", "modify", True),
        ("cefazolin", None, True),
        ("cef", "IV", False),
        ("aspirin", "IV", False),
    ],
)
def test_antibiotic_include_and_excludes(spark, drug, route, kept):
    df = spark.createDataFrame([(drug, route)], "drug string, route string")
    column = text.included(
        F.col("drug"), fv.ANTIBIOTIC_PATTERN, (F.col("drug"), fv.TOPICAL_DRUG_PATTERN),
        (F.col("route"), fv.NON_SYSTEMIC_ROUTE_PATTERN),
    )
    assert df.select(column).first()[0] is kept


@pytest.mark.parametrize(
    "note, phrase, source",
    [
        ("off balance", None, "pulmonary"),
        ("Sepsis, UTI", "sepsis", "urinary"),
        ("asepsis", None, None),
        ("ésepsis", "sepsis", None),
        ("r/o infection", "rule out infection", None),
        ("suspecting infection of bile", "suspected infection", "abdominal"),
        ("empiric antibiotic", "empiric antibiotics", None),
    ],
)
def test_ordered_classifiers(spark, note, phrase, source):
    lowered = text.lowered(F.lit(note))
    assert one(spark, text.first_label(lowered, fv.NOTE_PHRASES)) == phrase
    assert one(spark, text.first_label(lowered, fv.CONTEXT_SOURCES)) == source


def test_matches_equals_the_plain_regex(spark):
    import re

    words = ["a rule out infection", "r/o  infection", "line infection", "wbc", "xwbc", "white blood cell",
             "od", "x od y", "food", "map", "cef", "cefx", "an uti.", "utility", "suspect infection"]
    patterns = [fv.ANTIBIOTIC_PATTERN, fv.NON_SYSTEMIC_ROUTE_PATTERN, fv.WBC_LABEL_PATTERN,
                *[p for _, p in fv.NOTE_PHRASES + fv.CONTEXT_SOURCES + fv.DIAGNOSIS_SOURCES]]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for pattern in patterns:
        got = {r["w"]: r["m"] for r in df.select("w", text.matches(F.col("w"), pattern).alias("m")).collect()}
        assert got == {w: re.search(pattern, w, re.ASCII) is not None for w in words}, pattern


def test_phrases_in_one_pass_equal_the_plain_regexes(spark):
    import random
    import re

    from stayline.operators.phrases import with_labels

    rng = random.Random(6)
    words = ["rule out", "r/o", "infection", "line", "sepsis", "urosepsis", "uti", "utility", "solution", "cef", "cefx", "suspect", "ed",
             "suspected", "empiric antibiotic", "s", "bal", "é", "_", "-", "tion", "tionier", "the", "an", "as", "ree", "od", "\n", "concern for"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "."]) for _ in range(rng.randint(0, 9))) for _ in range(500)] + [None, ""]
    rules = {"phrase": fv.NOTE_PHRASES, "context": fv.CONTEXT_SOURCES, "diagnosis": fv.DIAGNOSIS_SOURCES,
             "odd": (("an", r"\bthe [a-z]+ an\b"), ("on", r"tion(ier)?\b"), ("re", r"re{1,2}"), ("any", r"\b as\b|x?$"))}
    flags = {"drug": fv.ANTIBIOTIC_PATTERN, "route": fv.NON_SYSTEMIC_ROUTE_PATTERN, "word": r"\bas\b|\ban"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in with_labels(df, F.col("t"), labels=rules, flags=flags).collect():
        held = lambda p: re.search(p, r.t, re.ASCII) is not None
        for name, own in rules.items():
            assert r[name] == (None if r.t is None else next((label for label, p in own if held(p)), None)), (name, r.t)
        assert [r[n] for n in flags] == [None if r.t is None else held(p) for p in flags.values()], r.t


def test_code_roots(spark):
    df = spark.createDataFrame([("A41.9",), ("A419",), ("V",), ("",), (None,)], "c string")
    roots = {r[0] for r in df.select(text.code_root(F.col("c"))).collect()}
    assert roots == {"A419", None}


def test_signature_and_evidence(spark):
    assert one(spark, text.signature(F.lit("  Left\n LUNG "))) == "left lung"
    assert one(spark, text.evidence_lines(F.lit(" a \r\n  b\n"))) == "a\nb"
    assert one(spark, text.evidence_lines(F.lit("  \n "))) is None
    assert one(spark, text.file_safe(F.lit(" Dr. A/B "))) == "Dr._A_B"
    assert one(spark, text.file_safe(F.lit("  "))) == "reviewer"


def test_lists_keep_the_first_place(spark):
    column = lists.listed([(F.lit(True), ["b", "a"]), (F.lit(False), "c"), (F.lit(True), ["a", "d"])])
    assert one(spark, column) == ["b", "a", "d"]
    assert one(spark, lists.joined(lists.listed([(F.lit(False), "x")]))) is None


def test_time_arithmetic(spark):
    df = frame(spark, "a time, b time", [("2024-01-01 00:00:00.000001", "2024-01-01 03:00:01.000001")])
    row = df.select(
        times.hours_between(F.col("a"), F.col("b")).alias("h"),
        times.seconds_between(F.col("b"), F.col("a")).alias("s"),
        times.add_hours(F.col("a"), -0.5).alias("m"),
    ).first()
    assert row["h"] == pytest.approx(10801 / 3600)
    assert row["s"] == -10801
    assert row["m"] == datetime(2023, 12, 31, 23, 30, 0, 1)


@pytest.mark.parametrize("hours, label", [(3.0, "plus3h"), (-3.0, "minus3h"), (0.5, "plus0p5h"), (-0.25, "minus0p25h")])
def test_shift_label(spark, hours, label):
    assert one(spark, times.shift_label(F.lit(hours))) == label


def test_typed_keeps_matching_columns_bare(spark):
    df = spark.createDataFrame([(1, "2"), (2, "x")], "a bigint, b string")
    out = typing.typed(df, {"a": "bigint", "b": "bigint"})
    assert [tuple(r) for r in out.collect()] == [(1, 2), (2, None)]
    assert one(spark, typing.optional_column(df, ("zz", "yy"), "int")) is None


def test_round6_is_the_binary_value_rounded_half_even(spark):
    import random

    rng = random.Random(4)
    values = [n / 86400 for n in range(27, 400_000, 54)] + [-n / 86400 for n in range(27, 50_000, 54)]
    values += [k / 128 for k in range(-300, 300)] + [rng.uniform(-50, 50) for _ in range(5000)] + [0.0, 28.0, 1e-7, 5e-7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["x"] for r in df.select("i", typing.round6(F.col("v")).alias("x")).collect()}
    assert [v for i, v in enumerate(values) if got[i] != round(v, 6)] == []
    assert one(spark, typing.round6(F.lit(None).cast("double"))) is None
