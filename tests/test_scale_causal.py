import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import records
from stayline.operators import causal as ca, scale
from stayline.operators.checks import ContractError


@pytest.mark.parametrize("buckets", [["b"], ["b", "c"], []])
def test_running_total_equals_a_plain_prefix_sum(spark, buckets):
    rng = random.Random(1)
    rows = [(1 if i % 3 else rng.randrange(2, 5), i, i // 50, i // 7, float(rng.randrange(9))) for i in range(350)]
    df = spark.createDataFrame(rows, "g int, t int, b int, c int, v double")
    up = {(r["g"], r["t"]): r["s"] for r in records(scale.running_total(df, ["g"], "t", buckets, {"s": "v"}))}
    down = {(r["g"], r["t"]): r["s"] for r in records(
        scale.running_total(df, ["g"], "t", buckets, {"s": "v"}, descending=True, inclusive=False))}
    for g, t, _, _, _ in rows:
        assert up[g, t] == sum(v for gg, tt, _, _, v in rows if gg == g and tt <= t)
        assert down[g, t] == sum(v for gg, tt, _, _, v in rows if gg == g and tt > t)


def test_running_total_broadcasts_no_rows(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id", F.floor(F.col("id") / 10).alias("b"), F.lit(1).alias("v"))
    out = scale.running_total(df, ["g"], "id", ["b"], {"s": "v"})
    assert sorted(r["s"] for r in out.collect()) == sorted([*range(1, 51)] * 2)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_hash_positions_are_the_sorted_hash_order(spark):
    keys = [f"k{i}" for i in range(500)]
    got = {r["k"]: r["p"] for r in records(scale.hash_positions(spark.createDataFrame([(k,) for k in keys], "k string"), "k", "9", "p"))}
    assert got == {k: i for i, k in enumerate(sorted(keys, key=lambda k: hashlib.md5(f"9-{k}".encode()).hexdigest()))}


PROBS = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def test_ordered_bits_are_the_binary_form(spark):
    import struct

    rng = np.random.default_rng(8)
    values = [0.0, -0.0, 1.0, -1.0, 2.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, np.nextafter(2.0**-1022, 0), 1.7976931348623157e308,
              float("inf"), float("-inf"), 0.1, 1 / 3, np.nextafter(8.0, 0), np.nextafter(8.0, 9), 1e18, 123456.789]
    values += rng.integers(0, 2**63, 500, dtype=np.uint64).view(np.float64).tolist()
    values = [v for v in map(float, values) if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", scale.ordered_bits(F.col("v")).alias("b")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b == (-bits if r.v < 0 else bits), r.v
    top = spark.sql("select double('nan') v").select(scale.ordered_bits(F.col("v")).alias("b")).first().b
    assert top > 2047 << 52


def test_quantiles_of_values_far_apart(spark):
    """Nearly all values share one slice of the range; no window holds more than one digit's."""
    rng = np.random.default_rng(3)
    values = [*rng.random(3000) * 1e6, 1e18, -1e300, 5e-324, 0.0, -0.0, *([7.25] * 500)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r.quantile for r in scale.exact_quantiles(df, [], "v", PROBS).orderBy("probability").collect()]
    assert got == pytest.approx([np.quantile(values, p) for p in sorted(PROBS)], rel=1e-12, abs=1e-12)
    assert scale.exact_quantiles(df.limit(0), [], "v", PROBS).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 2, 9000), np.full(6000, 1.5), rng.normal(1.5, 1e-9, 3000)])
    groups = {"big": values, "tiny": np.array([1.0, 2.0, 4.0, 10.0]), "same": np.full(50, 3.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    got = {(r["g"], r["probability"]): r["quantile"] for r in records(
        scale.exact_quantiles(df, ["g"], "v", PROBS))}
    assert len(got) == 27
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], p), rel=1e-12, abs=1e-12)
    alone = records(scale.exact_quantiles(df.where("g = 'tiny'"), [], "v", [0.5]))
    assert [r["quantile"] for r in alone] == [3.0]


def test_truncation_bounds(spark):
    df = spark.createDataFrame([("d", w) for w in (1.0, 2.0, 4.0, 10.0)], "dataset string, stabilized_weight_raw double")
    out = ca.truncated_weights(df)
    row = out.first()
    assert row["primary_truncation_lower"] == pytest.approx(1.03) and row["primary_truncation_upper"] == pytest.approx(9.82)
    assert ca.weight_summary(out).first()["primary_truncated_rate"] == 0.5


def cohort(seed=2, n=400, ties=True, effect=0.5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, n)
    t = rng.exponential(12 / np.exp(effect * x))
    t = np.minimum(np.round(t * (2 if ties else 1000)) / (2 if ties else 1000) + (0.5 if ties else 0.001), 28.0)
    e = (t < 28) & (rng.random(n) < 0.8)
    w = rng.uniform(0.3, 3, n)
    return x, np.round(t, 6), e.astype(int), w


def survival_frame(spark, x, t, e, w, dataset="d"):
    return spark.createDataFrame(
        [(dataset, int(a), float(b), bool(c), float(d)) for a, b, c, d in zip(x, t, e, w)],
        "dataset string, treatment int, followup_duration_days double, event boolean, w double")


def efron(x, t, e, w, beta):
    """Weighted Efron score and information, straight from the definition."""
    score = info = 0.0
    for time in np.unique(t[e == 1]):
        risk, dead = t >= time, (t == time) & (e == 1)
        m, phi = dead.sum(), w * np.exp(beta * x)
        mean_w = w[dead].sum() / m
        score += (w * x)[dead].sum()
        for i in range(m):
            s0 = phi[risk].sum() - i / m * phi[dead].sum()
            s1 = (phi * x)[risk].sum() - i / m * (phi * x)[dead].sum()
            score -= mean_w * s1 / s0
            info += mean_w * (s1 / s0) * (1 - s1 / s0)
    return score, info


def reference_cox(x, t, e, w):
    beta = 0.0
    for _ in range(60):
        score, info = efron(x, t, e, w, beta)
        beta += score / info
    _, info = efron(x, t, e, w, beta)
    phi, residual = np.exp(beta * x), np.zeros(len(x))
    s0 = {s: (w * phi)[t >= s].sum() for s in np.unique(t)}
    s1 = {s: (w * phi * x)[t >= s].sum() for s in np.unique(t)}
    for i in range(len(x)):
        if e[i]:
            residual[i] += x[i] - s1[t[i]] / s0[t[i]]
        for j in np.flatnonzero((e == 1) & (t <= t[i])):
            residual[i] -= phi[i] * w[j] / s0[t[j]] * (x[i] - s1[t[j]] / s0[t[j]])
    return beta, math.sqrt(((w * residual) ** 2).sum()) / info


@pytest.mark.parametrize("ties", [True, False])
def test_cox_equals_the_definition(spark, ties):
    data = {f"s{seed}": cohort(seed, 300, ties) for seed in (1, 2)}
    frames = [survival_frame(spark, *d, dataset=k) for k, d in data.items()]
    df = frames[0].unionByName(frames[1]).withColumn("one", F.lit(1.0))
    got = {(r["dataset"], r["weighting"]): r for r in records(ca.weighted_hazard_ratios(df, {"w": "w", "one": "one"}))}
    assert len(got) == 4
    for k, (x, t, e, w) in data.items():
        for name, weights in (("w", w), ("one", np.ones(len(w)))):
            beta, se = reference_cox(x, t, e, weights)
            r = got[k, name]
            assert r["coefficient"] == pytest.approx(beta, abs=1e-8)
            assert r["robust_se"] == pytest.approx(se, rel=1e-8)
            assert r["hr"] == pytest.approx(math.exp(beta)) and r["ci_lower"] < r["hr"] < r["ci_upper"]


def test_cox_hand_case(spark):
    """Deaths at 1 (treated) and 2 (control), one censored per arm later: b solves 1 = p1 + p2."""
    df = survival_frame(spark, np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 3.0, 3.0]), np.array([1, 1, 0, 0]), np.ones(4))
    r = ca.weighted_hazard_ratios(df, {"w": "w"}).first()
    h = math.exp(r["coefficient"])
    assert h / (h + 1) + h / (h + 2) == pytest.approx(1.0)


def test_many_ties_are_chunked(spark):
    rng = np.random.default_rng(8)
    n = 6000
    x = rng.integers(0, 2, n)
    t = np.where(rng.random(n) < 0.5, 1.0, 2.0)
    e = (rng.random(n) < 0.4 + 0.2 * x).astype(int)
    df = survival_frame(spark, x, t, e, np.ones(n))
    beta = ca.weighted_hazard_ratios(df, {"w": "w"}).first()["coefficient"]
    score, info = efron(x, t, e, np.ones(n), beta)
    assert abs(score / info) < 1e-8


def test_fits_of_several_datasets_without_python_workers(spark):
    """Datasets that fit, hold a missing value, one arm only, or no rows at all."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    rows = [("good", float(t), float(a), float(b)) for t, (a, b) in zip(y, x)]
    rows += [("missing", 1.0, 0.5, None), ("missing", 0.0, 0.1, 0.2), ("untold", None, 0.1, 0.2), ("treated", 1.0, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "dataset string, treatment double, a double, b double")
    names = ["good", "missing", "untold", "empty"]
    fits, failed, scored = ca.fit_propensities(df, ["a", "b"], datasets=names)
    assert failed == {"missing": "not_finite", "untold": "not_finite", "empty": "no_rows"}
    z, beta = np.column_stack([np.ones(600), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        penalty = np.diag([0.0, 1.0, 1.0])
        beta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
    assert [fits["good"].intercept, *fits["good"].coefficients] == pytest.approx(beta.tolist(), abs=1e-8)
    assert scored.count() == 600
    sums = ca._likelihood_sums(ca._design_vectors(df, ["a", "b"], "treatment", "dataset"), {"treated": np.zeros(3)})
    rows, loss, gradient, hessian = sums["treated"]
    assert (rows, loss) == (1, pytest.approx(math.log(2)))
    assert gradient == pytest.approx([0.5, 0.05, 0.1])
    assert hessian == pytest.approx(0.25 * np.outer([1, 0.1, 0.2], [1, 0.1, 0.2]))
    plan = ca._design_vectors(df, ["a", "b"], "treatment", "dataset")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_diverging_effect_fails_loudly(spark):
    df = survival_frame(spark, np.array([1, 1, 0, 0]), np.array([1.0, 2.0, 3.0, 3.0]), np.array([1, 1, 0, 0]), np.ones(4))
    with pytest.raises(ca.ConvergenceError):
        ca.weighted_hazard_ratios(df, {"w": "w"})
    failures = {}
    ca.weighted_hazard_ratios(df, {"w": "w"}, failures=failures)
    assert list(failures) == [("d", "w")]


def test_survival_curve(spark):
    x, t, e, w = cohort(4, 250)
    got = records(ca.weighted_survival(survival_frame(spark, x, t, e, w), weight="w"))
    for arm, name in ((0, "control"), (1, "treated")):
        curve = {r["timeline_days"]: r["survival_probability"] for r in got if r["treatment_group"] == name}
        times = np.unique(t[x == arm])
        assert set(curve) == {0.0, *times} and curve[0.0] == 1.0
        s = 1.0
        for time in times:
            in_arm = x == arm
            s *= 1 - w[in_arm & (t == time) & (e == 1)].sum() / w[in_arm & (t >= time)].sum()
            assert curve[time] == pytest.approx(s, abs=1e-12)
        values = [curve[k] for k in sorted(curve)]
        assert all(a >= b >= 0 for a, b in zip(values, values[1:]))


def test_curve_reaches_zero(spark):
    df = survival_frame(spark, [0, 0, 1], [2.0, 2.0, 1.0], [1, 1, 1], [0.1, 0.2, 0.3])
    got = {(r["treatment_group"], r["timeline_days"]): r["survival_probability"] for r in records(ca.weighted_survival(df, weight="w"))}
    assert got == {("control", 0.0): 1.0, ("control", 2.0): 0.0, ("treated", 0.0): 1.0, ("treated", 1.0): 0.0}


def test_propensity_matches_newton(spark):
    rng = np.random.default_rng(0)
    n = 400
    z = rng.normal(size=(n, 2))
    c = rng.choice(["a", "b", "c"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(z[:, 0] - 0.5 * z[:, 1] + (c == "a"))))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), k, bool(t)) for (a, b), k, t in zip(z, c, y)], "a double, b double, k string, treatment boolean")
    design = ca.fit_preprocessing(df, df, ["a", "b"], ["k"], [])
    assert design.names == ["a", "b", "k=a", "k=b", "k=c"]
    features = [f"x{i}" for i in range(5)]
    fit, scored = ca.fit_propensity(df.select("*", *design.columns()), features)
    X = np.c_[np.ones(n), (z - z.mean(0)) / z.std(0), c == "a", c == "b", c == "c"].astype(float)
    b, penalty = np.zeros(6), np.diag([0.0] + [1.0] * 5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ b))
        b += np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + penalty, X.T @ (y - p) - penalty @ b)
    assert fit.intercept == pytest.approx(b[0], abs=1e-4)
    assert list(fit.coefficients) == pytest.approx(b[1:], abs=1e-4)
    got = {(r["a"], r["b"]): r["propensity_score"] for r in scored.collect()}
    want = 1 / (1 + np.exp(-X @ b))
    assert max(abs(got[tuple(map(float, zz))] - p) for zz, p in zip(z, want)) < 1e-5


def test_preprocessing_keeps_constant_columns_and_unknown_levels(spark):
    reference = spark.createDataFrame([(1.0, "a", True), (1.0, "b", False)], "v double, k string, f boolean")
    other = spark.createDataFrame([(3.0, "zz", True)], "v double, k string, f boolean")
    design = ca.fit_preprocessing(reference, reference, ["v"], ["k"], ["f"])
    assert list(other.select(*design.columns()).first()) == [2.0, 0.0, 0.0, 1.0]


def test_weights_and_overlap(spark):
    df = spark.createDataFrame([("d", True, 0.5), ("d", True, 0.8), ("d", False, 0.2), ("d", False, 0.6)],
                               "dataset string, treatment boolean, propensity_score double")
    out = records(ca.raw_weights(df), "propensity_score")
    assert [r["stabilized_weight_raw"] for r in out] == pytest.approx([0.5 / 0.8, 1.0, 0.5 / 0.4, 0.5 / 0.8])
    assert [r["overlap_weight"] for r in out] == pytest.approx([0.2, 0.5, 0.6, 0.2])
    o = ca.overlap_summary(df).first()
    assert (o["overlap_lower"], o["overlap_upper"]) == (0.5, 0.6)
    assert o["overlap_width"] == pytest.approx(0.1)
    apart = ca.overlap_summary(df.where("propensity_score IN (0.8, 0.2)")).first()
    assert apart["overlap_lower"] is None and apart["overlap_width"] == 0 and apart["severe_overlap_flag"]


def test_guards(spark):
    schema = "dataset string, treatment boolean, event boolean, followup_duration_days double"
    base = [(True, True, 1.0), (False, False, 28.0)]
    bad = {
        "fine": base, "treatment": base + [(None, True, 1.0)], "outcome": base + [(True, None, 1.0)],
        "followup": base + [(True, True, None)], "zero": base + [(True, True, 0.0)],
        "arm": [(True, True, 1.0), (True, False, 2.0)], "event": [(True, True, 1.0), (False, True, 2.0)],
    }
    df = spark.createDataFrame([(k, *r) for k, rows in bad.items() for r in rows], schema)
    verdicts = {r["dataset"]: r["verdict"] for r in ca.estimation_guards(df).collect()}
    assert verdicts == {
        "fine": None, "treatment": "treatment_missing", "outcome": "outcome_missing", "followup": "followup_missing",
        "zero": "followup_not_positive", "arm": "one_treatment_arm", "event": "one_outcome",
    }
    heavy = df.where("dataset = 'fine'").withColumn("w", F.lit(101.0))
    assert ca.estimation_guards(heavy, weight="w").first()["verdict"] == "extreme_weight"
    assert ca.estimation_guards(heavy, weight="w", max_weight=102.0).first()["verdict"] is None
    empty = spark.createDataFrame([], "v double, k string")
    with pytest.raises(ContractError):
        ca.fit_preprocessing(empty, empty, ["v"], ["k"], [])


def test_robustness(spark):
    schema = "dataset_name string, dataset_type string, analysis_scope string, source_predictor_name string, synthetic_shift_hours double, primary_hr double"
    rows = [
        ("gold", "gold", "full_cohort", None, None, 0.8), ("x_rule", "rule_based", "full_cohort", None, None, 0.9),
        ("m1", "model", "full_cohort", None, None, 1.0), ("m2", "model", "full_cohort", None, None, 0.7),
        ("m1", "model", "disagreement_subset", None, None, 5.0), ("s1", "synthetic", "full_cohort", "gold", 2.0, 0.85),
        ("s0", "synthetic", "full_cohort", "gold", -1.0, None), ("s2", "synthetic", "full_cohort", "gold", -1.0, 0.75),
    ]
    bias, models, trend = ca.robustness(spark.createDataFrame(rows, schema))
    assert {r["dataset_name"]: r["hr_bias"] for r in bias.collect()} == {"x_rule": 0.1, "m1": 0.2, "m2": -0.1}
    assert models.first()["stability"] == 0.3 and models.first()["variance_across_models"] == 0.0225
    assert [(r["dataset_name"], r["gold_hr_difference"]) for r in trend.collect()] == [("s2", -0.05), ("s1", 0.05)]
    _, few, _ = ca.robustness(spark.createDataFrame(rows[:3], schema))
    assert few.first()["stability"] is None
