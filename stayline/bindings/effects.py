"""Propensity, weighting, survival and robustness bindings.

Each event is one unit; its type is the dataset, a strong value the treatment, and a
quarter of the value the follow-up in days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayline.bindings import Bound, rounded, table
from stayline.operators import causal as ca
from stayline.session import cut_lineage

HORIZON = 28.0


def units(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    days = F.col("value") / 4
    return e.select(
        "event_id",
        F.col("event_type").alias("dataset"),
        k.alias("k"),
        F.floor(k / 20).alias("stratum"),
        F.hour("ts").alias("hour"),
        (F.col("user_id") % 3).cast("string").alias("unit"),
        (F.dayofmonth("ts") + F.pmod(k, F.lit(7)) > 18).alias("treatment"),
        ((days < HORIZON) & (k < 70)).alias("event"),
        F.round(F.least(days, F.lit(HORIZON)), 6).alias("followup_duration_days"),
        F.col("value").alias("severity"),
    )


def stratum_scores(rows: DataFrame) -> DataFrame:
    """Closed-form propensity: the treated share of the stratum."""
    share = rows.groupBy("dataset", "stratum").agg(
        F.avg(F.col("treatment").cast("double")).alias("propensity_score")
    )
    scored = rows.join(share, ["dataset", "stratum"])
    return scored.withColumn("propensity_score", ca.clipped(F.col("propensity_score")))


def weighted(spark, sf) -> DataFrame:
    # read by several small jobs (shares, quantile bounds), so written once
    scores = cut_lineage(stratum_scores(units(spark, sf)))
    return ca.truncated_weights(ca.raw_weights(scores))


def iptw_weights(spark, sf):
    out = weighted(spark, sf).select(
        "event_id", "dataset", "propensity_score", "stabilized_weight_raw", "overlap_weight",
        "stabilized_weight_primary", "stabilized_weight_sensitivity",
    )
    return rounded(out, *[c for c in out.columns if c not in ("event_id", "dataset")])


def weight_summary(spark, sf):
    out = ca.weight_summary(weighted(spark, sf))
    return rounded(out, *[c for c in out.columns if c != "dataset"])


def overlap_summary(spark, sf):
    out = ca.overlap_summary(weighted(spark, sf))
    return rounded(out, *[c for c in out.columns if c not in ("dataset", "severe_overlap_flag")])


def _curve(rows: DataFrame, weight: str, horizon: float) -> DataFrame:
    return rounded(ca.weighted_survival(rows, weight=weight, horizon=horizon), "survival_probability")


def km_curve(spark, sf):
    return _curve(weighted(spark, sf), "stabilized_weight_primary", HORIZON)


def curve_stack(spark, sf):
    """Unweighted control and treated curves over order lines: days from order to shipping."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    days = F.datediff("l_shipdate", "o_orderdate")
    rows = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .where(days > 0)
        .select(
            F.col("o_orderstatus").alias("dataset"),
            F.least(days, F.lit(365)).cast("double").alias("followup_duration_days"),
            ((days < 365) & (F.col("l_returnflag") != "N")).alias("event"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("treatment"),
            F.lit(1.0).alias("weight"),
        )
    )
    return _curve(rows, "weight", 365.0)


_SQL_UNITS = """
u0 AS (SELECT event_id, event_type AS dataset, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts, value,
  user_id FROM events),
u AS (SELECT event_id, dataset, floor(k / 20) AS stratum,
  extract(day FROM ts) + k % 7 > 18 AS treat, value / 4 < 28 AND k < 70 AS died,
  round(least(value / 4, 28.0), 6) AS dur FROM u0),
e AS (SELECT *, greatest(1e-6, least(1 - 1e-6, avg(CAST(treat AS DOUBLE)) OVER (PARTITION BY dataset, stratum))) AS ps,
  avg(CAST(treat AS DOUBLE)) OVER (PARTITION BY dataset) AS p FROM u),
w AS (SELECT *, CASE WHEN treat THEN p / ps ELSE (1 - p) / (1 - ps) END AS raw, CASE WHEN treat THEN 1 - ps ELSE ps END AS ov FROM e),
q AS (SELECT dataset, quantile_cont(raw, 0.01) AS l1, quantile_cont(raw, 0.99) AS h1, quantile_cont(raw, 0.05) AS l5,
  quantile_cont(raw, 0.95) AS h5 FROM w GROUP BY 1),
t AS (SELECT w.*, l1, h1, l5, h5, least(greatest(raw, l1), h1) AS w1, least(greatest(raw, l5), h5) AS w5 FROM w JOIN q USING (dataset))"""

_SQL_WEIGHTS = "WITH" + _SQL_UNITS + """
SELECT event_id, dataset, round(ps, 6) AS propensity_score, round(raw, 6) AS stabilized_weight_raw, round(ov, 6) AS overlap_weight,
  round(w1, 6) AS stabilized_weight_primary, round(w5, 6) AS stabilized_weight_sensitivity FROM t"""

_SQL_WEIGHT_SUMMARY = "WITH" + _SQL_UNITS + """
SELECT dataset, round(avg(CAST(w1 <> raw AS DOUBLE)), 6) AS primary_truncated_rate, round(avg(CAST(w5 <> raw AS DOUBLE)), 6) AS sensitivity_truncated_rate,
  round(max(l1), 6) AS primary_truncation_lower, round(max(h1), 6) AS primary_truncation_upper,
  round(max(l5), 6) AS sensitivity_truncation_lower, round(max(h5), 6) AS sensitivity_truncation_upper,
  round(min(w1), 6) AS primary_weight_min, round(max(w1), 6) AS primary_weight_max, round(avg(w1), 6) AS primary_weight_mean,
  round(stddev_pop(w1), 6) AS primary_weight_std, round(quantile_cont(w1, 0.01), 6) AS primary_weight_p01,
  round(quantile_cont(w1, 0.05), 6) AS primary_weight_p05, round(quantile_cont(w1, 0.25), 6) AS primary_weight_p25,
  round(quantile_cont(w1, 0.5), 6) AS primary_weight_p50, round(quantile_cont(w1, 0.75), 6) AS primary_weight_p75,
  round(quantile_cont(w1, 0.95), 6) AS primary_weight_p95, round(quantile_cont(w1, 0.99), 6) AS primary_weight_p99
FROM t GROUP BY 1"""

_SQL_OVERLAP = "WITH" + _SQL_UNITS + """,
r AS (SELECT dataset, min(ps) a, max(ps) b, min(ps) FILTER (treat) c, max(ps) FILTER (treat) d, min(ps) FILTER (NOT treat) f, max(ps) FILTER (NOT treat) g FROM t GROUP BY 1)
SELECT dataset, round(a, 6) AS propensity_min, round(b, 6) AS propensity_max, round(c, 6) AS treated_ps_min, round(d, 6) AS treated_ps_max,
  round(f, 6) AS control_ps_min, round(g, 6) AS control_ps_max, CASE WHEN least(d, g) >= greatest(c, f) THEN round(greatest(c, f), 6) END AS overlap_lower,
  CASE WHEN least(d, g) >= greatest(c, f) THEN round(least(d, g), 6) END AS overlap_upper,
  round(greatest(0, least(d, g) - greatest(c, f)), 6) AS overlap_width, greatest(0, least(d, g) - greatest(c, f)) < 0.1 AS severe_overlap_flag FROM r"""

_SQL_KM_TAIL = """
a AS (SELECT dataset, CASE WHEN treat THEN 'treated' ELSE 'control' END AS arm, dur, sum(CASE WHEN died THEN wt ELSE 0 END) AS d, sum(wt) AS n
  FROM src GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY dataset, arm ORDER BY dur DESC ROWS UNBOUNDED PRECEDING) AS risk FROM a),
s AS (SELECT *, CASE WHEN max(CASE WHEN d >= risk THEN 1 ELSE 0 END) OVER x = 1 THEN 0.0
  ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk) ELSE 0 END) OVER x) END AS surv FROM r
  WINDOW x AS (PARTITION BY dataset, arm ORDER BY dur ROWS UNBOUNDED PRECEDING))
SELECT dataset, arm AS treatment_group, CAST(dur AS DOUBLE) AS timeline_days, round(surv, 6) AS survival_probability FROM s
UNION ALL SELECT DISTINCT dataset, arm, 0.0, 1.0 FROM s"""

_SQL_KM = "WITH" + _SQL_UNITS + ", src AS (SELECT dataset, treat, dur, died, w1 AS wt FROM t)," + _SQL_KM_TAIL

_SQL_CURVES = """WITH src AS (SELECT o_orderstatus AS dataset, o_orderpriority IN ('1-URGENT', '2-HIGH') AS treat,
  CAST(least(g, 365) AS DOUBLE) AS dur, g < 365 AND l_returnflag <> 'N' AS died, 1.0::DOUBLE AS wt
  FROM (SELECT *, date_diff('day', o_orderdate, l_shipdate) AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE g > 0),""" + _SQL_KM_TAIL


# ------------------------------------------------------------------------- model fits


def scored(spark, sf) -> tuple[DataFrame, list[dict]]:
    """Propensity fitted per dataset on shared preprocessing, all datasets together."""
    rows = cut_lineage(units(spark, sf))
    names = sorted(r["dataset"] for r in rows.select("dataset").distinct().collect())
    design = ca.fit_preprocessing(
        rows.where(F.col("dataset") == names[0]), rows, ["k", "hour", "severity"], ["unit"], []
    )
    columns = design.columns()
    features = [f"x{i}" for i in range(len(columns))]
    fits, failed, out = ca.fit_propensities(rows.select("*", *columns), features, datasets=names)
    if failed:
        raise ca.ConvergenceError(str(failed))
    coefficients = [
        {"dataset": name, "term": label, "coefficient": value, "rows": fits[name].rows}
        for name in names
        for label, value in zip(["intercept", *design.names], [fits[name].intercept, *fits[name].coefficients])
    ]
    return cut_lineage(out.drop(*features)), coefficients


def propensity_logit(spark, sf):
    """Fitted coefficients per dataset."""
    _, coefficients = scored(spark, sf)
    out = spark.createDataFrame(coefficients, "dataset string, term string, coefficient double, rows bigint")
    return rounded(out, "coefficient")


def hazard_ratios(spark, sf) -> DataFrame:
    rows, _ = scored(spark, sf)
    ready = ca.truncated_weights(ca.raw_weights(rows))
    return ca.weighted_hazard_ratios(
        ready,
        {
            "primary": "stabilized_weight_primary",
            "sensitivity": "stabilized_weight_sensitivity",
            "overlap": "overlap_weight",
        },
        horizon=HORIZON,
    )


def cox_hr(spark, sf):
    out = hazard_ratios(spark, sf)
    return rounded(out, "coefficient", "robust_se", "hr", "ci_lower", "ci_upper")


def robustness(spark, sf):
    return _robust(hazard_ratios(spark, sf))


def _robust(ratios: DataFrame) -> DataFrame:
    """Bias, stability and shift trend, with clicks as gold and signups as a shifted copy."""
    hr = ratios.where(F.col("weighting") == "primary")
    name = F.col("dataset")
    results = hr.select(
        F.when(name == "click", "gold").when(name == "view", "x_rule").otherwise(name).alias("dataset_name"),
        F.when(name == "click", "gold").when(name == "view", "rule_based")
        .when(name == "signup", "synthetic").otherwise("model").alias("dataset_type"),
        F.lit("full_cohort").alias("analysis_scope"),
        F.when(name == "signup", "gold").alias("source_predictor_name"),
        F.when(name == "signup", 1.0).alias("synthetic_shift_hours"),
        F.round("hr", 6).alias("primary_hr"),
    )
    bias, models, trend = ca.robustness(results)
    measure = lambda label: F.lit(label).alias("measure")
    return (
        bias.select(measure("bias"), F.col("dataset_name").alias("name"), F.col("hr_bias").alias("value"))
        .unionByName(models.select(measure("stability"), F.lit("models").alias("name"), F.col("stability").alias("value")))
        .unionByName(models.select(measure("variance"), F.lit("models").alias("name"), F.col("variance_across_models").alias("value")))
        .unionByName(trend.select(measure("trend"), F.col("dataset_name").alias("name"), F.col("gold_hr_difference").alias("value")))
    )


# ------------------------------------------------------------- fits that SQL can follow


def propensity_newton(spark, sf):
    """Logistic fits on an intercept and two columns, per dataset."""
    rows = units(spark, sf).select("dataset", "treatment", (F.col("k") / 100).alias("x0"), (F.col("hour") / 24).alias("x1"))
    names = sorted(r["dataset"] for r in rows.select("dataset").distinct().collect())
    fits, _, _ = ca.fit_propensities(rows, ["x0", "x1"], datasets=names)
    out = spark.createDataFrame(
        [(n, f.rows, f.intercept, *f.coefficients) for n, f in fits.items()],
        "dataset string, rows bigint, intercept double, b0 double, b1 double",
    )
    return rounded(out, "intercept", "b0", "b1")


_SQL_NEWTON = """WITH RECURSIVE r AS (SELECT event_type AS dataset, CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 AS x0,
  extract(hour FROM ts) / 24 AS x1,
  CAST(extract(day FROM ts) + CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 > 18 AS DOUBLE) AS y FROM events),
n AS (SELECT dataset, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM r GROUP BY dataset
  UNION ALL
  SELECT dataset, step + 1,
    a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
    b + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
    c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
    SELECT dataset, step, a, b, c, sum(y - p) AS g0, sum((y - p) * x0) - b AS g1, sum((y - p) * x1) - c AS g2,
      sum(v) AS h00, sum(v * x0) AS h01, sum(v * x1) AS h02, sum(v * x0 * x0) + 1 AS h11, sum(v * x0 * x1) AS h12, sum(v * x1 * x1) + 1 AS h22
    FROM (SELECT *, p * (1 - p) AS v FROM (SELECT n.*, y, x0, x1, 1 / (1 + exp(-(a + b * x0 + c * x1))) AS p
      FROM n JOIN r USING (dataset) WHERE step < 12)) GROUP BY dataset, step, a, b, c)))
SELECT dataset, (SELECT count(*) FROM r WHERE r.dataset = n.dataset) AS rows, round(a, 6) AS intercept, round(b, 6) AS b0, round(c, 6) AS b1
FROM n WHERE step = 12"""

WEIGHTINGS = {"primary": "stabilized_weight_primary", "sensitivity": "stabilized_weight_sensitivity", "overlap": "overlap_weight"}


def strata_hazard_ratios(spark, sf) -> DataFrame:
    return ca.weighted_hazard_ratios(cut_lineage(weighted(spark, sf)), WEIGHTINGS, horizon=HORIZON)


def cox_strata(spark, sf):
    """Weighted hazard ratios with robust limits, on closed-form propensities."""
    return rounded(strata_hazard_ratios(spark, sf), "coefficient", "robust_se", "hr", "ci_lower", "ci_upper")


_SQL_HAZARD = "WITH RECURSIVE" + _SQL_UNITS + """,
x AS (SELECT dataset, weighting, dur, treat, died, w FROM (
  SELECT dataset, dur, treat, died, 'primary' AS weighting, w1 AS w FROM t UNION ALL
  SELECT dataset, dur, treat, died, 'sensitivity', w5 FROM t UNION ALL SELECT dataset, dur, treat, died, 'overlap', ov FROM t)),
g AS (SELECT dataset, weighting, dur, count(*) FILTER (died) AS m, coalesce(sum(w) FILTER (NOT treat), 0) AS w0,
  coalesce(sum(w) FILTER (treat), 0) AS w1, coalesce(sum(w) FILTER (NOT treat AND died), 0) AS d0, coalesce(sum(w) FILTER (treat AND died), 0) AS d1,
  coalesce(sum(w * w) FILTER (NOT treat AND died), 0) AS q01, coalesce(sum(w * w) FILTER (treat AND died), 0) AS q11,
  coalesce(sum(w * w) FILTER (NOT treat AND NOT died), 0) AS q00, coalesce(sum(w * w) FILTER (treat AND NOT died), 0) AS q10
  FROM x GROUP BY 1, 2, 3),
k AS (SELECT *, sum(w0) OVER z AS r0, sum(w1) OVER z AS r1 FROM g WINDOW z AS (PARTITION BY dataset, weighting ORDER BY dur DESC ROWS UNBOUNDED PRECEDING)),
ties AS (SELECT dataset, weighting, m, d0, d1, r0, r1, unnest(generate_series(0, m - 1)) AS i FROM k WHERE m > 0),
n AS (SELECT dataset, weighting, 0 AS step, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS info FROM g GROUP BY 1, 2
  UNION ALL
  SELECT dataset, weighting, step + 1, beta + score / information, information FROM (
    SELECT dataset, weighting, step, beta, sum(CASE WHEN i = 0 THEN d1 ELSE 0 END - (d0 + d1) / m * p) AS score, sum((d0 + d1) / m * p * (1 - p)) AS information
    FROM (SELECT *, (r1 * exp(beta) - i / m * d1 * exp(beta)) / (r0 + r1 * exp(beta) - i / m * (d0 + d1 * exp(beta))) AS p
      FROM n JOIN ties USING (dataset, weighting) WHERE step < 15) GROUP BY dataset, weighting, step, beta)),
f AS (SELECT dataset, weighting, beta, info FROM n WHERE step = 15),
s AS (SELECT *, r1 * exp(beta) / (r0 + r1 * exp(beta)) AS p, (d0 + d1) / (r0 + r1 * exp(beta)) AS h FROM k JOIN f USING (dataset, weighting)),
c AS (SELECT *, sum(h) OVER z AS ch, sum(h * p) OVER z AS cg FROM s WINDOW z AS (PARTITION BY dataset, weighting ORDER BY dur ROWS UNBOUNDED PRECEDING)),
v AS (SELECT dataset, weighting, beta, sqrt(sum(q00 * cg ** 2 + q01 * (cg - p) ** 2 + q10 * (exp(beta) * (ch - cg)) ** 2
  + q11 * (1 - p - exp(beta) * (ch - cg)) ** 2)) / info AS se FROM c GROUP BY dataset, weighting, beta, info)"""

_SQL_COX = _SQL_HAZARD + """
SELECT dataset, weighting, round(beta, 6) AS coefficient, round(se, 6) AS robust_se, round(exp(beta), 6) AS hr,
  round(exp(beta - 1.959963984540054 * se), 6) AS ci_lower, round(exp(beta + 1.959963984540054 * se), 6) AS ci_upper FROM v"""


def robustness_strata(spark, sf):
    """Bias, stability and shift trend of the closed-form hazard ratios."""
    return _robust(strata_hazard_ratios(spark, sf))


_SQL_ROBUST = _SQL_HAZARD + """,
hr AS (SELECT dataset, round(exp(beta), 6) AS hr FROM v WHERE weighting = 'primary'),
gold AS (SELECT hr AS gold FROM hr WHERE dataset = 'click'),
model AS (SELECT count(*) AS n, max(hr) - min(hr) AS width, var_pop(hr) AS variance FROM hr WHERE dataset NOT IN ('click', 'view', 'signup'))
SELECT 'bias' AS measure, CASE WHEN dataset = 'view' THEN 'x_rule' ELSE dataset END AS name, round(hr - gold, 6) AS value FROM hr, gold WHERE dataset NOT IN ('click', 'signup')
UNION ALL SELECT 'stability', 'models', CASE WHEN n >= 2 THEN round(width, 6) END FROM model
UNION ALL SELECT 'variance', 'models', CASE WHEN n >= 2 THEN round(variance, 6) END FROM model
UNION ALL SELECT 'trend', dataset, round(hr - gold, 6) FROM hr, gold WHERE dataset = 'signup'"""

QUERIES = {
    "iptw_weights": Bound(iptw_weights, _SQL_WEIGHTS),
    "weight_summary": Bound(weight_summary, _SQL_WEIGHT_SUMMARY),
    "overlap_summary": Bound(overlap_summary, _SQL_OVERLAP),
    "km_curve": Bound(km_curve, _SQL_KM),
    "curve_stack": Bound(curve_stack, _SQL_CURVES),
    "propensity_logit": Bound(propensity_logit),
    "cox_hr": Bound(cox_hr),
    "robustness": Bound(robustness),
    "propensity_newton": Bound(propensity_newton, _SQL_NEWTON),
    "cox_strata": Bound(cox_strata, _SQL_COX),
    "robustness_strata": Bound(robustness_strata, _SQL_ROBUST),
}
