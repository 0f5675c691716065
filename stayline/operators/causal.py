"""Propensity weighting, overlap diagnostics, weighted survival curves and hazard ratios.

All rows of all datasets travel in one long frame keyed by ``dataset``.  Row data never
reaches the driver: it receives per-dataset scalars only (means, counts, Newton steps).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import Interaction, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.typing import round6
from stayline.operators.checks import ContractError
from stayline.operators.scale import quantile_columns, running_total
from stayline.session import cut_lineage

EPSILON = 1e-6
PRIMARY_QUANTILES = (0.01, 0.99)
SENSITIVITY_QUANTILES = (0.05, 0.95)
MAX_WEIGHT = 100.0
SEVERE_OVERLAP_WIDTH = 0.10

_TIE_CHUNK = 1024
_TIME_BUCKETS = 4096
_Z975 = 1.959963984540054


class ConvergenceError(RuntimeError):
    """A model fit did not converge; its numbers must not be used."""


# --------------------------------------------------------------------------- design


@dataclass(frozen=True)
class Preprocessing:
    """Scaling and category levels fitted once and shared by all datasets."""

    continuous: dict[str, tuple[float, float]]
    categorical: dict[str, tuple[str, ...]]
    binary: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        levels = [f"{c}={level}" for c, ls in self.categorical.items() for level in ls]
        return [*self.continuous, *levels, *self.binary]

    def columns(self) -> list[Column]:
        """Design columns: standardised, one-hot (unknown level: all zero), flags."""
        scaled = [
            ((F.col(c).cast("double") - F.lit(mean)) / F.lit(scale)).alias(f"x{i}")
            for i, (c, (mean, scale)) in enumerate(self.continuous.items())
        ]
        hot = [
            F.when(F.col(c) == level, 1.0).otherwise(0.0)
            for c, levels in self.categorical.items()
            for level in levels
        ]
        flags = [F.col(c).cast("double") for c in self.binary]
        return [c.alias(f"x{i}") for i, c in enumerate([*scaled, *hot, *flags])]


def fit_preprocessing(
    reference: DataFrame,
    everything: DataFrame,
    continuous: Sequence[str],
    categorical: Sequence[str],
    binary: Sequence[str],
) -> Preprocessing:
    """Means and population deviations from the reference rows, levels from all rows."""
    moments = reference.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in continuous],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in continuous],
    ).first()
    scaling = {}
    for c in continuous:
        if moments[f"m_{c}"] is None:
            raise ContractError("the reference dataset has no eligible rows")
        scaling[c] = (float(moments[f"m_{c}"]), float(moments[f"s_{c}"]) or 1.0)
    levels = {}
    for c in categorical:
        found = (
            everything.where(F.col(c).isNotNull())
            .select(F.col(c).cast("string").alias("level"))
            .distinct()
            .collect()  # one design column per level: they are the model's size
        )
        levels[c] = tuple(sorted(row["level"] for row in found))
    return Preprocessing(scaling, levels, tuple(binary))


# ----------------------------------------------------------------------- propensity


@dataclass(frozen=True)
class PropensityFit:
    coefficients: tuple[float, ...]
    intercept: float
    iterations: int
    rows: int


def _design_vectors(design: DataFrame, features: Sequence[str], treatment: str, dataset: str) -> DataFrame:
    """Dataset, treatment, inputs, the row's vector (intercept first) and its products."""
    inputs = [f"x_{i}" for i in range(len(features))]
    narrow = design.select(
        F.col(dataset).cast("string").alias("dataset"), F.col(treatment).cast("double").alias("y"), F.lit(1.0).alias("one"),
        *[F.col(f).cast("double").alias(c) for f, c in zip(features, inputs)],
    )
    # a missing value becomes NaN, so its dataset's likelihood is not finite
    assembler = VectorAssembler(inputCols=["one", *inputs], outputCol="x", handleInvalid="keep")
    doubled = assembler.transform(narrow).withColumn("same", F.col("x"))
    return Interaction(inputCols=["x", "same"], outputCol="outer").transform(doubled).drop("one", "same")


def _likelihood_sums(vectors: DataFrame, betas: dict[str, np.ndarray]) -> dict[str, tuple[int, float, np.ndarray, np.ndarray]]:
    """Per dataset: rows, negative log likelihood, gradient and Hessian.

    The vector sums are built-in aggregates, combined in the tasks: a dataset sends one
    partial sum per task.  Weights of a vector sum may not be negative or all zero, hence
    two sums for the gradient and a smallest weight far below any other.
    """
    # one list per open fit of this call
    fitted = F.create_map(*[F.lit(v) for d, beta in betas.items() for v in (d, beta.tolist())])
    rows = vectors.where(F.col("dataset").isin(*betas)).withColumn("beta", F.try_element_at(fitted, "dataset"))
    inputs = [c for c in vectors.columns if c.startswith("x_")]
    linear = reduce(lambda a, b: a + b, [F.col("beta")[i + 1] * F.col(c) for i, c in enumerate(inputs)], F.col("beta")[0])
    rows = rows.withColumn("score", linear)
    score = F.col("score")
    bounded = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), score))
    rows = rows.withColumn("p", F.when(score.isNotNull() & ~F.isnan(score), 1 / (1 + F.exp(-bounded))).otherwise(0.5))

    def weight(value: Column) -> Column:
        return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(1e-200))

    y, p = F.col("y"), F.col("p")
    # a missing treatment or score has no likelihood
    loss = F.coalesce(F.greatest(score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score))) - y * score, F.lit(math.nan))
    summed = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(loss).alias("loss"),
        Summarizer.sum(F.col("x"), weight(y)).alias("observed"), Summarizer.sum(F.col("x"), weight(p)).alias("expected"),
        Summarizer.sum(F.col("outer"), weight(p * (1 - p))).alias("hessian"),
    )
    out = {}
    for r in summed.collect():  # fits x (features squared) numbers
        size = len(betas[r["dataset"]])
        gradient = r["observed"].toArray() - r["expected"].toArray()
        out[r["dataset"]] = (r["rows"], r["loss"], gradient, r["hessian"].toArray().reshape(size, size))
    return out


def fit_propensities(
    design: DataFrame, features: Sequence[str], treatment: str = "treatment", *,
    dataset: str = "dataset", datasets: Sequence[str] | None = None, max_iter: int = 100,
) -> tuple[dict[str, PropensityFit], dict[str, str], DataFrame]:
    """L2 logistic regressions with C = 1 and a free intercept, one per dataset, together.

    Each Newton step is one job for all datasets that are still open, so the number of jobs
    does not grow with the datasets.  A step that makes the penalised likelihood worse is
    halved.  Returns the fits, the reasons of failed ones, and the rows of fitted datasets
    with ``propensity_score``.
    """
    size = len(features) + 1
    if datasets is None:
        datasets = [r[0] for r in design.select(F.col(dataset).cast("string")).distinct().collect()]
    betas = {d: np.zeros(size) for d in datasets}
    steps, best = {d: np.zeros(size) for d in datasets}, {d: math.inf for d in datasets}
    fits: dict[str, PropensityFit] = {}
    failed: dict[str, str] = {}
    penalty = np.diag([0.0] + [1.0] * len(features))
    vectors = _design_vectors(design, features, treatment, dataset)
    for step in range(1, max_iter + 1):
        open_ = {d: b for d, b in betas.items() if d not in fits and d not in failed}
        if not open_:
            break
        sums = _likelihood_sums(vectors, open_)
        for d, beta in open_.items():
            if d not in sums:
                failed[d] = "no_rows"
                continue
            rows, loss, gradient, hessian = sums[d]
            loss += 0.5 * beta @ penalty @ beta
            if not math.isfinite(loss):
                failed[d] = "not_finite"
                continue
            if loss > best[d] + 1e-9 * abs(best[d]):
                steps[d] = steps[d] / 2
                betas[d] = beta - steps[d]
                continue
            best[d] = loss
            try:
                steps[d] = np.linalg.solve(hessian + penalty, gradient - penalty @ beta)
            except np.linalg.LinAlgError:
                failed[d] = "singular"
                continue
            if np.abs(steps[d]).max() < 1e-9 * (1 + np.abs(beta).max()):
                fits[d] = PropensityFit(tuple(beta[1:].tolist()), float(beta[0]), step, rows)
            else:
                betas[d] = beta + steps[d]
    failed |= {d: "no_convergence" for d in datasets if d not in fits and d not in failed}
    literal = design.sparkSession.createDataFrame(
        [(d, [f.intercept, *f.coefficients]) for d, f in fits.items()], "_fitted string, _coefficients array<double>"
    )
    linear = reduce(lambda a, b: a + b, [F.col("_coefficients")[i + 1] * F.col(f) for i, f in enumerate(features)])
    score = clipped(1 / (1 + F.exp(-(F.col("_coefficients")[0] + linear))))
    # one row per fit of this call
    joined = design.join(F.broadcast(literal), F.col(dataset).cast("string") == F.col("_fitted"))
    return fits, failed, joined.withColumn("propensity_score", score).drop("_fitted", "_coefficients")


def fit_propensity(
    design: DataFrame, features: Sequence[str], treatment: str = "treatment", *, max_iter: int = 100
) -> tuple[PropensityFit, DataFrame]:
    """``fit_propensities`` of one dataset; a fit that fails is an error."""
    named = design.withColumn("_dataset", F.lit("all"))
    fits, failed, scored = fit_propensities(
        named, features, treatment, dataset="_dataset", datasets=["all"], max_iter=max_iter
    )
    if failed:
        raise ConvergenceError(f"the propensity model failed: {failed['all']}")
    return fits["all"], scored.drop("_dataset")


def clipped(score: Column) -> Column:
    """Score kept away from 0 and 1."""
    return F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), score))


# -------------------------------------------------------------------------- weights


def raw_weights(rows: DataFrame, *, dataset: str = "dataset", treatment: str = "treatment") -> DataFrame:
    """Stabilised inverse-probability and overlap weights."""
    share = rows.groupBy(dataset).agg(F.avg(F.col(treatment).cast("double")).alias("_share"))
    treated = F.col(treatment).cast("int") == 1
    e = F.col("propensity_score")
    return (
        _with_dataset_values(rows, share, dataset)
        .withColumn(
            "stabilized_weight_raw",
            F.when(treated, F.col("_share") / e).otherwise((1 - F.col("_share")) / (1 - e)),
        )
        .withColumn("overlap_weight", F.when(treated, 1 - e).otherwise(e))
        .drop("_share")
    )


def _with_dataset_values(rows: DataFrame, values: DataFrame, dataset: str) -> DataFrame:
    """Attach one-row-per-dataset values.

    Adaptive execution sends the values along when it has measured them as small, and
    splits the rows of a large dataset when it joins by key.
    """
    return rows.join(values, dataset)


def truncated_weights(rows: DataFrame, *, dataset: str = "dataset") -> DataFrame:
    """Add primary (1/99 %) and sensitivity (5/95 %) truncations of the raw weight."""
    bounds = quantile_columns(
        rows,
        [dataset],
        "stabilized_weight_raw",
        {
            "primary_truncation_lower": PRIMARY_QUANTILES[0],
            "primary_truncation_upper": PRIMARY_QUANTILES[1],
            "sensitivity_truncation_lower": SENSITIVITY_QUANTILES[0],
            "sensitivity_truncation_upper": SENSITIVITY_QUANTILES[1],
        },
    )
    w = F.col("stabilized_weight_raw")
    return _with_dataset_values(rows, bounds, dataset).withColumns(
        {
            f"stabilized_weight_{kind}": F.least(
                F.greatest(w, F.col(f"{kind}_truncation_lower")), F.col(f"{kind}_truncation_upper")
            )
            for kind in ("primary", "sensitivity")
        }
    )


def weight_summary(rows: DataFrame, *, dataset: str = "dataset") -> DataFrame:
    """Distribution of the primary weight and truncation bounds and rates per dataset."""
    raw, primary = F.col("stabilized_weight_raw"), F.col("stabilized_weight_primary")

    def rate(kind: str) -> Column:
        return F.avg((F.col(f"stabilized_weight_{kind}") != raw).cast("double"))

    moments = rows.groupBy(dataset).agg(
        rate("primary").alias("primary_truncated_rate"),
        rate("sensitivity").alias("sensitivity_truncated_rate"),
        *[
            F.max(f"{kind}_truncation_{side}").alias(f"{kind}_truncation_{side}")
            for kind in ("primary", "sensitivity")
            for side in ("lower", "upper")
        ],
        F.min(primary).alias("primary_weight_min"),
        F.max(primary).alias("primary_weight_max"),
        F.avg(primary).alias("primary_weight_mean"),
        F.stddev_pop(primary).alias("primary_weight_std"),
    )
    quantiles = quantile_columns(
        rows,
        [dataset],
        "stabilized_weight_primary",
        {f"primary_weight_p{q:02d}": q / 100 for q in (1, 5, 25, 50, 75, 95, 99)},
    )
    return moments.join(quantiles, dataset)


def overlap_summary(
    rows: DataFrame,
    *,
    dataset: str = "dataset",
    treatment: str = "treatment",
    severe_width: float = SEVERE_OVERLAP_WIDTH,
) -> DataFrame:
    """Propensity range per arm, its intersection, width and the severe-overlap flag."""
    e, treated = F.col("propensity_score"), F.col(treatment).cast("int") == 1
    ranges = rows.groupBy(dataset).agg(
        F.min(e).alias("propensity_min"),
        F.max(e).alias("propensity_max"),
        F.min(F.when(treated, e)).alias("treated_ps_min"),
        F.max(F.when(treated, e)).alias("treated_ps_max"),
        F.min(F.when(~treated, e)).alias("control_ps_min"),
        F.max(F.when(~treated, e)).alias("control_ps_max"),
    )
    low = F.greatest("treated_ps_min", "control_ps_min")
    high = F.least("treated_ps_max", "control_ps_max")
    width = F.greatest(F.lit(0.0), high - low)
    return ranges.withColumns(
        {
            "overlap_lower": F.when(high >= low, low),
            "overlap_upper": F.when(high >= low, high),
            "overlap_width": width,
            "severe_overlap_flag": width < severe_width,
        }
    )


# ------------------------------------------------------------------------- survival


def _time_table(
    rows: DataFrame, dataset: str, duration: str, event: str, treatment: str, weights: dict[str, str]
) -> DataFrame:
    """One row per (dataset, weighting, duration) with weighted counts by arm.

    Durations are taken as they are; stored follow-up is rounded to six decimals, which
    bounds the table by the follow-up horizon.
    """
    weighting = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("weighting"), F.col(c).alias("w")) for k, c in weights.items()]
        )
    )
    died = F.col("_event") == 1
    arms = {0: F.col("_arm") == 0, 1: F.col("_arm") == 1}
    w = F.col("_v.w")
    sums = []
    for a, arm in arms.items():
        sums += [
            F.sum(F.when(arm, w).otherwise(0.0)).alias(f"w{a}"),
            F.sum(F.when(arm & died, w).otherwise(0.0)).alias(f"d{a}"),
            F.sum(F.when(arm & died, w * w).otherwise(0.0)).alias(f"q{a}1"),
            F.sum(F.when(arm & ~died, w * w).otherwise(0.0)).alias(f"q{a}0"),
            F.count_if(arm).alias(f"n{a}"),
        ]
    return (
        rows.select(
            F.col(dataset).alias("dataset"),
            F.col(duration).cast("double").alias("time"),
            F.col(event).cast("int").alias("_event"),
            F.col(treatment).cast("int").alias("_arm"),
            weighting.alias("_v"),
        )
        .groupBy("dataset", F.col("_v.weighting").alias("weighting"), "time")
        .agg(F.count_if(died).alias("deaths"), *sums)
    )


def _with_buckets(table: DataFrame, horizon: float) -> DataFrame:
    """Time buckets for prefix sums: equal slices of the follow-up horizon."""
    return table.withColumn("_bucket", F.floor(F.col("time") * F.lit(_TIME_BUCKETS / horizon)))


def weighted_survival(
    rows: DataFrame,
    *,
    weight: str,
    dataset: str = "dataset",
    duration: str = "followup_duration_days",
    event: str = "event",
    treatment: str = "treatment",
    horizon: float = 28.0,
) -> DataFrame:
    """Weighted Kaplan-Meier curve per dataset and arm, starting with 1 at time 0.

    Rows first collapse to one per distinct time; the risk set is a reverse running sum
    over time buckets.  When everyone left dies the curve is exactly 0: the logarithm
    there is undefined and is not summed.
    """
    # small and read several times below, so it is written once
    table = cut_lineage(_time_table(rows, dataset, duration, event, treatment, {"w": weight}))
    arms = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("treatment_group"),
                    F.col(f"w{a}").alias("w"),
                    F.col(f"d{a}").alias("d"),
                    F.col(f"n{a}").alias("n"),
                )
                for a, name in ((0, "control"), (1, "treated"))
            ]
        )
    )
    keys = ["dataset", "treatment_group"]
    long = (
        table.select("dataset", "time", arms.alias("a"))
        .select("dataset", "a.treatment_group", "time", "a.w", "a.d", "a.n")
        .where(F.col("n") > 0)
    )
    # every curve starts at time 0, where an arm without a row there loses nothing
    none = F.lit(0.0)
    start = long.select(*keys, none.alias("time"), none.alias("w"), none.alias("d")).distinct()
    timed = (
        long.select(*keys, "time", "w", "d")
        .unionByName(start)
        .groupBy(*keys, "time")
        .agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    )
    at_risk = running_total(
        _with_buckets(timed, horizon), keys, "time", ["_bucket"], {"risk": "w"}, descending=True
    )
    steps = at_risk.withColumns(
        {
            "_all": ((F.col("d") > 0) & (F.col("d") >= F.col("risk"))).cast("int"),
            "_log": F.when(F.col("d") < F.col("risk"), F.log1p(-F.col("d") / F.col("risk"))).otherwise(0.0),
        }
    )
    summed = running_total(steps, keys, "time", ["_bucket"], {"_ended": "_all", "_total": "_log"})
    return summed.select(
        *keys,
        F.col("time").alias("timeline_days"),
        F.when(F.col("_ended") > 0, 0.0).otherwise(F.exp("_total")).alias("survival_probability"),
    )


# ------------------------------------------------------------------------------ cox


def _ties(table: DataFrame) -> DataFrame:
    """Death times with risk sets, split into chunks of tied deaths.

    The tie correction sums one term per tied death.  A time with very many deaths is
    spread over chunk rows, so no term list grows with the group.
    """
    return (
        table.where(F.col("deaths") > 0)
        .select(
            "dataset", "weighting", "time", "deaths", "d0", "d1", "risk0", "risk1",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deaths") - 1, F.lit(_TIE_CHUNK).cast("bigint"))).alias("_from"),
        )
        .withColumn("_to", F.least(F.col("_from") + (_TIE_CHUNK - 1), F.col("deaths") - 1))
    )


def _slopes(ties: DataFrame, betas: dict[tuple[str, str], float]) -> dict[tuple[str, str], tuple[float, float]]:
    """Score and information of the weighted tie-corrected partial likelihood per fit."""
    spark = ties.sparkSession
    literal = spark.createDataFrame(
        [(d, w, b) for (d, w), b in betas.items()], "dataset string, weighting string, beta double"
    )
    m = F.col("deaths").cast("double")
    phi = F.exp("beta")
    risk_x, dead_x = F.col("risk1") * phi, F.col("d1") * phi
    risk, dead = F.col("risk0") + risk_x, F.col("d0") + dead_x

    def share(i: Column) -> Column:
        part = i.cast("double") / m
        return (risk_x - part * dead_x) / (risk - part * dead)

    terms = F.transform(F.sequence("_from", "_to"), share)
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("v"))
    summed = F.aggregate(
        terms,
        zero,
        lambda acc, p: F.struct((acc["p"] + p).alias("p"), (acc["v"] + p * (1 - p)).alias("v")),
    )
    mean_weight = (F.col("d0") + F.col("d1")) / m
    found = (
        ties.join(F.broadcast(literal), ["dataset", "weighting"])
        .withColumn("_t", summed)
        .groupBy("dataset", "weighting")
        .agg(
            F.sum(F.when(F.col("_from") == 0, F.col("d1")).otherwise(0.0) - mean_weight * F.col("_t.p")).alias("score"),
            F.sum(mean_weight * F.col("_t.v")).alias("information"),
        )
        .collect()
    )
    return {(r["dataset"], r["weighting"]): (r["score"], r["information"]) for r in found}


def _newton(
    ties: DataFrame, fits: Sequence[tuple[str, str]], max_iter: int
) -> tuple[dict[tuple[str, str], tuple[float, float]], dict[tuple[str, str], str]]:
    """Newton steps for all fits at once: one small job per step for every open fit.

    Returns (coefficient, information) of the solved fits and the reason of each failure.
    """
    betas = {fit: 0.0 for fit in fits}
    solved: dict[tuple[str, str], tuple[float, float]] = {}
    failed: dict[tuple[str, str], str] = {}
    for _ in range(max_iter):
        open_fits = {f: b for f, b in betas.items() if f not in solved and f not in failed}
        if not open_fits:
            break
        slopes = _slopes(ties, open_fits)
        for fit, beta in open_fits.items():
            score, information = slopes.get(fit, (0.0, 0.0))
            if not information > 1e-12 or not math.isfinite(score):
                failed[fit] = "no information about the effect"
                continue
            step = score / information
            if abs(step) < 1e-9:
                solved[fit] = (beta, information)
                continue
            # long steps are shortened; the likelihood is concave in one coefficient
            betas[fit] = beta + max(-2.0, min(2.0, step))
            if abs(betas[fit]) > 30:
                failed[fit] = "the effect diverges"
    for fit in fits:
        if fit not in solved and fit not in failed:
            failed[fit] = f"no convergence in {max_iter} steps"
    return solved, failed


def weighted_hazard_ratios(
    rows: DataFrame,
    weights: dict[str, str],
    *,
    dataset: str = "dataset",
    duration: str = "followup_duration_days",
    event: str = "event",
    treatment: str = "treatment",
    horizon: float = 28.0,
    max_iter: int = 50,
    failures: dict[tuple[str, str], str] | None = None,
) -> DataFrame:
    """Weighted Cox hazard ratio of a binary treatment with robust 95 % limits.

    ``weights`` maps a weighting name to a weight column; all datasets and weightings are
    fitted together.  With one binary covariate the partial likelihood depends only on a
    table of weighted deaths and risk sets per distinct time.  Ties use the weighted Efron
    correction; the variance is the sandwich of weighted score residuals, whose risk sets
    at tied times are the full ones.

    Result: (dataset, weighting, coefficient, robust_se, hr, ci_lower, ci_upper).  A fit
    that fails raises, or is noted in ``failures`` and left out when that is given.
    """
    spark = rows.sparkSession
    table = cut_lineage(_time_table(rows, dataset, duration, event, treatment, weights))
    keys = ["dataset", "weighting"]
    risk = running_total(
        _with_buckets(table, horizon), keys, "time", ["_bucket"],
        {"risk0": "w0", "risk1": "w1"}, descending=True,
    )
    risk = cut_lineage(risk)
    fits = [(r["dataset"], r["weighting"]) for r in risk.select(*keys).distinct().collect()]
    ties = cut_lineage(_ties(risk))
    solved, failed = _newton(ties, fits, max_iter)
    if failures is None and failed:
        raise ConvergenceError("; ".join(f"hazard model of {fit}: {why}" for fit, why in failed.items()))
    if failures is not None:
        failures.update(failed)

    literal = spark.createDataFrame(
        [(d, w, beta, info) for (d, w), (beta, info) in solved.items()],
        "dataset string, weighting string, coefficient double, information double",
    )
    phi = F.exp("coefficient")
    total = F.col("risk0") + F.col("risk1") * phi
    share = F.col("risk1") * phi / total
    hazard = (F.col("d0") + F.col("d1")) / total
    steps = risk.join(F.broadcast(literal), keys).withColumns(
        {"_p": share, "_h": hazard, "_hp": hazard * share}
    )
    summed = running_total(steps, keys, "time", ["_bucket"], {"_H": "_h", "_G": "_hp"})

    def residual(arm: int, died: int) -> Column:
        risk_score = F.col("coefficient")
        scale = F.exp(risk_score) if arm else F.lit(1.0)
        expected = scale * ((F.col("_H") if arm else F.lit(0.0)) - F.col("_G"))
        return (F.lit(float(arm)) - F.col("_p") - expected) if died else -expected

    meat = reduce(
        lambda a, b: a + b,
        [
            F.col(f"q{arm}{died}") * residual(arm, died) * residual(arm, died)
            for arm in (0, 1)
            for died in (0, 1)
        ],
    )
    fitted = summed.groupBy(*keys, "coefficient", "information").agg(F.sum(meat).alias("_meat"))
    se = F.sqrt("_meat") / F.col("information")
    z = F.lit(_Z975)
    return fitted.select(
        *keys,
        "coefficient",
        se.alias("robust_se"),
        F.exp("coefficient").alias("hr"),
        F.exp(F.col("coefficient") - z * se).alias("ci_lower"),
        F.exp(F.col("coefficient") + z * se).alias("ci_upper"),
    )


# ------------------------------------------------------------------------- guards


def estimation_guards(
    rows: DataFrame, *, dataset: str = "dataset", weight: str | None = None, max_weight: float = MAX_WEIGHT
) -> DataFrame:
    """(dataset, verdict): the first violated guard, NULL when the dataset may be fitted.

    One pass with one row per dataset.  With a ``weight`` column the largest weight is
    guarded too.
    """
    t, e, f = F.col("treatment").cast("int"), F.col("event").cast("int"), F.col("followup_duration_days")
    verdict = F.when(F.count_if(t.isNull()) > 0, "treatment_missing")
    for broken, code in (
        (F.count_if(e.isNull()) > 0, "outcome_missing"),
        (F.count_if(f.isNull()) > 0, "followup_missing"),
        (F.count_if(f <= 0) > 0, "followup_not_positive"),
        (F.min(t) == F.max(t), "one_treatment_arm"),
        (F.min(e) == F.max(e), "one_outcome"),
    ):
        verdict = verdict.when(broken, code)
    if weight is not None:
        verdict = verdict.when(F.max(weight) > max_weight, "extreme_weight")
    return rows.groupBy(dataset).agg(verdict.alias("verdict"))


# --------------------------------------------------------------------- robustness


def robustness(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bias against gold, stability over models, and the trend over shifts.

    ``results`` has one row per dataset and scope: dataset_name, dataset_type,
    analysis_scope, source_predictor_name, synthetic_shift_hours, primary_hr.
    """
    wanted = ("dataset_name", "dataset_type", "source_predictor_name", "synthetic_shift_hours", "primary_hr")
    # a few rows behind long plans, read four times below
    full = cut_lineage(results.where((F.col("analysis_scope") == "full_cohort") & F.col("primary_hr").isNotNull()).select(*wanted))
    gold = full.where(F.col("dataset_name") == "gold").agg(F.max("primary_hr").alias("gold_hr"))
    gold_hr = gold.first()["gold_hr"]
    reference = F.lit(gold_hr).cast("double")
    difference = round6(F.col("primary_hr") - reference)
    compared = (F.col("dataset_type") == "model") | (F.col("dataset_name") == "x_rule")
    bias = full.where(compared & reference.isNotNull()).select("dataset_name", difference.alias("hr_bias"))
    models = full.where(F.col("dataset_type") == "model").agg(
        F.count(F.lit(1)).alias("model_count"),
        round6(F.max("primary_hr") - F.min("primary_hr")).alias("stability"),
        round6(F.var_pop("primary_hr")).alias("variance_across_models"),
    )
    enough = F.col("model_count") >= 2
    models = models.select(
        "model_count",
        F.when(enough, F.col("stability")).alias("stability"),
        F.when(enough, F.col("variance_across_models")).alias("variance_across_models"),
    )
    trend = (
        full.where((F.col("dataset_type") == "synthetic") & F.col("synthetic_shift_hours").isNotNull())
        .select(
            "dataset_name",
            "source_predictor_name",
            F.col("synthetic_shift_hours").alias("shift_hours"),
            "primary_hr",
            difference.alias("gold_hr_difference"),
        )
        .orderBy("source_predictor_name", "shift_hours")
    )
    return bias, models, trend
