"""Scores by stratum, their gaps, and learned component weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import quantiles, running_sums
from ..functions.stats import with_average_rank
from ..session import cut
from . import reliability
from .trust import COMPONENTS, WEIGHTS, category, component_scores, overall, overall_from_components


def with_quartiles(df: DataFrame, column: str, name: str = "stratum", among: DataFrame | None = None) -> DataFrame:
    """Q1 to Q4 by exact quartiles of the column in ``df`` (or in ``among``), right-closed; if edges coincide, low and high around the median."""
    edges = quantiles(df if among is None else among, [column], [q / 4 for q in range(5)])[column]
    c = F.col(column)
    if None in edges:
        return df.withColumn(name, F.lit(None).cast("string"))
    if len(set(edges)) == 5:
        cuts = F.when(c <= edges[1], "Q1").when(c <= edges[2], "Q2").when(c <= edges[3], "Q3").otherwise("Q4")
    else:
        cuts = F.when(c <= edges[2], "low").otherwise("high")
    return df.withColumn(name, F.when(c.isNotNull(), cuts))


def stratified(df: DataFrame, column: str, binning: str = "quartile", name: str = "stratum") -> DataFrame:
    if column not in df.columns:
        raise KeyError(column)
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    return with_quartiles(df, column, name) if numeric and binning != "none" else df.withColumn(name, F.col(column).cast("string"))


def fairness_audit(df: DataFrame, column: str, binning: str = "quartile", least: int = 10, replicates: int = 0, weights: Mapping[str, float] = WEIGHTS, seed: int = 42) -> DataFrame:
    """(stratum, n_days, components, overall, category[, ci_low, ci_high]) for strata of at least ``least`` rows.

    Strata with several devices have no device component. With ``replicates`` participants are resampled
    by stratum (three at least) for an interval of the overall score.
    """
    rows = stratified(df, column, binning)
    scored = component_scores(rows, "stratum", cohort_hr=False, few_keys=True).filter(F.col("n_days") >= least).withColumn("overall", overall(weights))
    scored = scored.withColumn("category", category(F.col("overall")))
    return scored.join(bootstrap_overall(rows, "stratum", weights, replicates, seed), "stratum", "left") if replicates else scored


def bootstrap_overall(rows: DataFrame, key: str, weights: Mapping[str, float] = WEIGHTS, replicates: int = 100, seed: int = 42) -> DataFrame:
    """(key, ci_low, ci_high): percentile interval over resampled participants.

    Participants are reduced to sums once; a replicate weighs them. The longest run is the longest of the
    drawn participants.
    """
    w = Window.partitionBy(key, "participant_id").orderBy("date")
    missing = F.coalesce((F.col("missing_wearable_flag") == 1).cast("int"), F.lit(0))
    runs = rows.withColumn("__m", missing).withColumn("__g", F.sum(1 - F.col("__m")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("__l", F.sum("__m").over(Window.partitionBy(key, "participant_id", "__g").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    ok = F.col("heat_index").isNotNull() & F.col("hrv_rmssd").isNotNull()
    x, y = F.when(ok, F.col("heat_index")), F.when(ok, F.col("hrv_rmssd"))
    sums = {
        "days": F.count(F.lit(1)), "q_n": F.count("signal_quality_ground_truth"), "q": F.sum("signal_quality_ground_truth"), "b_n": F.count("artifact_burden_ground_truth"), "b": F.sum("artifact_burden_ground_truth"),
        "v_n": F.count("hrv_rmssd"), "v": F.sum("hrv_rmssd"), "vv": F.sum(F.col("hrv_rmssd") * F.col("hrv_rmssd")), "miss": F.sum("__m"), "n": F.count(x), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y),
    }
    own = runs.groupBy(key, "participant_id").agg(*[F.coalesce(e, F.lit(0)).cast("double").alias(c) for c, e in sums.items()], F.max("__l").alias("longest"), F.min("device_type").alias("d_low"), F.max("device_type").alias("d_high"))
    enough = own.groupBy(key).agg(F.count(F.lit(1)).alias("__p")).filter("__p >= 3").select(key)
    drawn = own.join(enough, key, "left_semi").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", reliability.bootstrap_weight(F.col("participant_id"), F.col("rep"), seed)).filter("w > 0")
    t = drawn.groupBy(key, "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums], F.max("longest").alias("longest"), (F.min("d_low").eqNullSafe(F.max("d_high"))).alias("one_device"))
    c = {n: F.col(n) for n in sums}
    div = lambda a, b: F.try_divide(a, b)
    clip = lambda e: F.least(F.greatest(e, F.lit(0.0)), F.lit(100.0))
    std = F.sqrt(F.greatest(div(c["vv"], c["v_n"]) - div(c["v"], c["v_n"]) ** 2, F.lit(0.0)))
    vx, vy = div(c["sxx"], c["n"]) - div(c["sx"], c["n"]) ** 2, div(c["syy"], c["n"]) - div(c["sy"], c["n"]) ** 2
    r = div(div(c["sxy"], c["n"]) - div(c["sx"], c["n"]) * div(c["sy"], c["n"]), F.sqrt(vx * vy))
    scored = t.select(
        key, "rep",
        F.when(c["q_n"] > 0, clip(100 * div(c["q"], c["q_n"]))).alias("signal_quality_score"), F.when(c["b_n"] > 0, clip(100 * (1 - div(c["b"], c["b_n"])))).alias("artifact_burden_score"),
        F.when(c["v_n"] >= 5, F.when(c["v"] <= 0, 0.0).otherwise(clip(100 * (1 - F.least(div(std, div(c["v"], c["v_n"])), F.lit(1.0)))))).alias("temporal_stability_score"),
        clip(100 * (1 - 0.7 * div(c["miss"], c["days"]) - 0.3 * F.least(F.col("longest") / 7, F.lit(1.0)))).alias("missingness_risk_score"),
        F.when(F.col("one_device"), 100.0).alias("device_bias_score"), F.when(c["n"] >= 5, 100 * (1 - F.abs(F.coalesce(r, F.lit(0.0))))).alias("confounding_risk_score"),
    )
    return scored.withColumn("o", overall(weights)).groupBy(key).agg(F.percentile("o", F.lit(0.025)).alias("ci_low"), F.percentile("o", F.lit(0.975)).alias("ci_high"))


def disparity_summary(strata: DataFrame, components: Sequence[str] = (*COMPONENTS, "overall")) -> DataFrame:
    """(component, lowest, highest, disparity, lowest_stratum, highest_stratum), largest gap first; empty for under two strata."""
    held = [c for c in components if c in strata.columns]
    tall = strata.unpivot(["stratum"], held, "component", "score").filter("score is not null")
    by = tall.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.min_by("stratum", F.struct("score", "stratum")).alias("lowest_stratum"), F.min_by("stratum", F.struct(-F.col("score"), F.col("stratum"))).alias("highest_stratum"))
    return by.filter("n >= 2").select("component", "lowest", "highest", (F.col("highest") - F.col("lowest")).alias("disparity"), "lowest_stratum", "highest_stratum").orderBy(F.desc("disparity"), "component")


def multi_stratify(df: DataFrame, columns: Sequence[str], **options) -> dict[str, DataFrame]:
    """An audit for each column that is there."""
    return {c: fairness_audit(df, c, **options) for c in columns if c in df.columns}


# weights


def candidate_weights(n: int, seed: int = 0, centre: Sequence[float] | None = None, step: float = 0.05) -> np.ndarray:
    """``n`` uniform points of the simplex; around a centre: each weight a step up and down, renormalised."""
    if centre is None:
        return np.random.default_rng(seed).dirichlet(np.ones(len(COMPONENTS)), n)
    near = [np.maximum(np.asarray(centre) + s * step * e, 0) for e in np.eye(len(centre)) for s in (1, -1)]
    return np.array([w / w.sum() for w in near if w.sum() > 0])


def weight_objectives(scores: DataFrame, target: DataFrame, weights: np.ndarray, key: str = "participant_id", value: str = "reproducibility", least: int = 5) -> DataFrame:
    """(candidate, n, rho): rank correlation of each candidate's overall score with the target. All candidates in one job.

    A score is missing for every candidate or for none, so targets are ranked once. Rows become counts and sums of target ranks by candidate and score; scores'
    ranks come from running sums over these, and the correlation from sums, so no rank goes back to a row.
    """
    whole = " and ".join(f"{c} is not null" for c in (value, *COMPONENTS))
    rows = cut(scores.join(target, key).filter(whole).select(F.col(value).alias("y"), *COMPONENTS))
    middle = (rows.count() + 1) / 2
    columns = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
    score = sum((F.col(c) * F.get("w", F.lit(i)) for i, c in enumerate(COMPONENTS)), F.lit(0.0)) / F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    ranked = with_average_rank(rows, "y", "ry").select((F.col("ry") - middle).alias("b"), *COMPONENTS, F.posexplode(columns).alias("candidate", "w")).select("candidate", "b", F.round(score, 9).alias("x"))
    cells = ranked.groupBy("candidate", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    a = F.col("before") + (F.col("n") + 1) / 2.0 - middle
    placed = running_sums(cells, [F.col("x")], {"before": F.col("n")}, ["candidate"]).withColumn("a", a)
    sums = placed.groupBy("candidate").agg(F.sum("n").alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("n") * F.col("a") * F.col("a")).alias("aa"), F.sum("bb").alias("bb"))
    return sums.select("candidate", "n", F.when((F.col("n") >= least) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))


def learn_weights(scores: DataFrame, target: DataFrame, candidates: int = 400, rounds: int = 6, holdout: float = 0.3, seed: int = 0, key: str = "participant_id", value: str = "reproducibility") -> dict:
    """Weights with the best rank correlation on the training participants, and that on the held-out ones.

    The search is a small table of candidates met with one row a participant; only correlations reach the
    driver. Too few participants give the default weights.
    """
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000)) / 1000.0
    scores = scores.select(key, *COMPONENTS).filter(" and ".join(f"{c} is not null" for c in COMPONENTS)).cache()
    train, held = scores.filter(u >= holdout), scores.filter(u < holdout)
    best_of = lambda w: max(((r["rho"], -r["candidate"]) for r in weight_objectives(train, target, w, key, value).collect() if r["rho"] is not None), default=None)
    w = candidate_weights(candidates, seed)
    top = best_of(w)
    default = {"weights": dict(WEIGHTS), "rho_train": None, "rho_holdout": None, "evaluations": candidates}
    if top is None:
        scores.unpersist()
        return default
    rho, current, tried = top[0], w[-top[1]], candidates
    for _ in range(rounds):
        near = candidate_weights(0, centre=current)
        tried += len(near)
        top = best_of(near)
        if top is None or top[0] <= rho:
            break
        rho, current = top[0], near[-top[1]]
    out = weight_objectives(held, target, np.array([current]), key, value).collect()
    scores.unpersist()
    return {"weights": dict(zip(COMPONENTS, map(float, current))), "rho_train": rho, "rho_holdout": out[0]["rho"] if out else None, "evaluations": tried}


def perturbed_weights(weights: Mapping[str, float] = WEIGHTS, magnitudes: Sequence[float] = (0.05, 0.1, 0.2, 0.4), draws: int = 50, seed: int = 0) -> np.ndarray:
    """``draws`` noisy weightings for each magnitude in turn, each with a sum of 1."""
    rng = np.random.default_rng(seed)
    base = np.array([weights[c] for c in COMPONENTS])
    noisy = np.array([np.maximum(base * (1 + rng.normal(0, m, len(base))), 1e-9) for m in magnitudes for _ in range(draws)])
    return noisy / noisy.sum(axis=1, keepdims=True)


def sensitivity_table(scores: DataFrame, weights: Mapping[str, float] = WEIGHTS, magnitudes: Sequence[float] = (0.05, 0.1, 0.2, 0.4), draws: int = 50, seed: int = 0, key: str = "participant_id") -> DataFrame:
    """(magnitude, median_rho, min_rho): rank correlation of scores under perturbed weights with those under ``weights``."""
    target = scores.select(key, overall_from_components(weights).alias("reproducibility"))
    rho = weight_objectives(scores, target, perturbed_weights(weights, magnitudes, draws, seed), key)
    at = F.array(*[F.lit(float(m)) for m in magnitudes])
    return rho.withColumn("magnitude", F.get(at, F.floor(F.col("candidate") / draws).cast("int"))).groupBy("magnitude").agg(F.percentile("rho", F.lit(0.5)).alias("median_rho"), F.min("rho").alias("min_rho"))
