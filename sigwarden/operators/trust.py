"""The composite trust score: six components of 0 to 100, a weighted mean, a category and an explanation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import run_summaries
from ..functions.stats import clip, flag, ratio, safe_corr
from ..session import cut

# Default weights and the categories' lower bounds.
WEIGHTS = {
    "signal_quality_score": 0.25,
    "artifact_burden_score": 0.20,
    "temporal_stability_score": 0.20,
    "missingness_risk_score": 0.15,
    "device_bias_score": 0.10,
    "confounding_risk_score": 0.10,
}
CATEGORIES = (("high", 80), ("moderate", 60), ("low", 40))
COMPONENTS = tuple(WEIGHTS)


def component_scores(df: DataFrame, key: str, cohort_hr: bool = True, order: tuple[str, ...] = ("date",), few_keys: bool = False) -> DataFrame:
    """The six components by ``key``; NULL keys are left out, absent columns give NULL components.

    One shuffle by key serves the run lengths and the aggregates: rows get their run's number by a
    window, runs are summed up, and runs add up to keys. ``cohort_hr`` compares a group's heart rate with
    the mean of all (else a group of several devices has no device component). With ``few_keys`` (strata) a key may have a large part
    of all rows: run lengths then come from mergeable summaries of ranges, and no task sees a key's rows together.
    """
    by = _sums(df, [key], order, few_keys)
    if cohort_hr:
        by = by.join(F.broadcast(df.filter(F.col(key).isNotNull()).agg(F.avg(_value(df, "resting_hr")).alias("cohort_hr"))))  # one row
    else:
        by = by.withColumn("cohort_hr", F.lit(None).cast("double"))
    return by.select(key, *_components(df))


def scores_of_cohorts(df: DataFrame, cohort: str, key: str = "participant_id", order: tuple[str, ...] = ("date",), further: Sequence[Column] = ()) -> DataFrame:
    """(cohort, key, n_days, components, overall, ``further`` aggregates of a key's rows) of several cohorts, in one pass over the rows.

    A cohort's mean heart rate comes from its keys' sums. Rows that are partitioned by ``key`` are not shuffled.
    """
    hr = _value(df, "resting_hr")
    by = cut(_sums(df, [cohort, key], order, further=[F.sum(hr).alias("hr_sum"), F.count(hr).alias("hr_n"), *further]))
    held = by.columns[by.columns.index("hr_n") + 1 :]
    mean = by.groupBy(F.col(cohort).alias("__cohort")).agg(ratio(F.sum("hr_sum"), F.sum("hr_n").cast("double")).alias("cohort_hr"))
    by = by.join(F.broadcast(mean), F.col(cohort) == F.col("__cohort"))  # a row for each cohort
    return by.select(cohort, key, *_components(df), *held).withColumn("overall", overall())


def _value(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("double")


def _sums(df: DataFrame, keys: list[str], order: tuple[str, ...], few_keys: bool = False, further: Sequence[Column] = ()) -> DataFrame:
    """What the components are made of, by ``keys``."""
    key = keys[-1]
    has = lambda c: c in df.columns
    value = lambda c: _value(df, c)
    held = df
    for k in keys:
        held = held.filter(F.col(k).isNotNull())
    by_order = [*order, *(["participant_id"] if "participant_id" in df.columns and key != "participant_id" else [])]
    missing = flag(value("missing_wearable_flag") == 1)
    sums = held.withColumn("__missing", missing)
    if not few_keys:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in by_order])
        sums = sums.withColumn("__run", F.sum(1 - F.col("__missing")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # Run lengths: within a run the counter only grows, so its place in the run is a difference of row numbers.
        sums = sums.withColumn("__at", F.sum("__missing").over(Window.partitionBy(*keys, "__run").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)))
    quality, wear, hrv, hr = value("signal_quality_ground_truth"), value("wearable_minutes"), value("hrv_rmssd"), value("resting_hr")
    device = F.col("device_type") if has("device_type") else F.lit(None).cast("string")
    a, b = F.when(hrv.isNotNull(), value("heat_index")), F.when(value("heat_index").isNotNull(), hrv)
    pairs = F.count(a)
    by = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(quality).alias("quality"),
        F.avg(F.coalesce(wear, F.lit(0.0)) / 1440).alias("wear") if has("wearable_minutes") else F.lit(None).cast("double").alias("wear"),
        F.avg(value("artifact_burden_ground_truth")).alias("burden"),
        F.count(hrv).alias("n_hrv"),
        F.avg(hrv).alias("hrv_mean"),
        F.stddev_pop(hrv).alias("hrv_std"),
        F.avg("__missing").alias("missing_rate"),
        F.lit(None).cast("long").alias("longest") if few_keys else F.max("__at").alias("longest"),
        F.size(F.collect_set(device)).alias("n_devices") if further else F.count_distinct(device).alias("n_devices"),
        F.avg(hr).alias("hr_mean"),
        pairs.alias("n_pairs"),
        safe_corr(a, b, 5, 1e-6).alias("r"),
        *further,
    )
    if few_keys:
        by = by.drop("longest").join(run_summaries(held, key, [F.col(c) for c in by_order], missing == 1).select(key, "longest"), key)
    return by


def _components(df: DataFrame) -> list[Column | str]:
    """n_days and the components, of the sums of ``df``."""
    has = lambda c: c in df.columns
    stability = F.when(F.col("hrv_mean") <= 0, 0.0).otherwise(100 * (1 - F.least(ratio(F.col("hrv_std"), F.col("hrv_mean")), F.lit(1.0))))
    return [
        "n_days",
        clip(100 * F.coalesce("quality", "wear"), 0, 100).alias("signal_quality_score"),
        clip(100 * (1 - F.col("burden")), 0, 100).alias("artifact_burden_score"),
        F.when(F.col("n_hrv") >= 5, clip(stability, 0, 100)).alias("temporal_stability_score"),
        (clip(100 * (1 - 0.7 * F.col("missing_rate") - 0.3 * F.least(F.col("longest") / 7, F.lit(1.0))), 0, 100) if has("missing_wearable_flag") else F.lit(None).cast("double")).alias("missingness_risk_score"),
        (F.when(F.col("n_devices") <= 1, 100.0).when(F.col("cohort_hr").isNotNull() & F.col("hr_mean").isNotNull(), 100 * (1 - F.least(F.abs(F.col("hr_mean") - F.col("cohort_hr")) / 10, F.lit(1.0)))) if has("device_type") else F.lit(None).cast("double")).alias("device_bias_score"),
        F.when(F.col("n_pairs") >= 5, 100 * (1 - F.abs(F.coalesce("r", F.lit(0.0))))).alias("confounding_risk_score"),
    ]


def overall(weights: Mapping[str, float] = WEIGHTS, least: int = 3) -> Column:
    """Weighted mean of the components that are there, NULL under ``least`` of them."""
    total = sum((F.when(F.col(c).isNotNull(), F.col(c) * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    there = sum((F.col(c).isNotNull().cast("int") for c in weights), F.lit(0))
    return F.when(there >= least, F.round(ratio(total, weight), 2))


def overall_from_components(weights: Mapping[str, float]) -> Column:
    """Dot product with normalised weights; a missing component makes it NULL."""
    total = float(sum(weights.values()))
    return sum((F.col(c) * (w / total) for c, w in weights.items()), F.lit(0.0))


def category(score: Column) -> Column:
    out = F.when(score.isNull(), "insufficient_data")
    for name, bound in CATEGORIES:
        out = out.when(score >= bound, name)
    return out.otherwise("unreliable")


def explanation(score: Column, label: Column, key: Column) -> Column:
    """Names the strongest and the weakest component; ties go to the first component."""
    items = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.lit(-i).alias("at"), F.lit(c.removesuffix("_score")).alias("name"))) for i, c in enumerate(COMPONENTS)]))
    worst = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.lit(i).alias("at"), F.lit(c.removesuffix("_score")).alias("name"))) for i, c in enumerate(COMPONENTS)]))
    hi, lo = F.array_max(items), F.array_min(worst)
    text = F.concat(key, F.lit(": trust "), label, F.lit(", strongest "), hi["name"], F.lit(" "), F.format_number(hi["v"], 1), F.lit(", weakest "), lo["name"], F.lit(" "), F.format_number(lo["v"], 1))
    return F.when(score.isNull(), F.concat(key, F.lit(": too few components for a score"))).otherwise(text)


def score_groups(df: DataFrame, key: str, weights: Mapping[str, float] = WEIGHTS, cohort_hr: bool = True, order: tuple[str, ...] = ("date",)) -> DataFrame:
    scored = component_scores(df, key, cohort_hr, order).withColumn("overall", overall(weights))
    scored = scored.withColumn("category", category(F.col("overall")))
    return scored.withColumn("explanation", explanation(F.col("overall"), F.col("category"), F.col(key)))


def cohort_scores(df: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """One row for each participant: components, overall, category, explanation."""
    if "participant_id" not in df.columns:
        raise ValueError("participant_id is missing")
    return score_groups(df, "participant_id", weights)
