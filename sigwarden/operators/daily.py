"""Participant-day operators: derived columns, rolling features, validation, summaries, missingness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, flag, ratio, safe_corr
from ..schema import PHYSIOLOGICAL_RANGES, REQUIRED_COLUMNS

ROLLING = ("resting_hr", "hrv_rmssd", "sleep_duration", "sleep_efficiency", "step_count")


def add_derived_columns(df: DataFrame) -> DataFrame:
    """Wear coverage, motion proxy, heat load over 26 degrees and sleep deficit under 7 hours, for the inputs that are there."""
    made = {
        "wear_coverage": ("wearable_minutes", lambda c: c / 1440.0),
        "motion_proxy": ("active_minutes", lambda c: c / 240.0),
        "heat_load": ("heat_index", lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c - 26.0))),
        "sleep_deficit": ("sleep_duration", lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), 7.0 - c))),
    }
    return df.withColumns({name: f(F.col(src)) for name, (src, f) in made.items() if src in df.columns})


def add_rolling_features(df: DataFrame, columns: Sequence[str] = ROLLING, rows: int = 7, least: int = 2, key: str = "participant_id", order: str = "date") -> DataFrame:
    """Mean and sample deviation over the last ``rows`` rows of each participant; NULL under ``least`` values.

    All windows share one partitioning and one sort.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    made = {}
    for c in columns:
        if c in df.columns:
            enough = F.count(c).over(w) >= least
            made[f"{c}_roll{rows}_mean"] = F.when(enough, F.avg(c).over(w))
            made[f"{c}_roll{rows}_std"] = F.when(enough, F.stddev_samp(c).over(w))
    return df.withColumns(made)


def preprocess(df: DataFrame) -> DataFrame:
    return df.transform(add_derived_columns).transform(add_rolling_features)


@dataclass
class ValidationResult:
    n_rows: int
    missing_columns: list[str]
    out_of_range: dict[str, int]
    all_null_columns: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.missing_columns and not any(self.out_of_range.values()) and not self.all_null_columns

    def summary(self) -> str:
        if self.ok:
            return f"{self.n_rows} rows, no problem found"
        parts = [f"missing columns: {', '.join(self.missing_columns)}"] if self.missing_columns else []
        parts += [f"{c}: {n} out of range" for c, n in self.out_of_range.items() if n]
        parts += [f"{c}: no value" for c in self.all_null_columns]
        return f"{self.n_rows} rows; " + "; ".join(parts)


def validation_report(df: DataFrame, ranges: dict[str, tuple[float, float]] = PHYSIOLOGICAL_RANGES, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row for each required or ranged column: present, n_rows, n_values, n_out_of_range. One pass over the table."""
    columns = [*dict.fromkeys([*required, *ranges])]
    sums = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        if c in df.columns:
            sums.append(F.count(c).alias(f"v_{c}"))
            if c in ranges:
                lo, hi = ranges[c]
                sums.append(F.coalesce(F.count_if((F.col(c) < lo) | (F.col(c) > hi)), F.lit(0)).alias(f"b_{c}"))
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), F.col("n").alias("n_rows"), (F.col(f"v_{c}") if c in df.columns else F.lit(0).cast("long")).alias("n_values"), (F.col(f"b_{c}") if c in df.columns and c in ranges else F.lit(0).cast("long")).alias("n_out_of_range"))
        for c in columns
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def validate(df: DataFrame, **options) -> ValidationResult:
    rows = validation_report(df, **options).collect()
    n = rows[0]["n_rows"]
    return ValidationResult(n, sorted(r["column_name"] for r in rows if not r["present"]), {r["column_name"]: r["n_out_of_range"] for r in rows if r["n_out_of_range"]}, [r["column_name"] for r in rows if r["present"] and n and not r["n_values"]])


# The columns that real data must have for an audit.
REAL_COLUMNS = ("participant_id", "date", "resting_hr", "hrv_rmssd", "step_count", "sleep_duration", "sleep_efficiency", "wearable_minutes", "device_type")


def check_real_schema(df: DataFrame, required: Sequence[str] = REAL_COLUMNS) -> dict:
    """Whether a table has the columns for an audit, and those it lacks; reads no row."""
    lacking = [c for c in required if c not in df.columns]
    return {"ready_for_audit": not lacking, "missing_columns": lacking}


def daily_signal_quality(df: DataFrame) -> Column:
    """clip(0.95 coverage - 0.25 clip(active / 240)); no wear column counts as coverage 0.5, no activity column as 0, neither as NULL."""
    wear, active = "wearable_minutes" in df.columns, "active_minutes" in df.columns
    if not wear and not active:
        return F.lit(None).cast("double")
    coverage = F.col("wearable_minutes") / 1440.0 if wear else F.lit(0.5)
    motion = clip(F.col("active_minutes") / 240.0, 0, 1) if active else F.lit(0.0)
    return clip(0.95 * coverage - 0.25 * motion, 0, 1)


def activity_summary(df: DataFrame, key: str = "participant_id") -> DataFrame:
    steps, n = F.col("step_count"), F.count("step_count")
    active = F.col("active_minutes")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.when((n >= 3) & (F.avg(steps) >= 1), clip(1 - ratio(F.stddev_pop(steps), F.avg(steps) + 1e-6), 0, 1)).alias("step_consistency"),
        F.avg((active > 120).cast("int")).alias("activity_artifact_risk"),
        F.when(F.count(active) >= 3, clip(1 - F.stddev_pop(active) / 60, 0, 1)).alias("active_minute_reliability"),
    )


def sleep_summary(df: DataFrame, key: str = "participant_id") -> DataFrame:
    hours, eff = F.col("sleep_duration"), F.col("sleep_efficiency")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.when(F.count(hours) >= 3, clip(1 - F.stddev_pop(hours) / 4, 0, 1)).alias("sleep_regularity"),
        F.when(F.count(eff) >= 3, clip(1 - 2 * F.stddev_pop(eff), 0, 1)).alias("sleep_efficiency_reliability"),
        F.avg(F.abs(hours - 7.5)).alias("sleep_duration_deviation"),
    )


def run_lengths(df: DataFrame, key: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Gaps and islands: a row (key, run, length) for each unbroken run of rows where ``condition`` holds."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.select(*key, *order, flag(condition).alias("__f")).withColumn("run", F.sum(1 - F.col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("__f = 1").groupBy(*key, "run").agg(F.count(F.lit(1)).alias("length"))


def longest_runs(df: DataFrame, key: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """By key: n_rows, n_true, n_runs, longest, mean_length (0 without a run)."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.select(*key, *order, flag(condition).alias("__f")).withColumn("run", F.sum(1 - F.col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*key, "run").agg(F.count(F.lit(1)).alias("n"), F.sum("__f").alias("length"))
    return runs.groupBy(*key).agg(
        F.sum("n").alias("n_rows"), F.sum("length").alias("n_true"), F.count_if(F.col("length") > 0).alias("n_runs"), F.max("length").alias("longest"),
        F.coalesce(F.avg(F.when(F.col("length") > 0, F.col("length"))), F.lit(0.0)).alias("mean_length"),
    )


def missingness_summary(df: DataFrame, key: str = "participant_id", order: str = "date", flag_col: str = "missing_wearable_flag") -> DataFrame:
    runs = longest_runs(df.filter(F.col(key).isNotNull()), [key], [order], F.col(flag_col) == 1)
    return runs.select(key, (F.col("n_true") / F.col("n_rows")).alias("missing_rate"), F.col("longest").alias("max_run"), F.col("mean_length").alias("mean_run"), F.col("n_runs").alias("n_episodes"))


def state_dependent_missingness(df: DataFrame, states: Sequence[str] = ("stress_proxy", "sleep_efficiency", "heat_index"), flag_col: str = "missing_wearable_flag") -> DataFrame:
    """(state, r): correlation of the missing flag with each state, NULL if a value is missing or a side is flat. One pass."""
    held = [s for s in states if s in df.columns]
    complete = lambda s: (F.count(s) == F.count(F.lit(1))) & (F.count(flag_col) == F.count(F.lit(1)))
    one = df.agg(*[F.when(complete(s), safe_corr(F.col(flag_col).cast("double"), s)).alias(s) for s in held])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("r")) for s in held])))
