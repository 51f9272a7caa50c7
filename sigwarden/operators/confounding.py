"""Screening correlations and device bias."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import FLAT, both, clip, percentile, safe_corr, strict_corr

# Exposure and outcome pairs that are screened.
PAIRS = (
    ("heat_index", "hrv_rmssd"),
    ("heat_index", "sleep_efficiency"),
    ("temperature_c", "sleep_duration"),
    ("aqi", "sleep_efficiency"),
    ("aqi", "hrv_rmssd"),
    ("humidity", "resting_hr"),
)


def correlation_table(df: DataFrame, pairs: Sequence[tuple[str, str]] = PAIRS, least: int = 5) -> DataFrame:
    """(exposure, outcome, r, n) for pairs with at least ``least`` complete rows and two spread sides, strongest first. One pass."""
    held = [(i, x, y) for i, (x, y) in enumerate(pairs) if x in df.columns and y in df.columns]
    if not held:
        return df.sparkSession.createDataFrame([], "exposure string, outcome string, r double, n long")
    sums = [e for i, x, y in held for e in (safe_corr(x, y, least).alias(f"r{i}"), F.count(both(x, y)[0]).alias(f"n{i}"))]
    rows = [F.struct(F.lit(x).alias("exposure"), F.lit(y).alias("outcome"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, x, y in held]
    return df.agg(*sums).select(F.inline(F.array(*rows))).filter("r is not null").orderBy(F.abs("r").desc(), "exposure", "outcome")


def top_confounder(df: DataFrame, **options) -> DataFrame:
    """The strongest pair."""
    return correlation_table(df, **options).limit(1)


def per_entity_correlation(df: DataFrame, x: str = "heat_index", y: str = "sleep_efficiency", key: str = "participant_id", least: int = 7) -> DataFrame:
    """By participant: n, r and both means over complete pairs; participants with under ``least`` or a flat side are left out."""
    a, b = both(x, y)
    by = df.filter(F.col(key).isNotNull()).groupBy(key)
    return by.agg(F.count(a).alias("n"), safe_corr(x, y, least).alias("r"), F.avg(a).alias(f"mean_{x}"), F.avg(b).alias(f"mean_{y}")).filter("r is not null")


def correlation_summary(per_entity: DataFrame, strong: float = -0.2) -> DataFrame:
    return per_entity.agg(percentile("r", 0.5).alias("median_r"), F.count_if(F.col("r") < strong).alias("n_strong"), F.count(F.lit(1)).alias("n"))


def behavioral_correlations(df: DataFrame) -> DataFrame:
    """(name, r) of activity against signal quality and wear against reliability, NULL as soon as a value is missing."""
    pairs = [("activity_vs_quality", "active_minutes", "signal_quality_ground_truth"), ("wear_vs_reliability", "wearable_minutes", "reliability_ground_truth")]
    held = [p for p in pairs if p[1] in df.columns and p[2] in df.columns]
    if not held:
        return df.sparkSession.createDataFrame([], "name string, r double")
    return df.agg(*[strict_corr(x, y).alias(n) for n, x, y in held]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("r")) for n, _, _ in held])))


def device_bias(df: DataFrame, columns: Sequence[str], device: str = "device_type", reference: str | None = None) -> DataFrame:
    """(device, column_name, mean, reference_mean, difference, n_obs): each device's mean less the reference device's.

    The reference is by default the first device in order; one that isn't there is a KeyError. Without
    a device column, or with no device, the result is empty. n_obs counts all rows.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "device string, column_name string, mean double, reference_mean double, difference double, n_obs long")
    if device not in df.columns:
        return empty
    held = [c for c in columns if c in df.columns]
    means = df.filter(F.col(device).isNotNull()).groupBy(F.col(device).alias("device")).agg(F.count(F.lit(1)).alias("n_obs"), *[F.avg(c).alias(f"m_{c}") for c in held])
    if reference is None:
        ref = means.agg(*[F.min_by(f"m_{c}", "device").alias(f"r_{c}") for c in held])
    else:
        if not df.filter(F.col(device) == reference).limit(1).count():
            raise KeyError(reference)
        ref = means.filter(F.col("device") == reference).select(*[F.col(f"m_{c}").alias(f"r_{c}") for c in held])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("mean"), F.col(f"r_{c}").alias("reference_mean"), (F.col(f"m_{c}") - F.col(f"r_{c}")).alias("difference")) for c in held]
    # ``ref`` is one row by construction.
    return means.join(F.broadcast(ref)).select("device", "n_obs", F.inline(F.array(*rows))).select("device", "column_name", "mean", "reference_mean", "difference", "n_obs")


def bias_severity(bias: DataFrame) -> DataFrame:
    """One row: the largest absolute difference over 10, clipped to 1; 0 for an empty table."""
    return bias.agg(F.coalesce(clip(F.max(F.abs("difference")) / 10, 0, 1), F.lit(0.0)).alias("severity"))


__all__ = ["FLAT", "PAIRS", "behavioral_correlations", "bias_severity", "correlation_summary", "correlation_table", "device_bias", "per_entity_correlation", "top_confounder"]
