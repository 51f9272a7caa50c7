"""Adapters from foreign daily exports to the canonical participant-day table: renames and unit expressions, no row code."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.daily import ValidationResult, validate
from ..schema import DAILY, PHYSIOLOGICAL_RANGES, REQUIRED_COLUMNS, nan_to_null


def _percent_to_share(c: Column) -> Column:
    return F.when(c > 1.5, c / 100).otherwise(c)


@dataclass(frozen=True)
class Adapter:
    name: str
    renames: Mapping[str, str]
    units: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)


# The foreign columns and what they are called here.
FITBIT_LIKE = Adapter(
    "fitbit-like",
    {
        "user_id": "participant_id", "summary_date": "date", "tracker": "device_type", "resting_heart_rate": "resting_hr", "rmssd": "hrv_rmssd", "sdnn": "hrv_sdnn", "steps": "step_count",
        "very_active_minutes": "active_minutes", "minutes_asleep": "sleep_duration", "sleep_efficiency_pct": "sleep_efficiency", "ambient_temp_f": "temperature_c", "humidity_pct": "humidity",
        "aqi_us": "aqi", "wear_minutes": "wearable_minutes", "is_missing": "missing_wearable_flag",
    },
    # Humidity comes out as a share, although the canonical column is 0 to 100; see ``percent_humidity``.
    {"sleep_duration": lambda c: c / 60, "sleep_efficiency": _percent_to_share, "temperature_c": lambda c: (c - 32) * 5 / 9, "humidity": _percent_to_share},
)
EMPATICA_LIKE = Adapter(
    "empatica-like",
    {
        "subject": "participant_id", "day": "date", "device_model": "device_type", "hr_rest_bpm": "resting_hr", "hrv_rmssd_ms": "hrv_rmssd", "hrv_sdnn_ms": "hrv_sdnn", "step_total": "step_count",
        "active_min": "active_minutes", "sleep_hours": "sleep_duration", "sleep_eff_frac": "sleep_efficiency", "amb_temp_c": "temperature_c", "amb_humidity_frac": "humidity",
        "aqi": "aqi", "wear_min": "wearable_minutes", "non_wear_flag": "missing_wearable_flag",
    },
)
GENERIC = Adapter("generic", {})


def percent_humidity(adapter: Adapter) -> Adapter:
    """The adapter with humidity left on the canonical scale of 0 to 100."""
    return Adapter(adapter.name, adapter.renames, {k: f for k, f in adapter.units.items() if k != "humidity"})


@dataclass
class AdapterReport:
    rows_in: int
    rows_out: int
    dropped_reason_counts: dict[str, int]
    validation: ValidationResult

    @property
    def rows_dropped(self) -> int:
        return self.rows_in - self.rows_out


def to_canonical(df: DataFrame, adapter: Adapter) -> DataFrame:
    """Renames (a canonical column that is already there gives way), converts units, adds missing columns as NULL."""
    renames = {a: b for a, b in adapter.renames.items() if a in df.columns}
    clash = [b for a, b in renames.items() if a != b and b in df.columns]
    out = nan_to_null(df.drop(*clash).withColumnsRenamed(renames))
    out = out.withColumns({c: f(F.col(c).cast("double")) for c, f in adapter.units.items() if c in out.columns})
    kinds = {f.name: f.dataType for f in DAILY.fields}
    return out.withColumns({c: F.lit(None).cast(kinds[c]) for c in REQUIRED_COLUMNS if c not in out.columns})


def _outside(c: str) -> Column:
    lo, hi = PHYSIOLOGICAL_RANGES[c]
    return F.coalesce(~F.col(c).between(lo, hi), F.lit(False))


def adapt(df: DataFrame, adapter: Adapter, drop_out_of_range: bool = True) -> DataFrame:
    """The canonical table; rows with a value out of range are dropped, NULL isn't out of range."""
    out = to_canonical(df, adapter)
    return out.filter(~reduce(lambda a, b: a | b, [_outside(c) for c in PHYSIOLOGICAL_RANGES])) if drop_out_of_range else out


def adapt_with_report(df: DataFrame, adapter: Adapter, drop_out_of_range: bool = True) -> tuple[DataFrame, AdapterReport]:
    """Also how many rows each range rejects (a row may count for several), from one pass."""
    every = to_canonical(df, adapter)
    any_out = reduce(lambda a, b: a | b, [_outside(c) for c in PHYSIOLOGICAL_RANGES])
    s = every.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_out).alias("dropped"), *[F.count_if(_outside(c)).alias(c) for c in PHYSIOLOGICAL_RANGES]).first()
    out = adapt(df, adapter, drop_out_of_range)
    reasons = {f"{c}_out_of_range": s[c] for c in PHYSIOLOGICAL_RANGES if s[c]} if drop_out_of_range else {}
    return out, AdapterReport(s["n"], s["n"] - (s["dropped"] if drop_out_of_range else 0), reasons, validate(out))


def adapt_csv(spark: SparkSession, path: str, out: str, adapter: Adapter, schema=None) -> AdapterReport:
    """CSV to CSV. Give a schema on large inputs; else the columns' types are inferred by an extra pass."""
    df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    adapted, report = adapt_with_report(df, adapter)
    adapted.write.mode("overwrite").csv(out, header=True)
    return report
