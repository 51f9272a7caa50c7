"""The participant-day table and the rules its values keep to. NULL is the only missing marker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns a daily summary must have.
REQUIRED_COLUMNS = (
    "participant_id", "date", "resting_hr", "hrv_rmssd", "hrv_sdnn", "step_count", "active_minutes", "sleep_duration", "sleep_efficiency", "stress_proxy",
    "temperature_c", "humidity", "aqi", "heat_index", "wearable_minutes", "missing_wearable_flag",
    "signal_quality_ground_truth", "artifact_burden_ground_truth", "reliability_ground_truth",
)

# Closed intervals of plausible values.
PHYSIOLOGICAL_RANGES = {
    "resting_hr": (30, 130),
    "hrv_rmssd": (0, 250),
    "hrv_sdnn": (0, 300),
    "step_count": (0, 60000),
    "active_minutes": (0, 480),
    "sleep_duration": (0, 14),
    "sleep_efficiency": (0, 1),
    "temperature_c": (-20, 50),
    "humidity": (0, 100),
    "aqi": (0, 500),
}

DAILY = T.StructType([T.StructField("participant_id", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.IntegerType() if c.endswith("flag") else T.DoubleType()) for c in REQUIRED_COLUMNS[2:]]])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Applied at every source: NaN becomes NULL, so that aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
