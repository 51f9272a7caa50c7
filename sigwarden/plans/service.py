"""The service facade: one summary in, scores and warnings out. No web stack is needed; a server can call these functions."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trust
from ..sources.synthetic import normal, uniform

VERSION = "1.0"


@dataclass
class SignalSummary:
    participant_id: str
    n_days_observed: int
    mean_resting_hr: float
    mean_hrv_rmssd: float
    mean_step_count: float
    mean_sleep_duration: float
    mean_sleep_efficiency: float
    mean_heat_index: float
    missing_rate: float
    device_type: str = "device_A"
    mean_active_minutes: float = 60.0
    mean_wearable_minutes: float = 1100.0

    def __post_init__(self):
        if not 1 <= self.n_days_observed <= 365:
            raise ValueError("n_days_observed must be from 1 to 365")
        if not 0 <= self.missing_rate <= 1:
            raise ValueError("missing_rate must be from 0 to 1")


@dataclass
class TrustScoreResult:
    participant_id: str
    overall: float | None
    category: str
    explanation: str
    signal_quality_score: float | None
    artifact_burden_score: float | None
    temporal_stability_score: float | None
    missingness_risk_score: float | None
    device_bias_score: float | None
    confounding_risk_score: float | None


@dataclass
class AuditResult:
    participant_id: str
    overall: float | None
    category: str
    signal_quality_score: float | None
    missingness_risk_score: float | None
    warnings: list[str]


def summaries_to_days(summaries: DataFrame) -> DataFrame:
    """Expands summaries to at least 7 days each, with noise that depends on the participant and the day alone."""
    n = F.greatest(F.col("n_days_observed"), F.lit(7))
    rows = summaries.withColumn("__d", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("date", F.date_add(F.lit("2025-01-01").cast("date"), F.col("__d")))
    key = (F.col("participant_id"), F.col("__d"))
    z = lambda name: normal(0, name, *key)
    missing = (uniform(0, "missing", *key) < F.col("missing_rate")).cast("int")
    at_least = lambda e, lo: F.greatest(F.lit(float(lo)), e)
    active = at_least(F.col("mean_active_minutes") + 8 * z("active"), 0)
    return rows.withColumn("missing_wearable_flag", missing).select(
        "participant_id", "date", "device_type", "missing_wearable_flag",
        (F.col("mean_resting_hr") + 2.5 * z("hr")).alias("resting_hr"), at_least(F.col("mean_hrv_rmssd") + 6 * z("hrv"), 1).alias("hrv_rmssd"),
        at_least(F.col("mean_step_count") + 1500 * z("steps"), 0).alias("step_count"), active.alias("active_minutes"),
        at_least(F.col("mean_sleep_duration") + 0.6 * z("sleep"), 0).alias("sleep_duration"), F.least(at_least(F.col("mean_sleep_efficiency") + 0.04 * z("eff"), 0), F.lit(1.0)).alias("sleep_efficiency"),
        (F.col("mean_heat_index") + 2 * z("heat")).alias("heat_index"), F.when(F.col("missing_wearable_flag") == 1, 0.0).otherwise(at_least(F.col("mean_wearable_minutes") + 120 * z("wear"), 0)).alias("wearable_minutes"),
        F.least(F.lit(1.0), 0.15 + 0.5 * active / 240 + 0.4 * F.col("missing_wearable_flag")).alias("artifact_burden_ground_truth"),
    )


def warnings(overall, missing_rate, quality):
    """Texts of the rules that hold; an unknown score gives none."""
    rules = ((overall < 40, "trust score below 40: do not use for decisions"), (missing_rate > 0.3, "over 30 % of the days are missing"), (quality < 50, "signal quality below 50"))
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))


def score_summaries(summaries: DataFrame) -> DataFrame:
    """All summaries of a table at once, with their warnings."""
    scored = trust.cohort_scores(summaries_to_days(summaries)).join(summaries.select("participant_id", "missing_rate"), "participant_id")
    return scored.withColumn("warnings", warnings(F.col("overall"), F.col("missing_rate"), F.col("signal_quality_score")))


def _one(spark: SparkSession, summary: SignalSummary) -> dict:
    kinds = {"str": "string", "int": "int", "float": "double"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(SignalSummary))
    values = tuple(float(v) if f.type == "float" else v for f, v in zip(fields(SignalSummary), asdict(summary).values()))
    return score_summaries(spark.createDataFrame([values], schema)).first().asDict()


def root() -> dict:
    return {"name": "sigwarden", "version": VERSION, "endpoints": ["/health", "/audit-signal", "/trust-score"]}


def health() -> dict:
    return {"status": "ok"}


def audit_signal(spark: SparkSession, summary: SignalSummary) -> AuditResult:
    r = _one(spark, summary)
    return AuditResult(*[r[f.name] for f in fields(AuditResult)])


def trust_score(spark: SparkSession, summary: SignalSummary) -> TrustScoreResult:
    r = _one(spark, summary)
    return TrustScoreResult(*[r[f.name] for f in fields(TrustScoreResult)])
