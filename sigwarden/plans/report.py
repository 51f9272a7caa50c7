"""The audit report as Markdown. Every section collects a small aggregate of one cached table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import scan_changes
from ..functions.ordered import quantiles
from ..operators import causal, confounding, daily, fairness, reliability, trust

METRICS = ("resting_hr", "hrv_rmssd")


def table(df: DataFrame, rows: int = 20) -> str:
    """The first rows of a small result as a Markdown table."""
    found = df.limit(rows).collect()
    if not found:
        return "_no rows_"
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return head + "\n" + "\n".join("| " + " | ".join(cell(v) for v in r) + " |" for r in found)


def headline(df: DataFrame, scores: DataFrame) -> str:
    d = df.agg(F.count_distinct("participant_id").alias("p"), F.count(F.lit(1)).alias("n")).first()
    s = scores.agg(F.avg("overall").alias("m"), F.count_if(F.col("overall") < 60).alias("low")).first()
    return f"{d['p']} participants, {d['n']} days. Mean trust score {s['m'] or float('nan'):.1f}; {s['low']} participants below 60."


def recommendations(df: DataFrame, scores: DataFrame) -> str:
    r = df.agg(F.avg("missing_wearable_flag").alias("missing"), F.avg((F.col("artifact_burden_ground_truth") > 0.5).cast("double")).alias("burden")).first()
    low = scores.agg(F.avg((F.col("overall") < 60).cast("double")).alias("low")).first()["low"]
    rules = ((r["missing"], 0.2, "Look into non-wear: over a fifth of the days are missing."), (r["burden"], 0.2, "Clean the signals: over a fifth of the days carry heavy artifacts."), (low, 0.25, "Leave participants of low trust out of the main analysis."))
    found = [t for v, bound, t in rules if v is not None and v > bound]
    return "\n".join(f"- {t}" for t in found) or "- No rate is over its limit."


def csv_section(df: DataFrame, path: str, required: Sequence[str]) -> str:
    """A table from an earlier run; a missing or malformed file is said, not raised."""
    try:
        found = df.sparkSession.read.csv(path, header=True, inferSchema=True)
    except Exception:
        return "_not available_"
    return table(found.select(*required)) if set(required) <= set(found.columns) else "_malformed_"


def missingness_figures(df: DataFrame) -> DataFrame:
    """One row: the median participant's share of missing days and the longest run of any."""
    rates = daily.missingness_summary(df)
    median = quantiles(rates, ["missing_rate"], [0.5])["missing_rate"][0]
    return rates.agg(F.lit(median).cast("double").alias("median_rate"), F.max("max_run").alias("longest_run"))


def missingness_section(df: DataFrame) -> str:
    return table(missingness_figures(df)) + "\n\n" + table(daily.state_dependent_missingness(df))


def device_section(df: DataFrame) -> str:
    bias = confounding.device_bias(df, [*METRICS, "signal_quality_ground_truth"])
    return table(bias) + f"\n\nSeverity {confounding.bias_severity(bias).first()['severity']:.2f}."


def change_section(df: DataFrame) -> str:
    found = scan_changes(df, "resting_hr").filter(F.abs("delta") >= 2).cache()
    n = found.agg(F.count_distinct("participant_id").alias("p"), F.count(F.lit(1)).alias("n")).first()
    return f"{n['n']} change-points of at least 2 in {n['p']} participants.\n\n" + table(found.orderBy("participant_id", "index"), 10)


def fairness_section(df: DataFrame) -> str:
    parts = []
    for name, strata in fairness.multi_stratify(df, ["device_type", "skin_tone_proxy"]).items():
        parts += [f"By {name}:", table(strata.select("stratum", "n_days", "overall", "category").orderBy("stratum")), table(fairness.disparity_summary(strata).limit(6))]
    return "\n\n".join(parts)


def weights_section(df: DataFrame, scores: DataFrame) -> str:
    learned = fairness.learn_weights(scores, reliability.weekly_reproducibility(df, "hrv_rmssd"))
    rows = "\n".join(f"| {k} | {v:.3f} |" for k, v in learned["weights"].items())
    return f"| component | weight |\n|---|---|\n{rows}\n\nRank correlation on training participants {learned['rho_train']}, on held-out ones {learned['rho_holdout']}."


def participant_report(scores: DataFrame, participant: str) -> str:
    r = scores.filter(F.col("participant_id") == participant).first()
    if r is None:
        return f"# {participant}\n\n_unknown_\n"
    lines = "\n".join(f"| {c.removesuffix('_score')} | {'' if r[c] is None else f'{r[c]:.1f}'} |" for c in trust.COMPONENTS)
    return f"# {participant}\n\nTrust score {r['overall']} ({r['category']})\n\n| component | score |\n|---|---|\n{lines}\n\n{r['explanation']}\n"


def median_participant(scores: DataFrame) -> str | None:
    """The participant whose score is nearest the median."""
    m = scores.agg(F.percentile("overall", F.lit(0.5)).alias("m"))
    r = scores.join(F.broadcast(m)).filter("overall is not null").orderBy(F.abs(F.col("overall") - F.col("m")), "participant_id").first()
    return r["participant_id"] if r else None


def generate_report(df: DataFrame, path: str | None = None, causal_pairs: Sequence[tuple[str, str]] = (("heat_index", "hrv_rmssd"),), icc_csv: str = "icc_vs_test_retest.csv", sqi_csv: str = "baseline_comparison.csv") -> str:
    """All sections as one text; written to ``path`` if given (a driver-side file of a few pages)."""
    df = df.cache()
    scores = trust.cohort_scores(df).cache()
    middle = median_participant(scores)
    sections: list[tuple[str, Callable[[], str]]] = [
        ("Headline", lambda: headline(df, scores)),
        ("Validation", lambda: daily.validate(df).summary()),
        ("Confounding", lambda: table(confounding.correlation_table(df).limit(6))),
        ("Heat and sleep", lambda: table(confounding.correlation_summary(confounding.per_entity_correlation(df)))),
        ("Device bias", lambda: device_section(df)),
        ("Missingness", lambda: missingness_section(df)),
        ("Test-retest", lambda: table(reliability.cohort_test_retest_table(df, METRICS, replicates=300))),
        ("ICC comparison", lambda: csv_section(df, icc_csv, ["metric", "icc", "r"])),
        ("Quality method comparison", lambda: csv_section(df, sqi_csv, ["modality", "spearman"])),
        ("Adjusted effects", lambda: table(causal.screening_vs_adjusted(df, causal_pairs))),
        ("Change-points", lambda: change_section(df)),
        ("Fairness", lambda: fairness_section(df)),
        ("Learned weights", lambda: weights_section(df, scores)),
        ("Activity", lambda: table(daily.activity_summary(df).agg(*[F.avg(c).alias(c) for c in ("step_consistency", "activity_artifact_risk", "active_minute_reliability")]))),
        ("Sleep", lambda: table(daily.sleep_summary(df).agg(*[F.avg(c).alias(c) for c in ("sleep_regularity", "sleep_efficiency_reliability", "sleep_duration_deviation")]))),
        ("Median participant", lambda: participant_report(scores, middle) if middle else "_none_"),
        ("Recommendations", lambda: recommendations(df, scores)),
        ("Limits", lambda: "Scores describe data, not people; they are no medical device."),
    ]
    text = "# Signal audit\n\n" + "\n\n".join(f"## {name}\n\n{make()}" for name, make in sections) + "\n"
    scores.unpersist()
    df.unpersist()
    if path:
        Path(path).write_text(text)
    return text
