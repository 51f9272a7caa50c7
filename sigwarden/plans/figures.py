"""The data behind figures and dashboard pages, as small DataFrames; drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement
from ..operators.trust import COMPONENTS


def trust_radar(scores: DataFrame, participant: str) -> DataFrame:
    """(component, score) of one participant."""
    return scores.filter(F.col("participant_id") == participant).unpivot([], list(COMPONENTS), "component", "score")


def reliability_heatmap(df: DataFrame, value: str = "reliability_ground_truth", top: int = 60) -> DataFrame:
    """Participants by dates: means of the first ``top`` participants in order."""
    first = df.select("participant_id").distinct().orderBy("participant_id").limit(top)
    held = df.join(F.broadcast(first), "participant_id")
    dates = [r[0] for r in held.select(F.col("date").cast("string").alias("d")).distinct().orderBy("d").collect()]
    return held.withColumn("d", F.col("date").cast("string")).groupBy("participant_id").pivot("d", dates).agg(F.avg(value)).orderBy("participant_id")


def confounding_scatter(df: DataFrame, x: str, y: str, points: int = 3000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Up to ``points`` rows chosen by a hash, and the least-squares line of all rows."""
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    line = rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.xxhash64("x", "y", F.lit(seed))).limit(points), line


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, start, n) over equal bins between the least and the greatest value."""
    e = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("__lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    rows = df.filter(F.col(value).isNotNull()).join(F.broadcast(e)).select(at.alias("bin"), (F.col("__lo") + at * width).alias("start"))
    return rows.groupBy("bin", "start").agg(F.count(F.lit(1)).alias("n"))


def trust_distribution(scores: DataFrame) -> DataFrame:
    return histogram(scores, "overall", 30)


def signal_example(windows: DataFrame, window_idx: int, signals: Sequence[str] = ("ecg", "ppg")) -> DataFrame:
    """(signal, sample, value) of one window."""
    one, out = windows.filter(F.col("window_idx") == window_idx), None
    for s in signals:
        part = one.select(F.lit(s).alias("signal"), F.posexplode(s).alias("sample", "value"))
        out = part if out is None else out.unionByName(part)
    return out


def fairness_forest(strata: DataFrame) -> DataFrame:
    return strata.orderBy("overall").select("stratum", "overall", *[c for c in ("ci_low", "ci_high") if c in strata.columns])


def bland_altman_points(df: DataFrame, a: str = "hr_ecg", b: str = "hr_ppg", state: str = "label_name") -> DataFrame:
    return df.select(F.col(state).alias("state"), ((F.col(a) + F.col(b)) / 2).alias("mean"), (F.col(b) - F.col(a)).alias("difference")).dropna()


def rate_scatter(df: DataFrame, a: str = "hr_ecg", b: str = "hr_ppg", state: str = "label_name") -> DataFrame:
    return df.select(F.col(state).alias("state"), F.col(a).alias("x"), F.col(b).alias("y")).dropna()


def pass_rates(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    rules = {"in_house": F.coalesce(F.col("inhouse_ppg_sqi") >= threshold, F.lit(False)), "orphanidou": F.col("orphanidou_acceptable") == 1, "sukor": F.col("sukor_acceptable") == 1, "elgendi": F.col("elgendi_acceptable") == 1}
    one = df.agg(*[F.avg(c.cast("double")).alias(n) for n, c in rules.items()])
    return one.unpivot([], list(rules), "method", "pass_rate")


def per_state_boxes(df: DataFrame, metrics: Sequence[str], state: str = "label_name") -> DataFrame:
    """(state, metric, quartiles as an array, n)."""
    tall = df.unpivot([state], list(metrics), "metric", "value")
    return tall.groupBy(state, "metric").agg(F.percentile("value", F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("quantiles"), F.count("value").alias("n"))


def motion_scatter(df: DataFrame) -> DataFrame:
    return df.select(F.col("inhouse_ppg_motion").alias("motion"), F.col("hr_abs_diff").alias("error")).dropna()


def recalibration_curve(df: DataFrame, score: str = "inhouse_ppg_sqi", label: str = "orphanidou_acceptable", points: int = 90) -> DataFrame:
    return agreement.threshold_grid(df, score, label, [0.1 + i * 0.89 / (points - 1) for i in range(points)]).select("threshold", "kappa").orderBy("threshold")


def participant_page(df: DataFrame, participant: str) -> DataFrame:
    return df.filter(F.col("participant_id") == participant).orderBy("date")


def artifact_page(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row: days over the burden limit, all days, their share."""
    over = F.count_if(F.col("artifact_burden_ground_truth") > limit)
    return df.agg(over.alias("n_over"), F.count(F.lit(1)).alias("n"), F.try_divide(over.cast("double"), F.count(F.lit(1)).cast("double")).alias("share"))


def device_bias_page(bias: DataFrame) -> DataFrame:
    """Devices by columns: differences from the reference."""
    names = [r[0] for r in bias.select("column_name").distinct().orderBy("column_name").collect()]
    return bias.groupBy("device").pivot("column_name", names).agg(F.first("difference")).orderBy("device")


def write_all(drawn: Mapping[str, DataFrame], folder: str, kind: str = "json") -> dict[str, str]:
    """Writes each figure's data below ``folder``/name as JSON lines or CSV, and gives the paths by name. Data of points can
    be large, so each is written by its own tasks."""
    paths = {}
    for name, data in sorted(drawn.items()):
        paths[name] = f"{folder}/{name}"
        writer = data.write.mode("overwrite")
        writer.json(paths[name], ignoreNullFields=False) if kind == "json" else writer.csv(paths[name], header=True)
    return paths
