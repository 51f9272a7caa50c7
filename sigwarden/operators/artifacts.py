"""Artifact detectors on array columns and RR-interval operators, as higher-order functions; motion needs a spectrum and is an Arrow function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, ratio


def _mean(a: Column) -> Column:
    return ratio(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))


def array_median(a: Column) -> Column:
    n = F.size(a)
    # Without nulls the sort is compiled; with nulls they come last.
    s = F.when(F.exists(a, lambda x: x.isNull()), F.array_sort(a)).otherwise(F.sort_array(a))
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def finite(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))


def dropout(signal: Column, least: int = 32, tolerance: float = 0.02) -> Column:
    """Longest run of missing or near-zero samples: (flag, severity, longest)."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("longest"))

    def step(s, x):
        bad = x.isNull() | F.isnan(x) | (F.abs(x) <= tolerance)
        run = F.when(bad, s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["longest"], run).alias("longest"))

    longest = F.aggregate(F.transform(signal, lambda x: x.cast("double")), start, step)["longest"]
    return F.struct((longest >= least).cast("int").alias("flag"), clip(longest / (4.0 * least), 0, 1).alias("severity"), longest.alias("longest"))


def with_noise_spikes(df: DataFrame, signal: str, name: str = "spikes", limit: float = 4.0) -> DataFrame:
    """Samples over ``limit`` robust deviations from the median: (flag, severity, n_spikes). Under 4 samples there are none.

    Medians are columns of their own, so each is sorted for once.
    """
    out = df.withColumn("__x", F.transform(signal, lambda x: x.cast("double"))).withColumn("__m", array_median(F.col("__x")))
    out = out.withColumn("__d", F.transform("__x", lambda x: F.abs(x - F.col("__m")))).withColumn("__mad", array_median(F.col("__d")) + 1e-6)
    n = F.when(F.size("__x") >= 4, F.size(F.filter("__d", lambda d: d / (1.4826 * F.col("__mad")) > limit))).otherwise(0)
    found = F.struct((n > 0).cast("int").alias("flag"), clip(n / F.greatest(F.size("__x") * 0.02, F.lit(1.0)), 0, 1).alias("severity"), n.alias("n_spikes"))
    return out.withColumn(name, found).drop("__x", "__m", "__d", "__mad")


def with_flatline(df: DataFrame, signal: str, name: str = "flatline", width: int = 64, limit: float = 1e-4) -> DataFrame:
    """Frames of ``width`` samples whose variance is under ``limit``: (flag, severity, n_flat), from running sums."""
    x = F.transform(signal, lambda v: v.cast("double"))
    start = F.struct(F.array(F.lit(0.0)).alias("s"), F.array(F.lit(0.0)).alias("q"))
    sums = F.aggregate(x, start, lambda a, v: F.struct(F.concat(a["s"], F.array(F.element_at(a["s"], -1) + v)).alias("s"), F.concat(a["q"], F.array(F.element_at(a["q"], -1) + v * v)).alias("q")))
    out = df.withColumn("__c", sums).withColumn("__n", F.size(signal) - width + 1)

    def variance(i):
        s = F.get("__c.s", i + width) - F.get("__c.s", i)
        q = F.get("__c.q", i + width) - F.get("__c.q", i)
        return q / width - (s / width) * (s / width)

    frames = F.when(F.col("__n") > 0, F.sequence(F.lit(0), F.col("__n") - 1)).otherwise(F.array().cast("array<int>"))
    flat = F.size(F.filter(frames, lambda i: variance(i) < limit))
    found = F.struct((flat > 0).cast("int").alias("flag"), clip(flat / F.greatest(F.greatest(F.col("__n"), F.lit(0)) * 0.1, F.lit(1.0)), 0, 1).alias("severity"), flat.alias("n_flat"))
    return out.withColumn(name, found).drop("__c", "__n")


def timestamp_jitter(df: DataFrame, time_ms: Column, expected_ms: float, key: Sequence[str], jitter_ms: float = 5.0, gap_factor: float = 3.0) -> DataFrame:
    """By key: n intervals, those off by more than ``jitter_ms``, those over ``gap_factor`` intervals, severity, flag."""
    w = Window.partitionBy(*key).orderBy("__t")
    d = df.select(*key, time_ms.cast("double").alias("__t")).withColumn("__d", F.col("__t") - F.lag("__t").over(w)).filter("__d is not null")
    out = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n_intervals"), F.count_if(F.abs(F.col("__d") - expected_ms) > jitter_ms).alias("n_jitter"), F.count_if(F.col("__d") > expected_ms * gap_factor).alias("n_gaps"))
    total = F.col("n_jitter") + F.col("n_gaps")
    return out.withColumns({"severity": clip(total / F.col("n_intervals"), 0, 1), "flag": (total > 0).cast("int")})


def evaluate_windows(df: DataFrame, signal: str, fs: float) -> DataFrame:
    """Adds all detectors' results to a window table: flags and severities of motion, dropout, spikes and flatline, any_flag, mean_severity."""
    from ..functions.arrow import motion_artifact

    out = df.withColumn("motion", motion_artifact(F.col(signal).cast("array<double>"), F.lit(float(fs)))).withColumn("dropout", dropout(F.col(signal)))
    out = with_flatline(with_noise_spikes(out, signal), signal)
    kinds = ["motion", "dropout", "spikes", "flatline"]
    made = {f"{k}_{p}": F.col(f"{k}.{p}") for k in kinds for p in ("flag", "severity")}
    made["any_flag"] = F.greatest(*[F.col(f"{k}.flag") for k in kinds])
    made["mean_severity"] = sum((F.col(f"{k}.severity") for k in kinds), F.lit(0.0)) / len(kinds)
    return out.withColumns(made).drop(*kinds)


def impossible_physiology(hr: Column, rmssd: Column, hr_range: tuple[float, float] = (25, 220), rmssd_range: tuple[float, float] = (1, 300)) -> Column:
    return F.coalesce(~hr.between(*hr_range), F.lit(False)) | F.coalesce(~rmssd.between(*rmssd_range), F.lit(False))


def non_wear(motion: Column, minutes: Column, least_minutes: float = 60, motion_limit: float = 0.05) -> Column:
    return (minutes >= least_minutes) & (motion < motion_limit)


# array statistics


def with_entropy(df: DataFrame, signal: str, name: str = "entropy", bins: int = 16) -> DataFrame:
    """Normalised Shannon entropy of the amplitudes over ``bins`` equal bins; NULL for under 4 finite or flat samples."""
    out = df.withColumn("__x", finite(F.transform(signal, lambda x: x.cast("double")))).withColumns({"__lo": F.array_min("__x"), "__hi": F.array_max("__x")})
    width = (F.col("__hi") - F.col("__lo")) / bins
    out = out.withColumn("__b", F.transform("__x", lambda x: F.least(F.floor(F.try_divide(x - F.col("__lo"), width)), F.lit(bins - 1)).cast("int")))
    n = F.size("__x").cast("double")
    part = lambda i: F.size(F.filter("__b", lambda b: b == i)) / n
    bits = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.when(part(i) > 0, -part(i) * F.log2(part(i))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ok = (F.size("__x") >= 4) & (F.col("__hi") - F.col("__lo") >= 1e-12)
    return out.withColumn(name, F.when(ok, bits / F.log2(F.lit(float(bins))))).drop("__x", "__lo", "__hi", "__b")


def with_moments(df: DataFrame, signal: str) -> DataFrame:
    """Adds ``skewness`` and ``kurtosis`` (3 for a normal distribution), both bias-corrected."""
    out = df.withColumn("__x", finite(F.transform(signal, lambda x: x.cast("double")))).withColumn("__m", _mean(F.col("__x")))
    for p in (2, 3, 4):
        out = out.withColumn(f"__m{p}", _mean(F.transform("__x", lambda x: F.pow(x - F.col("__m"), F.lit(p)))))
    n = F.size("__x").cast("double")
    g1, g2 = ratio(F.col("__m3"), F.pow("__m2", F.lit(1.5))), ratio(F.col("__m4"), F.col("__m2") * F.col("__m2")) - 3
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3)
    return out.withColumns({"skewness": skew, "kurtosis": kurt}).drop("__x", "__m", "__m2", "__m3", "__m4")


def with_dft_motion(df: DataFrame, signal: str, fs: float, size: int, name: str = "motion") -> DataFrame:
    """Share of the power in (4, 15] Hz of that in [0.5, 15] Hz for windows of ``size`` samples, by an explicit transform.

    Frequencies are constants of the plan; a window of another length gives NULL.
    """
    import math

    out = df.withColumn("__x", F.transform(signal, lambda x: x.cast("double"))).withColumn("__m", _mean(F.col("__x")))
    power = {}
    for f in range(1, size // 2 + 1):
        hz = f * fs / size
        if 0.5 <= hz <= 15:
            dot = lambda fn, f=f: F.aggregate(F.zip_with(F.transform("__x", lambda x: x - F.col("__m")), F.array(*[F.lit(fn(2 * math.pi * f * t / size)) for t in range(size)]), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x)
            power[hz] = F.pow(dot(math.cos), F.lit(2)) + F.pow(dot(math.sin), F.lit(2))
    low = sum((p for hz, p in power.items() if hz <= 4), F.lit(0.0)) + 1e-9
    high = sum((p for hz, p in power.items() if hz > 4), F.lit(0.0))
    return out.withColumns({"__lo": low, "__hi": high}).withColumn(name, F.when(F.size("__x") == size, clip(F.col("__hi") / (F.col("__lo") + F.col("__hi")), 0, 1))).drop("__x", "__m", "__lo", "__hi")


# RR intervals in long form: one row an interval


def interval_statistics(df: DataFrame, rr: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """By key: n, mean interval, RMSSD, SDNN, rate; RMSSD and SDNN are NULL for under 2 intervals. Intervals in ms."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.filter(F.col(rr).isNotNull()).withColumn("__d", F.col(rr) - F.lag(rr).over(w))
    return d.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(rr).alias("mean_rr"), F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("rmssd"), F.stddev_samp(rr).alias("sdnn"), ratio(F.lit(60000.0), F.avg(rr)).alias("rate"))


def interpolated_rmssd(df: DataFrame, rr: str, key: Sequence[str], order: Sequence[str], low: float = 300, high: float = 2000) -> DataFrame:
    """RMSSD after intervals outside [low, high] are replaced by a straight line between their valid neighbours (held at the edges)."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.select(*key, F.col(rr).alias("__v"), F.row_number().over(w).alias("__i"))
    rows = rows.withColumn("__ok", F.when(F.col("__v").between(low, high), F.struct("__i", "__v")))
    by_row = Window.partitionBy(*key).orderBy("__i")
    near = rows.select(*key, "__i", F.last("__ok", ignorenulls=True).over(by_row.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.first("__ok", ignorenulls=True).over(by_row.rowsBetween(0, Window.unboundedFollowing)).alias("b"), F.count("__ok").over(Window.partitionBy(*key)).alias("__n"))
    share = F.coalesce(ratio((F.col("__i") - F.col("a.__i")).cast("double"), (F.col("b.__i") - F.col("a.__i")).cast("double")), F.lit(0.0))
    value = F.coalesce(F.col("a.__v") + share * (F.col("b.__v") - F.col("a.__v")), "a.__v", "b.__v")
    d = near.withColumn("__r", value).withColumn("__d", F.col("__r") - F.lag("__r").over(by_row))
    return d.groupBy(*key).agg(F.when(F.max("__n") >= 2, F.sqrt(F.avg(F.col("__d") * F.col("__d")))).alias("corrected_rmssd"))


def cleaning_policies(df: DataFrame, rr: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(policy, interval statistics) under five cleaning rules: none, plausible range, 25 % and 10 % around the median, 50 ms from the last."""
    w = Window.partitionBy(*key)
    marked = df.filter(F.col(rr).isNotNull()).withColumn("__med", F.percentile(rr, F.lit(0.5)).over(w)).withColumn("__lag", F.lag(rr).over(w.orderBy(*order)))
    v = F.col(rr)
    off = F.abs(v - F.col("__med")) / F.col("__med")
    plausible = v.between(400, 1500)
    rules = {"raw": F.lit(True), "plausible": plausible, "median_25": plausible & (off < 0.25), "median_10": plausible & (off < 0.10), "successive_50": F.coalesce(F.abs(v - F.col("__lag")) < 50, F.lit(True))}
    held = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return interval_statistics(marked.withColumn("policy", F.explode(held)), rr, [*key, "policy"], order)
