"""Test-retest reliability, intraclass correlation, drift and stability of series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, hashed_uniform, percentile, ratio, safe_corr


def weekly_means(df: DataFrame, value: str, key: str = "participant_id", date: str = "date", anchor_on_values: bool = False) -> DataFrame:
    """(key, week, mean): weeks of 7 days from each participant's first date; weeks without a value are left out.

    ``anchor_on_values`` counts from the first date that has a value.
    """
    rows = df.select(F.col(key), F.col(date).cast("date").alias("__d"), F.col(value).alias("__v"))
    rows = rows.filter("__v is not null") if anchor_on_values else rows
    w = Window.partitionBy(key)
    week = F.floor(F.datediff("__d", F.min("__d").over(w)) / 7).cast("int")
    return rows.withColumn("week", week).groupBy(key, "week").agg(F.avg("__v").alias("mean")).filter("mean is not null")


def week_pairs(weeks: DataFrame, key: str = "participant_id", least: int = 4) -> DataFrame:
    """(key, week, x, y): a week's mean and the next one's, for participants with at least ``least`` weeks."""
    w = Window.partitionBy(key)
    return weeks.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("y", F.lead("mean").over(w.orderBy("week"))).filter((F.col("__n") >= least) & F.col("y").isNotNull()).select(key, "week", F.col("mean").alias("x"), "y")


def week_pair_correlation(df: DataFrame, value: str, key: str = "participant_id", date: str = "date") -> DataFrame:
    pairs = week_pairs(weekly_means(df, value, key, date), key)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(key).alias("n_participants"), safe_corr("x", "y", 3).alias("r"))


def half_pairs(df: DataFrame, value: str, key: str = "participant_id", order: str = "date") -> DataFrame:
    """(key, x, y): value i of the first half with value i of the second, over at least 4 values in order."""
    rows = df.filter(F.col(value).isNotNull())
    w = Window.partitionBy(key)
    placed = rows.select(key, F.col(value).alias("__v"), (F.row_number().over(w.orderBy(order)) - 1).alias("__i"), F.count(F.lit(1)).over(w).alias("__n")).withColumn("__h", F.floor(F.col("__n") / 2))
    placed = placed.filter("__n >= 4 and __i < 2 * __h").withColumn("pair", F.col("__i") % F.col("__h"))
    return placed.groupBy(key, "pair").agg(F.max(F.when(F.col("__i") < F.col("__h"), F.col("__v"))).alias("x"), F.max(F.when(F.col("__i") >= F.col("__h"), F.col("__v"))).alias("y"))


def split_half(df: DataFrame, value: str, key: str = "participant_id", order: str = "date") -> DataFrame:
    """By participant: n_pairs and the correlation of the two halves."""
    return half_pairs(df, value, key, order).groupBy(key).agg(F.count(F.lit(1)).alias("n_pairs"), safe_corr("x", "y", 2).alias("r"))


def pair_statistics(pairs: DataFrame, key: str) -> DataFrame:
    """Sums by participant that give every correlation of pooled pairs."""
    x, y = F.col("x"), F.col("y")
    return pairs.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))


def bootstrap_weight(key, replicate, seed: int):
    """How often a cluster is drawn in a replicate: Poisson(1), by inversion of a hash, so that no draw is shared between tasks."""
    below, total = [], 0.0
    for k in range(12):
        total += np.exp(-1.0) / np.prod(range(1, k + 1)) if k else np.exp(-1.0)
        below.append(float(total))
    # The digest is the one element of an array, so it is computed once and not for each bound.
    count = lambda u: sum(((u > b).cast("int") for b in below), F.lit(0))
    return F.get(F.transform(F.array(hashed_uniform(F.lit(seed), replicate, key)), count), F.lit(0))


def cohort_test_retest(df: DataFrame, value: str, method: str = "week_pair", key: str = "participant_id", order: str = "date", replicates: int = 200, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(metric, method, r, ci_low, ci_high, n_participants, n_pairs): pooled correlation with a cluster bootstrap.

    Each participant is six sums; a replicate is a weighted sum of those, so rows are never resampled and
    the shuffle is participants x 6 numbers once, then replicates partial sums a task.
    """
    if method == "week_pair":
        pairs = week_pairs(weekly_means(df, value, key, order), key)
    elif method == "split_half":
        pairs = half_pairs(df, value, key, order)
    else:
        raise ValueError(f"unknown method {method!r}")
    own = pair_statistics(pairs, key)
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    weighted = own.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", F.when(F.col("b") == 0, 1).otherwise(bootstrap_weight(F.col(key), F.col("b"), seed)))
    total = weighted.groupBy("b").agg(*[F.sum(F.col("w") * F.col(s)).alias(s) for s in sums], F.count(F.lit(1)).alias("k"))
    var = lambda s, ss: F.col(ss) / F.col("n") - (F.col(s) / F.col("n")) ** 2
    cov = F.col("sxy") / F.col("n") - F.col("sx") / F.col("n") * F.col("sy") / F.col("n")
    r = F.when((F.col("n") >= 3) & (var("sx", "sxx") > 1e-12) & (var("sy", "syy") > 1e-12), cov / F.sqrt(var("sx", "sxx") * var("sy", "syy")))
    tail = (1 - confidence) / 2
    return total.withColumn("r", r).agg(
        F.lit(value).alias("metric"), F.lit(method).alias("method"), F.max(F.when(F.col("b") == 0, F.col("r"))).alias("r"),
        F.percentile(F.when(F.col("b") > 0, F.col("r")), F.lit(tail)).alias("ci_low"), F.percentile(F.when(F.col("b") > 0, F.col("r")), F.lit(1 - tail)).alias("ci_high"),
        F.max(F.when(F.col("b") == 0, F.col("k"))).alias("n_participants"), F.max(F.when(F.col("b") == 0, F.col("n"))).cast("long").alias("n_pairs"),
    )


def cohort_test_retest_table(df: DataFrame, values: Sequence[str], **options) -> DataFrame:
    out = None
    for v in values:
        one = cohort_test_retest(df, v, **options)
        out = one if out is None else out.unionByName(one)
    return out


def icc_2_1(tall: DataFrame, subject: str, rater: str, value: str) -> DataFrame:
    """(icc, n_subjects, n_raters): two-way random effects, single rater, over subjects that all raters rated.

    A closed form over sums: one grouping by subject, one by rater, one of all.
    """
    rated = tall.filter(F.col(value).isNotNull()).select(F.col(subject).alias("__s"), F.col(rater).alias("__r"), F.col(value).alias("__v"))
    raters = rated.agg(F.count_distinct("__r").alias("__k"))
    by_subject = rated.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    full = rated.join(by_subject.join(F.broadcast(raters)).filter("__n = __k").select("__s"), "__s")
    v = F.col("__v")
    whole = full.agg(F.count_distinct("__s").cast("double").alias("n"), F.count_distinct("__r").cast("double").alias("k"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    squares = lambda by, name: full.groupBy(by).agg(F.sum(v).alias("__t")).agg(F.sum(F.col("__t") * F.col("__t")).alias(name))
    one = whole.join(F.broadcast(squares("__s", "rows_q"))).join(F.broadcast(squares("__r", "cols_q")))
    N, K = F.col("n"), F.col("k")
    mean2 = ratio(F.col("s") * F.col("s"), N * K)
    ms_r = ratio(ratio(F.col("rows_q"), K) - mean2, N - 1)
    ms_c = ratio(ratio(F.col("cols_q"), N) - mean2, K - 1)
    ms_e = ratio(F.col("q") - ratio(F.col("rows_q"), K) - ratio(F.col("cols_q"), N) + mean2, (N - 1) * (K - 1))
    below = ms_r + (K - 1) * ms_e + ratio(K * (ms_c - ms_e), N)
    icc = F.when((N >= 2) & (K >= 2) & (below > 0), ratio(ms_r - ms_e, below))
    return one.select(icc.alias("icc"), N.cast("long").alias("n_subjects"), K.cast("long").alias("n_raters"))


def first_days(df: DataFrame, value: str, days: int = 7, key: str = "participant_id", order: str = "date") -> DataFrame:
    """(key, day, value): the first ``days`` rows of each participant, numbered from 1."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select(key, F.row_number().over(w).alias("day"), F.col(value).alias("value")).filter(F.col("day") <= days)


def icc_of_days(df: DataFrame, value: str, days: int = 7, **options) -> DataFrame:
    """ICC(2,1) with the first days as raters, over participants with a value on each."""
    key = options.get("key", "participant_id")
    tall = first_days(df, value, days, **options)
    full = tall.groupBy(key).agg(F.count("value").alias("__c")).filter(F.col("__c") == days).select(key)
    return icc_2_1(tall.join(full, key), key, "day", "value")


def compare_to_test_retest(df: DataFrame, values: Sequence[str], **options) -> DataFrame:
    """(metric, icc, r, ci_low, ci_high), rounded to 4 digits."""
    out = None
    for v in values:
        icc = icc_of_days(df, v).select(F.round("icc", 4).alias("icc"))
        r = cohort_test_retest(df, v, **options).select("metric", *[F.round(c, 4).alias(c) for c in ("r", "ci_low", "ci_high")])
        one = r.join(F.broadcast(icc)).select("metric", "icc", "r", "ci_low", "ci_high")
        out = one if out is None else out.unionByName(one)
    return out


def weekly_reproducibility(df: DataFrame, value: str, key: str = "participant_id", date: str = "date") -> DataFrame:
    """(key, reproducibility): 1 less the median relative change from week to week, for 14 values and 2 weeks at least."""
    enough = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n >= 14").select(key)
    weeks = weekly_means(df, value, key, date, anchor_on_values=True)
    before = F.lag("mean").over(Window.partitionBy(key).orderBy("week"))
    change = weeks.withColumn("change", F.abs(F.col("mean") - before) / (F.abs(before) + 1e-6))
    return change.join(enough, key, "left_semi").groupBy(key).agg(clip(1 - percentile("change", 0.5), 0, 1).alias("reproducibility")).filter("reproducibility is not null")


def rolling_variation(df: DataFrame, value: str, rows: int = 7, key: str = "participant_id", order: str = "date") -> DataFrame:
    """(key, order, variation): sample deviation over mean in full frames of ``rows`` values."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    full = F.count(value).over(w) == rows
    return df.select(key, order, F.when(full, ratio(F.stddev_samp(value).over(w), F.avg(value).over(w) + 1e-9)).alias("variation"))


def drift(df: DataFrame, value: str, key: str = "participant_id", order: str = "date", least: int = 5) -> DataFrame:
    """(key, n, slope, t): least-squares slope on the index of the non-null values in order, with its t statistic."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("__y"), (F.row_number().over(w) - 1).cast("double").alias("__x"))
    by = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("__y").alias("__s"), F.regr_slope("__y", "__x").alias("slope"), F.regr_r2("__y", "__x").alias("__r2"), F.covar_pop("__x", "__y").alias("__c"))
    ok = (F.col("n") >= least) & (F.col("__s") >= 1e-9)
    t = F.signum("__c") * F.sqrt(ratio(F.col("__r2") * (F.col("n") - 2), 1 - F.col("__r2")))
    return by.select(key, "n", F.when(ok, F.col("slope")).alias("slope"), F.when(ok, t).alias("t"))


def participant_stability(df: DataFrame, value: str, key: str = "participant_id", order: str = "date") -> DataFrame:
    """(key, mean_variation, slope, p_value)."""
    from ..functions.arrow import t_test_p

    rolling = rolling_variation(df, value, key=key, order=order).groupBy(key).agg(F.avg("variation").alias("mean_variation"))
    return rolling.join(drift(df, value, key, order), key, "left").select(key, "mean_variation", "slope", t_test_p(F.col("t"), (F.col("n") - 2).cast("double")).alias("p_value"))
