"""Effect sizes and tests between two states or groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import grouped_medians, running_sums
from ..functions.stats import normal_p, rank_sums, ratio

#: Replicates of a bootstrap that one task draws.
CHUNK = 250


def unpivoted(df: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, metric, value) for each metric that is there."""
    held = [m for m in metrics if m in df.columns]
    return df.unpivot(list(keep), held, "metric", "value")


def per_state_comparison(df: DataFrame, metrics: Sequence[str], state: str, a, b, by: Sequence[str] = ("subject_id",), least: int = 3) -> DataFrame:
    """By subject and metric: counts, means, their difference b - a and the rank-sum p-value (normal, without corrections)."""
    tall = unpivoted(df.filter(F.col(state).isin(a, b)), metrics, [*by, state]).filter("value is not null")
    keys = [*by, "metric"]
    is_a = F.col(state) == F.lit(a)
    means = tall.groupBy(*keys).agg(F.count_if(is_a).alias("n_a"), F.count_if(~is_a).alias("n_b"), F.avg(F.when(is_a, F.col("value"))).alias("mean_a"), F.avg(F.when(~is_a, F.col("value"))).alias("mean_b"))
    ranks = rank_sums(tall, "value", is_a, keys).select(*keys, "z")
    return means.join(ranks, keys).filter((F.col("n_a") >= least) & (F.col("n_b") >= least)).select(*keys, "n_a", "n_b", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("delta"), "z", normal_p(F.col("z")).alias("p_value"))


def within_subject_tests(df: DataFrame, metrics: Sequence[str], state: str, contrasts: Sequence[tuple], by: Sequence[str] = ("subject_id",), least: int = 5, sides: str = "greater") -> DataFrame:
    """By subject, metric and contrast (a, b): Mann-Whitney U of a, p-value with tie and continuity correction, Cliff's delta."""
    from ..functions.arrow import mann_whitney_p, mann_whitney_p_greater

    p = mann_whitney_p_greater if sides == "greater" else mann_whitney_p
    out = None
    for a, b in contrasts:
        tall = unpivoted(df.filter(F.col(state).isin(a, b)), metrics, [*by, state])
        r = rank_sums(tall, "value", F.col(state) == F.lit(a), [*by, "metric"]).filter((F.col("n_a") >= least) & (F.col("n_b") >= least))
        one = r.select(*by, "metric", F.lit(f"{a}_vs_{b}").alias("contrast"), "n_a", "n_b", "u_a", "cliffs_delta", p("u_a", "n_a", "n_b", F.col("ties").cast("double")).alias("p_value"))
        out = one if out is None else out.unionByName(one)
    return out


def cohens_d(df: DataFrame, value: str, group: Column, by: Sequence[str] = ()) -> DataFrame:
    """Difference of means (a - b) over the pooled deviation; NULL for under 2 values a side or no spread."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    n_a, n_b = F.count(a), F.count(b)
    pooled = ratio((n_a - 1) * F.var_samp(a) + (n_b - 1) * F.var_samp(b), (n_a + n_b - 2).cast("double"))
    return df.groupBy(*by).agg(n_a.alias("n_a"), n_b.alias("n_b"), F.when((n_a >= 2) & (n_b >= 2) & (pooled > 0), ratio(F.avg(a) - F.avg(b), F.sqrt(pooled))).alias("cohens_d"))


def e_value(effect: Column, low: Column, high: Column, null: float = 0.0) -> dict[str, Column]:
    """How strong a hidden confounder must be to explain a standardised effect, and its nearer bound (1 if the interval holds the null)."""
    risk = lambda c: F.exp(0.91 * F.abs(c - null))
    e = lambda c: risk(c) + F.sqrt(risk(c) * (risk(c) - 1))
    near = F.when(effect >= null, low).otherwise(high)
    return {"risk_ratio": risk(effect), "e_value": e(effect), "e_value_bound": F.when((low <= null) & (high >= null), 1.0).otherwise(e(near))}


def cliffs_interval(tall: DataFrame, is_a: Column, keys: Sequence[str], replicates: int = 500, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(keys, ci_low, ci_high): bootstrap interval of Cliff's delta of ``value``, each side resampled to its own size.

    Resampling rows is drawing multinomial counts for the different values, so a task holds these and not the rows;
    the replicates of a group are spread over tasks by CHUNK. Many small groups share a batch, and a chunk of replicates is one row.
    """
    counts = tall.filter("value is not null").groupBy(*keys, F.col("value").cast("double").alias("value")).agg(F.count_if(is_a).alias("__a"), F.count_if(~is_a).alias("__b"))
    groups = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("value", "__a", "__b"))).alias("__vs"))
    groups = groups.select(*keys, F.transform("__vs", lambda v: v["__a"]).alias("__a"), F.transform("__vs", lambda v: v["__b"]).alias("__b"))
    parts = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // CHUNK))))
    # Few bytes and much work: dealt to a number of partitions that adaptive execution doesn't coalesce.
    parts = parts.withColumn("__seed", F.xxhash64(*keys, "__part", F.lit(seed))).repartition(2 * int(tall.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__part")

    def drawn(a: np.ndarray, b: np.ndarray, part: int, start: int) -> np.ndarray:
        n_a, n_b = int(a.sum()), int(b.sum())
        if not n_a or not n_b:
            return np.zeros(0)
        rng = np.random.default_rng(start & 0x7FFFFFFFFFFFFFFF)
        left, step, out = min(CHUNK, replicates - CHUNK * part), max(1, 1_000_000 // len(a)), []
        while left > 0:
            x, y = rng.multinomial(n_a, a / n_a, min(step, left)), rng.multinomial(n_b, b / n_b, min(step, left))
            out.append(2 * (x * (y.cumsum(1) - y / 2)).sum(1) / (n_a * n_b))
            left -= step
        return np.concatenate(out) - 1

    def resampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["__a"], pdf["__b"], pdf["__part"], pdf["__seed"])
            yield pdf[list(keys)].assign(deltas=[drawn(np.asarray(a, np.int64), np.asarray(b, np.int64), int(part), int(start)) for a, b, part, start in rows])

    fields = T.StructType([*[tall.schema[k] for k in keys], T.StructField("deltas", T.ArrayType(T.DoubleType()))])
    of = parts.mapInPandas(resampled, fields).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("deltas"))).alias("d")).filter(F.size("d") > 0)
    tail = (1 - confidence) / 2
    return of.select(*keys, _percentile("d", tail).alias("ci_low"), _percentile("d", 1 - tail).alias("ci_high"))


def _percentile(ordered: str, q: float) -> Column:
    """Of an array in order, with linear interpolation as ``percentile`` has it."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, high)
    return F.when((low == high) | (below == above), below).otherwise((high - at) * below + (at - low) * above)


def state_effect_sizes(df: DataFrame, metrics: Sequence[str], state: str, a, b, by: Sequence[str] = (), least: int = 5, replicates: int = 500, seed: int = 42) -> DataFrame:
    """By ``by``, contrast and metric with ``least`` values a side: counts, means, medians, two-sided Mann-Whitney p, Cliff's
    delta with its bootstrap interval, Cohen's d."""
    from ..functions.arrow import mann_whitney_p

    tall = unpivoted(df.filter(F.col(state).isin(a, b)), metrics, [*by, state]).filter("value is not null")
    is_a, keys = F.col(state) == F.lit(a), [*by, "metric"]
    x, y = F.when(is_a, F.col("value")), F.when(~is_a, F.col("value"))
    half = F.lit(0.5)
    sides = tall.groupBy(*keys).agg(F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), F.percentile(x, half).alias("median_a"), F.percentile(y, half).alias("median_b"))
    r = rank_sums(tall, "value", is_a, keys).filter((F.col("n_a") >= least) & (F.col("n_b") >= least))
    d = cohens_d(tall, "value", is_a, keys).select(*keys, "cohens_d")
    interval = cliffs_interval(tall.join(r.select(*keys), keys, "left_semi"), is_a, keys, replicates, seed=seed)
    p = mann_whitney_p("u_a", "n_a", "n_b", F.col("ties").cast("double")).alias("p_value")
    held = r.select(*keys, F.lit(f"{a}_vs_{b}").alias("contrast"), "n_a", "n_b", p, "cliffs_delta")
    named = interval.withColumnsRenamed({"ci_low": "cliffs_delta_ci_low", "ci_high": "cliffs_delta_ci_high"})
    return held.join(sides, keys).join(named, keys).join(d, keys)


def _signed_sums(df: DataFrame, delta: str, by: Sequence[str]) -> DataFrame:
    """By group: numbers of non-zero and of zero differences, W+ with average ranks, sum of t^3 - t over tied sizes."""
    rows = df.filter(F.col(delta).isNotNull()).select(*by, F.col(delta).alias("__d"))
    counts = rows.groupBy(*by, F.abs("__d").alias("__s")).agg(F.count_if(F.col("__d") > 0).alias("__p"), F.count(F.lit(1)).alias("__n"))
    held = F.when(F.col("__s") > 0, F.col("__n")).otherwise(0)
    ranked = running_sums(counts, [F.col("__s")], {"__before": held}, by).withColumn("__held", held)
    cubes = F.pow(F.col("__held").cast("double"), F.lit(3.0)) - F.col("__held")
    return ranked.groupBy(*by).agg(
        F.sum("__held").alias("n"), F.sum(F.col("__n") - F.col("__held")).alias("zeros"),
        F.sum((F.col("__before") + (F.col("__n") + 1) / 2.0) * F.col("__p")).alias("w_plus"), F.sum(cubes).alias("ties"),
    )


def signed_ranks(df: DataFrame, delta: str, by: Sequence[str] = ()) -> DataFrame:
    """By group: n, W+ of the non-zero differences with average ranks."""
    return _signed_sums(df, delta, by).filter("n > 0").select(*by, "n", "w_plus")


def paired_wilcoxon(df: DataFrame, delta: str, by: Sequence[str] = ()) -> DataFrame:
    """n, median difference, W+ and the one-sided p-value of differences, by group; W+ is NULL where all are zero.

    Ranks and medians come from counts of different values, and the p-value needs sums only, so a group of any size is
    spread over tasks.
    """
    from ..functions.arrow import signed_rank_p

    w = _signed_sums(df, delta, by)
    tested = w.select(*[F.col(b).alias(f"__w_{b}") for b in by], F.when(F.col("n") > 0, F.col("w_plus")).alias("w_plus"), signed_rank_p("w_plus", "n", "zeros", "ties").alias("p_value"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__w_{b}"))
    return grouped_medians(df, delta, by).join(tested, same).select(*by, "n", F.col("median").alias("median_delta"), "w_plus", "p_value")
