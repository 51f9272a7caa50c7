"""Adjustment sets from a causal graph and adjusted effects: linear g-computation, doubly robust estimates, positivity."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import quantiles
from ..functions.stacked import design, least_squares_fits, poisson_counts, products, stacked_logistic, stacked_sums
from ..functions.stats import safe_corr
from ..session import cut

# The default graph, cause before effect.
WEARABLE_EDGES = (
    ("age", "baseline_hr"), ("age", "baseline_hrv"), ("sex", "baseline_hr"),
    ("heat_index", "sleep_efficiency"), ("heat_index", "hrv_rmssd"),
    ("stress_proxy", "sleep_efficiency"), ("stress_proxy", "hrv_rmssd"), ("stress_proxy", "missing_wearable_flag"),
    ("active_minutes", "resting_hr"), ("active_minutes", "hrv_rmssd"), ("active_minutes", "ppg_motion"),
    ("device_type", "resting_hr"), ("device_type", "signal_quality"), ("skin_tone", "signal_quality"),
    ("baseline_hr", "resting_hr"), ("baseline_hrv", "hrv_rmssd"), ("sleep_efficiency", "hrv_rmssd"), ("aqi", "sleep_efficiency"),
)


class Graph:
    """A small directed graph, kept on the driver."""

    def __init__(self, edges: Iterable[tuple[str, str]] = ()):
        self.parents: dict[str, set[str]] = {}
        for cause, effect in edges:
            self.add_edge(cause, effect)

    def add_node(self, node: str) -> None:
        self.parents.setdefault(node, set())

    def add_edge(self, cause: str, effect: str) -> None:
        self.add_node(cause)
        self.add_node(effect)
        self.parents[effect].add(cause)

    @property
    def nodes(self) -> list[str]:
        return sorted(self.parents)

    def has_cycle(self) -> bool:
        """Takes away nodes without parents until none is left; what stays is on or behind a cycle."""
        left = {n: set(p) for n, p in self.parents.items()}
        while free := [n for n, p in left.items() if not p]:
            for n in free:
                del left[n]
            for p in left.values():
                p.difference_update(free)
        return bool(left)

    def ancestors(self, node: str) -> set[str]:
        found: set[str] = set()
        todo = [node]
        while todo:
            new = self.parents.get(todo.pop(), set()) - found
            found |= new
            todo += new
        return found

    def descendants(self, node: str) -> set[str]:
        return {n for n in self.parents if node in self.ancestors(n)}

    def back_door_set(self, treatment: str, outcome: str) -> list[str]:
        """Common ancestors of both that the treatment doesn't cause."""
        if self.has_cycle():
            raise ValueError("the graph has a cycle")
        if treatment == outcome:
            raise ValueError("treatment and outcome are the same")
        for n in (treatment, outcome):
            if n not in self.parents:
                raise KeyError(n)
        common = self.ancestors(treatment) & self.ancestors(outcome)
        return sorted(common - self.descendants(treatment) - {treatment, outcome})


def default_graph() -> Graph:
    return Graph(WEARABLE_EDGES)


@dataclass
class Estimate:
    treatment: str
    outcome: str
    method: str
    effect: float | None
    ci_low: float | None = None
    ci_high: float | None = None
    n: int = 0
    adjustment: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {k: (round(v, 4) if isinstance(v, float) else ",".join(v) if isinstance(v, list) else v) for k, v in asdict(self).items()}


def binarized(df: DataFrame, column: str, name: str = "t", at_least: bool = False) -> DataFrame:
    """0/1 of a treatment: two levels in order, or over (``at_least``: at or over) the median of a number."""
    levels = [r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().limit(3).collect()]
    numeric = isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))
    if len(levels) == 2:
        return df.withColumn(name, (F.col(column) == F.lit(max(levels))).cast("double"))
    if not numeric:
        raise ValueError(f"{column} has more than two levels and is not a number")
    m = F.lit(quantiles(df, [column], [0.5])[column][0]).cast("double")
    return df.withColumn(name, (F.col(column) >= m if at_least else F.col(column) > m).cast("double"))


def gram(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> np.ndarray:
    """Sums of products of the columns with a leading 1, from one aggregation of complete rows."""
    names = ["__one", *columns]
    rows = df.withColumn("__one", F.lit(1.0)).select(*names, *([weight] if weight else [])).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    w = F.col(weight) if weight else F.lit(1.0)
    sums = rows.agg(*[F.coalesce(F.sum(F.col(names[i]) * F.col(names[j]) * w), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for i, j in pairs:
        out[i, j] = out[j, i] = sums[f"s{i}_{j}"]
    return out


def least_squares(g: np.ndarray) -> np.ndarray:
    """Coefficients of the last column on the others, of least norm if they are collinear."""
    return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]


def _complete(df: DataFrame, treatment: str, outcome: str, adjust: Sequence[str]) -> DataFrame:
    held = [a for a in adjust if a in df.columns]
    rows = df.select(F.col(treatment).alias("__x"), F.col(outcome).cast("double").alias("y"), *[F.col(a).cast("double").alias(a) for a in held]).dropna()
    return binarized(rows, "__x", "t").drop("__x")


def _replicate_weights(df: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Rows with Poisson(1) counts of ``replicates`` resamples as an array; stable under any partitioning of equal rows' values."""
    from .reliability import bootstrap_weight

    row = F.xxhash64(*df.columns)
    return df.withColumn("__w", F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda b: bootstrap_weight(row, b, seed).cast("double")))


def g_computation(df: DataFrame, treatment: str, outcome: str, adjust: Sequence[str], replicates: int = 0, seed: int = 42, learner: str = "linear") -> Estimate:
    """Mean outcome under treatment less that without, by a linear outcome model: the treatment's coefficient.

    All that leaves the executors is the matrix of sums, one for each replicate. ``learner="boosted"`` fits
    gradient-boosted trees instead and averages their predictions; it has no interval.
    """
    rows = _complete(df, treatment, outcome, adjust)
    held = [c for c in rows.columns if c not in ("t", "y")]
    if learner == "boosted":
        return _boosted(rows, treatment, outcome, held, seed)
    if learner != "linear":
        raise ValueError(f"unknown learner {learner!r}")
    g = gram(rows, ["t", *held, "y"])
    boot = []
    if replicates:
        cols = ["t", *held, "y"]
        names = ["__one", *cols]
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        exploded = _replicate_weights(rows, replicates, seed).withColumn("__one", F.lit(1.0)).select(*names, F.posexplode("__w").alias("b", "w"))
        for r in exploded.groupBy("b").agg(*[F.sum(F.col(names[i]) * F.col(names[j]) * F.col("w")).alias(f"s{i}_{j}") for i, j in pairs]).collect():
            m = np.zeros_like(g)
            for i, j in pairs:
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
            boot.append(least_squares(m)[1])
    return Estimate(treatment, outcome, "g_computation", float(least_squares(g)[1]), *(map(float, np.percentile(boot, [2.5, 97.5])) if boot else (None, None)), int(g[0, 0]), held)


def _boosted(rows: DataFrame, treatment: str, outcome: str, held: list[str], seed: int) -> Estimate:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    model = Pipeline(stages=[VectorAssembler(inputCols=["t", *held], outputCol="features"), GBTRegressor(labelCol="y", maxIter=40, maxDepth=3, seed=seed)]).fit(rows)
    under = [model.transform(rows.withColumn("t", F.lit(a))).agg(F.avg("prediction").alias("p"), F.count(F.lit(1)).alias("n")).first() for a in (1.0, 0.0)]
    return Estimate(treatment, outcome, "g_computation_boosted", under[0]["p"] - under[1]["p"], n=under[0]["n"], adjustment=held)


def logistic(df: DataFrame, label: str, features: Sequence[str], c: float = 1.0, iterations: int = 50) -> np.ndarray:
    """Intercept and coefficients of an L2-penalised logistic model (strength 1/c, intercept free), by Newton steps.

    Each step is one aggregation of the gradient and Hessian; rows stay where they are.
    """
    names = ["__one", *features]
    rows = df.withColumn("__one", F.lit(1.0))
    beta = np.zeros(len(names))
    penalty = np.diag([0.0, *[1.0 / c] * len(features)])
    for _ in range(iterations):
        eta = sum((F.col(x) * float(b) for x, b in zip(names, beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        s = rows.agg(*[F.sum((F.col(label) - p) * F.col(x)).alias(f"g{i}") for i, x in enumerate(names)], *[F.sum(p * (1 - p) * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in pairs]).first()
        grad = np.array([s[f"g{i}"] or 0.0 for i in range(len(names))]) - penalty @ beta
        hess = penalty.copy()
        for i, j in pairs:
            hess[i, j] += s[f"h{i}_{j}"] or 0.0
            if i != j:
                hess[j, i] = hess[i, j]
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _linear(features: Sequence[str], beta: np.ndarray):
    return sum((F.col(x) * float(b) for x, b in zip(features, beta[1:])), F.lit(float(beta[0])))


def with_propensity(df: DataFrame, features: Sequence[str], label: str = "t", clip: tuple[float, float] | None = (0.02, 0.98)) -> DataFrame:
    p = 1 / (1 + F.exp(-_linear(features, logistic(df, label, features))))
    return df.withColumn("ps", F.least(F.greatest(p, F.lit(clip[0])), F.lit(clip[1])) if clip else p)


def aipw(df: DataFrame, treatment: str, outcome: str, adjust: Sequence[str], replicates: int = 0, seed: int = 42, learner: str = "linear", clip: tuple[float, float] = (0.02, 0.98)) -> Estimate:
    """Augmented inverse-propensity estimate: clipped propensity and an outcome model in each arm.

    Without adjustment columns it is the difference of means; with under two rows in an arm it has no effect. Every replicate fits its own
    propensity and outcome models (``linear``: logistic and linear), all replicates in the same passes; one with under two rows in an arm is left out.
    ``learner="boosted"`` fits gradient-boosted trees instead; it has no interval.
    """
    if learner not in ("linear", "boosted"):
        raise ValueError(f"unknown learner {learner!r}")
    rows = _complete(df, treatment, outcome, adjust)
    held = [c for c in rows.columns if c not in ("t", "y")]
    # Many passes follow, so rows are dealt evenly to a few tasks a core.
    rows = cut(rows.withColumn("__row", F.xxhash64(*rows.columns)).repartition(3 * rows.sparkSession.sparkContext.defaultParallelism))
    arms = {r["t"]: r["n"] for r in rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = Estimate(treatment, outcome, "aipw", None, n=sum(arms.values()), adjustment=held)
    if min(arms.get(0.0, 0), arms.get(1.0, 0)) < 2:
        return out
    if learner == "boosted":
        out.effect = _boosted_aipw(rows, held, seed, clip)
        return out
    models, k = replicates + 1, len(held) + 2
    weights = lambda pdf: poisson_counts(pdf["__row"].to_numpy(), replicates, seed)

    def arms_sums(pdf) -> np.ndarray:
        w, xy, t = weights(pdf), products(design(pdf, [*held, "y"])), pdf["t"].to_numpy()
        return np.hstack([w[t == a].T @ xy[t == a] for a in (1.0, 0.0)])

    if held:
        # Replicates begin at the model of all rows, which one model's passes find, and their first step's pass sums the outcome models too.
        found: list = []
        whole = stacked_logistic(rows, held, "t", lambda pdf: np.ones((len(pdf), 1)), 1)
        ps = stacked_logistic(rows, held, "t", weights, models, start=whole[0], beside=(arms_sums, 2 * k * k, found))
        both = found[0]
    else:
        ps, both = None, stacked_sums(rows, arms_sums, models, 2 * k * k)
    m1, m0 = least_squares_fits(both[:, : k * k]), least_squares_fits(both[:, k * k :])

    def sums(pdf) -> np.ndarray:
        x, w, t, y = design(pdf, held), weights(pdf), pdf["t"].to_numpy()[:, None], pdf["y"].to_numpy()[:, None]
        treated = [(w * (t == a)).sum(0) for a in (1.0, 0.0)]
        if ps is None:
            return np.column_stack([(w * t * y).sum(0), (w * (1 - t) * y).sum(0), *treated, w.sum(0)])
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ ps.T, -500, 500))), *clip)
        one, none = x @ m1.T, x @ m0.T
        return np.column_stack([(w * (one + t * (y - one) / p)).sum(0), (w * (none + (1 - t) * (y - none) / (1 - p))).sum(0), *treated, w.sum(0)])

    s = stacked_sums(rows, sums, models, 5)
    below = (s[:, 2], s[:, 3]) if ps is None else (s[:, 4], s[:, 4])
    fit = (s[:, 2] >= 2) & (s[:, 3] >= 2)
    effects = np.where(fit, s[:, 0] / np.maximum(below[0], 1) - s[:, 1] / np.maximum(below[1], 1), np.nan)
    out.effect = float(effects[0])
    if fit[1:].any():
        out.ci_low, out.ci_high = map(float, np.percentile(effects[1:][fit[1:]], [2.5, 97.5]))
    return out


def _boosted_aipw(rows: DataFrame, held: list[str], seed: int, clip: tuple[float, float]) -> float | None:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    if not held:
        r = rows.agg(F.avg(F.when(F.col("t") == 1, F.col("y"))).alias("a"), F.avg(F.when(F.col("t") == 0, F.col("y"))).alias("b")).first()
        return r["a"] - r["b"]
    x = VectorAssembler(inputCols=held, outputCol="features")
    boosted = {"maxIter": 40, "maxDepth": 3, "seed": seed}
    score = Pipeline(stages=[x, GBTClassifier(labelCol="t", **boosted)]).fit(rows)
    scored = score.transform(rows).withColumn("ps", F.least(F.greatest(F.get(vector_to_array("probability"), F.lit(1)), F.lit(clip[0])), F.lit(clip[1]))).drop("rawPrediction", "probability", "prediction")
    for a in (1.0, 0.0):
        arm = GBTRegressor(labelCol="y", predictionCol=f"m{int(a)}", **boosted).fit(x.transform(rows.filter(F.col("t") == a)))
        scored = arm.transform(scored)
    t, y = F.col("t"), F.col("y")
    return scored.agg(F.avg(F.col("m1") + t * (y - F.col("m1")) / F.col("ps") - F.col("m0") - (1 - t) * (y - F.col("m0")) / (1 - F.col("ps"))).alias("e")).first()["e"]


def positivity(df: DataFrame, treatment: str, adjust: Sequence[str], least: int = 50) -> DataFrame | None:
    """One row on the propensities: min, max, mean, 5th and 95th percentile, share outside [0.05, 0.95], effective sample size; None for under ``least`` rows."""
    held = [a for a in adjust if a in df.columns]
    rows = binarized(df.select(F.col(treatment).alias("__x"), *[F.col(a).cast("double").alias(a) for a in held]).dropna(), "__x", "t", at_least=True)
    if rows.limit(least).count() < least:
        return None
    p = F.col("ps")
    w = F.when(F.col("t") == 1, 1 / p).otherwise(1 / (1 - p))
    scored = cut(with_propensity(rows, held, clip=(1e-6, 1 - 1e-6)))
    low, high = quantiles(scored, ["ps"], [0.05, 0.95])["ps"]
    return scored.agg(
        F.lit(treatment).alias("treatment"), F.count(F.lit(1)).alias("n"), F.min(p).alias("ps_min"), F.max(p).alias("ps_max"), F.avg(p).alias("ps_mean"), F.lit(low).alias("ps_p05"), F.lit(high).alias("ps_p95"),
        F.avg(((p < 0.05) | (p > 0.95)).cast("double")).alias("outside"), (F.sum(w) ** 2 / F.sum(w * w)).alias("effective_n"),
    )


def screening_vs_adjusted(df: DataFrame, pairs: Sequence[tuple[str, str]], graph: Graph | None = None, fallback: Sequence[str] = ("stress_proxy", "active_minutes", "sleep_efficiency", "temperature_c"), replicates: int = 0, least: int = 10) -> DataFrame:
    """(treatment, outcome, r, effect, ci_low, ci_high, n, adjustment) for each pair with enough complete rows."""
    graph, out = graph or default_graph(), []
    # Every pair reads the days several times, and they may be long in the making.
    df = cut(df.select([c for c in df.columns if c in {*fallback, *graph.parents, *(c for pair in pairs for c in pair)}]))
    for t, y in pairs:
        known = t in graph.parents and y in graph.parents
        adjust = [a for a in (graph.back_door_set(t, y) if known else []) if a in df.columns] or [a for a in fallback if a in df.columns and a not in (t, y)]
        one = df.agg(safe_corr(t, y).alias("r"), F.count(F.when(F.col(y).isNotNull(), F.col(t))).alias("n")).first()
        if one["n"] >= least:
            e = aipw(df, t, y, adjust, replicates)
            out.append((t, y, one["r"], e.effect, e.ci_low, e.ci_high, e.n, ",".join(e.adjustment)))
    return df.sparkSession.createDataFrame(out, "treatment string, outcome string, r double, effect double, ci_low double, ci_high double, n long, adjustment string")
