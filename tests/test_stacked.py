"""Models fitted together over the same rows: each equals the one fitted alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwarden.functions import stacked
from sigwarden.operators import causal, models


def newton(x, y, w, penalty=1.0):
    """A weighted logistic fit with a free intercept, alone."""
    x, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0, *[penalty] * (x.shape[1] - 1)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            return beta


def data(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    t = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    y = 2 * t + x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n)
    return x, t, y


def test_aipw_refits_every_replicate(spark):
    """200 replicates against a loop that fits propensity and arms for each of them."""
    x, t, y = data()
    df = spark.createDataFrame([(float(a), float(b), *map(float, c)) for a, b, c in zip(t, y, x)], "treat double, out double, a double, b double").repartition(3)
    e = causal.aipw(df, "treat", "out", ["a", "b"], replicates=200)
    rows = causal._complete(df, "treat", "out", ["a", "b"])
    held = rows.withColumn("h", F.xxhash64(*rows.columns)).toPandas()
    xs, ts, ys, counts = held[["a", "b"]].to_numpy(), held["t"].to_numpy(), held["y"].to_numpy(), stacked.poisson_counts(held["h"].to_numpy(), 200, 42)
    effects = []
    for w in counts.T:
        p = np.clip(1 / (1 + np.exp(-np.column_stack([np.ones(len(xs)), xs]) @ newton(xs, ts, w))), 0.02, 0.98)
        arms = []
        for a in (1, 0):
            v = w * (ts == a)
            z = np.column_stack([np.ones(len(xs)), xs])
            arms.append(z @ np.linalg.solve((z * v[:, None]).T @ z, z.T @ (v * ys)))
        psi = arms[0] + ts * (ys - arms[0]) / p - arms[1] - (1 - ts) * (ys - arms[1]) / (1 - p)
        effects.append((w * psi).sum() / w.sum())
    assert e.effect == pytest.approx(effects[0], abs=1e-8) and abs(e.effect - 2) < 0.5
    assert [e.ci_low, e.ci_high] == pytest.approx(np.percentile(effects[1:], [2.5, 97.5]).tolist(), abs=1e-8)
    assert e.ci_low < e.effect < e.ci_high


def test_aipw_without_adjustment_arms_or_with_trees(spark):
    x, t, y = data()
    df = spark.createDataFrame([(float(a), float(b), *map(float, c)) for a, b, c in zip(t, y, x)], "treat double, out double, a double, b double")
    e = causal.aipw(df, "treat", "out", [], replicates=50)
    assert e.effect == pytest.approx(y[t == 1].mean() - y[t == 0].mean()) and e.ci_low < e.effect < e.ci_high
    assert causal.aipw(df.limit(3).withColumn("treat", F.monotonically_increasing_id() == 0), "treat", "out", ["a"], replicates=5).effect is None
    boosted = causal.aipw(df, "treat", "out", ["a", "b"], learner="boosted")
    assert abs(boosted.effect - 2) < 0.6 and boosted.ci_low is None
    with pytest.raises(ValueError):
        causal.aipw(df, "treat", "out", ["a"], learner="other")


def test_poisson_counts_are_poisson():
    c = stacked.poisson_counts(np.arange(2000, dtype=np.int64) * 7919, 50, 42)
    assert (c[:, 0] == 1).all() and abs(c[:, 1:].mean() - 1) < 0.02 and abs(c[:, 1:].var() - 1) < 0.03
    assert abs(np.corrcoef(c[:, 1], c[:, 2])[0, 1]) < 0.08


def test_poisson_counts_equal_a_search_in_all_ends():
    rows = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 700)
    ends = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(16)])
    x = rows.view(np.uint64)[:, None] + (np.arange(1, 101, dtype=np.uint64) + np.uint64(42 << 32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    want = np.searchsorted(ends, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53, "right")
    assert (stacked.poisson_counts(rows, 100, 42)[:, 1:] == want).all()


def test_replicates_take_few_passes_over_days_that_are_made_once(spark, monkeypatch):
    """Replicates begin at the model of all rows and their outcome models share its first pass; pairs share one table of days."""
    x, t, y = data()
    made = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(float(a), float(b), *map(float, c)) for a, b, c in zip(t, y, x)], "treat double, out double, stress_proxy double, temperature_c double")

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    passes, sums = [], stacked.stacked_sums
    counted = lambda rows, f, models, width: passes.append(models) or sums(rows, f, models, width)
    monkeypatch.setattr(stacked, "stacked_sums", counted)
    monkeypatch.setattr(causal, "stacked_sums", counted)
    rows = causal.screening_vs_adjusted(df.mapInPandas(count, df.schema), [("treat", "out"), ("out", "treat")], replicates=100).collect()
    assert len(rows) == 2 and made.value == 300
    # A step or two more than Newton needs from nearby, and the effects.
    assert passes.count(101) <= 2 * 7


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(6):
        for _ in range(60):
            a, b = rng.normal(size=2) * (1 + s / 3) + s
            rows.append((f"S{s}", float(a), float(b * 100), int(rng.random() < 1 / (1 + np.exp(-(a - s) * 1.5)))))
    rows += [("few", 1.0, 2.0, 1)] * 4 + [("one", 1.0, 2.0, 1)] * 20 + [("S0", None, 1.0, 1)]
    return spark.createDataFrame(rows, "subject_id string, a double, b double, y int").cache()


def test_folds_equal_one_fit_each(spark, windows):
    pdf = windows.dropna().toPandas()
    got = {r.subject_id: r for r in models.loso_classify(windows, ["a", "b"], "y").collect()}
    assert set(got) == {f"S{i}" for i in range(6)}
    for s, r in got.items():
        train, test = pdf[pdf.subject_id != s], pdf[pdf.subject_id == s]
        x = train[["a", "b"]].to_numpy()
        m, d = x.mean(0), x.std(0)
        beta = newton((x - m) / d, train.y.to_numpy(float), np.ones(len(train)))
        score = (test[["a", "b"]].to_numpy() - m) / d @ beta[1:]
        pos, neg = score[test.y == 1], score[test.y == 0]
        auroc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert r.n == len(test) and r.auroc == pytest.approx(auroc)


def test_folds_send_no_rows(spark, windows):
    plan = models._logistic_folds(models.cut(windows.dropna()), ["a", "b"], "subject_id", [r for r in _sums(windows)], _total(windows), 1e-8, 100)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def _sums(windows):
    return windows.dropna().groupBy("subject_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("positive"), *[F.sum(c).alias(f"s_{c}") for c in "ab"], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in "ab"]).filter("positive < n").collect()


def _total(windows):
    r = windows.dropna().agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in "ab"], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in "ab"]).first()
    return r.asDict()


def test_forest_folds_tell_states_apart(spark, windows):
    rows = models.loso_classify(windows, ["a", "b"], "y", classifier="forest", trees=20, depth=4).collect()
    assert len(rows) == 6 and np.mean([r.auroc for r in rows]) > 0.6
    with pytest.raises(ValueError):
        models.loso_classify(windows, ["a"], "y", classifier="tree")
    assert models.loso_classify(windows.limit(0), ["a"], "y").count() == 0
