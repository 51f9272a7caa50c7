"""Effect sizes by subject and the intervals of Cliff's delta and of mean scores, against resampled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwarden.operators import effects, models


def delta(a, b):
    return float(np.sign(a[:, None] - b[None, :]).mean())


def test_state_effect_sizes_by_subject(spark):
    rng, rows = np.random.default_rng(4), []
    for subject, (n_a, n_b, gap) in {"s1": (30, 40, 1.0), "s2": (25, 25, 0.0), "few": (4, 30, 1.0)}.items():
        rows += [(subject, "x", float(v)) for v in np.round(rng.normal(gap, 1, n_a), 1)]
        rows += [(subject, "y", float(v)) for v in np.round(rng.normal(0, 1, n_b), 1)]
    rows += [("s1", "x", None), ("s1", "other", 3.0)]
    df = spark.createDataFrame(rows, "subject_id string, state string, m double")
    got = {r.subject_id: r for r in effects.state_effect_sizes(df, ["m"], "state", "x", "y", by=["subject_id"]).collect()}
    assert set(got) == {"s1", "s2"}
    for s, r in got.items():
        a, b = (np.array([v for u, t, v in rows if (u, t) == (s, side) and v is not None]) for side in "xy")
        assert (r.n_a, r.n_b, r.contrast, r.metric) == (len(a), len(b), "x_vs_y", "m")
        assert abs(r.cliffs_delta - delta(a, b)) < 1e-9 and abs(r.median_a - np.median(a)) < 1e-9 and abs(r.mean_b - b.mean()) < 1e-9
        boot = [delta(rng.choice(a, len(a)), rng.choice(b, len(b))) for _ in range(4000)]
        low, high = np.percentile(boot, [2.5, 97.5])
        assert abs(r.cliffs_delta_ci_low - low) < 0.06 and abs(r.cliffs_delta_ci_high - high) < 0.06
    assert effects.state_effect_sizes(df, ["m"], "state", "x", "y").count() == 1


def test_track_summary(spark):
    x = [0.5, 0.6, 0.7, 0.9, 0.95, 0.4]
    track = spark.createDataFrame([("all", f"s{i}", v) for i, v in enumerate(x)] + [("all", "none", None), ("pass_both", "s1", 0.8)], "condition string, subject_id string, auroc double")
    got = {r.condition: r for r in models.track_summary(track).collect()}
    rng = np.random.default_rng(1)
    low, high = np.percentile([rng.choice(x, len(x)).mean() for _ in range(4000)], [2.5, 97.5])
    r = got["all"]
    assert r.n_subjects == 6 and abs(r["mean"] - np.mean(x)) < 1e-9 and abs(r.ci_low - low) < 0.03 and abs(r.ci_high - high) < 0.03
    assert got["pass_both"].ci_low == got["pass_both"].ci_high == 0.8


def test_interval_of_many_groups_in_batches(spark):
    """Small groups share a batch: none is a call of its own, and the bounds are those of NumPy's draws."""
    rows = [(g, "m", float(i % 7), i % 2 == 0) for g in range(3) for i in range(12 + g)]
    df = spark.createDataFrame(rows, "g long, metric string, value double, a boolean")
    out = effects.cliffs_interval(df, F.col("a"), ["g", "metric"], replicates=260)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    seeds = {(r.g, r.p): r.s for r in df.select("g", "metric").distinct().withColumn("p", F.explode(F.array(F.lit(0), F.lit(1)))).select("g", "p", F.xxhash64("g", "metric", "p", F.lit(42)).alias("s")).collect()}
    for r in out.collect():
        own = [x for x in rows if x[0] == r.g]
        a, b = (np.array([sum(x[2] == v and x[3] is side for x in own) for v in range(7)]) for side in (True, False))
        deltas = []
        for part, n in ((0, 250), (1, 10)):
            rng = np.random.default_rng(seeds[r.g, part] & 0x7FFFFFFFFFFFFFFF)
            x, y = rng.multinomial(a.sum(), a / a.sum(), n), rng.multinomial(b.sum(), b / b.sum(), n)
            deltas += list(2 * (x * (y.cumsum(1) - y / 2)).sum(1) / (a.sum() * b.sum()) - 1)
        assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.percentile(deltas, [2.5, 97.5])), abs=1e-12)
