"""Kernels and column statistics against planted truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwarden.functions import arrow, kernels as k, ordered, stats

FS = 64


def ppg(bpm=72, seconds=5, noise=0.02, seed=0):
    t = np.arange(seconds * FS) / FS
    f = bpm / 60
    return np.sin(2 * np.pi * f * t) + 0.3 * np.sin(4 * np.pi * f * t) + noise * np.random.default_rng(seed).normal(size=len(t))


def ecg(bpm=72, seconds=5, fs=250, noise=0.02, seed=0):
    t = np.arange(seconds * fs) / fs
    beats = np.arange(0.3, seconds, 60 / bpm)
    return sum(1.2 * np.exp(-((t - b) ** 2) / (2 * 0.012**2)) for b in beats) + noise * np.random.default_rng(seed).normal(size=len(t))


def test_bandpass_passes_and_stops():
    t = np.arange(4000) / FS
    inner = slice(1000, 3000)
    assert np.abs(k.bandpass(np.sin(2 * np.pi * 2 * t), FS, k.PPG_BAND))[inner].max() == pytest.approx(1, abs=0.01)
    assert np.abs(k.bandpass(np.sin(2 * np.pi * 25 * t), FS, k.PPG_BAND))[inner].max() < 0.01
    assert np.abs(k.bandpass(np.ones(400), FS, k.PPG_BAND)).max() < 1e-6
    with pytest.raises(ValueError):
        k.butter_bandpass(3, 0.5, 40, 64)
    with pytest.raises(ValueError):
        k.bandpass(np.zeros(10), FS, k.PPG_BAND)
    # Zero phase: a symmetric pulse stays where it is.
    pulse = np.exp(-((np.arange(401) - 200) ** 2) / 200)
    assert np.argmax(k.bandpass(pulse, FS, k.PPG_BAND)) == 200


def test_find_peaks_rules():
    assert k.find_peaks(np.array([0, 1, 0, 2, 2, 2, 0, 1])).tolist() == [1, 4]
    assert k.find_peaks(np.array([0, 1, 0, 3, 0, 2, 0]), distance=3).tolist() == [3]
    assert k.find_peaks(np.array([0, 1, 0, 3, 0, 2, 0]), height=1.5).tolist() == [3, 5]
    assert k.find_peaks(np.zeros(10)).tolist() == [] and k.find_peaks(np.array([1.0, 2.0])).tolist() == []


@pytest.mark.parametrize("bpm", [55, 72, 110])
def test_heart_rates(bpm):
    assert k.hr_from_ppg(ppg(bpm, 10), FS) == pytest.approx(bpm, abs=3)
    assert k.hr_from_ecg(ecg(bpm, 10), 250) == pytest.approx(bpm, abs=3)
    assert math.isnan(k.hr_from_ppg(ppg(bpm, 2), FS))


def test_quality_scores_tell_clean_from_noise():
    noise = np.random.default_rng(1).normal(size=320)
    assert k.orphanidou_window(ppg(), FS)["acceptable"] and not k.orphanidou_window(noise, FS)["acceptable"]
    assert k.orphanidou_window(ecg(), 250, "ecg")["acceptable"]
    assert k.sukor_window(ppg(), FS)["acceptable"] and not k.sukor_window(np.zeros(320), FS)["acceptable"]
    assert k.ppg_quality(ppg(), FS) > k.ppg_quality(noise, FS) and k.ppg_quality(np.zeros(320), FS) == 0
    assert k.ecg_quality(ecg(), 250) > 0.5 and k.ecg_quality(np.zeros(1250), 250) == 0
    skewed = np.maximum(0, np.sin(2 * np.pi * 1.2 * np.arange(320) / FS) ** 3)
    assert k.elgendi_window(skewed, FS)["skewness"] > 0 > k.elgendi_window(skewed, FS, invert=True)["skewness"]


@pytest.mark.parametrize("x", [np.zeros(0), np.zeros(20), np.full(320, np.nan), np.ones(320)])
def test_degenerate_windows(x):
    assert not k.orphanidou_window(x, FS)["acceptable"] and not k.sukor_window(x, FS)["acceptable"] and not k.elgendi_window(x, FS)["acceptable"]


def test_changes():
    rng = np.random.default_rng(3)
    step = np.r_[rng.normal(60, 2, 40), rng.normal(68, 2, 40)]
    assert abs(k.binary_segmentation(step)[0]["index"] - 40) <= 3
    assert any(abs(c["index"] - 40) <= 3 and c["delta"] > 4 for c in k.bocpd(step))
    assert k.binary_segmentation(rng.normal(60, 2, 10)) == [] and k.bocpd(np.array([1.0, 2.0])) == []
    assert k.binary_segmentation(np.arange(80.0) + rng.normal(0, 0.1, 80), detrend=True) == []


def test_p_values():
    assert k.t_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert k.pearson_p(0.5, 30) == pytest.approx(0.004892, abs=1e-5)
    assert k.signed_rank(np.array([1.0, 2, 3, 4, 5]))[1] == pytest.approx(1 / 32)
    assert k.signed_rank(np.zeros(5)) == (0.0, 1.0) and math.isnan(k.signed_rank(np.array([1.0]))[1])
    assert k.mann_whitney_p(50, 10, 10, 0) == pytest.approx(1.0, abs=0.05)


def test_column_statistics(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=200), 1)
    y = np.round(x + rng.normal(size=200), 1)
    df = spark.createDataFrame([(float(a), float(b), int(i % 3 == 0)) for i, (a, b) in enumerate(zip(x, y))] + [(None, 1.0, 1)], "x double, y double, g int")
    rank = lambda v: np.array([(np.sum(v < e) + np.sum(v <= e) + 1) / 2 for e in v])
    r = df.agg(stats.safe_corr("x", "y").alias("r"), stats.strict_corr("x", "y").alias("s"), stats.sample_skewness("x").alias("k")).first()
    assert r["r"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and r["s"] is None
    assert stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    m = stats.rank_sums(df, "x", F.col("g") == 1).first()
    a, b = x[::3], np.delete(x, np.s_[::3])
    u = sum((e > b).sum() + 0.5 * (e == b).sum() for e in a)
    assert m["u_a"] == pytest.approx(u) and m["auroc"] == pytest.approx(u / len(a) / len(b))
    flat = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert flat.agg(stats.safe_corr("x", "y").alias("r")).first()["r"] is None


def test_kappa_conventions(spark):
    df = spark.createDataFrame([(1, 1)] * 6, "a int, b int")
    assert df.agg(stats.kappa("a", "b").alias("k")).first()["k"] is None
    assert df.agg(stats.kappa("a", "b", degenerate_zero=True).alias("k")).first()["k"] == 0
    df = spark.createDataFrame([(1, 1)] * 4 + [(0, 0)] * 4 + [(1, 0)] * 2, "a int, b int")
    assert df.agg(stats.kappa("a", "b").alias("k")).first()["k"] == pytest.approx(0.6154, abs=1e-3)


def test_window_table_polarity_and_nulls(spark):
    rows = [(i, "s", 1, "baseline", [float(v) for v in ecg(seed=i)], [float(v) for v in ppg(seed=i)]) for i in range(12)] + [(12, "s", 1, "baseline", None, None)]
    w = spark.createDataFrame(rows, "window_idx int, subject_id string, label int, label_name string, ecg array<double>, ppg array<double>")
    t = {r["window_idx"]: r for r in arrow.window_table(w, 250, FS).collect()}
    assert len(t[0]) == 19 and t[0]["hr_abs_diff"] < 5 and t[0]["orphanidou_acceptable"] == 1
    assert t[12]["hr_ecg"] is None and t[12]["orphanidou_acceptable"] == 0
    skewed = [(i, [float(v) for v in -np.maximum(0, np.sin(2 * np.pi * 1.2 * np.arange(320) / FS + i) ** 3)]) for i in range(12)]
    assert arrow.polarity_inverted(spark.createDataFrame(skewed, "window_idx int, ppg array<double>"), FS)


def runs_of(flags):
    out, n = [], 0
    for f in [*flags, 0]:
        if f:
            n += 1
        elif n:
            out.append(n)
            n = 0
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_run_summaries_against_brute_force(spark, partitions):
    """One key has most rows, so it spans ranges; NULL keys are left out, NULL flags are false."""
    rng = np.random.default_rng(0)
    rows = [("hot", i, bool(f)) for i, f in enumerate(rng.random(5000) < 0.9)] + [("all", i, True) for i in range(900)] + [("none", i, None if i % 2 else False) for i in range(40)] + [(None, 1, True), ("one", None, True)]
    df = spark.createDataFrame(rows, "k string, t int, f boolean").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r for r in ordered.run_summaries(df, "k", [F.col("t")], F.col("f")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {"hot", "all", "none", "one"}
    for k in got:
        flags = [bool(f) for key, t, f in sorted((r for r in rows if r[0] == k), key=lambda r: r[1] or -1)]
        runs = runs_of(flags)
        prefix = flags.index(False) if False in flags else len(flags)
        suffix = flags[::-1].index(False) if False in flags else len(flags)
        assert tuple(got[k])[1:] == (len(flags), prefix, suffix, max(runs, default=0), sum(runs), len(runs)), k


def test_filter_matrix_equals_the_recursion():
    x = np.random.default_rng(1).normal(size=(5, 200))
    once = k._forwards_and_backwards(x, 64.0, k.PPG_BAND, k.ORDER)
    assert np.allclose(k.bandpass_many(x, 64, k.PPG_BAND), once, atol=1e-12)
    with pytest.raises(ValueError):
        k.bandpass_many(x[:, :21], 64, k.PPG_BAND)


def test_rank_correlations_of_several_pairs_at_once(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b) if i % 7 else None, float(c)) for i, (a, b, c) in enumerate(rng.integers(0, 12, (300, 3)))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = stats.spearmans(df, {"ab": ("a", "b"), "ca": ("c", "a")}).first()
    assert got["ab"] == pytest.approx(stats.spearman(df, "a", "b").first()["rho"]) and got["ca"] == pytest.approx(stats.spearman(df, "c", "a").first()["rho"])
    flat = stats.spearmans(df.withColumn("one", F.lit(1.0)), {"flat": ("a", "one"), "few": ("a", "b")}, least=1000).first()
    assert flat["flat"] is None and flat["few"] is None
