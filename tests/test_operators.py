"""Operators on planted data and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwarden.functions import arrow, kernels
from sigwarden.operators import agreement, artifacts, causal, confounding, daily, effects, fairness, models, reliability, trust
from sigwarden.schema import nan_to_null


def frame(spark, people=4, n=30, seed=0, **change):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(people):
        for d in range(n):
            r = {"participant_id": f"P{p}", "date": f"2025-{1 + d // 28:02d}-{1 + d % 28:02d}", "resting_hr": 60 + rng.normal(), "hrv_rmssd": 50 + 5 * rng.normal(), "hrv_sdnn": 45.0, "step_count": 8000.0, "active_minutes": 40.0, "sleep_duration": 7.0,
                 "sleep_efficiency": 0.9, "stress_proxy": 0.3, "temperature_c": 20.0, "humidity": 50.0, "aqi": 40.0, "heat_index": 20 + rng.normal(), "wearable_minutes": 1200.0, "missing_wearable_flag": int(d % 10 == 3),
                 "signal_quality_ground_truth": 0.8, "artifact_burden_ground_truth": 0.1, "reliability_ground_truth": 0.8, "device_type": "A" if p % 2 else "B", "skin_tone_proxy": p / people}
            rows.append({k: (change[k](p, d, v) if k in change else v) for k, v in r.items()})
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int' if k.endswith('flag') else 'double'}" for k, v in rows[0].items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("date", F.to_date("date"))


def test_trust_scores(spark):
    r = trust.cohort_scores(frame(spark)).orderBy("participant_id").collect()
    assert len(r) == 4 and all(0 <= x["overall"] <= 100 for x in r) and r[0]["signal_quality_score"] == pytest.approx(80)
    assert r[0]["missingness_risk_score"] == pytest.approx(100 * (1 - 0.7 * 0.1 - 0.3 / 7)) and r[0]["device_bias_score"] == 100
    worse = trust.cohort_scores(frame(spark, signal_quality_ground_truth=lambda p, d, v: 0.2)).first()
    assert worse["overall"] < r[0]["overall"]
    with pytest.raises(ValueError):
        trust.cohort_scores(frame(spark).drop("participant_id"))


def test_trust_with_missing_columns_and_values(spark):
    df = frame(spark).drop("heat_index", "missing_wearable_flag", "device_type", "artifact_burden_ground_truth")
    r = trust.cohort_scores(df).first()
    assert r["overall"] is None and r["category"] == "insufficient_data" and "too few" in r["explanation"]
    none = frame(spark).withColumn("signal_quality_ground_truth", F.lit(None).cast("double"))
    assert trust.cohort_scores(none).first()["signal_quality_score"] == pytest.approx(100 * 1200 / 1440)
    assert trust.overall_from_components({"signal_quality_score": 1.0}) is not None
    nan = frame(spark).withColumn("hrv_rmssd", F.lit(float("nan")))
    assert trust.cohort_scores(nan_to_null(nan)).first()["temporal_stability_score"] is None


def test_fairness_finds_the_gap(spark):
    df = frame(spark, 6, signal_quality_ground_truth=lambda p, d, v: 0.8 if p % 2 else 0.5)
    s = fairness.fairness_audit(df, "device_type", replicates=20)
    r = {x["stratum"]: x for x in s.collect()}
    assert r["A"]["signal_quality_score"] - r["B"]["signal_quality_score"] == pytest.approx(30)
    assert all(x["ci_low"] - 3 <= x["overall"] <= x["ci_high"] + 3 and x["ci_low"] <= x["ci_high"] for x in r.values())
    d = fairness.disparity_summary(s).filter("component = 'signal_quality_score'").first()
    assert d["disparity"] == pytest.approx(30) and d["lowest_stratum"] == "B"
    with pytest.raises(KeyError):
        fairness.fairness_audit(df, "nothing")
    assert {x["stratum"] for x in fairness.fairness_audit(frame(spark, 8), "skin_tone_proxy").collect()} == {"Q1", "Q2", "Q3", "Q4"}
    assert list(fairness.multi_stratify(df, ["device_type", "nothing"])) == ["device_type"]


def test_run_lengths(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([1, 1, 0, 1, None, 1, 1, 1])] + [("b", 0, 0)], "participant_id string, date int, missing_wearable_flag int")
    assert sorted(r["length"] for r in daily.run_lengths(df, ["participant_id"], ["date"], F.col("missing_wearable_flag") == 1).collect()) == [1, 2, 3]
    r = {x["participant_id"]: x for x in daily.missingness_summary(df).collect()}
    assert (r["a"]["max_run"], r["a"]["n_episodes"], r["a"]["mean_run"]) == (3, 3, 2) and (r["b"]["max_run"], r["b"]["mean_run"]) == (0, 0)


def test_validation(spark):
    df = frame(spark).withColumn("resting_hr", F.when(F.col("participant_id") == "P0", 200.0).otherwise(F.col("resting_hr"))).withColumn("aqi", F.lit(None).cast("double")).drop("humidity")
    v = daily.validate(df)
    assert v.missing_columns == ["humidity"] and v.out_of_range == {"resting_hr": 30} and v.all_null_columns == ["aqi"] and not v.ok and "humidity" in v.summary()
    assert daily.validate(frame(spark)).ok


def test_correlations_and_bias(spark):
    df = frame(spark, hrv_rmssd=lambda p, d, v: None if d == 0 else v)
    assert confounding.correlation_table(df).count() >= 1 and confounding.top_confounder(df).count() == 1
    assert confounding.correlation_table(df.select("participant_id")).count() == 0
    b = confounding.device_bias(frame(spark, resting_hr=lambda p, d, v: 60.0 + (0 if p % 2 else 5)), ["resting_hr"])
    assert {(r["device"], r["difference"]) for r in b.collect()} == {("A", 0.0), ("B", 5.0)} and confounding.bias_severity(b).first()["severity"] == 0.5
    with pytest.raises(KeyError):
        confounding.device_bias(df, ["resting_hr"], reference="Z")
    assert confounding.bias_severity(confounding.device_bias(df.drop("device_type"), ["resting_hr"])).first()["severity"] == 0


def test_reliability_of_stable_and_noisy_people(spark):
    rng = np.random.default_rng(1)
    rows = [(f"P{p}", f"2025-{1 + d // 28:02d}-{1 + d % 28:02d}", float(60 + 5 * base + 2 * rng.normal()), float(rng.normal())) for p, base in enumerate(rng.normal(size=20)) for d in range(56)]
    df = spark.createDataFrame(rows, "participant_id string, date string, stable double, noise double")
    for method in ("week_pair", "split_half"):
        s, n = (reliability.cohort_test_retest(df, c, method, replicates=50).first() for c in ("stable", "noise"))
        assert s["r"] > 0.6 > abs(n["r"]) and s["ci_low"] <= s["r"] <= s["ci_high"]
    with pytest.raises(ValueError):
        reliability.cohort_test_retest(df, "stable", "other")
    assert reliability.icc_of_days(df, "stable").first()["icc"] > 0.6 > reliability.icc_of_days(df, "noise").first()["icc"]


def test_icc_textbook(spark):
    ratings = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    tall = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(ratings) for j, v in enumerate(r)], "s int, r int, v double")
    assert reliability.icc_2_1(tall, "s", "r", "v").first()["icc"] == pytest.approx(0.29, abs=0.005)
    assert reliability.icc_2_1(tall.filter("s = 0"), "s", "r", "v").first()["icc"] is None


def test_changes_and_sides(spark):
    df = frame(spark, 2, 40, resting_hr=lambda p, d, v: v + (8 if d >= 20 and p == 0 else 0))
    c = arrow.scan_changes(df, "resting_hr")
    r = c.collect()
    assert len(r) == 1 and r[0]["participant_id"] == "P0" and abs(r[0]["index"] - 20) <= 3
    sides = arrow.stratify_before_after(df, "resting_hr", c).first()
    assert sides["delta"] == pytest.approx(8, abs=1.5) and sides["n_before"] + sides["n_after"] == 40


def test_bland_altman_recovers_bias(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(a + 3 + b)) for a, b in zip(rng.normal(70, 10, 500), rng.normal(0, 2, 500))] + [(1.0, None)], "a double, b double")
    r = agreement.bland_altman(df, "a", "b").first()
    assert r["bias"] == pytest.approx(3, abs=0.3) and r["loa_high"] - r["loa_low"] == pytest.approx(2 * 1.96 * 2, abs=0.5) and r["n_pairs"] == 500
    assert agreement.bland_altman(df.limit(3), "a", "b").first()["bias"] is None


def test_thresholds(spark):
    df = spark.createDataFrame([(i / 100, int(i >= 60), "ab"[i % 2]) for i in range(100)], "s double, y int, g string")
    grid = [i / 100 for i in range(10, 100)]
    assert agreement.recalibrate(df, "s", "y", grid).first()["threshold"] == pytest.approx(0.6)
    assert agreement.recalibrate(df, "s", "y", grid, "f1", strict=True).first()["threshold"] == pytest.approx(0.59)
    assert all(r["held_kappa"] > 0.9 for r in agreement.loso_recalibration(df, "s", "y", "g", grid).collect())
    best = agreement.best_thresholds(df, "s", "y").first()
    assert best["auroc"] == pytest.approx(1) and best["youden_threshold"] == pytest.approx(0.6) and best["average_precision"] == pytest.approx(1)
    assert agreement.expected_calibration_error(df, "s", "y").first()["n"] == 100
    mixed = spark.createDataFrame([(i % 10 / 10, int((i * 7) % 13 < i % 10)) for i in range(300)], "s double, y int")
    a = agreement.auroc_interval(mixed, "s", "y", replicates=40).first()
    assert a["ci_low"] < a["auroc"] < a["ci_high"] and a["auroc"] == pytest.approx(agreement.best_thresholds(mixed, "s", "y").first()["auroc"])


def test_effects(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("s", int(i % 2), float(rng.normal() + (i % 2))) for i in range(200)], "subject_id string, state int, m double")
    r = effects.per_state_comparison(df, ["m"], "state", 0, 1).first()
    assert r["delta"] == pytest.approx(1, abs=0.4) and r["p_value"] < 0.001
    t = effects.within_subject_tests(df, ["m"], "state", [(1, 0)]).first()
    assert t["p_value"] < 0.001 and t["cliffs_delta"] > 0.3
    assert effects.cohens_d(df, "m", F.col("state") == 1).first()["cohens_d"] == pytest.approx(1, abs=0.35)
    e = spark.range(1).select(*[c.alias(n) for n, c in effects.e_value(F.lit(0.5), F.lit(-0.1), F.lit(1.1)).items()]).first()
    assert e["risk_ratio"] == pytest.approx(math.exp(0.455)) and e["e_value_bound"] == 1
    d = spark.createDataFrame([(float(v),) for v in range(1, 6)], "d double")
    assert effects.paired_wilcoxon(d, "d").first()["p_value"] == pytest.approx(1 / 32)


def triples(spark, n=1500):
    rng = np.random.default_rng(5)
    c = rng.normal(size=n)
    x = 0.6 * c + rng.normal(size=n)
    y = 1.5 * c + 2.0 * (x > np.median(x)) + rng.normal(size=n)
    return spark.createDataFrame([(float(a), float(b), float(z)) for a, b, z in zip(x, y, c)], "X double, Y double, C double")


def test_adjusted_effects_recover_two(spark):
    df = triples(spark)
    assert causal.g_computation(df, "X", "Y", ["C"], replicates=20).effect == pytest.approx(2, abs=0.5)
    assert causal.g_computation(df, "X", "Y", ["C"], learner="boosted").effect == pytest.approx(2, abs=0.6)
    e = causal.aipw(df, "X", "Y", ["C"], replicates=20)
    assert e.effect == pytest.approx(2, abs=0.5) and e.ci_low < e.effect < e.ci_high
    assert causal.aipw(df, "X", "Y", []).effect > 2.3
    assert 0 < causal.positivity(df, "X", ["C"]).first()["effective_n"] <= 1500
    assert causal.positivity(df.limit(10), "X", ["C"]) is None
    with pytest.raises(ValueError):
        causal.binarized(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "t")


def test_graph():
    g = causal.default_graph()
    assert g.back_door_set("active_minutes", "resting_hr") == [] and not g.has_cycle()
    h = causal.Graph([("c", "x"), ("c", "y"), ("x", "m"), ("m", "y")])
    assert h.back_door_set("x", "y") == ["c"] and h.ancestors("y") == {"c", "x", "m"}
    h.add_edge("y", "x")
    assert h.has_cycle()
    with pytest.raises(ValueError):
        h.back_door_set("x", "y")
    with pytest.raises(KeyError):
        g.back_door_set("heat_index", "unknown")


def test_array_detectors(spark):
    spiky, flat, ok = [0.5, 0.4, 0.6] * 30, [1.0] * 100, list(np.sin(np.arange(100) / 3))
    spiky[10] = 50.0
    rows = [(0, spiky), (1, flat), (2, [float(v) for v in ok]), (3, [0.0] * 100), (4, [])]
    df = spark.createDataFrame(rows, "i int, signal array<double>")
    r = {x["i"]: x for x in artifacts.evaluate_windows(df, "signal", 20.0).collect()}
    assert r[0]["spikes_flag"] == 1 and r[1]["flatline_flag"] == 1 and r[2]["any_flag"] in (0, 1) and r[3]["dropout_flag"] == 1 and r[4]["any_flag"] == 0
    nulls = spark.createDataFrame([(0, [1.0, None, float("nan"), 0.0, 1.0])], "i int, signal array<double>")
    assert nulls.select(artifacts.dropout(F.col("signal"), 3)["longest"].alias("n")).first()["n"] == 3
    m = artifacts.with_moments(df.filter("i = 2"), "signal").first()
    x = np.array(ok)
    g1 = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert m["skewness"] == pytest.approx(g1 * math.sqrt(100 * 99) / 98)


def test_intervals(spark):
    rows = [("a", i, v) for i, v in enumerate([800.0, 810.0, 790.0, 5000.0, 800.0])]
    df = spark.createDataFrame(rows, "k string, i int, rr double")
    assert artifacts.interval_statistics(df.filter("rr < 1000"), "rr", ["k"], ["i"]).first()["rmssd"] == pytest.approx(math.sqrt((100 + 400 + 100) / 3))
    assert artifacts.interpolated_rmssd(df, "rr", ["k"], ["i"]).first()["corrected_rmssd"] == pytest.approx(math.sqrt((100 + 400 + 25 + 25) / 4))
    assert {r["policy"] for r in artifacts.cleaning_policies(df, "rr", ["k"], ["i"]).collect()} == {"raw", "plausible", "median_25", "median_10", "successive_50"}


def test_models(spark):
    df = frame(spark, 8, 30, signal_quality_ground_truth=lambda p, d, v: 0.9 if d % 2 else 0.3, active_minutes=lambda p, d, v: 20.0 + d % 2 * 100 + d)
    r = {x["model"]: x for x in models.train_baselines(df, trees=10, depth=4).collect()}
    assert r["logistic_regression"]["auroc"] > 0.9 and r["random_forest"]["auroc"] > 0.9 and 0 <= r["isolation_forest"]["auroc"] <= 1
    one = models.train_baselines(frame(spark), trees=3, depth=2).collect()
    assert all(x["auroc"] is None for x in one)
    scored = models.reconstruction_scores(df, models.train_autoencoder(df))
    assert scored.filter("reconstruction_error < 0").count() == 0
    seq = models.sequences(df)
    assert seq.select(F.size("steps").alias("n")).distinct().collect()[0]["n"] == 30
    assert models.sequence_baseline(models.sequences(frame(spark, 30, 10)))["n_train"] > 0


def test_loso_and_tracks(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{s}", float(rng.normal() + 2 * y), y, float(rng.uniform(0.5, 1)), int(rng.random() < 0.6)) for s in range(5) for y in (0, 1) for _ in range(40)]
    df = spark.createDataFrame(rows, "subject_id string, hr double, stress int, inhouse_ppg_sqi double, orphanidou_acceptable int")
    assert all(r["auroc"] > 0.8 for r in models.loso_classify(df, ["hr"], "stress").collect())
    track = models.biomarker_track(df, "hr", "inhouse_ppg_sqi")
    assert {r["condition"] for r in track.select("condition").distinct().collect()} <= set(models.MASKS)
    assert models.perturbation_stability(df, lambda d: F.col("hr") * 10, ["hr"], trials=2) < 1


def test_learned_weights(spark):
    df = frame(spark, 30, 30, signal_quality_ground_truth=lambda p, d, v: p / 30, hrv_rmssd=lambda p, d, v: 50 + (v - 50) * (31 - p) / 3)
    scores = trust.component_scores(df, "participant_id")
    target = reliability.weekly_reproducibility(df, "hrv_rmssd")
    w = fairness.learn_weights(scores, target, candidates=20, rounds=1)
    assert sum(w["weights"].values()) == pytest.approx(1) and w["rho_train"] > 0
    assert fairness.sensitivity_table(scores, magnitudes=(0.1,), draws=3).first()["median_rho"] > 0.5


def test_paired_wilcoxon_by_group_against_the_kernel(spark):
    rng = np.random.default_rng(3)
    groups = {"few": rng.normal(0.3, 1, 12), "tied": rng.integers(-3, 5, 60).astype(float), "many": rng.normal(0.1, 1, 200), "zeros": np.zeros(4), "two": np.array([1.0, 2.0]), None: rng.normal(0, 1, 9)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("few", None)]
    got = {r["g"]: r for r in effects.paired_wilcoxon(spark.createDataFrame(rows, "g string, d double"), "d", ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        w, p = kernels.signed_rank(values)
        assert got[g]["n"] == len(values) and got[g]["median_delta"] == pytest.approx(np.median(values))
        if g == "two":
            assert got[g]["p_value"] is None or np.isnan(got[g]["p_value"])
        else:
            assert got[g]["p_value"] == pytest.approx(p) and got[g]["w_plus"] == (None if g == "zeros" else pytest.approx(w))
    one = effects.paired_wilcoxon(spark.createDataFrame([(float(v),) for v in groups["few"]], "d double"), "d").first()
    assert one["p_value"] == pytest.approx(kernels.signed_rank(groups["few"])[1])


def test_strata_are_not_gathered(spark):
    """Four strata of 10^6 rows: the longest runs come from ranges, and no window is over a stratum."""
    from sigwarden.functions.ordered import run_summaries

    rows = spark.range(1_000_000).select((F.col("id") % 4).cast("string").alias("stratum"), (F.col("id") / 4).cast("long").alias("t"), (F.col("id") % 1000 != 0).alias("f"))
    out = run_summaries(rows, "stratum", [F.col("t")], F.col("f"))
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and "rangepartitioning" in plan
    got = {r.stratum: r for r in out.collect()}
    assert {k: (r.rows, r.longest, r.true) for k, r in got.items()} == {"0": (250_000, 249, 249_000), **{str(k): (250_000, 250_000, 250_000) for k in (1, 2, 3)}}
    assert "Window" not in fairness.fairness_audit(frame(spark), "device_type")._jdf.queryExecution().toString()


def test_weight_objectives_rank_targets_once(spark, monkeypatch):
    """As by force, with ties and missing components; a target is ranked for all candidates together, not for each."""
    average_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    rng, weights = np.random.default_rng(3), np.array([[4, 2, 1, 1, 1, 1], [1, 1, 1, 1, 2, 4]], float)
    parts, y = rng.integers(0, 4, (40, 6)).astype(float), rng.integers(0, 6, 40).astype(float)
    rows = [(f"P{i}", *[None if i == 7 and j == 2 else float(v) for j, v in enumerate(p)]) for i, p in enumerate(parts)]
    scores = spark.createDataFrame(rows, "participant_id string, " + ", ".join(f"{c} double" for c in trust.COMPONENTS))
    target = spark.createDataFrame([(f"P{i}", None if i == 9 else float(v)) for i, v in enumerate(y)], "participant_id string, reproducibility double")
    groups, whole = [], fairness.with_average_rank
    monkeypatch.setattr(fairness, "with_average_rank", lambda df, value, name, by=(): groups.append(tuple(by)) or whole(df, value, name, by))
    found = {r.candidate: r for r in fairness.weight_objectives(scores, target, weights).collect()}
    held = [i for i in range(40) if i not in (7, 9)]
    for k, w in enumerate(weights):
        x = average_rank(np.round(parts[held] @ w / w.sum(), 9))
        assert found[k].n == 38 and found[k].rho == pytest.approx(np.corrcoef(x, average_rank(y[held]))[0, 1], abs=1e-12)
    assert groups == [()]
