"""Sources, facade, report, figures, streams and registered queries."""

import os
import pickle
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwarden import config
from sigwarden.operators import agreement, trust
from sigwarden.plans import figures, queries, report, service
from sigwarden.sources import adapters, recordings, synthetic
from sigwarden.streaming import audit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cohort(spark):
    return synthetic.generate(spark, synthetic.Cohort(30, 30)).cache()


def test_synthetic_cohort(spark, cohort):
    assert cohort.count() == 900 and len(cohort.columns) == 28
    again = synthetic.generate(spark, synthetic.Cohort(30, 30)).repartition(7)
    assert cohort.exceptAll(again).count() == 0
    r = cohort.agg(F.min("resting_hr").alias("lo"), F.max("resting_hr").alias("hi"), F.avg("missing_wearable_flag").alias("m")).first()
    assert 40 <= r["lo"] and r["hi"] <= 110 and 0 < r["m"] < 0.6
    with pytest.raises(ValueError):
        synthetic.Cohort(heat_hrv=float("nan"))
    w = synthetic.windows(cohort, synthetic.Cohort(), share=0.02).first()
    assert len(w["ecg"]) == 1250 and len(w["ppg"]) == 320


def test_sweeps(spark):
    sweep = synthetic.stress_test(spark, synthetic.Cohort(40, 15), {"device_b_hr": (0.0, 5.0, 15.0)})
    r = synthetic.monotonic_response(sweep).first()
    assert r["monotonic"] and r["change"] > 5
    alone = synthetic.observed_effects(synthetic.generate(spark, synthetic.Cohort(40, 15, device_b_hr=5.0))).first()
    assert {x["coefficient"]: x["observed"] for x in sweep.collect()}[5.0] == pytest.approx(alone["device_b_hr"], abs=1e-9)
    with pytest.raises(ValueError):
        synthetic.stress_test(spark, synthetic.Cohort(40, 15), {})
    s = synthetic.regime_summary(spark, 30, 29, {k: synthetic.REGIMES[k] for k in ("clean_world", "severe_skin_bias")})
    status = {x["prediction"]: x["status"] for x in synthetic.predicted_vs_observed(s).collect()}
    assert status["severe skin bias widens the gap"] == "pass" and status["severe heat lowers HRV"] == "skip" and len(status) == 8


def test_adapters(spark, tmp_path):
    row = ("u1", "2025-01-01", "x", 60.0, 50.0, 45.0, 8000.0, 40.0, 420.0, 90.0, 68.0, 50.0, 30.0, 1200.0, 0)
    df = spark.createDataFrame([row, ("u2", *row[1:3], 500.0, *row[4:])], list(adapters.FITBIT_LIKE.renames))
    out, rep = adapters.adapt_with_report(df, adapters.FITBIT_LIKE)
    r = out.first()
    assert rep.rows_in == 2 and rep.rows_out == 1 and rep.dropped_reason_counts == {"resting_hr_out_of_range": 1}
    assert r["sleep_duration"] == 7 and r["sleep_efficiency"] == 0.9 and r["temperature_c"] == pytest.approx(20) and r["humidity"] == 0.5 and r["stress_proxy"] is None
    assert adapters.adapt(df, adapters.percent_humidity(adapters.FITBIT_LIKE)).first()["humidity"] == 50
    clash = df.withColumn("resting_hr", F.lit(1.0))
    assert adapters.adapt(clash, adapters.FITBIT_LIKE).first()["resting_hr"] == 60
    df.write.csv(str(tmp_path / "in"), header=True)
    assert adapters.adapt_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), adapters.FITBIT_LIKE).rows_out == 1
    assert adapters.adapt(spark.createDataFrame([("p",)], "participant_id string"), adapters.GENERIC).count() == 1


def recording(seconds=30, bpm=75):
    t, u = np.arange(seconds * 700) / 700, np.arange(seconds * 64) / 64
    ecg = sum(np.exp(-((t - b) ** 2) / (2 * 0.012**2)) for b in np.arange(0.2, seconds, 60 / bpm))
    label = np.where(np.arange(len(t)) < len(t) // 2, 1, 2)
    return {"subject": "S2", "signal": {"chest": {"ECG": ecg[:, None]}, "wrist": {"BVP": np.sin(2 * np.pi * bpm / 60 * u)[:, None], "ACC": np.random.default_rng(0).normal(size=(seconds * 32, 3))}}, "label": label}


def test_recordings(spark, tmp_path):
    (tmp_path / "S2").mkdir()
    (tmp_path / "S2/S2.pkl").write_bytes(pickle.dumps(recording()))
    recs = recordings.read_recordings(spark, str(tmp_path)).cache()
    w = recordings.extract_windows(recs).orderBy("window_idx").collect()
    assert [x["window_idx"] for x in w] == list(range(6)) and [x["label_name"] for x in w] == ["baseline"] * 3 + ["stress"] * 3
    assert all(len(x["ecg"]) == 3500 and len(x["ppg"]) == 320 for x in w)
    s = recordings.session_summary(recs).first()
    assert s["resting_hr"] == pytest.approx(75, abs=2) and s["stress_proxy"] == pytest.approx(0.5, abs=0.01)
    assert recordings.activity_seconds(recs).first()["seconds_sitting"] == pytest.approx(15)
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        recordings.read_recordings(spark, str(tmp_path / "none"))

    class Evil:
        def __reduce__(self):
            return os.system, ("true",)

    with pytest.raises(pickle.UnpicklingError):
        recordings.decode(pickle.dumps(Evil()), "S1.pkl")
    assert recordings.upsampled(np.array([1, 2]), 3, 8).tolist() == [1, 1, 1, 2, 2, 2, 2, 2]


@pytest.mark.parametrize(("dialect", "taken"), [("wesad", (1, 2, 3)), ("dalia", tuple(range(1, 9)))])
def test_adapt_directory_takes_the_states_of_its_dialect(spark, tmp_path, dialect, taken):
    """Ten seconds of each code, those that are not taken (0, and 4 or 9) among them; one subject's file is missing."""
    codes = [0, 1, 2, 3, 4] if dialect == "wesad" else list(range(10))
    for s in ("S2", "S3", "S4"):
        (tmp_path / "in" / s).mkdir(parents=True)
        if s != "S4":
            rec = recording(10 * len(codes))
            label = np.repeat(codes, 10 * (700 if dialect == "wesad" else 4))
            own = {k: v for k, v in rec.items() if k != "label"} | {"subject": s}
            (tmp_path / f"in/{s}/{s}.pkl").write_bytes(pickle.dumps(own | ({"label": label} if dialect == "wesad" else {"activity": label})))
    with pytest.warns(UserWarning, match="S4.pkl is missing"):
        n = recordings.adapt_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), dialect)
    w = spark.read.parquet(str(tmp_path / "out/windows")).orderBy("window_idx").collect()
    assert n == {"recordings": 2, "windows": 4 * len(taken), "sessions": 2}
    assert [x.window_idx for x in w] == list(range(len(w))) and [x.label for x in w] == [c for _ in range(2) for c in taken for _ in range(2)]
    assert all(x.end_seconds - x.start_seconds == 5 and int(x.start_seconds // 10) == codes.index(x.label) for x in w)


def test_recordings_as_a_data_source(spark, tmp_path):
    """One partition a file, the same rows as Spark's own readers give, and the same as a Parquet copy."""
    from sigwarden.sources import recording_source

    for s in ("S2", "S3"):
        (tmp_path / "in" / s).mkdir(parents=True)
        (tmp_path / f"in/{s}/{s}.pkl").write_bytes(pickle.dumps(recording(6) | {"subject": s}))
    recording_source.register(spark)
    found = spark.read.format("recordings").option("dialect", "wesad").load(str(tmp_path / "in"))
    assert found.rdd.getNumPartitions() == 2
    recordings.read_recordings(spark, str(tmp_path / "in")).write.parquet(str(tmp_path / "copy"))
    key = lambda r: r.subject_id
    assert sorted(found.collect(), key=key) == sorted(spark.read.parquet(str(tmp_path / "copy")).collect(), key=key)
    (tmp_path / "in/S9").mkdir()
    reader = recording_source.RecordingReader({"path": f"file://{tmp_path}/in"})
    with pytest.warns(UserWarning, match="S9.pkl is missing"):
        assert len(reader.partitions()) == 2
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        recording_source.RecordingReader({"path": str(tmp_path / "none")}).partitions()
    with pytest.raises(ValueError):
        recording_source.RecordingReader({"path": "x", "dialect": "other"})


def test_change_points_in_sql(spark):
    from sigwarden.functions import arrow, table_functions

    table_functions.register(spark)
    rng = np.random.default_rng(2)
    rows = [(k, d, None if d == 7 else float(rng.normal(10 * (d > 20), 1))) for k in ("a", "b") for d in range(40)] + [("short", d, 1.0) for d in range(5)] + [(None, d, 1.0) for d in range(20)]
    df = spark.createDataFrame(rows, "k string, d int, v double").repartition(3)
    df.createOrReplaceTempView("some_days")
    for method in ("binary_segmentation", "bocpd"):
        got = spark.sql(f"SELECT * FROM change_points(TABLE(some_days), 'k', 'd', 'v', '{method}')")
        want = arrow.scan_changes(df, "v", "k", "d", method)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() >= 2
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM change_points(TABLE(some_days), 'k', 'd', 'w', 'bocpd')").collect()


def test_windows_end_with_the_labels(spark):
    rec = {"subject_id": "S2", "chest_ecg": [0.0] * 700 * 12, "wrist_ppg": [0.0] * 64 * 12, "wrist_acc": [], "labels": [1] * 700 * 9}
    assert recordings.extract_windows(spark.createDataFrame([rec], recordings.RECORDING)).count() == 1


def test_loaders(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"hr_ecg": [60.0, 70.0], "hr_ppg": [61.0, 72.0]}')
    (tmp_path / "b.json").write_text('[{"hr_ecg": 60.0, "hr_ppg": 61.0}, {"hr_ecg": 70.0, "hr_ppg": null}]')
    assert recordings.read_paired_rates(spark, str(tmp_path / "a.json")).count() == 2
    assert recordings.read_paired_rates(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "w.csv").write_text("a,b\n1,2\n")
    assert recordings.read_window_table(spark, str(tmp_path / "w.csv"), ["a"]).count() == 1
    with pytest.raises(KeyError, match="c, d"):
        recordings.read_window_table(spark, str(tmp_path / "w.csv"), ["a", "d", "c"])
    recordings.write_json_nulls(spark.createDataFrame([(1, float("nan")), (2, float("inf"))], "i int, x double"), str(tmp_path / "out"))
    assert spark.read.schema("i int, x double").json(str(tmp_path / "out")).filter("x is not null").count() == 0


def test_service(spark):
    s = service.SignalSummary("P1", 14, 62, 48, 8000, 7.2, 0.88, 24, 0.05)
    t, a = service.trust_score(spark, s), service.audit_signal(spark, service.SignalSummary("P1", 14, 62, 48, 8000, 7.2, 0.88, 24, 0.9))
    assert 0 <= t.overall <= 100 and t.explanation.startswith("P1") and service.health() == {"status": "ok"} and "/trust-score" in service.root()["endpoints"]
    assert any("missing" in w for w in a.warnings)
    with pytest.raises(ValueError):
        service.SignalSummary("P1", 0, 62, 48, 8000, 7.2, 0.88, 24, 0.05)


def test_report_and_figures(spark, cohort, tmp_path):
    text = report.generate_report(cohort, str(tmp_path / "report.md"))
    assert text.count("\n## ") == 18 and (tmp_path / "report.md").read_text() == text and "_not available_" in text
    scores = trust.cohort_scores(cohort)
    assert figures.trust_radar(scores, "P0001").count() == 6 and len(figures.reliability_heatmap(cohort).columns) == 31
    assert figures.trust_distribution(scores).agg(F.sum("n")).first()[0] == 30
    points, line = figures.confounding_scatter(cohort, "heat_index", "hrv_rmssd", 50)
    assert points.count() == 50 and line.first()["n"] == 900
    assert report.participant_report(scores, "nobody").strip().endswith("_unknown_")


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("motion: {amplitude_variance_threshold: 0.9}\nnew: {x: 1}\n")
    c = config.load(tmp_path / "a.yaml")
    assert c.motion.amplitude_variance_threshold == 0.9 and c.motion.high_freq_power_threshold == 0.4 and c.new.x == 1


def test_threshold_grid_meets_few_rows(spark):
    """The grid multiplies interval sums, not rows."""
    df = spark.range(1000).select((F.col("id") / 1000.0).alias("s"), (F.col("id") % 2).alias("y"))
    grid = agreement.threshold_grid(df, "s", "y", [0.25, 0.5, 0.75])
    assert {r["threshold"]: r["n_pass"] for r in grid.collect()} == {0.25: 750, 0.5: 500, 0.75: 250}


@pytest.mark.parametrize("files", [1, 6])
def test_streams_take_late_and_shuffled_events_in_their_order(spark, tmp_path, files):
    """Events shuffled over batches, within the lateness that is waited for: equal to all of them at once in order."""
    from sigwarden.functions import kernels

    rng = np.random.default_rng(3)
    rows, hour = [], 3_600_000
    for u in range(3):
        ms = np.cumsum(rng.integers(1, 4, 120)) * hour // 4
        rows += [(u, int(t), i, float(v)) for i, (t, v) in enumerate(zip(ms, np.r_[rng.normal(0, 1, 60), rng.normal(9, 1, 60)]))]
    rows += [(0, rows[5][1], 1000, 0.5)]  # a tie in time
    df = spark.createDataFrame(rows, "user_id int, ms long, event_id long, value double").selectExpr("user_id", "timestamp_millis(ms) as ts", "event_id", "value")
    # A day's events stand in any of the files of their two days.
    order = sorted(rows, key=lambda r: r[1] + rng.integers(0, 20 * hour))
    place = {(r[0], r[2]): i * files // len(order) for i, r in enumerate(order)}
    pdf = df.toPandas()
    pdf["file"] = [place[u, i] for u, i in zip(pdf["user_id"], pdf["event_id"])]
    for f in range(files):
        spark.createDataFrame(pdf[pdf.file == f].drop(columns="file").sample(frac=1, random_state=f), df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("*.parquet"))) == files

    def streamed(name, mode, f):
        out = []
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        f(source).writeStream.foreachBatch(lambda b, i: out.append(b.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return out

    batches = streamed("jitter", "update", lambda e: audit.jitter(e, hour, jitter_ms=hour / 4, late_ms=24 * hour))
    last = {r.user_id: tuple(r)[1:] for b in batches for r in b}
    for u in range(3):
        d = np.diff(sorted(r[1] for r in rows if r[0] == u))
        assert last[u] == (len(d), int((np.abs(d - hour) > hour / 4).sum()), int((d > 3 * hour).sum()))
    found = sorted(tuple(r) for b in streamed("changes", "append", lambda e: audit.change_points(e, late_ms=24 * hour)) for r in b)
    want = []
    for u in range(3):
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == u)
        x = [v for t, _, v in own if t < own[-1][0] - 24 * hour]
        model, before = kernels.RunLength(float(np.mean(x[:5])), 1 / 50), 0
        for n, v in enumerate(x, 1):
            now = model.update(v)
            if before - now >= 5 and n >= 5:
                want.append((u, n - 1, float(before - now), v))
            before = now
    assert found == sorted(want) and len(found) >= 3


def test_all_run_lengths_can_be_kept():
    from sigwarden.functions import kernels

    x = np.random.default_rng(0).normal(size=400)
    few, all_ = kernels.RunLength(0.0), kernels.RunLength(0.0, longest=None)
    for v in x:
        few.update(v)
        last = all_.update(v)
    assert len(few.mu) == 200 and len(all_.mu) == 401 and last > 300
    assert all_.update(1e100) <= 1 and np.isfinite(all_.log_p).all()  # densities of long runs would underflow


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
def test_streams_equal_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = audit.sliding_rate(events).agg(F.sum("n")).first()[0]
    assert batch == 6 * events.count()
    stream = queries._streamed(spark, SF, "rate", "complete", lambda e: audit.sliding_rate(e))
    assert stream.agg(F.sum("n")).first()[0] == batch
    jitter = queries._streamed(spark, SF, "jitter", "update", lambda e: audit.jitter(e, 3e7))
    assert jitter.agg(F.sum("n_intervals")).first()[0] == events.count() - events.select("user_id").distinct().count()
    assert queries._streamed(spark, SF, "changes", "append", lambda e: audit.change_points(e)).count() >= 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part", "documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    tidy = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) else v
    want = Counter(tuple(tidy(r[names.index(c)]) for c in columns) for r in con.fetchall())
    assert Counter(tuple(tidy(r[c]) for c in columns) for r in got.collect()) == want


def test_synthetic_days_share_draws_and_compiled_code(spark):
    """Few participants are still dealt to many tasks, generated methods stay short enough for the JVM to compile, and a cohort's draws do not depend on its coefficients."""
    from dataclasses import replace

    c = synthetic.Cohort(30, 5)
    ids = spark.range(2000).select(F.format_string("P%05d", "id").alias("participant_id")).distinct()
    people = synthetic.participants(spark, c, ids)
    assert people.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = synthetic.daily(people, c)._jdf.queryExecution().debug().codegenToSeq()
        assert all(code.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(code.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    other = replace(c, heat_hrv=-5.0, missing_scale=2.5)
    drawn = synthetic.drawn_days(synthetic.participants(spark, c), c)
    assert synthetic.settled(drawn, other).exceptAll(synthetic.generate(spark, other)).count() == 0


def test_synthetic_days_of_long_user_ids_equal_sql(spark, tmp_path):
    """Users whose ids begin with the same five characters are participants of their own, in the query as in its SQL."""
    con = duckdb.connect()
    users = [0, 7, 99999, 100000, 100001, 1000000, -123456, -123457, 2**63 - 2, 2**63 - 1]
    con.execute(f"COPY (SELECT unnest({users})::BIGINT AS user_id) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = con.execute(f"SELECT participant_id, date, age, device_type, resting_hr, hrv_rmssd, reliability_ground_truth FROM ({queries.oracle_sql()['synthetic_days']})")
    got = queries.queries()["synthetic_days"](spark, str(tmp_path)).select(*[d[0] for d in want.description]).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    days = Counter(r["participant_id"] for r in got)
    assert len(days) == len(users) and set(days.values()) == {20} and {"P00007", "P100000", "P100001", f"P{2**63 - 1}"} <= set(days)


def test_window_table_of_incomplete_groups_equals_sql(spark, tmp_path):
    """The last group of vectors may have under four, and so a chest window that is too short to be filtered."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM read_parquet('{SF}/embeddings.parquet') WHERE vec_id < 12 OR vec_id = 16 OR vec_id IN (20, 21) OR vec_id IN (24, 25, 26)) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(f"SELECT window_idx, inhouse_ecg_sqi FROM ({queries.oracle_sql()['window_table']})").fetchall()
    got = queries.queries()["window_table"](spark, str(tmp_path)).select("window_idx", "inhouse_ecg_sqi").collect()
    assert sorted(map(tuple, got)) == sorted(want) and dict(want)[16] is not None


def test_regimes_are_one_pass_over_rows_that_stay(spark, monkeypatch):
    """Days are drawn and settled once for all regimes, which give what each gives alone."""
    from dataclasses import replace

    from sigwarden.operators import reliability, trust

    passes, settled = [], synthetic.settled
    monkeypatch.setattr(synthetic, "settled", lambda *a: passes.append(1) or settled(*a))
    held = {k: synthetic.REGIMES[k] for k in ("clean_world", "severe_missingness", "severe_device_bias")}
    s = {r["regime"]: r for r in synthetic.regime_summary(spark, 30, 30, held).collect()}
    assert len(passes) == 1 and set(s) == set(held)
    for name, coefficients in held.items():
        df = synthetic.generate(spark, replace(synthetic.Cohort(30, 30), **coefficients))
        seen = synthetic.observed_effects(df).first()
        assert [s[name][f"observed_{e}"] for e in synthetic.EFFECTS] == pytest.approx([seen[e] for e in synthetic.EFFECTS], abs=1e-9)
        assert s[name]["mean_trust"] == pytest.approx(trust.cohort_scores(df).agg(F.avg("overall")).first()[0], abs=1e-9)
        assert s[name]["test_retest_r"] == pytest.approx(reliability.week_pair_correlation(df, "hrv_rmssd").first()["r"], abs=1e-9)
