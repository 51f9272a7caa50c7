"""A synthetic cohort: participants, days and signal windows, by column expressions on hashed random numbers.

Every draw is a function of (seed, row key, name), so any partitioning gives the same cohort and no state is
shared between rows. Values are distributed as stated, not equal to any other generator's.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import clip, hashed_uniform
from ..session import cut


@dataclass(frozen=True)
class Cohort:
    """Size and coefficients. The device table is (bias of the heart rate, factor of the signal quality)."""

    participants: int = 300
    days: int = 60
    seed: int = 42
    start: str = "2025-01-01"
    heat_hrv: float = -1.8
    skin_tone_penalty: float = 0.12
    device_b_hr: float = 3.8
    device_c_hr: float = -2.1
    missing_scale: float = 1.0

    def __post_init__(self):
        if not all(map(math.isfinite, (self.heat_hrv, self.skin_tone_penalty, self.device_b_hr, self.device_c_hr, self.missing_scale))):
            raise ValueError("coefficients must be finite")

    @property
    def devices(self) -> Mapping[str, tuple[float, float]]:
        return device_table(self.device_b_hr, self.device_c_hr)


def device_table(device_b_hr, device_c_hr) -> Mapping[str, tuple]:
    return {"device_A": (0.0, 1.00), "device_B": (device_b_hr, 0.92), "device_C": (device_c_hr, 0.85)}


def uniform(seed: int, name: str, *key: Column) -> Column:
    """In (0, 1)."""
    return hashed_uniform(F.lit(seed), F.lit(name), *key)


def normal(seed: int, name: str, *key: Column) -> Column:
    """Standard normal, by the Box-Muller transform."""
    return F.sqrt(-2 * F.log(uniform(seed, name + "/r", *key))) * F.cos(2 * math.pi * uniform(seed, name + "/a", *key))


def _element(value: Column, f) -> Column:
    """``f`` of ``value``, as the one element of an array: it is computed once a row, apart from the one method that is generated for a stage. With many
    draws or roundings in it that method is too long for the JVM to compile (8000 bytes of code) and runs many times slower."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _uniform(seed: int, name: str, *key: Column) -> Column:
    return _element(F.lit(name), lambda n: hashed_uniform(F.lit(seed), n, *key))


def _normal(seed: int, name: str, *key: Column) -> Column:
    u = lambda n: hashed_uniform(F.lit(seed), n, *key)
    return _element(F.lit(name), lambda n: F.sqrt(-2 * F.log(u(F.concat(n, F.lit("/r"))))) * F.cos(2 * math.pi * u(F.concat(n, F.lit("/a")))))


def _gamma_whole(seed: int, name: str, shape: int, *key: Column) -> Column:
    exponentials = F.transform(F.array(*[F.lit(f"{name}/{i}") for i in range(shape)]), lambda n: -F.log(hashed_uniform(F.lit(seed), n, *key)))
    return F.aggregate(exponentials, F.lit(0.0), lambda total, x: total + x)


def participants(spark: SparkSession, c: Cohort, ids: DataFrame | None = None) -> DataFrame:
    """A row for each participant: P0001 and so on, or each different ``participant_id`` of ``ids``.

    Participants are few bytes and much work, as each stands for many days, so they are dealt to a fixed number of partitions that adaptive execution doesn't
    coalesce: twice those of a shuffle, since a second shuffle to the same number would be left out."""
    p = spark.range(1, c.participants + 1).withColumn("participant_id", F.format_string("P%04d", "id")) if ids is None else ids.select("participant_id").filter("participant_id is not null").distinct()
    k = F.col("participant_id")
    p = p.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), k).withColumns({
        **{f"__u_{n}": _uniform(c.seed, n, k) for n in ("device", "age", "sex", "skin")}, **{f"__z_{n}": _normal(c.seed, n, k) for n in ("hr", "hrv", "act")},
        **{f"__g_{n}": _gamma_whole(c.seed, n, shape, k) for n, shape in (("climate/x", 2), ("climate/y", 5), ("missing/x", 2), ("missing/y", 8))},
    }).withColumn("age", (18 + F.floor(F.col("__u_age") * 58)).cast("int"))
    beta = lambda name: F.col(f"__g_{name}/x") / (F.col(f"__g_{name}/x") + F.col(f"__g_{name}/y"))
    return p.select(
        "participant_id", "age", F.when(F.col("__u_sex") < 0.51, "F").otherwise("M").alias("sex"),
        F.round(clip(70 + (F.col("age") - 40) * 0.05 + 6 * F.col("__z_hr"), 45, 95), 1).alias("baseline_hr"),
        F.round(clip(55 - (F.col("age") - 30) * 0.4 + 9 * F.col("__z_hrv"), 12, 110), 1).alias("baseline_hrv"),
        F.round(clip(7500 + 2800 * F.col("__z_act"), 800, 22000)).cast("int").alias("baseline_activity"),
        F.when(F.col("__u_device") < 0.45, "device_A").when(F.col("__u_device") < 0.85, "device_B").otherwise("device_C").alias("device_type"),
        F.round("__u_skin", 3).alias("skin_tone_proxy"), F.round(beta("climate"), 3).alias("climate_sensitivity"), F.round(beta("missing"), 3).alias("missingness_tendency"),
    )


#: Normal draws by participant and day.
_NORMAL = ("temp", "hum", "steps", "active", "sleep", "eff", "rmssd", "hr", "stress", "sdnn", "wear", "sq", "ab", "rel")


def drawn_days(people: DataFrame, c: Cohort) -> DataFrame:
    """``people`` with a row for each day and its draws. These depend on the seed only, so cohorts of other coefficients can share them."""
    rows = people.withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(c.days - 1)))).withColumn("date", F.date_add(F.lit(c.start).cast("date"), F.col("__d")))
    key = (F.col("participant_id"), F.col("__d"))
    return rows.withColumns({**{f"__z_{n}": _normal(c.seed + 1, n, *key) for n in _NORMAL}, "__g_aqi": _gamma_whole(c.seed + 1, "aqi", 2, *key), "__worn": _uniform(c.seed + 1, "worn", *key)})


def daily(people: DataFrame, c: Cohort) -> DataFrame:
    """A row for each participant and day: environment, activity, sleep, heart, stress, missingness that follows the state, latent truths."""
    return settled(drawn_days(people, c), c)


def settled(rows: DataFrame, c: Cohort, varied: Mapping[str, Column] | None = None) -> DataFrame:
    """The days of ``drawn_days`` under the cohort's coefficients.

    ``varied`` has columns of ``rows`` that hold coefficients; they stand in for the cohort's own."""
    at = lambda name: (varied or {}).get(name, getattr(c, name))
    devices = device_table(at("device_b_hr"), at("device_c_hr"))
    z = lambda name: F.col(f"__z_{name}")
    pos = lambda e: F.greatest(F.lit(0.0), e)
    bias = sum((F.when(F.col("device_type") == d, v[0]).otherwise(0.0) for d, v in devices.items()), F.lit(0.0))
    factor = sum((F.when(F.col("device_type") == d, v[1]).otherwise(0.0) for d, v in devices.items()), F.lit(0.0))
    steps = [
        {"temperature_c": 22 + 8 * F.sin(2 * math.pi * F.col("__d") / 60) + 2 * z("temp"), "humidity": clip(55 + 12 * z("hum"), 15, 95), "aqi": clip(25 * F.col("__g_aqi"), 8, 280),
         "step_count": F.floor(pos(F.col("baseline_activity") * F.when(F.weekday("date") >= 5, 1.12).otherwise(1.0) + 2200 * z("steps")))},
        {"heat_index": F.col("temperature_c") + 0.04 * (F.col("humidity") - 50), "active_minutes": F.floor(clip(F.col("step_count") / 120 + 8 * z("active"), 0, 240)), "__aqi": pos(F.col("aqi") - 100) * 0.002},
        {"__heat": pos(F.col("heat_index") - 26) * F.col("climate_sensitivity")},
        {"sleep_duration": clip(7.4 + 0.9 * z("sleep") - 0.08 * F.col("__heat") - 0.5 * F.col("__aqi"), 3, 11), "sleep_efficiency": clip(0.87 + 0.06 * z("eff") - 0.012 * F.col("__heat") - 0.04 * F.col("__aqi"), 0.4, 0.99)},
        {"hrv_rmssd": clip(F.col("baseline_hrv") + 6 * z("rmssd") + at("heat_hrv") * F.col("__heat") - 4 * pos(7 - F.col("sleep_duration")) - 0.0006 * pos(F.col("step_count") - 12000), 5, 180),
         "resting_hr": clip(F.col("baseline_hr") + bias + 2.5 * z("hr") + 0.0002 * pos(F.col("step_count") - 10000) + 0.06 * F.col("__heat"), 40, 110),
         "stress_proxy": clip(0.35 + 0.18 * z("stress") + 0.02 * F.col("__heat") + 0.04 * pos(7 - F.col("sleep_duration")) - 0.000008 * F.col("step_count"), 0, 1)},
        {"hrv_sdnn": clip(F.col("hrv_rmssd") * (0.9 + 0.08 * z("sdnn")), 4, 220), "__miss": clip(at("missing_scale") * (F.col("missingness_tendency") + 0.15 * F.col("stress_proxy") + 0.08 * (1 - F.col("sleep_efficiency")) + 0.01 * F.col("__heat")), 0, 0.6)},
        {"missing_wearable_flag": (F.col("__worn") < F.col("__miss")).cast("int"), "__motion": F.col("active_minutes") / 240},
        {"wearable_minutes": F.when(F.col("missing_wearable_flag") == 1, 0.0).otherwise(F.floor(clip(1100 + 180 * z("wear"), 200, 1440)).cast("double")),
         "signal_quality_ground_truth": clip(0.92 * factor - 0.3 * F.col("__motion") - at("skin_tone_penalty") * F.col("skin_tone_proxy") + 0.06 * z("sq") - 0.4 * F.col("missing_wearable_flag"), 0, 1),
         "artifact_burden_ground_truth": clip(0.15 + 0.5 * F.col("__motion") + 0.4 * F.col("missing_wearable_flag") + 0.05 * z("ab"), 0, 1),
         "reliability_ground_truth": clip(0.85 - 0.4 * F.col("missing_wearable_flag") - 0.15 * F.col("__motion") - 0.1 * (1 - F.col("sleep_efficiency")) + 0.05 * z("rel"), 0, 1)},
    ]
    for s in steps:
        rows = rows.withColumns(s)
    digits = {"resting_hr": 1, "hrv_rmssd": 1, "hrv_sdnn": 1, "sleep_duration": 2, "sleep_efficiency": 3, "stress_proxy": 3, "temperature_c": 1, "humidity": 1, "aqi": 1, "heat_index": 1, "signal_quality_ground_truth": 3, "artifact_burden_ground_truth": 3, "reliability_ground_truth": 3}
    to = lambda d: lambda x: F.round(x, d)
    out = rows.withColumns({k: _element(F.col(k), to(d)) for k, d in digits.items()} | {k: F.col(k).cast("double") for k in ("step_count", "active_minutes")})
    return out.drop("__d", "__aqi", "__heat", "__miss", "__motion", "__g_aqi", "__worn", *[f"__z_{n}" for n in _NORMAL])


def generate(spark: SparkSession, c: Cohort = Cohort(), path: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The full frame of 28 columns, of the participants of ``ids`` if given; written as Parquet, with the participants beside it, if a path is given."""
    people = participants(spark, c, ids)
    out = daily(people, c)
    if path:
        people.write.mode("overwrite").parquet(f"{path}/participants")
        out.write.mode("overwrite").parquet(f"{path}/daily")
        windows(out, c).write.mode("overwrite").parquet(f"{path}/windows")
    return out


def windows(days: DataFrame, c: Cohort, ecg_hz: int = 250, ppg_hz: int = 64, seconds: int = 5, share: float = 0.1) -> DataFrame:
    """A pair of ECG and PPG waveforms for a hash-chosen ``share`` of the days, with their flags, as one row each."""
    key = (F.col("participant_id"), F.col("date"))
    held = days.filter(uniform(7, "window", *key) < share)
    held = held.select(
        "participant_id", "date", "resting_hr", (F.col("active_minutes") > 90).cast("int").alias("motion_flag"),
        ((F.col("missing_wearable_flag") == 1) | (uniform(7, "drop", *key) < 0.07)).cast("int").alias("dropout_flag"), (uniform(7, "jitter", *key) < 0.05).cast("int").alias("jitter_flag"),
    )
    rate = F.col("resting_hr") / 60

    def wave(hz: int, name: str, shape, motion_hz: float, longest: int) -> Column:
        at = uniform(8, name + "/at", *key) * (seconds * hz - longest)
        run = (0.25 + 0.75 * uniform(8, name + "/run", *key)) * longest

        def sample(i):
            t = i / float(hz)
            v = shape(t) + 0.03 * normal(9, name, *key, i) + F.when(F.col("motion_flag") == 1, 0.4 * F.sin(2 * math.pi * motion_hz * t)).otherwise(0.0)
            return F.when((F.col("dropout_flag") == 1) & (i >= at) & (i < at + run), 0.0).otherwise(v).cast("float")

        return F.transform(F.sequence(F.lit(0), F.lit(seconds * hz - 1)), sample)

    beat = lambda t: F.exp(-F.pow(((t * rate) - F.round(t * rate)) / rate, F.lit(2)) / (2 * 0.012**2)) + 0.15 * F.sin(2 * math.pi * 0.3 * t)
    pulse = lambda t: F.sin(2 * math.pi * rate * t) + 0.25 * F.sin(4 * math.pi * rate * t)
    return held.withColumns({"ecg": wave(ecg_hz, "ecg", beat, 3.5, 2 * ecg_hz), "ppg": wave(ppg_hz, "ppg", pulse, 1.7, ppg_hz)})


# sweeps

# Regimes of the cross-cohort check.
REGIMES = {
    "clean_world": {"heat_hrv": 0.0, "skin_tone_penalty": 0.0, "device_b_hr": 0.0, "device_c_hr": 0.0, "missing_scale": 0.1},
    "severe_heat": {"heat_hrv": -5.0},
    "severe_skin_bias": {"skin_tone_penalty": 0.45},
    "severe_device_bias": {"device_b_hr": 10.0, "device_c_hr": -8.0},
    "severe_missingness": {"missing_scale": 2.5},
}
EFFECTS = {"heat_hrv": (0.0, -1.8, -5.0), "skin_tone_penalty": (0.0, 0.12, 0.40), "device_b_hr": (0.0, 3.8, 10.0)}


def _observed(days) -> DataFrame:
    """The effects' columns for a grouping of days that have their skin-tone quartile in ``q``."""
    from ..functions.stats import safe_corr

    mean = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    return days.agg(
        safe_corr("heat_index", "hrv_rmssd", 10).alias("heat_hrv"), (mean("signal_quality_ground_truth", F.col("q").isin("Q4", "high")) - mean("signal_quality_ground_truth", F.col("q").isin("Q1", "low"))).alias("skin_tone_penalty"),
        (mean("resting_hr", F.col("device_type") == "device_B") - mean("resting_hr", F.col("device_type") == "device_A")).alias("device_b_hr"),
    )


def observed_effects(df: DataFrame) -> DataFrame:
    """One row: correlation of heat and HRV, quality of the top less the bottom skin-tone quartile, heart rate of device B less A."""
    from ..operators.fairness import with_quartiles

    df = cut(df.select("skin_tone_proxy", "signal_quality_ground_truth", "heat_index", "hrv_rmssd", "resting_hr", "device_type"))
    return _observed(with_quartiles(df, "skin_tone_proxy", "q").groupBy())


def _with_skin_quartile(spark: SparkSession, c: Cohort, ids: DataFrame | None) -> DataFrame:
    """The participants with ``q``, the quartile of their skin tone among all participants' days."""
    from ..operators.fairness import with_quartiles

    people = cut(participants(spark, c, ids))
    worn = people.select("participant_id", "skin_tone_proxy", F.explode(F.sequence(F.lit(1), F.lit(c.days))))
    return with_quartiles(people, "skin_tone_proxy", "q", worn)


def stress_test(spark: SparkSession, base: Cohort = Cohort(60, 30), effects: Mapping[str, Sequence[float]] = EFFECTS, ids: DataFrame | None = None) -> DataFrame:
    """(effect, coefficient, observed) over each effect's strengths.

    All settings are columns of one frame, so one grouped aggregation observes the whole sweep. Skin tones and draws do not
    depend on a setting: quartiles are cut and days drawn once for all of them.
    """
    settings = [(name, float(s), replace(base, **{name: s})) for name, strengths in effects.items() for s in strengths]
    if not settings or not set(effects) <= set(EFFECTS):
        raise ValueError(f"effects must be among {sorted(EFFECTS)}, with a strength at least")
    rows = [F.struct(F.lit(i).alias("__setting"), F.lit(n).alias("effect"), F.lit(v).alias("coefficient"), *[F.lit(float(getattr(c, k))).alias(f"__{k}") for k in EFFECTS]) for i, (n, v, c) in enumerate(settings)]
    swept = drawn_days(_with_skin_quartile(spark, base, ids), base).select("*", F.inline(F.array(*rows)))
    seen = _observed(settled(swept, base, {k: F.col(f"__{k}") for k in EFFECTS}).groupBy("__setting", "effect", "coefficient"))
    return seen.select("effect", "coefficient", F.coalesce(*[F.when(F.col("effect") == k, F.col(k)) for k in EFFECTS]).alias("observed"))


def monotonic_response(sweep: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(effect, monotonic, change): whether the observed effect follows its strength, up to ``tolerance`` of its spread."""
    from pyspark.sql import Window

    strength = F.abs("coefficient")
    ends = sweep.groupBy("effect").agg((F.max_by("observed", strength) - F.min_by("observed", strength)).alias("change"), F.stddev_pop("observed").alias("__s"))
    step = F.col("observed") - F.lag("observed").over(Window.partitionBy("effect").orderBy(strength))
    held = sweep.withColumn("__d", step).join(ends, "effect")
    follows = F.coalesce(F.col("__d") * F.signum("change") >= -tolerance * F.col("__s"), F.lit(True))
    return held.groupBy("effect").agg(F.bool_and(follows).alias("monotonic"), F.first("change").alias("change"))


def regime_summary(spark: SparkSession, participants: int = 60, days: int = 35, regimes: Mapping[str, Mapping] = REGIMES, ids: DataFrame | None = None) -> DataFrame:
    """(regime, mean_trust, observed effects, test_retest_r) for each regime.

    Regimes of one seed and size are columns of one frame. Its rows stay where their participant is: one pass makes a row for each regime and
    participant, and all results come from those.
    """
    groups: dict[tuple, list[tuple[str, Cohort]]] = {}
    for name, coefficients in regimes.items():
        c = replace(Cohort(participants, days), **coefficients)
        groups.setdefault((c.participants, c.days, c.seed, c.start), []).append((name, c))
    out = None
    for settings in groups.values():
        one = _summary(spark, settings, ids)
        out = one if out is None else out.unionByName(one)
    return out


#: Coefficients that a regime may change.
COEFFICIENTS = ("heat_hrv", "skin_tone_penalty", "device_b_hr", "device_c_hr", "missing_scale")


def _summary(spark: SparkSession, settings: Sequence[tuple[str, Cohort]], ids: DataFrame | None) -> DataFrame:
    from pyspark.sql import Window

    from ..functions.stats import both, ratio, safe_corr
    from ..operators import trust

    base = settings[0][1]
    rows = [F.struct(F.lit(n).alias("regime"), *[F.lit(float(getattr(c, k))).alias(f"__{k}") for k in COEFFICIENTS]) for n, c in settings]
    people = _with_skin_quartile(spark, base, ids).repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "participant_id")
    swept = drawn_days(people, base).select("*", F.inline(F.array(*rows)))
    df = settled(swept, base, {k: F.col(f"__{k}") for k in COEFFICIENTS}).drop(*[f"__{k}" for k in COEFFICIENTS])

    # A week's mean stands at the first of its days that has a value.
    own = ["regime", "participant_id"]
    week = F.floor(F.datediff("date", F.min("date").over(Window.partitionBy(*own))) / 7).cast("int")
    w = Window.partitionBy(*own, "__week")
    df = df.withColumn("__week", week).withColumn("__mean", F.avg("hrv_rmssd").over(w)).withColumn("__first", F.row_number().over(w.orderBy("date")) == 1)
    weekly = F.sort_array(F.collect_list(F.when(F.col("__first") & F.col("__mean").isNotNull(), F.struct(F.col("__week").alias("week"), F.col("__mean").alias("x")))))
    x, y = both("heat_index", "hrv_rmssd")
    sums = {"n": F.count(x).cast("double"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}
    further = {"q": F.first("q"), "device": F.first("device_type"), "sq_sum": F.sum("signal_quality_ground_truth"), "sq_n": F.count("signal_quality_ground_truth"), "weeks": weekly, **sums}
    by = trust.scores_of_cohorts(df, "regime", further=[v.alias(f"__{k}") for k, v in further.items()] + [F.sum("resting_hr").alias("__hr_sum"), F.count("resting_hr").alias("__hr_n")])

    mean = lambda name, cond: ratio(F.sum(F.when(cond, F.col(f"__{name}_sum"))), F.sum(F.when(cond, F.col(f"__{name}_n"))).cast("double"))
    s = lambda k: F.sum(f"__{k}")
    var = lambda a, aa: s(aa) / s("n") - (s(a) / s("n")) ** 2
    r = F.when((s("n") >= 10) & (var("sx", "sxx") > 1e-12) & (var("sy", "syy") > 1e-12), (s("sxy") / s("n") - s("sx") / s("n") * s("sy") / s("n")) / F.sqrt(var("sx", "sxx") * var("sy", "syy")))
    seen = by.groupBy("regime").agg(
        F.avg("overall").alias("mean_trust"), r.alias("observed_heat_hrv"), (mean("sq", F.col("__q").isin("Q4", "high")) - mean("sq", F.col("__q").isin("Q1", "low"))).alias("observed_skin_tone_penalty"),
        (mean("hr", F.col("__device") == "device_B") - mean("hr", F.col("__device") == "device_A")).alias("observed_device_b_hr"),
    )
    pair = F.transform(F.slice("__weeks", 2, F.size("__weeks") - 1), lambda e, i: F.struct(F.get("__weeks", i)["x"].alias("x"), e["x"].alias("y")))
    again = by.filter(F.size("__weeks") >= 4).select("regime", F.inline(pair)).groupBy("regime").agg(safe_corr("x", "y", 3).alias("test_retest_r"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n, _ in settings])).alias("regime"))
    return names.join(F.broadcast(seen), "regime", "left").join(F.broadcast(again), "regime", "left")


def predicted_vs_observed(summary: DataFrame) -> DataFrame:
    """(prediction, observed, status): what each regime should show against what it does; a value that is missing is skipped."""
    at = lambda regime, c: F.max(F.when(F.col("regime") == regime, F.col(c)))
    tests = [
        ("clean world has no skin-tone gap", at("clean_world", "observed_skin_tone_penalty"), lambda v: F.abs(v) < 0.05),
        ("clean world has no device offset", at("clean_world", "observed_device_b_hr"), lambda v: F.abs(v) < 3.0),
        ("severe heat lowers HRV", at("severe_heat", "observed_heat_hrv"), lambda v: v < -0.1),
        ("severe heat is stronger than a clean world", at("severe_heat", "observed_heat_hrv") - at("clean_world", "observed_heat_hrv"), lambda v: v < 0),
        ("severe skin bias widens the gap", at("severe_skin_bias", "observed_skin_tone_penalty"), lambda v: v < -0.2),
        ("severe device bias moves device B", at("severe_device_bias", "observed_device_b_hr"), lambda v: v > 6.0),
        ("severe missingness lowers trust", at("severe_missingness", "mean_trust") - at("clean_world", "mean_trust"), lambda v: v < -5.0),
        ("clean world is reproducible", at("clean_world", "test_retest_r"), lambda v: v > 0.5),
    ]
    one = summary.agg(*[v.alias(f"v{i}") for i, (_, v, _) in enumerate(tests)])
    status = lambda i, ok: F.when(F.col(f"v{i}").isNull(), "skip").when(ok(F.col(f"v{i}")), "pass").otherwise("fail")
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("prediction"), F.col(f"v{i}").alias("observed"), status(i, ok).alias("status")) for i, (n, _, ok) in enumerate(tests)])))
