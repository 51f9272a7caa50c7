"""Registered queries of cohorts, sweeps, bootstraps, graphs, the service, figures and reports, each with its SQL."""

from __future__ import annotations

import math
import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrow, table_functions
from ..operators import agreement, causal, daily as days, effects, fairness, models, reliability, trust
from ..session import checkpoint_folder, cut
from ..sources import adapters, recordings, synthetic
from . import figures, p_value_sql as p_values, report, service, views
from ..streaming import audit
from .queries import _COHORT, _GAPS, _ROUND, _STRATA, _WEEKS, B, D, L, Q_OF, R, S, W, _corr, _rank, _state_deltas, _streamed, _trust_sql, query, with_sql

# hashed numbers, as functions.stats.hashed_uniform and sources.synthetic.normal have them


def _u(seed, name: str, *key: str) -> str:
    parts = [f"'{seed}'", f"'{name}'", *[f"({k})::VARCHAR" for k in key]]
    return f"((('0x' || md5(concat_ws(':', {', '.join(parts)}))[1:13])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _z(seed, name: str, *key: str) -> str:
    return f"(sqrt(-2 * ln({_u(seed, name + '/r', *key)})) * cos({2 * math.pi!r}::DOUBLE * {_u(seed, name + '/a', *key)}))"


def _gamma(seed, name: str, shape: int, *key: str) -> str:
    return "(" + " + ".join(f"(-ln({_u(seed, f'{name}/{i}', *key)}))" for i in range(shape)) + ")"


def _clip(e: str, lo, hi) -> str:
    return f"least(greatest({e}, {lo}::DOUBLE), {hi}::DOUBLE)"


def _cohort_sql(c: synthetic.Cohort, at: str = "", people: str = views.PEOPLE_SQL) -> str:
    """The CTEs people and days (with ``at`` after their names) of a synthetic cohort, made of the ids of ``people``."""
    s, t, k, d = c.seed, c.seed + 1, "participant_id", ("participant_id", "d")
    beta = lambda name, a, b: f"({_gamma(s, name + '/x', a, k)} / ({_gamma(s, name + '/x', a, k)} + {_gamma(s, name + '/y', b, k)}))"
    bias = " ".join(f"WHEN '{n}' THEN {v[0]}::DOUBLE" for n, v in c.devices.items())
    factor = " ".join(f"WHEN '{n}' THEN {v[1]}::DOUBLE" for n, v in c.devices.items())
    return f"""people{at} AS (SELECT participant_id, age, CASE WHEN {_u(s, 'sex', k)} < 0.51 THEN 'F' ELSE 'M' END AS sex,
  round({_clip(f"70 + (age - 40) * 0.05::DOUBLE + 6 * {_z(s, 'hr', k)}", 45, 95)}, 1) AS baseline_hr, round({_clip(f"55 - (age - 30) * 0.4::DOUBLE + 9 * {_z(s, 'hrv', k)}", 12, 110)}, 1) AS baseline_hrv,
  round({_clip(f"7500 + 2800 * {_z(s, 'act', k)}", 800, 22000)})::INT AS baseline_activity,
  CASE WHEN {_u(s, 'device', k)} < 0.45 THEN 'device_A' WHEN {_u(s, 'device', k)} < 0.85 THEN 'device_B' ELSE 'device_C' END AS device_type,
  round({_u(s, 'skin', k)}, 3) AS skin_tone_proxy, round({beta('climate', 2, 5)}, 3) AS climate_sensitivity, round({beta('missing', 2, 8)}, 3) AS missingness_tendency
  FROM (SELECT *, (18 + floor({_u(s, 'age', k)} * 58))::INT AS age FROM ({people}))),
d0{at} AS (SELECT *, DATE '{c.start}' + d AS date FROM people{at}, (SELECT unnest(range({c.days}))::INT AS d)),
d1{at} AS (SELECT *, 22 + 8 * sin({2 * math.pi!r}::DOUBLE * d / 60) + 2 * {_z(t, 'temp', *d)} AS t0, {_clip(f"55 + 12 * {_z(t, 'hum', *d)}", 15, 95)} AS h0, {_clip(f"25 * {_gamma(t, 'aqi', 2, *d)}", 8, 280)} AS a0,
  floor(greatest(0.0::DOUBLE, baseline_activity * CASE WHEN isodow(date) >= 6 THEN 1.12::DOUBLE ELSE 1.0::DOUBLE END + 2200 * {_z(t, 'steps', *d)})) AS step_count FROM d0{at}),
d2{at} AS (SELECT *, t0 + 0.04::DOUBLE * (h0 - 50) AS i0, floor({_clip(f"step_count / 120 + 8 * {_z(t, 'active', *d)}", 0, 240)}) AS active_minutes, greatest(0.0::DOUBLE, a0 - 100) * 0.002::DOUBLE AS bad FROM d1{at}),
d3{at} AS (SELECT *, greatest(0.0::DOUBLE, i0 - 26) * climate_sensitivity AS heat FROM d2{at}),
d4{at} AS (SELECT *, {_clip(f"7.4::DOUBLE + 0.9::DOUBLE * {_z(t, 'sleep', *d)} - 0.08::DOUBLE * heat - 0.5::DOUBLE * bad", 3, 11)} AS l0, {_clip(f"0.87::DOUBLE + 0.06::DOUBLE * {_z(t, 'eff', *d)} - 0.012::DOUBLE * heat - 0.04::DOUBLE * bad", 0.4, 0.99)} AS e0 FROM d3{at}),
d5{at} AS (SELECT *, {_clip(f"baseline_hrv + 6 * {_z(t, 'rmssd', *d)} + ({c.heat_hrv})::DOUBLE * heat - 4 * greatest(0.0::DOUBLE, 7 - l0) - 0.0006::DOUBLE * greatest(0.0::DOUBLE, step_count - 12000)", 5, 180)} AS v0,
  {_clip(f"baseline_hr + CASE device_type {bias} END + 2.5::DOUBLE * {_z(t, 'hr', *d)} + 0.0002::DOUBLE * greatest(0.0::DOUBLE, step_count - 10000) + 0.06::DOUBLE * heat", 40, 110)} AS r0,
  {_clip(f"0.35::DOUBLE + 0.18::DOUBLE * {_z(t, 'stress', *d)} + 0.02::DOUBLE * heat + 0.04::DOUBLE * greatest(0.0::DOUBLE, 7 - l0) - 0.000008::DOUBLE * step_count", 0, 1)} AS s0 FROM d4{at}),
d6{at} AS (SELECT *, {_clip(f"v0 * (0.9::DOUBLE + 0.08::DOUBLE * {_z(t, 'sdnn', *d)})", 4, 220)} AS n0, ({_u(t, 'worn', *d)} < {_clip(f"{c.missing_scale}::DOUBLE * (missingness_tendency + 0.15::DOUBLE * s0 + 0.08::DOUBLE * (1 - e0) + 0.01::DOUBLE * heat)", 0, 0.6)})::INT AS missing_wearable_flag, active_minutes / 240 AS motion FROM d5{at}),
days{at} AS (SELECT participant_id, age, sex, baseline_hr, baseline_hrv, baseline_activity, device_type, skin_tone_proxy, climate_sensitivity, missingness_tendency, date, step_count, active_minutes, missing_wearable_flag,
  round(t0, 1) AS temperature_c, round(h0, 1) AS humidity, round(a0, 1) AS aqi, round(i0, 1) AS heat_index, round(l0, 2) AS sleep_duration, round(e0, 3) AS sleep_efficiency, round(v0, 1) AS hrv_rmssd, round(n0, 1) AS hrv_sdnn, round(r0, 1) AS resting_hr, round(s0, 3) AS stress_proxy,
  CASE WHEN missing_wearable_flag = 1 THEN 0.0::DOUBLE ELSE floor({_clip(f"1100 + 180 * {_z(t, 'wear', *d)}", 200, 1440)}) END AS wearable_minutes,
  round({_clip(f"0.92::DOUBLE * CASE device_type {factor} END - 0.3::DOUBLE * motion - {c.skin_tone_penalty}::DOUBLE * skin_tone_proxy + 0.06::DOUBLE * {_z(t, 'sq', *d)} - 0.4::DOUBLE * missing_wearable_flag", 0, 1)}, 3) AS signal_quality_ground_truth,
  round({_clip(f"0.15::DOUBLE + 0.5::DOUBLE * motion + 0.4::DOUBLE * missing_wearable_flag + 0.05::DOUBLE * {_z(t, 'ab', *d)}", 0, 1)}, 3) AS artifact_burden_ground_truth,
  round({_clip(f"0.85::DOUBLE - 0.4::DOUBLE * missing_wearable_flag - 0.15::DOUBLE * motion - 0.1::DOUBLE * (1 - e0) + 0.05::DOUBLE * {_z(t, 'rel', *d)}", 0, 1)}, 3) AS reliability_ground_truth FROM d6{at})"""


_OBSERVED = (
    f"(SELECT {_corr('heat_index', 'hrv_rmssd', 10)} FROM days{{at}}) AS heat_hrv, "
    "(SELECT avg(signal_quality_ground_truth) FILTER (skin_tone_proxy > q3) - avg(signal_quality_ground_truth) FILTER (skin_tone_proxy <= q1) FROM days{at}, (SELECT quantile_cont(skin_tone_proxy, 0.25) AS q1, quantile_cont(skin_tone_proxy, 0.75) AS q3 FROM days{at})) AS skin_tone_penalty, "
    "(SELECT avg(resting_hr) FILTER (device_type = 'device_B') - avg(resting_hr) FILTER (device_type = 'device_A') FROM days{at}) AS device_b_hr"
)

# synthetic cohorts

_SMALL = synthetic.Cohort(days=20)


@query("SELECT * FROM people", _cohort_sql(_SMALL))
def synthetic_participants(spark, sf):
    return synthetic.participants(spark, _SMALL, views.people(spark, sf))


@query("SELECT * FROM days", _cohort_sql(_SMALL, people=views.WHOLE_PEOPLE_SQL))
def synthetic_days(spark, sf):
    return synthetic.generate(spark, _SMALL, ids=views.people(spark, sf, whole=True))


_BASE = synthetic.Cohort(days=30)
_SWEEP = [(e, s, replace(_BASE, **{e: s})) for e, strengths in synthetic.EFFECTS.items() for s in strengths]
_SWEEP_SQL = "sweep AS (" + " UNION ALL ".join(f"SELECT '{e}' AS effect, ({s})::DOUBLE AS coefficient, {e} AS observed FROM (SELECT {_OBSERVED.format(at=i)})" for i, (e, s, _) in enumerate(_SWEEP)) + ")"
_SWEEP_WITH = [*[_cohort_sql(c, str(i)) for i, (_, _, c) in enumerate(_SWEEP)], _SWEEP_SQL]


@query("SELECT effect, coefficient, round(observed, 6) AS observed FROM sweep", *_SWEEP_WITH)
def stress_response(spark, sf):
    return synthetic.stress_test(spark, _BASE, ids=views.people(spark, sf))


with_sql("synthetic_cohort", "SELECT participant_id, date, device_type, resting_hr, hrv_rmssd, missing_wearable_flag, signal_quality_ground_truth FROM days", _cohort_sql(_SMALL))
with_sql("generator_stress_sweep", "SELECT effect, coefficient, round(observed, 6) AS observed FROM sweep", *_SWEEP_WITH)


@query(
    "SELECT effect, bool_and(coalesce(step * sign(change) >= -0.05::DOUBLE * spread, true)) AS monotonic, round(any_value(change), 6) AS change FROM (SELECT effect, observed - lag(observed) OVER (PARTITION BY effect ORDER BY abs(coefficient)) AS step, "
    "last_value(observed) OVER w - first_value(observed) OVER w AS change, stddev_pop(observed) OVER (PARTITION BY effect) AS spread FROM sweep WINDOW w AS (PARTITION BY effect ORDER BY abs(coefficient) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY effect",
    *_SWEEP_WITH,
)
def stress_monotonic(spark, sf):
    return synthetic.monotonic_response(synthetic.stress_test(spark, _BASE, ids=views.people(spark, sf)))


_REGIMES = [(n, replace(synthetic.Cohort(days=35), **x)) for n, x in synthetic.REGIMES.items()]


def _regime_sql(i: int, name: str) -> str:
    trusted = _trust_sql("participant_id", f"days{i}", f"(SELECT avg(resting_hr) FROM days{i})")
    weeks = _WEEKS.format(src=f"(SELECT participant_id, date, hrv_rmssd AS value FROM days{i})")
    effects_ = ", ".join(f"{e} AS observed_{e}" for e in synthetic.EFFECTS)
    return f"SELECT '{name}' AS regime, (WITH {trusted} SELECT avg(overall) FROM labelled) AS mean_trust, {effects_}, (WITH {weeks} SELECT {_corr('x', 'y', 3)} FROM pairs WHERE n >= 4 AND y IS NOT NULL) AS test_retest_r FROM (SELECT {_OBSERVED.format(at=i)})"


_REGIME_WITH = [*[_cohort_sql(c, str(i)) for i, (_, c) in enumerate(_REGIMES)], "regimes AS (" + " UNION ALL ".join(_regime_sql(i, n) for i, (n, _) in enumerate(_REGIMES)) + ")"]
_OBS = ", ".join(f"round(observed_{e}, 6) AS observed_{e}" for e in synthetic.EFFECTS)


@query(f"SELECT regime, round(mean_trust, 6) AS mean_trust, {_OBS}, round(test_retest_r, 6) AS test_retest_r FROM regimes", *_REGIME_WITH)
def regime_summary(spark, sf):
    return synthetic.regime_summary(spark, days=35, ids=views.people(spark, sf))


def _at(regime: str, column: str) -> str:
    return f"(SELECT {column} FROM regimes WHERE regime = '{regime}')"


_PREDICTED = (
    ("clean world has no skin-tone gap", _at("clean_world", "observed_skin_tone_penalty"), "abs(v) < 0.05"),
    ("clean world has no device offset", _at("clean_world", "observed_device_b_hr"), "abs(v) < 3.0"),
    ("severe heat lowers HRV", _at("severe_heat", "observed_heat_hrv"), "v < -0.1"),
    ("severe heat is stronger than a clean world", f"{_at('severe_heat', 'observed_heat_hrv')} - {_at('clean_world', 'observed_heat_hrv')}", "v < 0"),
    ("severe skin bias widens the gap", _at("severe_skin_bias", "observed_skin_tone_penalty"), "v < -0.2"),
    ("severe device bias moves device B", _at("severe_device_bias", "observed_device_b_hr"), "v > 6.0"),
    ("severe missingness lowers trust", f"{_at('severe_missingness', 'mean_trust')} - {_at('clean_world', 'mean_trust')}", "v < -5.0"),
    ("clean world is reproducible", _at("clean_world", "test_retest_r"), "v > 0.5"),
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS prediction, round(v, 6) AS observed, CASE WHEN v IS NULL THEN 'skip' WHEN {t} THEN 'pass' ELSE 'fail' END AS status FROM (SELECT {v} AS v)" for n, v, t in _PREDICTED), *_REGIME_WITH)
def regime_predictions(spark, sf):
    return synthetic.predicted_vs_observed(synthetic.regime_summary(spark, days=35, ids=views.people(spark, sf)))


# bootstraps by clusters: Poisson(1) counts from a hash, as reliability.bootstrap_weight draws them

_CUMULATIVE = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def _weight_sql(key: str) -> str:
    u = _u(42, "{b}", key).replace("'{b}'", "b::VARCHAR")
    return "(SELECT " + " + ".join(f"(u > {x!r}::DOUBLE)::INT" for x in _CUMULATIVE) + f" FROM (SELECT {u} AS u))"


def _retest_sql(metric: str, source: str, replicates: int) -> str:
    """One row, as reliability.cohort_test_retest gives it, of the table ``source`` (participant_id, date, value)."""
    return f"""SELECT '{metric}' AS metric, 'week_pair' AS method, max(r) FILTER (b = 0) AS r, quantile_cont(r, 0.025) FILTER (b > 0) AS ci_low, quantile_cont(r, 0.975) FILTER (b > 0) AS ci_high, max(k) FILTER (b = 0) AS n_participants, (max(n) FILTER (b = 0))::BIGINT AS n_pairs FROM (
WITH {_WEEKS.format(src=source)},
own AS (SELECT participant_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM pairs WHERE n >= 4 AND y IS NOT NULL GROUP BY 1),
drawn AS (SELECT *, CASE WHEN b = 0 THEN 1 ELSE {_weight_sql('participant_id')} END AS w FROM own, (SELECT unnest(range(0, {replicates + 1})) AS b)),
t AS (SELECT b, sum(w * n) AS n, sum(w * sx) / sum(w * n) AS mx, sum(w * sy) / sum(w * n) AS my, sum(w * sxx) / sum(w * n) AS xx, sum(w * syy) / sum(w * n) AS yy, sum(w * sxy) / sum(w * n) AS xy, count(*) AS k FROM drawn GROUP BY b HAVING sum(w * n) > 0)
SELECT b, n, k, CASE WHEN n >= 3 AND xx - mx * mx > 1e-12 AND yy - my * my > 1e-12 THEN (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) END AS r FROM t)"""


_RETEST = "metric, method, round(r, 6) AS r, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_participants, n_pairs"


@query(f"SELECT {_RETEST} FROM ({_retest_sql('value', 'S', 200)})", S)
def test_retest_interval(spark, sf):
    return reliability.cohort_test_retest_table(views.order_series(spark, sf), ["value"])


with_sql("test_retest_bootstrap", f"SELECT {_RETEST} FROM ({_retest_sql('value', 'S', 200)})", S)


_ICC_OF = """(SELECT CASE WHEN n >= 2 AND k >= 2 AND den > 0 THEN (msr - mse) / den END FROM (SELECT *, msr + (k - 1) * mse + k * (msc - mse) / n AS den FROM (SELECT *, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS mse FROM (
SELECT count(DISTINCT s) AS n, count(DISTINCT d) AS k, sum((v - g) * (v - g)) AS sst, sum((sm - g) * (sm - g)) AS ssr, sum((rm - g) * (rm - g)) AS ssc FROM (SELECT *, avg(v) OVER () AS g, avg(v) OVER (PARTITION BY s) AS sm, avg(v) OVER (PARTITION BY d) AS rm FROM (
SELECT participant_id AS s, row_number() OVER (PARTITION BY participant_id ORDER BY date) AS d, {m} AS v FROM D) WHERE d <= 7) WHERE s IN (SELECT s FROM first7 WHERE metric = '{m}')))))"""


@query(
    " UNION ALL ".join(f"SELECT metric, round({_ICC_OF.format(m=m)}, 4) AS icc, round(r, 4) AS r, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high FROM ({_retest_sql(m, f'(SELECT participant_id, date, {m} AS value FROM D)', 200)})" for m in ("resting_hr", "step_count")),
    D, "first7 AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, participant_id AS s FROM (SELECT participant_id, {m} AS v, row_number() OVER (PARTITION BY participant_id ORDER BY date) AS d FROM D) WHERE d <= 7 GROUP BY participant_id HAVING count(v) = 7" for m in ("resting_hr", "step_count")) + ")",
)
def icc_vs_test_retest(spark, sf):
    return reliability.compare_to_test_retest(views.daily(spark, sf), ["resting_hr", "step_count"], replicates=200)


@query(
    """SELECT participant_id, round(avg(variation), 6) AS mean_variation, round(any_value(slope), 6) AS slope FROM (SELECT participant_id, CASE WHEN count(resting_hr) OVER w = 7 THEN stddev_samp(resting_hr) OVER w / (avg(resting_hr) OVER w + 1e-9) END AS variation FROM D WINDOW w AS (PARTITION BY participant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
LEFT JOIN (SELECT participant_id, CASE WHEN count(*) >= 5 AND stddev_pop(y) >= 1e-9 THEN regr_slope(y, i) END AS slope FROM (SELECT participant_id, resting_hr AS y, row_number() OVER (PARTITION BY participant_id ORDER BY date) - 1 AS i FROM D) GROUP BY 1) USING (participant_id) GROUP BY participant_id""",
    D,
)
def stability(spark, sf):
    return reliability.participant_stability(views.daily(spark, sf), "resting_hr").drop("p_value")


with_sql(
    "participant_stability",
    f"""SELECT participant_id, round(avg(variation), 6) AS mean_variation, round(any_value(slope), 6) AS slope, round(any_value({p_values.t_p('t', 'df')}), 6) AS p_value FROM (SELECT participant_id, CASE WHEN count(resting_hr) OVER w = 7 THEN stddev_samp(resting_hr) OVER w / (avg(resting_hr) OVER w + 1e-9) END AS variation FROM D WINDOW w AS (PARTITION BY participant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
LEFT JOIN (SELECT participant_id, n - 2 AS df, CASE WHEN ok THEN slope END AS slope, CASE WHEN ok THEN sign(c) * sqrt(r2 * (n - 2) / nullif(1 - r2, 0)) END AS t FROM (SELECT participant_id, count(*) AS n, count(*) >= 5 AND stddev_pop(y) >= 1e-9 AS ok, regr_slope(y, i) AS slope, regr_r2(y, i) AS r2, covar_pop(y, i) AS c
  FROM (SELECT participant_id, resting_hr AS y, row_number() OVER (PARTITION BY participant_id ORDER BY date) - 1 AS i FROM D WHERE resting_hr IS NOT NULL) GROUP BY 1)) USING (participant_id) GROUP BY participant_id""",
    D,
)


# change-points: a segment is a list that splits into two lists while the F statistic of its best split is high

_SEGMENTS = """seg AS (SELECT participant_id, 0 AS lo, x FROM (SELECT participant_id, list(resting_hr ORDER BY date) AS x FROM D WHERE resting_hr IS NOT NULL GROUP BY 1) WHERE len(x) >= 14
UNION ALL SELECT participant_id, lo + p.at, p.part FROM (SELECT participant_id, lo, unnest([{'at': 0, 'part': x[1:i]}, {'at': i, 'part': x[i + 1:]}]) AS p FROM (
  SELECT participant_id, lo, x, best.i AS i, best.g AS g, list_sum(list_transform(x[1:best.i], lambda v: (v - list_avg(x[1:best.i])) * (v - list_avg(x[1:best.i])))) + list_sum(list_transform(x[best.i + 1:], lambda v: (v - list_avg(x[best.i + 1:])) * (v - list_avg(x[best.i + 1:])))) AS rest FROM (
    SELECT *, list_reduce(list_transform(range(2, len(x) - 2), lambda j: {'i': j, 'g': pow(list_sum(x[1:j]), 2) / j + pow(list_sum(x) - list_sum(x[1:j]), 2) / (len(x) - j) - pow(list_sum(x), 2) / len(x)}), lambda a, b: CASE WHEN b.g > a.g THEN b ELSE a END) AS best FROM seg WHERE len(x) >= 14))
  WHERE i >= 7 AND len(x) - i >= 7 AND g > 0 AND (rest <= 0 OR g / (rest / (len(x) - 2)) >= 8.0)))"""


_SERIES_OF = "series AS (SELECT participant_id, list(resting_hr ORDER BY date) AS x FROM D WHERE resting_hr IS NOT NULL GROUP BY participant_id HAVING count(*) >= 14)"
_SEGMENT_SCAN = """SELECT participant_id, (lo + i)::INT AS index, round(CASE WHEN rest <= 0 THEN 'inf'::DOUBLE ELSE g / (rest / (len(x) - 2)) END, 6) AS score, round(list_avg(x[1:i]), 6) AS before_mean, round(list_avg(x[i + 1:]), 6) AS after_mean, round(list_avg(x[i + 1:]) - list_avg(x[1:i]), 6) AS delta, 'binary_segmentation' AS method
FROM (SELECT participant_id, lo, x, best.i AS i, best.g AS g, list_sum(list_transform(x[1:best.i], lambda v: (v - list_avg(x[1:best.i])) * (v - list_avg(x[1:best.i])))) + list_sum(list_transform(x[best.i + 1:], lambda v: (v - list_avg(x[best.i + 1:])) * (v - list_avg(x[best.i + 1:])))) AS rest FROM (
  SELECT *, list_reduce(list_transform(range(2, len(x) - 2), lambda j: {'i': j, 'g': pow(list_sum(x[1:j]), 2) / j + pow(list_sum(x) - list_sum(x[1:j]), 2) / (len(x) - j) - pow(list_sum(x), 2) / len(x)}), lambda a, b: CASE WHEN b.g > a.g THEN b ELSE a END) AS best FROM seg WHERE len(x) >= 14))
WHERE i >= 7 AND len(x) - i >= 7 AND g > 0 AND (rest <= 0 OR g / (rest / (len(x) - 2)) >= 8.0)"""
with_sql("binary_segmentation_scan", _SEGMENT_SCAN, D, _SEGMENTS, recursive=True)
with_sql(
    "bocpd_scan",
    """SELECT participant_id, (t - 1)::INT AS index, round((last - now)::DOUBLE, 6) AS score, round(before_mean, 6) AS before_mean, round(after_mean, 6) AS after_mean, round(after_mean - before_mean, 6) AS delta, 'bocpd' AS method
FROM (SELECT *, list_avg(x[greatest(t - 10, 1):t - 1]) AS before_mean, list_avg(x[t:t + 9]) AS after_mean FROM online WHERE last - now >= 5 AND t >= 5 AND t <= len(x) - 3)""",
    D, _SERIES_OF, p_values.change_points("series"), recursive=True,
)


with_sql(
    "streaming_change_points",
    "SELECT participant_id AS user_id, (t - 1)::BIGINT AS index, round((last - now)::DOUBLE, 6) AS score, x[t] AS value FROM online WHERE last - now >= 5 AND t >= 5",
    "settled AS (SELECT user_id, ts, event_id, value, max(ts) OVER (PARTITION BY user_id) AS latest FROM events WHERE value IS NOT NULL)",
    "series AS (SELECT user_id AS participant_id, list(value ORDER BY ts, event_id) AS x FROM settled WHERE epoch_ms(ts) < epoch_ms(latest) - 86400000 GROUP BY user_id HAVING count(*) >= 5)",
    p_values.change_points("series"), recursive=True,
)


@query("SELECT participant_id, count(*) OVER (PARTITION BY participant_id) AS n_segments, lo::INT AS start FROM (SELECT DISTINCT participant_id, lo FROM seg)", D, _SEGMENTS, recursive=True)
def segmentation(spark, sf):
    d = views.daily(spark, sf)
    found = arrow.scan_changes(d, "resting_hr").groupBy("participant_id").agg(F.collect_list("index").alias("found"))
    enough = d.filter("resting_hr is not null").groupBy("participant_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 14")
    starts = F.array_sort(F.concat(F.array(F.lit(0)), F.coalesce("found", F.array().cast("array<int>"))))
    return enough.join(found, "participant_id", "left").select("participant_id", F.size(starts).cast("long").alias("n_segments"), F.explode(starts).alias("start"))


# agreement and effects

@query(
    f"SELECT r2, count(*) AS n, round({_corr('own', 'ok', 3, '1e-12')}, 6) AS point_biserial, count(*) FILTER (own >= 0.7 AND ok = 1) AS both_pass, count(*) FILTER (own >= 0.7 AND ok = 0) AS only_in_house, count(*) FILTER (own < 0.7 AND ok = 1) AS only_method, count(*) FILTER (own < 0.7 AND ok = 0) AS both_fail, "
    f"round(CASE WHEN count(*) >= 3 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) AS rho FROM (SELECT *, {_rank('own', '', 'r2')} AS a, {_rank('template', '', 'r2')} AS b FROM H) GROUP BY r2",
    R, "H AS (SELECT r2, own, coalesce(template, 0.0) AS template, r1::DOUBLE AS ok FROM R)",
)
def head_to_head_by(spark, sf):
    return agreement.head_to_head(views.raters(spark, sf), "own", "template", "r1", ["r2"])


_HALF = f"{_u(0, 'x', 'doc_id').replace(chr(39) + 'x' + chr(39) + ', ', '')} < 0.5"
_SPLIT_CELLS = "c{h} AS (SELECT threshold, count(*) AS n, count(*) FILTER (score >= threshold AND quality = 1)::DOUBLE AS tp, count(*) FILTER (score >= threshold AND quality = 0)::DOUBLE AS fp, count(*) FILTER (score < threshold AND quality = 1)::DOUBLE AS fn, count(*) FILTER (score < threshold AND quality = 0)::DOUBLE AS tn FROM (SELECT * FROM L WHERE ({half}) = {side}), grid GROUP BY threshold), k{h} AS (SELECT threshold, n, po, CASE WHEN pe < 1 - 1e-9 THEN (po - pe) / (1 - pe) END AS kappa FROM (SELECT *, (tp + tn) / n AS po, (tp + fp) / n * ((tp + fn) / n) + (1 - (tp + fp) / n) * (1 - (tp + fn) / n) AS pe FROM c{h}))"


@query(
    "SELECT threshold, round(b.kappa, 6) AS calibration_kappa, round(k1.kappa, 6) AS holdout_kappa, round(po, 6) AS holdout_agreement, n AS n_holdout FROM k1 JOIN (SELECT arg_max(threshold, {'k': kappa, 't': -threshold}) AS threshold, max(kappa) AS kappa FROM k0 WHERE kappa IS NOT NULL) AS b USING (threshold)",
    L, "grid AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(10, 100) AS r(i))", _SPLIT_CELLS.format(h=0, half=_HALF, side="true"), _SPLIT_CELLS.format(h=1, half=_HALF, side="false"),
)
def holdout_kappa(spark, sf):
    return agreement.recalibrate_with_holdout(views.scored_labels(spark, sf), "score", "quality", "doc_id", [i / 100 for i in range(10, 100)])


_TALL = "T AS (SELECT participant_id, missing_wearable_flag AS state, metric, value FROM (SELECT participant_id, missing_wearable_flag, resting_hr, hrv_rmssd FROM D) UNPIVOT (value FOR metric IN (resting_hr, hrv_rmssd)) WHERE value IS NOT NULL), K AS (SELECT *, rank() OVER (PARTITION BY participant_id, metric ORDER BY value) + (count(*) OVER (PARTITION BY participant_id, metric, value) - 1) / 2.0::DOUBLE AS rk FROM T)"


@query(
    "SELECT participant_id, metric, '0_vs_1' AS contrast, n_a, n_b, round(u, 6) AS u_a, round(2 * u / (n_a * n_b) - 1, 6) AS cliffs_delta FROM (SELECT *, s - n_a * (n_a + 1) / 2.0::DOUBLE AS u FROM (SELECT participant_id, metric, count(*) FILTER (state = 0) AS n_a, count(*) FILTER (state = 1) AS n_b, sum(rk) FILTER (state = 0) AS s FROM K GROUP BY 1, 2)) WHERE n_a >= 5 AND n_b >= 5",
    D, _TALL,
)
def within_subject_ranks(spark, sf):
    return effects.within_subject_tests(views.daily(spark, sf), ["resting_hr", "hrv_rmssd"], "missing_wearable_flag", [(0, 1)], by=["participant_id"]).drop("p_value")


with_sql(
    "within_subject_tests",
    f"SELECT participant_id, metric, '0_vs_1' AS contrast, n_a, n_b, round(u, 6) AS u_a, round(2 * u / (n_a * n_b) - 1, 6) AS cliffs_delta, round({p_values.mann_whitney_p('u', 'n_a', 'n_b', 'ties')}, 6) AS p_value FROM (SELECT *, s - n_a * (n_a + 1) / 2.0::DOUBLE AS u FROM (SELECT participant_id, metric, count(*) FILTER (state = 0) AS n_a, count(*) FILTER (state = 1) AS n_b, sum(rk) FILTER (state = 0) AS s FROM K GROUP BY 1, 2)) "
    "JOIN (SELECT participant_id, metric, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT participant_id, metric, value, count(*) AS c FROM K GROUP BY ALL) GROUP BY 1, 2) USING (participant_id, metric) WHERE n_a >= 5 AND n_b >= 5",
    D, _TALL,
)


@query(
    "SELECT participant_id, metric, '1_vs_0' AS contrast, n_a, n_b, round(2 * (s - n_a * (n_a + 1) / 2.0::DOUBLE) / (n_a * n_b) - 1, 6) AS cliffs_delta, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(qa, 6) AS median_a, round(qb, 6) AS median_b, "
    "round(CASE WHEN p > 0 THEN (ma - mb) / sqrt(p) END, 6) AS cohens_d FROM (SELECT *, ((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) AS p FROM (SELECT participant_id, metric, count(*) FILTER (state = 1) AS n_a, count(*) FILTER (state = 0) AS n_b, sum(rk) FILTER (state = 1) AS s, avg(value) FILTER (state = 1) AS ma, avg(value) FILTER (state = 0) AS mb, "
    "quantile_cont(value, 0.5) FILTER (state = 1) AS qa, quantile_cont(value, 0.5) FILTER (state = 0) AS qb, var_samp(value) FILTER (state = 1) AS va, var_samp(value) FILTER (state = 0) AS vb FROM K GROUP BY 1, 2)) WHERE n_a >= 5 AND n_b >= 5",
    D, _TALL,
)
def state_effect_table(spark, sf):
    found = effects.state_effect_sizes(views.daily(spark, sf), ["resting_hr", "hrv_rmssd"], "missing_wearable_flag", 1, 0, by=["participant_id"], replicates=1)
    return found.drop("p_value", "cliffs_delta_ci_low", "cliffs_delta_ci_high")


@query(
    """SELECT device_type, n, round(median_delta, 6) AS median_delta, w_plus FROM (SELECT device_type, count(*) AS n, quantile_cont(d, 0.5) AS median_delta FROM P GROUP BY 1) LEFT JOIN (
SELECT device_type, coalesce(sum(r) FILTER (d > 0), 0.0) AS w_plus FROM (SELECT *, rank() OVER (PARTITION BY device_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY device_type, abs(d)) - 1) / 2.0::DOUBLE AS r FROM P WHERE d <> 0) GROUP BY 1) USING (device_type)""",
    D, "P AS (SELECT * FROM (SELECT device_type, participant_id, round(avg(resting_hr) FILTER (missing_wearable_flag = 1) - avg(resting_hr) FILTER (missing_wearable_flag = 0), 6) AS d FROM D GROUP BY ALL) WHERE d IS NOT NULL)",
)
def paired_ranks(spark, sf):
    return effects.paired_wilcoxon(_state_deltas(views.daily(spark, sf)), "d", ["device_type"]).drop("p_value")


_DELTAS = "P AS (SELECT * FROM (SELECT device_type, participant_id, round(avg(resting_hr) FILTER (missing_wearable_flag = 1) - avg(resting_hr) FILTER (missing_wearable_flag = 0), 6) AS d FROM D GROUP BY ALL) WHERE d IS NOT NULL)"
_SIGNED = """ranked AS (SELECT device_type, count(*) AS held, sum(r) FILTER (d > 0) AS w, sum(c * c - 1)::DOUBLE AS ties FROM (SELECT *, rank() OVER (PARTITION BY device_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY device_type, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY device_type, abs(d)) AS c FROM P WHERE d <> 0) GROUP BY 1),
groups AS (SELECT device_type, n, median_delta, coalesce(held, 0) AS held, CASE WHEN held > 0 THEN coalesce(w, 0.0) END AS w_plus, coalesce(ties, 0) AS ties FROM (SELECT device_type, count(*) AS n, quantile_cont(d, 0.5) AS median_delta FROM P GROUP BY 1) LEFT JOIN ranked USING (device_type)),
sizes AS (SELECT DISTINCT held AS n FROM groups WHERE held = n AND held BETWEEN 1 AND 50 AND ties = 0)"""
_LARGE_P = p_values.normal_sf("(w_plus - held * (held + 1) / 4.0::DOUBLE) / sqrt(held * (held + 1) * (2 * held + 1) / 24.0::DOUBLE - ties / 48)")
with_sql(
    "paired_wilcoxon",
    f"SELECT device_type, groups.n, round(median_delta, 6) AS median_delta, w_plus, round(CASE WHEN groups.n < 3 THEN NULL WHEN held = 0 THEN 1.0 WHEN ways.n IS NOT NULL THEN list_sum(w[w_plus::BIGINT + 1:]) / list_sum(w) ELSE {_LARGE_P} END, 6) AS p_value FROM groups LEFT JOIN ways ON ways.n = held AND ways.k = held AND held = groups.n AND ties = 0",
    D, _DELTAS, _SIGNED, p_values.signed_rank_ways("sizes"), recursive=True,
)


@query(
    """SELECT subject_id, n AS n_windows_total, valid AS n_windows_valid, round(m, 6) AS mean, round(s, 6) AS deviation, round(100 * s / m, 6) AS variation_percent, round(r, 6) AS split_half_r FROM (
SELECT subject_id, count(*) AS n, count(rate) AS valid, avg(rate) AS m, stddev_pop(rate) AS s FROM V GROUP BY 1) JOIN (SELECT a.subject_id, CASE WHEN count(*) FILTER (a.rate IS NOT NULL AND b.rate IS NOT NULL) >= 5 THEN corr(a.rate, b.rate) END AS r
FROM V a JOIN V b ON a.subject_id = b.subject_id AND a.i < a.c // 2 AND b.i = a.i + a.c // 2 GROUP BY 1) USING (subject_id) WHERE n >= 6 AND valid > 0""",
    "V AS (SELECT user_id AS subject_id, CASE WHEN event_type <> 'error' THEN value END AS rate, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events)",
)
def session_rate_reliability(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("subject_id"), F.struct("ts", "event_id").alias("window_idx"), F.when(F.col("event_type") != "error", F.col("value")).alias("rate"))
    return recordings.rate_reliability(e)


# fairness and weights

def _strata_sql(column: str, stratum: str) -> str:
    return f"SELECT '{column}' AS stratified_by, stratum, n_days, {_ROUND}, overall, category FROM (WITH Q AS ({stratum}), {_STRATA} SELECT * FROM labelled WHERE n_days >= 10)"


@query(f"{_strata_sql('device_type', 'SELECT *, device_type AS stratum FROM D')} UNION ALL {_strata_sql('skin_tone_proxy', Q_OF)}", D)
def fairness_by_columns(spark, sf):
    out = None
    for name, strata in fairness.multi_stratify(views.daily(spark, sf), ["device_type", "skin_tone_proxy", "absent"]).items():
        one = strata.withColumn("stratified_by", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_SHAKEN = fairness.perturbed_weights(trust.WEIGHTS)
_SHAKEN_SQL = ", ".join("[" + ", ".join(repr(float(x)) for x in w) + "]" for w in _SHAKEN)
_TIMES = " + ".join(f"{n} * c.w[{i + 1}]" for i, n in enumerate(trust.COMPONENTS))
_PLAIN = " + ".join(f"{n} * {w}::DOUBLE" for n, w in trust.WEIGHTS.items())


_SHAKEN_QUERY = f"""SELECT m.magnitude, round(quantile_cont(rho, 0.5), 6) AS median_rho, round(min(rho), 6) AS min_rho FROM (SELECT i, CASE WHEN count(*) >= 5 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS rho FROM (
SELECT i, {_rank('x', '', 'i')} AS a, {_rank('y', '', 'i')} AS b FROM (SELECT c.i, round(({_TIMES}) / list_sum(c.w), 9) AS x, ({_PLAIN}) / {sum(trust.WEIGHTS.values())!r}::DOUBLE AS y FROM comp, (SELECT unnest(range({len(_SHAKEN)})) AS i, unnest([{_SHAKEN_SQL}]::DOUBLE[][]) AS w) AS c) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY i)
JOIN (SELECT unnest(range(4)) AS k, unnest([0.05, 0.1, 0.2, 0.4])::DOUBLE AS magnitude) AS m ON m.k = i // {len(_SHAKEN) // 4} GROUP BY m.magnitude"""
with_sql("weight_sensitivity", _SHAKEN_QUERY, D, _COHORT)


@query(_SHAKEN_QUERY, D, _COHORT)
def weight_stability(spark, sf):
    return fairness.sensitivity_table(trust.component_scores(views.daily(spark, sf), "participant_id"))



# bootstraps of counts: a cell's Poisson draw inverts the distribution up to a mean of 30, as agreement._poisson does

_DRAW_U = "concat_ws(':', '42', side, b::VARCHAR, score::VARCHAR{x})"
_UNIFORM = "((('0x' || md5({k})[1:13])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
_U_OF = lambda x="": _UNIFORM.format(k=_DRAW_U.format(x=x))
_CELLS_SQL = f"""cells AS (SELECT score, side, m FROM (SELECT score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM L WHERE quality IS NOT NULL AND score IS NOT NULL GROUP BY score) UNPIVOT (m FOR side IN (pos, neg))),
cdf AS (SELECT m, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY m ORDER BY k) AS c FROM (SELECT DISTINCT m::DOUBLE AS m FROM cells WHERE m BETWEEN 1 AND 30), range(0, 96) AS r(k) WHERE k <= ceil(m + 10 * sqrt(m) + 10)),
tosses AS (SELECT b, score, side, m::DOUBLE AS m, {_U_OF()} AS u, sqrt(-2 * ln({_U_OF(", 'r'")})) * cos({2 * math.pi!r}::DOUBLE * {_U_OF(", 'a'")}) AS z FROM cells, range(0, 201) AS r(b)),
small AS (SELECT b, score, side, count(c) FILTER (c < u) AS n FROM tosses JOIN cdf USING (m) GROUP BY ALL),
drawn AS (SELECT b, score, max(v) FILTER (side = 'pos') AS p, max(v) FILTER (side = 'neg') AS q FROM (SELECT b, score, side, CASE WHEN b = 0 OR m = 0 THEN m WHEN m <= 30 THEN small.n ELSE floor(greatest(0.0, m + sqrt(m) * z + (z * z - 1) / 6) + 0.5) END AS v FROM tosses LEFT JOIN small USING (b, score, side)) GROUP BY b, score)"""

with_sql(
    "auroc_bootstrap",
    "SELECT round(max(a) FILTER (b = 0), 6) AS auroc, round(quantile_cont(a, 0.025) FILTER (b > 0), 6) AS ci_low, round(quantile_cont(a, 0.975) FILTER (b > 0), 6) AS ci_high, (SELECT sum(m)::BIGINT FROM cells) AS n FROM (SELECT b, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS a FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM drawn) GROUP BY b)",
    L, _CELLS_SQL,
)
_BOUNDS = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in ("auroc", "average_precision", "youden_threshold", "f1_threshold") for n, q in (("low", 0.025), ("high", 0.975)))


@query(
    f"SELECT {_BOUNDS} FROM (SELECT b, sum(q * (tp - p / 2) / nullif(all_p * all_n, 0)) AS auroc, sum(p / nullif(all_p, 0) * coalesce(tp / nullif(tp + fp, 0), 0.0)) AS average_precision, "
    "arg_max(score, {'v': tp / nullif(all_p, 0) - fp / nullif(all_n, 0), 's': score}) AS youden_threshold, arg_max(score, {'v': 2 * tp / nullif(tp + fp + all_p, 0), 's': score}) AS f1_threshold "
    "FROM (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY b) AS all_p, sum(q) OVER (PARTITION BY b) AS all_n FROM drawn WHERE b > 0 WINDOW w AS (PARTITION BY b ORDER BY score DESC)) GROUP BY b)",
    L, _CELLS_SQL,
)
def threshold_intervals(spark, sf):
    return agreement.threshold_intervals(views.scored_labels(spark, sf), "score", "quality")


_SUMS = {
    "days": "count(*)", "q_n": "count(signal_quality_ground_truth)", "q": "sum(signal_quality_ground_truth)", "b_n": "count(artifact_burden_ground_truth)", "bu": "sum(artifact_burden_ground_truth)", "v_n": "count(hrv_rmssd)", "v": "sum(hrv_rmssd)",
    "vv": "sum(hrv_rmssd * hrv_rmssd)", "miss": "sum(m)", "n": "count(x)", "sx": "sum(x)", "sy": "sum(y)", "sxx": "sum(x * x)", "syy": "sum(y * y)", "sxy": "sum(x * y)",
}
_DIV = "({}) / nullif({}, 0)".format
_SCORES = {
    "signal_quality_score": f"CASE WHEN q_n > 0 THEN {_clip('100 * ' + _DIV('q', 'q_n'), 0, 100)} END",
    "artifact_burden_score": f"CASE WHEN b_n > 0 THEN {_clip('100 * (1 - ' + _DIV('bu', 'b_n') + ')', 0, 100)} END",
    "temporal_stability_score": f"CASE WHEN v_n >= 5 THEN CASE WHEN v <= 0 THEN 0.0 ELSE {_clip('100 * (1 - least(sqrt(greatest(vv / v_n - (v / v_n) * (v / v_n), 0.0)) / (v / v_n), 1.0))', 0, 100)} END END",
    "missingness_risk_score": _clip("100 * (1 - 0.7::DOUBLE * miss / days - 0.3::DOUBLE * least(longest / 7.0::DOUBLE, 1.0))", 0, 100),
    "device_bias_score": "100.0::DOUBLE",
    "confounding_risk_score": f"CASE WHEN n >= 5 THEN 100 * (1 - abs(coalesce({_DIV('sxy / n - sx / n * sy / n', 'sqrt((sxx / n - sx / n * sx / n) * (syy / n - sy / n * sy / n))')}, 0.0))) END",
}
_WEIGHED = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE * {{v}} ELSE 0.0 END" for c, w in trust.WEIGHTS.items())
_OVERALL = f"CASE WHEN {' + '.join(f'({c} IS NOT NULL)::INT' for c in trust.WEIGHTS)} >= 3 THEN round(({' + '.join(f'CASE WHEN {c} IS NOT NULL THEN {c} * {w}::DOUBLE ELSE 0.0 END' for c, w in trust.WEIGHTS.items())}) / ({_WEIGHED.format(v='1.0')}), 2) END"
with_sql(
    "fairness_bootstrap",
    f"SELECT stratum, n_days, {_ROUND}, overall, category, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM (WITH Q AS (SELECT *, device_type AS stratum FROM D), {_STRATA} SELECT * FROM labelled WHERE n_days >= 10) LEFT JOIN (SELECT stratum, quantile_cont(overall, 0.025) AS ci_low, quantile_cont(overall, 0.975) AS ci_high FROM scored GROUP BY stratum) USING (stratum)",
    D, "flagged AS (SELECT *, device_type AS stratum, coalesce((missing_wearable_flag = 1)::INT, 0) AS m, CASE WHEN heat_index IS NOT NULL AND hrv_rmssd IS NOT NULL THEN heat_index END AS x, CASE WHEN heat_index IS NOT NULL AND hrv_rmssd IS NOT NULL THEN hrv_rmssd END AS y FROM D)",
    "runs AS (SELECT stratum, participant_id, max(l) AS longest FROM (SELECT stratum, participant_id, g, sum(m) AS l FROM (SELECT *, sum(1 - m) OVER (PARTITION BY stratum, participant_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM flagged) GROUP BY ALL) GROUP BY ALL)",
    "own AS (SELECT stratum, participant_id, " + ", ".join(f"coalesce({e}, 0)::DOUBLE AS {c}" for c, e in _SUMS.items()) + " FROM flagged GROUP BY ALL)",
    f"tossed AS (SELECT *, {_weight_sql('participant_id')} AS w FROM own JOIN runs USING (stratum, participant_id), range(1, 101) AS r(b))",
    "summed AS (SELECT stratum, b, max(longest) AS longest, " + ", ".join(f"sum(w * {c}) AS {c}" for c in _SUMS) + " FROM tossed WHERE w > 0 GROUP BY ALL)",
    f"scored AS (SELECT stratum, {_OVERALL} AS overall FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _SCORES.items())} FROM summed))",
)

# adjustment graphs

#: Kinds of events in the order of how often they come before others less how often after; an edge goes down this order, where it is followed at least as often
#: as gone against. So the graph has no cycle, and at most as many edges as there are pairs of kinds.
_EDGES = """steps AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
moves AS (SELECT a, b, count(*) AS n FROM steps WHERE b IS NOT NULL AND a <> b GROUP BY a, b),
leads AS (SELECT k, sum(n) AS score FROM (SELECT a AS k, n FROM moves UNION ALL SELECT b, -n FROM moves) GROUP BY k),
edges AS (SELECT p.a, p.b FROM moves p LEFT JOIN moves q ON q.a = p.b AND q.b = p.a JOIN leads la ON la.k = p.a JOIN leads lb ON lb.k = p.b WHERE p.n >= coalesce(q.n, 0) AND (la.score > lb.score OR la.score = lb.score AND p.a < p.b))"""
_REACH = "reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b)"


def _event_graph(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = views.table(spark, sf, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"))
    moves = cut(steps.filter("b is not null and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    leads = moves.select(F.inline(F.array(F.struct(F.col("a").alias("k"), F.col("n").alias("v")), F.struct(F.col("b").alias("k"), (-F.col("n")).alias("v"))))).groupBy("k").agg(F.sum("v").alias("score"))
    back = moves.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    of = lambda c: leads.select(F.col("k").alias(c), F.struct(-F.col("score"), F.col("k")).alias(f"{c}_at"))
    kept = moves.join(back, ["a", "b"], "left").join(of("a"), "a").join(of("b"), "b").filter((F.col("n") >= F.coalesce("m", F.lit(0))) & (F.col("a_at") < F.col("b_at")))
    return causal.Graph([(r["a"], r["b"]) for r in kept.select("a", "b").collect()])


@query("SELECT b AS node, a AS ancestor, (SELECT coalesce(bool_or(a = b), false) FROM reach) AS has_cycle FROM reach", _EDGES, _REACH, recursive=True)
def graph_ancestors(spark, sf):
    g = _event_graph(spark, sf)
    return spark.createDataFrame([(n, a, g.has_cycle()) for n in g.nodes for a in sorted(g.ancestors(n))], "node string, ancestor string, has_cycle boolean")


@query(
    "SELECT t AS treatment, y AS outcome, coalesce((SELECT string_agg(a, ',' ORDER BY a) FROM reach WHERE b = y AND a IN (SELECT a FROM reach WHERE b = t) AND a NOT IN (SELECT b FROM reach WHERE reach.a = t) AND a NOT IN (t, y)), '') AS adjustment FROM nodes",
    _EDGES, _REACH, "kinds AS (SELECT a AS k FROM edges UNION SELECT b FROM edges), nodes AS (SELECT x.k AS t, z.k AS y FROM kinds x JOIN kinds z ON x.k <> z.k)", recursive=True,
)
def graph_back_door(spark, sf):
    g = _event_graph(spark, sf)
    return spark.createDataFrame([(t, y, ",".join(g.back_door_set(t, y))) for t in g.nodes for y in g.nodes if t != y], "treatment string, outcome string, adjustment string")


# table functions

@query(_SEGMENT_SCAN, D, _SEGMENTS, recursive=True)
def segmentation_in_sql(spark, sf):
    table_functions.register(spark)
    views.daily(spark, sf).createOrReplaceTempView("sigwarden_days")
    return spark.sql("SELECT * FROM change_points(TABLE(sigwarden_days), 'participant_id', 'date', 'resting_hr', 'binary_segmentation')")


# streams

@query("SELECT user_id, count(d) AS n_intervals, count(*) FILTER (abs(d - 30000000) > 20000000) AS n_jitter, count(*) FILTER (d > 90000000) AS n_gaps FROM gaps GROUP BY user_id", _GAPS)
def streaming_jitter(spark, sf):
    return _streamed(spark, sf, "jitter", "update", lambda e: audit.jitter(e, 3e7, jitter_ms=2e7))


@query("""SELECT event_type, start, start + INTERVAL 6 HOURS AS "end", count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - to_hours(k) AS start FROM events, range(0, 6) AS r(k)) GROUP BY ALL""")
def streaming_sliding_rate(spark, sf):
    s = _streamed(spark, sf, "rate", "complete", lambda e: audit.sliding_rate(e))
    return s.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# recordings: a user's values in order as a chest signal of 2 Hz, every other one as the pulse, the state by scores of values

_HZ = (2, 1)
_REC = "rec AS (SELECT user_id, list(value ORDER BY ts, event_id) AS ecg FROM events WHERE value IS NOT NULL GROUP BY user_id)"


def _recordings(spark, sf):
    e = views.table(spark, sf, "events").filter("value is not null").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("chest_ecg"))
    labels = F.transform("chest_ecg", lambda _, i: (F.floor(i / 20) % 5).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("subject_id"), "chest_ecg", F.filter("chest_ecg", lambda _, i: i % 2 == 0).alias("wrist_ppg"), labels.alias("labels"))


@query(
    """SELECT subject_id, (row_number() OVER (ORDER BY subject_id, w0) - 1)::INT AS window_idx, label::INT AS label, CASE label WHEN 1 THEN 'baseline' WHEN 2 THEN 'stress' ELSE 'amusement' END AS label_name, w0 / 2.0::DOUBLE AS start_seconds, (w0 + 10) / 2.0::DOUBLE AS end_seconds,
round(list_sum(ecg), 6) AS ecg_sum, round(list_sum(ppg), 6) AS ppg_sum FROM taken WHERE label = label_end AND label IN (1, 2, 3) AND len(ppg) = 5""",
    _REC,
    """taken AS (SELECT user_id::VARCHAR AS subject_id, w0, ecg[w0 + 1:w0 + 10] AS ecg, list_transform(list_filter(range(0, 5), lambda k: w0 + 2 * k < len(ecg)), lambda k: ecg[w0 + 2 * k + 1]) AS ppg, w0 // 20 % 5 AS label, (w0 + 9) // 20 % 5 AS label_end FROM (SELECT *, unnest(range(0, len(ecg) - 9, 10)) AS w0 FROM rec WHERE len(ecg) >= 10))""",
)
def recording_windows(spark, sf):
    w = recordings.extract_windows(_recordings(spark, sf), chest_hz=_HZ[0], pulse_hz=_HZ[1])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return w.select("subject_id", "window_idx", "label", "label_name", "start_seconds", "end_seconds", total("ecg").alias("ecg_sum"), total("ppg").alias("ppg_sum"))


_ACTIVE = ", ".join(f"round(count(*) FILTER (label = {c}) / 2.0::DOUBLE, 6) AS seconds_{n}" for c, n in recordings.ACTIVITIES.items())


@query(f"SELECT participant_id, count(*) AS n_samples, {_ACTIVE} FROM (SELECT user_id::VARCHAR AS participant_id, (i - 1) // 20 % 5 AS label FROM (SELECT user_id, unnest(range(1, len(ecg) + 1)) AS i FROM rec)) GROUP BY 1", _REC)
def recording_activities(spark, sf):
    return recordings.activity_seconds(_recordings(spark, sf), hz=_HZ[0])


@query("SELECT participant_id, date, round(least(greatest(0.95::DOUBLE * wearable_minutes / 1440 - 0.25::DOUBLE * least(greatest(active_minutes / 240, 0.0), 1.0), 0.0), 1.0), 6) AS quality FROM D", D)
def daily_quality(spark, sf):
    d = views.daily(spark, sf)
    return d.select("participant_id", "date", days.daily_signal_quality(d).alias("quality"))


_FILLED = ", ".join(f"coalesce({f}, (SELECT quantile_cont({f}, 0.5) FROM D), 0.0) AS {f}" for f in models.FEATURES)


@query(
    f"SELECT participant_id, least(count(*), 30)::INT AS n_steps, round(sum(s) FILTER (i <= 30), 6) AS steps_sum, round(avg(r), 6) AS target FROM (SELECT participant_id, row_number() OVER (PARTITION BY participant_id ORDER BY date) AS i, {' + '.join(models.FEATURES)} AS s, reliability_ground_truth AS r FROM (SELECT participant_id, date, reliability_ground_truth, {_FILLED} FROM D)) GROUP BY participant_id",
    D,
)
def sequence_steps(spark, sf):
    seq = models.sequences(views.daily(spark, sf))
    whole = F.aggregate("steps", F.lit(0.0), lambda a, x: a + F.aggregate(x, F.lit(0.0), lambda b, y: b + y))
    return seq.select("participant_id", F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("n_steps"), whole.alias("steps_sum"), "target")


_TRACKED = "tracked AS (SELECT source AS subject, quality AS y, score AS f1, (doc_id % 17)::DOUBLE AS f2, score >= 0.7 AS in_house, toxic = 0 AS published FROM L WHERE quality IS NOT NULL AND score IS NOT NULL AND source IS NOT NULL)"
_MASKED = {"all": "true", "pass_inhouse": "in_house", "pass_orphanidou": "published", "pass_both": "in_house AND published"}
with_sql("loso_classifier", "SELECT subject AS source, n, round(auroc, 6) AS auroc FROM track", L, _TRACKED, p_values.held_out("track", "tracked"))


def _tracked(spark, sf):
    rows = views.scored_labels(spark, sf).withColumns({"noise": F.pmod("doc_id", F.lit(17)).cast("double"), "inhouse_ppg_sqi": F.col("score"), "orphanidou_acceptable": 1 - F.col("toxic")})
    return models.classification_track(rows, ["score", "noise"], "quality", "source")


@query(
    " UNION ALL ".join(f"SELECT '{m}' AS condition, subject AS source, n, round(auroc, 6) AS auroc FROM {m}_track" for m in _MASKED),
    L, _TRACKED, *[f"{m}_rows AS (SELECT * FROM tracked WHERE {on}), {p_values.held_out(f'{m}_track', f'{m}_rows')}" for m, on in _MASKED.items()],
)
def classification_track(spark, sf):
    return _tracked(spark, sf)


@query()
def classification_gains(spark, sf):
    track = cut(_tracked(spark, sf))
    return models.track_summary(track).join(models.paired_deltas(track, "source"), "condition", "left")


with_sql(
    "positivity_check",
    "SELECT 'heat_index' AS treatment, count(*) AS n, round(min(ps), 6) AS ps_min, round(max(ps), 6) AS ps_max, round(avg(ps), 6) AS ps_mean, round(quantile_cont(ps, 0.05), 6) AS ps_p05, round(quantile_cont(ps, 0.95), 6) AS ps_p95, round(avg((ps < 0.05 OR ps > 0.95)::INT), 6) AS outside, "
    "round(pow(sum(w), 2) / sum(w * w), 6) AS effective_n FROM (SELECT ps, CASE WHEN y = 1 THEN 1 / ps ELSE 1 / (1 - ps) END AS w FROM (SELECT y, least(greatest(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 1e-6), 1 - 1e-6) AS ps FROM treated JOIN fitted USING (fold)))",
    D, "treated AS (SELECT 0 AS fold, (heat_index >= median(heat_index) OVER ())::INT AS y, stress_proxy AS x1, active_minutes AS x2 FROM D WHERE heat_index IS NOT NULL AND stress_proxy IS NOT NULL AND active_minutes IS NOT NULL)", p_values.logistic("fitted", "treated"),
)


@query()
def screening_vs_adjusted(spark, sf):
    return causal.screening_vs_adjusted(views.daily(spark, sf), [("heat_index", "hrv_rmssd"), ("stress_proxy", "hrv_rmssd"), ("active_minutes", "resting_hr")], replicates=200)


# service

def _summaries(spark, sf):
    d = views.daily(spark, sf)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(40.0)) + 3e-10, 6)
    return d.groupBy("participant_id", "device_type").agg(
        F.least(F.count(F.lit(1)), F.lit(365)).cast("int").alias("n_days_observed"),
        *[mean(c).alias(f"mean_{c}") for c in ("resting_hr", "hrv_rmssd", "step_count", "sleep_duration", "sleep_efficiency", "heat_index", "active_minutes", "wearable_minutes")],
        F.round(F.avg("missing_wearable_flag") + 3e-10, 6).alias("missing_rate"),
    )


_MEANS = ", ".join(f"round(coalesce(avg({c}), 40.0) + 3e-10::DOUBLE, 6) AS mean_{c}" for c in ("resting_hr", "hrv_rmssd", "step_count", "sleep_duration", "sleep_efficiency", "heat_index", "active_minutes", "wearable_minutes"))
_NOISE = lambda name: _z(0, name, "participant_id", "d")
_SUMMARIES = f"""sums AS (SELECT participant_id, device_type, least(count(*), 365) AS n_days_observed, {_MEANS}, round(avg(missing_wearable_flag) + 3e-10::DOUBLE, 6) AS missing_rate FROM D GROUP BY ALL),
sd AS (SELECT *, DATE '2025-01-01' + d AS date, ({_u(0, 'missing', 'participant_id', 'd')} < missing_rate)::INT AS missing_wearable_flag, greatest(0.0::DOUBLE, mean_active_minutes + 8 * {_NOISE('active')}) AS active_minutes FROM (SELECT *, unnest(range(greatest(n_days_observed, 7)))::INT AS d FROM sums)),
SD AS (SELECT participant_id, date, device_type, missing_wearable_flag, active_minutes, NULL::DOUBLE AS signal_quality_ground_truth, mean_resting_hr + 2.5::DOUBLE * {_NOISE('hr')} AS resting_hr, greatest(1.0::DOUBLE, mean_hrv_rmssd + 6 * {_NOISE('hrv')}) AS hrv_rmssd, mean_heat_index + 2 * {_NOISE('heat')} AS heat_index,
  CASE WHEN missing_wearable_flag = 1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, mean_wearable_minutes + 120 * {_NOISE('wear')}) END AS wearable_minutes, least(1.0::DOUBLE, 0.15::DOUBLE + 0.5::DOUBLE * active_minutes / 240 + 0.4::DOUBLE * missing_wearable_flag) AS artifact_burden_ground_truth FROM sd)""".replace("SD AS", "DAYS AS")
_SERVED = _trust_sql("participant_id", "DAYS", "(SELECT avg(resting_hr) FROM DAYS)")


@query(
    f"SELECT participant_id, n_days, {_ROUND}, overall, category, (coalesce(overall < 40, false)::INT + (missing_rate > 0.3)::INT + coalesce(signal_quality_score < 50, false)::INT) AS n_warnings FROM labelled JOIN sums USING (participant_id)",
    D, _SUMMARIES, _SERVED,
)
def service_scores(spark, sf):
    return service.score_summaries(_summaries(spark, sf)).withColumn("n_warnings", F.size("warnings")).select("participant_id", "n_days", *trust.COMPONENTS, "overall", "category", "n_warnings")


# daily operators

@query(
    "SELECT participant_id, date, round(wearable_minutes / 1440, 6) AS wear_coverage, round(greatest(0.0, heat_index - 26), 6) AS heat_load, " + ", ".join(f"CASE WHEN count({c}) OVER w >= 2 THEN round(avg({c}) OVER w, 6) END AS {c}_roll7_mean" for c in days.ROLLING) + " FROM D WINDOW w AS (PARTITION BY participant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    D,
)
def preprocessed(spark, sf):
    return days.preprocess(views.daily(spark, sf)).select("participant_id", "date", "wear_coverage", "heat_load", *[f"{c}_roll7_mean" for c in days.ROLLING])


_RANGED = {c: r for c, r in days.PHYSIOLOGICAL_RANGES.items()}


@query(
    "SELECT count(*) AS n_rows, 'absent' AS missing_columns, " + " + ".join(f"count(*) FILTER ({c} < {lo} OR {c} > {hi})" for c, (lo, hi) in _RANGED.items()) + " AS n_out_of_range, false AS ok FROM D",
    D,
)
def validation_result(spark, sf):
    r = days.validate(views.daily(spark, sf), required=(*days.REQUIRED_COLUMNS, "absent"))
    return spark.createDataFrame([(r.n_rows, ",".join(r.missing_columns), sum(r.out_of_range.values()), r.ok)], "n_rows long, missing_columns string, n_out_of_range long, ok boolean")


@query("SELECT true AS ready_for_audit, '' AS missing_columns UNION ALL SELECT false, 'heat_index,stress_proxy'")
def real_schema(spark, sf):
    d = views.daily(spark, sf)
    found = [days.check_real_schema(d), days.check_real_schema(d.drop("heat_index", "stress_proxy"), (*days.REAL_COLUMNS, "heat_index", "stress_proxy"))]
    return spark.createDataFrame([(x["ready_for_audit"], ",".join(x["missing_columns"])) for x in found], "ready_for_audit boolean, missing_columns string")


def _export(spark, sf, adapter):
    inverse = {v: k for k, v in adapter.renames.items()}
    d = views.daily(spark, sf)
    return d.select(*[F.col(c).alias(inverse.get(c, c)) for c in d.columns if c in inverse or c in adapters.REQUIRED_COLUMNS])


_KEPT = " AND ".join(f"NOT coalesce({c} NOT BETWEEN {lo} AND {hi}, false)" for c, (lo, hi) in _RANGED.items())


@query(f"SELECT participant_id, date, device_type, resting_hr, hrv_rmssd, step_count, wearable_minutes FROM D WHERE {_KEPT}", D)
def adapt_empatica_like(spark, sf):
    return adapters.adapt(_export(spark, sf, adapters.EMPATICA_LIKE), adapters.EMPATICA_LIKE).select("participant_id", "date", "device_type", "resting_hr", "hrv_rmssd", "step_count", "wearable_minutes")


@query(
    f"SELECT 'rows_in' AS item, count(*) AS n FROM D UNION ALL SELECT 'rows_out', count(*) FILTER ({_KEPT}) FROM D UNION ALL SELECT 'rows_dropped', count(*) FILTER (NOT ({_KEPT})) FROM D UNION ALL SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}_out_of_range' AS item, count(*) FILTER (coalesce({c} NOT BETWEEN {lo} AND {hi}, false)) AS n FROM D" for c, (lo, hi) in _RANGED.items()) + ") WHERE n > 0",
    D,
)
def adapter_report(spark, sf):
    _, r = adapters.adapt_with_report(_export(spark, sf, adapters.GENERIC), adapters.GENERIC)
    return spark.createDataFrame([("rows_in", r.rows_in), ("rows_out", r.rows_out), ("rows_dropped", r.rows_dropped), *r.dropped_reason_counts.items()], "item string, n long")


@query("SELECT count(*) AS n, count(*) FILTER (own >= 0.7) AS n_inhouse, count(*) FILTER (r1 = 1) AS n_orphanidou, count(*) FILTER (own >= 0.7 AND r1 = 1) AS n_both FROM R", R)
def audit_masks(spark, sf):
    m = models.add_audit_masks(views.raters(spark, sf).withColumnsRenamed({"own": "inhouse_ppg_sqi", "r1": "orphanidou_acceptable"}))
    return m.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"pass_{x}").alias(f"n_{x}") for x in ("inhouse", "orphanidou", "both")])


@query(
    f"""SELECT condition, subject_id, count(*) AS n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho FROM (SELECT *, {_rank('template', '', 'condition, subject_id')} AS a, {_rank('own', '', 'condition, subject_id')} AS b FROM (
SELECT 'all' AS condition, * FROM M UNION ALL SELECT 'pass_inhouse', * FROM M WHERE own >= 0.7 UNION ALL SELECT 'pass_orphanidou', * FROM M WHERE r1 = 1 UNION ALL SELECT 'pass_both', * FROM M WHERE own >= 0.7 AND r1 = 1)) GROUP BY ALL HAVING count(*) >= 30""",
    R, "M AS (SELECT l_linenumber AS subject_id, own, r1, template FROM R)",
)
def biomarker_track(spark, sf):
    r = views.raters(spark, sf).select(F.col("l_linenumber").alias("subject_id"), F.col("own").alias("inhouse_ppg_sqi"), F.col("r1").alias("orphanidou_acceptable"), "template")
    return models.biomarker_track(r, "template", "inhouse_ppg_sqi")


# figures

_FIRST = "(SELECT min(participant_id) FROM D)"


@query(f"SELECT component, round(score, 6) AS score FROM (SELECT * FROM labelled WHERE participant_id = {_FIRST}) UNPIVOT INCLUDE NULLS (score FOR component IN ({', '.join(trust.COMPONENTS)}))", D, _COHORT)
def figure_trust_radar(spark, sf):
    d = views.daily(spark, sf)
    return figures.trust_radar(trust.cohort_scores(d), d.agg(F.min("participant_id")).first()[0])


@query("SELECT participant_id, date::VARCHAR AS day, round(avg(reliability_ground_truth), 6) AS value FROM D WHERE participant_id IN (SELECT DISTINCT participant_id FROM D ORDER BY 1 LIMIT 60) GROUP BY 1, 2", D)
def figure_reliability_heatmap(spark, sf):
    return figures.reliability_heatmap(views.daily(spark, sf)).unpivot(["participant_id"], None, "day", "value").filter("value is not null")


@query("SELECT round(regr_slope(hrv_rmssd, heat_index), 6) AS slope, round(regr_intercept(hrv_rmssd, heat_index), 6) AS intercept, count(*) FILTER (hrv_rmssd IS NOT NULL AND heat_index IS NOT NULL) AS n, least(3000, count(*) FILTER (hrv_rmssd IS NOT NULL AND heat_index IS NOT NULL)) AS n_points FROM D", D)
def figure_confounding_scatter(spark, sf):
    points, line = figures.confounding_scatter(views.daily(spark, sf), "heat_index", "hrv_rmssd")
    return line.withColumn("n_points", F.lit(points.count()).cast("long"))


@query(
    """SELECT bin, round(lo + bin * (hi - lo) / 30, 6) AS start, count(*) AS n FROM (SELECT coalesce(least(floor((overall - lo) / nullif((hi - lo) / 30, 0)), 29), 0)::INT AS bin, lo, hi FROM labelled, (SELECT min(overall) AS lo, max(overall) AS hi FROM labelled) WHERE overall IS NOT NULL) GROUP BY bin, lo, hi""",
    D, _COHORT,
)
def figure_trust_distribution(spark, sf):
    return figures.trust_distribution(trust.cohort_scores(views.daily(spark, sf)))


@query("SELECT 'signal' AS signal, (i - 1)::INT AS sample, round(signal[i], 6) AS value FROM (SELECT signal, unnest(range(1, len(signal) + 1)) AS i FROM W WHERE window_idx = 0)", W)
def figure_signal_example(spark, sf):
    return figures.signal_example(views.windows(spark, sf), 0, ("signal",))


@query("SELECT stratum, overall FROM labelled WHERE n_days >= 10", D, f"Q AS ({Q_OF})", _STRATA)
def figure_fairness_forest(spark, sf):
    return figures.fairness_forest(fairness.fairness_audit(views.daily(spark, sf), "skin_tone_proxy"))


@query("SELECT r2 AS state, round((template + amplitude_cv) / 2, 6) AS mean, round(amplitude_cv - template, 6) AS difference FROM R", R)
def figure_bland_altman(spark, sf):
    return figures.bland_altman_points(views.raters(spark, sf), "template", "amplitude_cv", "r2")


@query("SELECT r2 AS state, round(template, 6) AS x, round(amplitude_cv, 6) AS y FROM R", R)
def figure_rate_scatter(spark, sf):
    return figures.rate_scatter(views.raters(spark, sf), "template", "amplitude_cv", "r2")


_METHODS = {"own": "inhouse_ppg_sqi", "r1": "orphanidou_acceptable", "r2": "sukor_acceptable", "r3": "elgendi_acceptable", "template": "inhouse_ppg_motion", "amplitude_cv": "hr_abs_diff"}


@query("SELECT 'in_house' AS method, round(avg((own >= 0.7)::INT), 6) AS pass_rate FROM R UNION ALL SELECT 'orphanidou', round(avg(r1), 6) FROM R UNION ALL SELECT 'sukor', round(avg(r2), 6) FROM R UNION ALL SELECT 'elgendi', round(avg(r3), 6) FROM R", R)
def figure_pass_rates(spark, sf):
    return figures.pass_rates(views.raters(spark, sf).withColumnsRenamed(_METHODS))


@query("SELECT brand AS state, metric, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, count(*) AS n FROM (SELECT brand, paid, listed FROM B) UNPIVOT (v FOR metric IN (paid, listed)) GROUP BY 1, 2", B)
def figure_state_boxes(spark, sf):
    q = figures.per_state_boxes(views.prices(spark, sf), ["paid", "listed"], "brand")
    return q.select(F.col("brand").alias("state"), "metric", *[F.get("quantiles", F.lit(i)).alias(c) for i, c in ((0, "p05"), (2, "p50"), (4, "p95"))], "n")


@query("SELECT round(template, 6) AS motion, round(amplitude_cv, 6) AS error FROM R", R)
def figure_motion_scatter(spark, sf):
    return figures.motion_scatter(views.raters(spark, sf).withColumnsRenamed(_METHODS))


_CURVE = ", ".join(repr(0.1 + i * 0.89 / 89) for i in range(90))


@query(
    "SELECT round(threshold, 6) AS threshold, round(CASE WHEN pe < 1 - 1e-9 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT *, (tp + tn) / n AS po, (tp + fp) / n * ((tp + fn) / n) + (1 - (tp + fp) / n) * (1 - (tp + fn) / n) AS pe FROM (SELECT threshold, count(*) AS n, count(*) FILTER (score >= threshold AND quality = 1)::DOUBLE AS tp, "
    "count(*) FILTER (score >= threshold AND quality = 0)::DOUBLE AS fp, count(*) FILTER (score < threshold AND quality = 1)::DOUBLE AS fn, count(*) FILTER (score < threshold AND quality = 0)::DOUBLE AS tn FROM L, grid GROUP BY threshold))",
    L, f"grid AS (SELECT unnest([{_CURVE}]::DOUBLE[]) AS threshold)",
)
def figure_recalibration_curve(spark, sf):
    return figures.recalibration_curve(views.scored_labels(spark, sf), "score", "quality")


@query(f"SELECT participant_id, date, round(signal_quality_ground_truth, 6) AS quality FROM D WHERE participant_id = {_FIRST}", D)
def page_signal_quality(spark, sf):
    d = views.daily(spark, sf)
    return figures.participant_page(d, d.agg(F.min("participant_id")).first()[0]).select("participant_id", "date", F.col("signal_quality_ground_truth").alias("quality"))


@query("SELECT count(*) FILTER (artifact_burden_ground_truth > 0.5) AS n_over, count(*) AS n, round(avg((artifact_burden_ground_truth > 0.5)::INT), 6) AS share FROM D", D)
def page_artifacts(spark, sf):
    return figures.artifact_page(views.daily(spark, sf))


_DIFF = lambda c: f"round(avg({c}) - (SELECT avg({c}) FROM D WHERE device_type = (SELECT min(device_type) FROM D)), 6) AS {c}"


@query(f"SELECT device_type AS device, {_DIFF('hrv_rmssd')}, {_DIFF('resting_hr')} FROM D GROUP BY device_type", D)
def page_device_bias(spark, sf):
    from ..operators import confounding

    return figures.device_bias_page(confounding.device_bias(views.daily(spark, sf), ("resting_hr", "hrv_rmssd")))


@query(
    f"SELECT 'artifact_page' AS name, 1::BIGINT AS n_rows UNION ALL SELECT 'bland_altman', count(*) FROM B UNION ALL SELECT 'participant_page', count(*) FROM D WHERE participant_id = {_FIRST} UNION ALL SELECT 'pass_rates', 4",
    B, D,
)
def figures_written(spark, sf):
    """Writes a set of figures' data and reads back how many rows each has."""
    d = views.daily(spark, sf)
    drawn = {
        "bland_altman": figures.bland_altman_points(views.prices(spark, sf), "paid", "listed", "brand"), "pass_rates": figures.pass_rates(views.raters(spark, sf).withColumnsRenamed(_METHODS)),
        "participant_page": figures.participant_page(d, d.agg(F.min("participant_id")).first()[0]), "artifact_page": figures.artifact_page(d),
    }
    paths = figures.write_all(drawn, f"{checkpoint_folder(spark)}/figures-{uuid.uuid4().hex}")
    return spark.createDataFrame([(n, spark.read.json(p).count()) for n, p in paths.items()], "name string, n_rows long")


# report

@query(
    "SELECT (SELECT count(DISTINCT participant_id) FROM D) || ' participants, ' || (SELECT count(*) FROM D) || ' days. Mean trust score ' || printf('%.1f', avg(overall)) || '; ' || count(*) FILTER (overall < 60) || ' participants below 60.' AS headline FROM labelled",
    D, _COHORT,
)
def report_headline(spark, sf):
    d = views.daily(spark, sf)
    return spark.createDataFrame([(report.headline(d, trust.cohort_scores(d)),)], "headline string")


_RULES = (("(SELECT avg(missing_wearable_flag) FROM D) > 0.2", "Look into non-wear: over a fifth of the days are missing."), ("(SELECT avg((artifact_burden_ground_truth > 0.5)::INT) FROM D) > 0.2", "Clean the signals: over a fifth of the days carry heavy artifacts."), ("(SELECT avg((overall < 60)::INT) FROM labelled) > 0.25", "Leave participants of low trust out of the main analysis."))


@query(" UNION ALL ".join(f"SELECT '- {t}' AS line WHERE {c}" for c, t in _RULES) + " UNION ALL SELECT '- No rate is over its limit.' WHERE NOT (" + " OR ".join(f"coalesce({c}, false)" for c, _ in _RULES) + ")", D, _COHORT)
def report_recommendations(spark, sf):
    d = views.daily(spark, sf)
    return spark.createDataFrame([(x,) for x in report.recommendations(d, trust.cohort_scores(d)).split("\n")], "line string")


@query(
    "SELECT round(quantile_cont(rate, 0.5), 6) AS median_rate, max(longest)::BIGINT AS longest_run FROM (SELECT participant_id, sum(l) / sum(n) AS rate, max(l) AS longest FROM (SELECT participant_id, g, count(*) AS n, sum(m) AS l FROM (SELECT participant_id, m, sum(1 - m) OVER (PARTITION BY participant_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, missing_wearable_flag AS m FROM D)) GROUP BY ALL) GROUP BY participant_id)",
    D,
)
def report_missingness(spark, sf):
    return report.missingness_figures(views.daily(spark, sf))


@query(
    """SELECT participant_id, round(mean_variation, 6) AS mean_variation, round(slope, 6) AS slope FROM (SELECT participant_id, avg(variation) AS mean_variation FROM (SELECT participant_id, CASE WHEN count(resting_hr) OVER w = 7 THEN stddev_samp(resting_hr) OVER w / (avg(resting_hr) OVER w + 1e-9) END AS variation
FROM D WINDOW w AS (PARTITION BY participant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) GROUP BY 1) LEFT JOIN (SELECT participant_id, CASE WHEN count(*) >= 5 AND stddev_pop(y) >= 1e-9 THEN regr_slope(y, i) END AS slope
FROM (SELECT participant_id, resting_hr AS y, row_number() OVER (PARTITION BY participant_id ORDER BY date) - 1 AS i FROM D WHERE resting_hr IS NOT NULL) GROUP BY 1) USING (participant_id)""",
    D,
)
def stability_table(spark, sf):
    return reliability.participant_stability(views.daily(spark, sf), "resting_hr").drop("p_value")
