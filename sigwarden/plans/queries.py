"""Registered queries of the audit operators, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions.stats import NUDGE, kappa, rank_sums, rounded, spearman
from ..operators import agreement, artifacts, causal, confounding, daily as days, effects, fairness, models, reliability, trust
from ..session import checkpoint_folder
from ..sources import adapters, synthetic
from ..streaming import audit
from . import views
from .window_sql import window_table_sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _nudged(sql: str) -> str:
    """``round(x, 6)`` with the nudge that reported results have."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(sql[j], 0)
            comma = j if sql[j] == "," and depth == 1 else comma
            j += 1
        inner, digits = _nudged(sql[i + 6 : comma]), sql[comma + 1 : j - 1].strip()
        out += sql[at:i] + (f"round(({inner}) + {NUDGE}::DOUBLE, 6)" if digits == "6" else f"round({inner}, {digits})")
        at = j
    return out + sql[at:]


def query(sql: str | None = None, *with_: str, recursive: bool = False):
    """Registers a function under its name; results are rounded to 6 digits, as ``sql`` must."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(with_)}\n" if with_ else "") + _nudged(sql)
        return f

    return add


def with_sql(name: str, sql: str, *with_: str, recursive: bool = False) -> None:
    """Gives a query that is registered already its SQL."""
    if name not in _QUERIES or name in _SQL:
        raise ValueError(f"{name} is not registered or has its SQL")
    _SQL[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(with_)}\n" if with_ else "") + _nudged(sql)


D, L, R, W, S, B = _nudged(views.DAILY_SQL), views.LABELS_SQL, views.RATERS_SQL, views.WINDOWS_SQL, views.SERIES_SQL, views.PRICES_SQL


def _clip(e: str, lo: str = "0.0", hi: str = "100.0") -> str:
    return f"CASE WHEN ({e}) IS NOT NULL THEN least(greatest(({e}), {lo}), {hi}) END"


def _corr(x: str, y: str, least: int = 2, flat: str = "1e-6") -> str:
    on = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"CASE WHEN count(*) {on} >= {least} AND stddev_pop({x}) {on} > {flat} AND stddev_pop({y}) {on} > {flat} THEN covar_pop({x}, {y}) / (stddev_pop({x}) {on} * stddev_pop({y}) {on}) END"


# trust score

_COMPONENTS_SQL = """
runs AS (SELECT *, sum(1 - m) OVER (PARTITION BY {key} ORDER BY date, participant_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, coalesce((missing_wearable_flag = 1)::INT, 0) AS m FROM {source})),
longest AS (SELECT {key}, max(l) AS longest FROM (SELECT {key}, g, sum(m) AS l FROM runs GROUP BY ALL) GROUP BY {key}),
agg AS (SELECT {key}, count(*) AS n_days, avg(signal_quality_ground_truth) AS quality, avg(coalesce(wearable_minutes, 0) / 1440) AS wear, avg(artifact_burden_ground_truth) AS burden,
  count(hrv_rmssd) AS n_hrv, avg(hrv_rmssd) AS hm, stddev_pop(hrv_rmssd) AS hs, avg(m) AS rate, count(DISTINCT device_type) AS nd, avg(resting_hr) AS hr,
  count(*) FILTER (heat_index IS NOT NULL AND hrv_rmssd IS NOT NULL) AS np, """ + _corr("heat_index", "hrv_rmssd", 5) + """ AS r FROM runs GROUP BY {key}),
comp AS (SELECT {key}, n_days,
  """ + _clip("100 * coalesce(quality, wear)") + """ AS signal_quality_score,
  """ + _clip("100 * (1 - burden)") + """ AS artifact_burden_score,
  CASE WHEN n_hrv >= 5 THEN CASE WHEN hm <= 0 THEN 0.0 ELSE 100 * (1 - least(hs / hm, 1.0)) END END AS temporal_stability_score,
  """ + _clip("100 * (1 - 0.7 * rate - 0.3 * least(longest / 7, 1.0))") + """ AS missingness_risk_score,
  CASE WHEN nd <= 1 THEN 100.0 ELSE 100 * (1 - least(abs(hr - {cohort}) / 10, 1.0)) END AS device_bias_score,
  CASE WHEN np >= 5 THEN 100 * (1 - abs(coalesce(r, 0.0))) END AS confounding_risk_score
  FROM agg JOIN longest USING ({key})),
scored AS (SELECT *, CASE WHEN {there} >= 3 THEN round(({total}) / nullif({weight}, 0), 2) END AS overall FROM comp),
labelled AS (SELECT *, CASE WHEN overall IS NULL THEN 'insufficient_data' WHEN overall >= 80 THEN 'high' WHEN overall >= 60 THEN 'moderate' WHEN overall >= 40 THEN 'low' ELSE 'unreliable' END AS category FROM scored)"""


def _trust_sql(key: str, source: str, cohort: str) -> str:
    c = trust.WEIGHTS
    return _COMPONENTS_SQL.format(
        key=key, source=source, cohort=cohort, there=" + ".join(f"({n} IS NOT NULL)::INT" for n in c), total=" + ".join(f"coalesce({n} * {w}::DOUBLE, 0.0)" for n, w in c.items()),
        weight=" + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0 END" for n, w in c.items()),
    )


_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in trust.COMPONENTS)
_COHORT = _trust_sql("participant_id", "D", "(SELECT avg(resting_hr) FROM D)")


@query(f"SELECT participant_id, n_days, {_ROUND}, overall, category FROM labelled", D, _COHORT)
def trust_score(spark, sf):
    return trust.cohort_scores(views.daily(spark, sf)).drop("explanation")


_NAMES = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {{{{'v': {c}, 'at': {{sign}}{i}, 'name': '{c.removesuffix('_score')}'}}}} END" for i, c in enumerate(trust.COMPONENTS))


@query(
    f"""SELECT participant_id, CASE WHEN overall IS NULL THEN participant_id || ': too few components for a score' ELSE participant_id || ': trust ' || category || ', strongest ' || hi.name || ' ' || printf('%.1f', hi.v) || ', weakest ' || lo.name || ' ' || printf('%.1f', lo.v) END AS explanation
FROM (SELECT *, list_max(list_filter([{_NAMES.format(sign='-')}], lambda x: x IS NOT NULL)) AS hi, list_min(list_filter([{_NAMES.format(sign='')}], lambda x: x IS NOT NULL)) AS lo FROM labelled)""",
    D, _COHORT,
)
def trust_explain(spark, sf):
    return trust.cohort_scores(views.daily(spark, sf)).select("participant_id", "explanation")


_OWN = {"signal_quality_score": 3.0, "artifact_burden_score": 1.0, "temporal_stability_score": 2.0, "missingness_risk_score": 1.0, "device_bias_score": 1.0, "confounding_risk_score": 2.0}


@query(f"SELECT participant_id, round({' + '.join(f'{c} * ({w} / 10.0::DOUBLE)' for c, w in _OWN.items())}, 6) AS overall FROM comp", D, _COHORT)
def trust_custom_weights(spark, sf):
    scores = trust.component_scores(views.daily(spark, sf), "participant_id")
    return scores.select("participant_id", trust.overall_from_components(_OWN).alias("overall"))


# validation and adapters


@query(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {str(there).lower()} AS present, count(*) AS n_rows, {f'count({c})' if there else '0::BIGINT'} AS n_values, {f'count(*) FILTER ({c} < {lo} OR {c} > {hi})' if there and rng else '0::BIGINT'} AS n_out_of_range FROM D"
        for c in dict.fromkeys([*days.REQUIRED_COLUMNS, *days.PHYSIOLOGICAL_RANGES, "absent"])
        for there in (c != "absent",)
        for rng in (days.PHYSIOLOGICAL_RANGES.get(c),)
        for lo, hi in (rng or (0, 0),)
    ),
    D,
)
def validate_ranges(spark, sf):
    return days.validation_report(views.daily(spark, sf), required=(*days.REQUIRED_COLUMNS, "absent"))


@query(
    """SELECT column_name, n_out_of_range FROM (SELECT count(*) FILTER (l_discount > 0.07) AS l_discount, count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS l_quantity, count(*) FILTER (l_tax > 0.08) AS l_tax FROM lineitem)
UNPIVOT (n_out_of_range FOR column_name IN (l_discount, l_quantity, l_tax))"""
)
def validate_lineitem(spark, sf):
    ranges = {"l_discount": (0, 0.07), "l_quantity": (5, 45), "l_tax": (0, 0.08)}
    return days.validation_report(views.table(spark, sf, "lineitem"), ranges, []).select("column_name", "n_out_of_range")


def _foreign(spark, sf):
    """The daily frame as a foreign export in US units."""
    d = views.daily(spark, sf)
    inverse = {v: k for k, v in adapters.FITBIT_LIKE.renames.items()}
    d = d.withColumns({"sleep_duration": F.round(F.col("sleep_duration") * 60, 6), "sleep_efficiency": F.round(F.col("sleep_efficiency") * 100, 6), "temperature_c": F.round(F.col("temperature_c") * 9 / 5 + 32, 6)})
    return d.select(*[F.col(c).alias(inverse[c]) for c in d.columns if c in inverse], F.lit(0.0).alias("aqi"))


@query(
    """SELECT participant_id, date, device_type, round(sleep_duration, 6) AS sleep_duration, round(sleep_efficiency, 6) AS sleep_efficiency, round(temperature_c, 6) AS temperature_c, round(CASE WHEN humidity > 1.5 THEN humidity / 100 ELSE humidity END, 6) AS humidity, aqi, NULL::DOUBLE AS stress_proxy
FROM (SELECT *, CASE WHEN e > 1.5 THEN e / 100 ELSE e END AS se FROM (SELECT *, round(sleep_efficiency * 100, 6) AS e FROM D))
WHERE NOT coalesce(resting_hr NOT BETWEEN 30 AND 130, false) AND NOT coalesce(hrv_rmssd NOT BETWEEN 0 AND 250, false) AND NOT coalesce(hrv_sdnn NOT BETWEEN 0 AND 300, false) AND NOT coalesce(step_count NOT BETWEEN 0 AND 60000, false)
  AND NOT coalesce(active_minutes NOT BETWEEN 0 AND 480, false) AND NOT coalesce(sleep_duration NOT BETWEEN 0 AND 14, false) AND NOT coalesce(se NOT BETWEEN 0 AND 1, false) AND NOT coalesce(aqi NOT BETWEEN 0 AND 500, false)""",
    D,
)
def adapt_fitbit_like(spark, sf):
    return adapters.adapt(_foreign(spark, sf), adapters.FITBIT_LIKE).select("participant_id", "date", "device_type", "sleep_duration", "sleep_efficiency", "temperature_c", "humidity", "aqi", "stress_proxy")


# daily operators


@query(
    """SELECT participant_id, date, round(wearable_minutes / 1440, 6) AS wear_coverage, round(active_minutes / 240, 6) AS motion_proxy, round(greatest(0.0, heat_index - 26), 6) AS heat_load, round(greatest(0.0, 7 - sleep_duration), 6) AS sleep_deficit,
  round(least(greatest(0.95 * (wearable_minutes / 1440) - 0.25 * least(greatest(active_minutes / 240, 0.0), 1.0), 0.0), 1.0), 6) AS signal_quality FROM D""",
    D,
)
def derived_columns(spark, sf):
    d = views.daily(spark, sf)
    return days.add_derived_columns(d).withColumn("signal_quality", days.daily_signal_quality(d)).select("participant_id", "date", "wear_coverage", "motion_proxy", "heat_load", "sleep_deficit", "signal_quality")


@query(
    """SELECT participant_id, date, CASE WHEN count(hrv_rmssd) OVER w >= 2 THEN round(avg(hrv_rmssd) OVER w, 6) END AS hrv_rmssd_roll7_mean, CASE WHEN count(hrv_rmssd) OVER w >= 2 THEN round(stddev_samp(hrv_rmssd) OVER w, 6) END AS hrv_rmssd_roll7_std
FROM D WINDOW w AS (PARTITION BY participant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    D,
)
def rolling_features(spark, sf):
    return days.add_rolling_features(views.daily(spark, sf), ["hrv_rmssd"]).select("participant_id", "date", "hrv_rmssd_roll7_mean", "hrv_rmssd_roll7_std")


@query(
    """SELECT participant_id, round(CASE WHEN count(step_count) >= 3 AND avg(step_count) >= 1 THEN least(greatest(1 - stddev_pop(step_count) / (avg(step_count) + 1e-6), 0.0), 1.0) END, 6) AS step_consistency, round(avg((active_minutes > 120)::INT), 6) AS activity_artifact_risk,
  round(CASE WHEN count(active_minutes) >= 3 THEN least(greatest(1 - stddev_pop(active_minutes) / 60, 0.0), 1.0) END, 6) AS active_minute_reliability FROM D GROUP BY participant_id""",
    D,
)
def activity_summary(spark, sf):
    return days.activity_summary(views.daily(spark, sf))


@query(
    """SELECT participant_id, round(CASE WHEN count(sleep_duration) >= 3 THEN least(greatest(1 - stddev_pop(sleep_duration) / 4, 0.0), 1.0) END, 6) AS sleep_regularity,
  round(CASE WHEN count(sleep_efficiency) >= 3 THEN least(greatest(1 - 2 * stddev_pop(sleep_efficiency), 0.0), 1.0) END, 6) AS sleep_efficiency_reliability, round(avg(abs(sleep_duration - 7.5)), 6) AS sleep_duration_deviation FROM D GROUP BY participant_id""",
    D,
)
def sleep_summary(spark, sf):
    return days.sleep_summary(views.daily(spark, sf))


@query(
    """SELECT participant_id, round(sum(l) / sum(n), 6) AS missing_rate, max(l)::BIGINT AS max_run, round(coalesce(avg(l) FILTER (l > 0), 0.0), 6) AS mean_run, count(*) FILTER (l > 0) AS n_episodes
FROM (SELECT participant_id, g, count(*) AS n, sum(m) AS l FROM (SELECT participant_id, m, sum(1 - m) OVER (PARTITION BY participant_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, missing_wearable_flag AS m FROM D)) GROUP BY ALL) GROUP BY participant_id""",
    D,
)
def missingness_runs(spark, sf):
    return days.missingness_summary(views.daily(spark, sf))


@query(
    "\nUNION ALL ".join(f"SELECT '{s}' AS state, round({_corr('missing_wearable_flag', s)}, 6) AS r FROM D" for s in ("stress_proxy", "sleep_efficiency", "heat_index")),
    D,
)
def state_dependent_missingness(spark, sf):
    return days.state_dependent_missingness(views.daily(spark, sf))


# confounding and devices

_PAIRS_SQL = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS exposure, '{y}' AS outcome, round({_corr(x, y, 5)}, 6) AS r, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n FROM D" for x, y in confounding.PAIRS) + ") WHERE r IS NOT NULL"


@query(_PAIRS_SQL, D)
def correlation_table(spark, sf):
    return confounding.correlation_table(views.daily(spark, sf))


@query(_PAIRS_SQL + " ORDER BY abs(r) DESC, exposure, outcome LIMIT 1", D)
def top_confounder(spark, sf):
    return confounding.top_confounder(views.daily(spark, sf))


_ENTITY = f"SELECT participant_id, count(*) FILTER (heat_index IS NOT NULL AND sleep_efficiency IS NOT NULL) AS n, {_corr('heat_index', 'sleep_efficiency', 7)} AS r, avg(heat_index) FILTER (sleep_efficiency IS NOT NULL) AS mh, avg(sleep_efficiency) FILTER (heat_index IS NOT NULL) AS ms FROM D GROUP BY participant_id"


@query(f"SELECT participant_id, n, round(r, 6) AS r, round(mh, 6) AS mean_heat_index, round(ms, 6) AS mean_sleep_efficiency FROM ({_ENTITY}) WHERE r IS NOT NULL", D)
def per_entity_correlation(spark, sf):
    return confounding.per_entity_correlation(views.daily(spark, sf))


@query(f"SELECT round(quantile_cont(r, 0.5), 6) AS median_r, count(*) FILTER (r < -0.2) AS n_strong, count(*) AS n FROM ({_ENTITY}) WHERE r IS NOT NULL", D)
def correlation_summary(spark, sf):
    return confounding.correlation_summary(confounding.per_entity_correlation(views.daily(spark, sf)))


@query(f"SELECT 'activity_vs_quality' AS name, round({_corr('active_minutes', 'signal_quality_ground_truth')}, 6) AS r FROM D UNION ALL SELECT 'wear_vs_reliability', round({_corr('wearable_minutes', 'reliability_ground_truth')}, 6) FROM D", D)
def behavioral_correlations(spark, sf):
    return confounding.behavioral_correlations(views.daily(spark, sf))


_DEVICE = ("resting_hr", "hrv_rmssd", "signal_quality_ground_truth")
_DEVICE_SQL = " UNION ALL ".join(
    f"SELECT device_type AS device, '{c}' AS column_name, avg({c}) AS mean, (SELECT avg({c}) FROM D WHERE device_type = (SELECT min(device_type) FROM D)) AS reference_mean, avg({c}) - (SELECT avg({c}) FROM D WHERE device_type = (SELECT min(device_type) FROM D)) AS difference, count(*) AS n_obs FROM D GROUP BY device_type"
    for c in _DEVICE
)


@query(f"SELECT device, column_name, round(mean, 6) AS mean, round(reference_mean, 6) AS reference_mean, round(difference, 6) AS difference, n_obs FROM ({_DEVICE_SQL})", D)
def device_bias(spark, sf):
    return confounding.device_bias(views.daily(spark, sf), _DEVICE)


@query(f"SELECT round(coalesce(least(greatest(max(abs(difference)) / 10, 0.0), 1.0), 0.0), 6) AS severity FROM ({_DEVICE_SQL})", D)
def bias_severity(spark, sf):
    return confounding.bias_severity(confounding.device_bias(views.daily(spark, sf), _DEVICE))


# reliability

_WEEKS = "weeks AS (SELECT participant_id, wk, avg(value) AS x FROM (SELECT *, floor((date - min(date) OVER (PARTITION BY participant_id)) / 7)::INT AS wk FROM {src}) GROUP BY ALL HAVING avg(value) IS NOT NULL), pairs AS (SELECT participant_id, wk AS week, x, lead(x) OVER (PARTITION BY participant_id ORDER BY wk) AS y, count(*) OVER (PARTITION BY participant_id) AS n FROM weeks)"


@query("SELECT participant_id, week, round(x, 6) AS x, round(y, 6) AS y FROM pairs WHERE n >= 4 AND y IS NOT NULL", S, _WEEKS.format(src="S"))
def week_pairs(spark, sf):
    return reliability.week_pairs(reliability.weekly_means(views.order_series(spark, sf), "value"))


@query(f"SELECT count(*) AS n_pairs, count(DISTINCT participant_id) AS n_participants, round({_corr('x', 'y', 3)}, 6) AS r FROM pairs WHERE n >= 4 AND y IS NOT NULL", S, _WEEKS.format(src="S"))
def week_pair_correlation(spark, sf):
    return reliability.week_pair_correlation(views.order_series(spark, sf), "value")


_HALVES = "ranked AS (SELECT participant_id, value, row_number() OVER (PARTITION BY participant_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY participant_id) AS n FROM S), halves AS (SELECT a.participant_id, a.value AS x, b.value AS y FROM ranked a JOIN ranked b ON a.participant_id = b.participant_id AND b.i = a.i + a.n // 2 WHERE a.n >= 4 AND a.i < a.n // 2)"


@query(f"SELECT participant_id, count(*) AS n_pairs, round({_corr('x', 'y')}, 6) AS r FROM halves GROUP BY participant_id", S, _HALVES)
def split_half(spark, sf):
    return reliability.split_half(views.order_series(spark, sf), "value")


_ICC = """SELECT round(CASE WHEN n >= 2 AND k >= 2 AND den > 0 THEN (msr - mse) / den END, 6) AS icc, n AS n_subjects, k AS n_raters FROM (
SELECT *, msr + (k - 1) * mse + k * (msc - mse) / n AS den FROM (
SELECT *, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS mse FROM (
SELECT count(DISTINCT s) AS n, count(DISTINCT r) AS k, sum((v - g) * (v - g)) AS sst, sum((sm - g) * (sm - g)) AS ssr, sum((rm - g) * (rm - g)) AS ssc
FROM (SELECT *, avg(v) OVER () AS g, avg(v) OVER (PARTITION BY s) AS sm, avg(v) OVER (PARTITION BY r) AS rm FROM rated))))"""


@query(
    _ICC, D,
    "first AS (SELECT participant_id AS s, row_number() OVER (PARTITION BY participant_id ORDER BY date) AS r, resting_hr AS v FROM D), rated AS (SELECT s, r, v FROM (SELECT *, count(v) OVER (PARTITION BY s) AS c FROM first WHERE r <= 7) WHERE c = 7)",
)
def icc_days_as_raters(spark, sf):
    return reliability.icc_of_days(views.daily(spark, sf), "resting_hr")


@query(
    """SELECT participant_id, round(least(greatest(1 - quantile_cont(ch, 0.5), 0.0), 1.0), 6) AS reproducibility FROM (SELECT participant_id, abs(x - lag(x) OVER o) / (abs(lag(x) OVER o) + 1e-6) AS ch FROM weeks WINDOW o AS (PARTITION BY participant_id ORDER BY wk))
WHERE participant_id IN (SELECT participant_id FROM S GROUP BY 1 HAVING count(value) >= 14) GROUP BY participant_id HAVING count(ch) > 0""",
    S, _WEEKS.format(src="S"),
)
def weekly_reproducibility(spark, sf):
    return reliability.weekly_reproducibility(views.order_series(spark, sf), "value")


@query("SELECT participant_id, date, CASE WHEN count(hrv_rmssd) OVER w = 7 THEN round(stddev_samp(hrv_rmssd) OVER w / (avg(hrv_rmssd) OVER w + 1e-9), 6) END AS variation FROM D WINDOW w AS (PARTITION BY participant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", D)
def rolling_variation(spark, sf):
    return reliability.rolling_variation(views.daily(spark, sf), "hrv_rmssd")


@query(
    "SELECT participant_id, count(*) AS n, round(CASE WHEN count(*) >= 5 AND stddev_pop(value) >= 1e-9 THEN regr_slope(value, i) END, 6) AS slope FROM (SELECT participant_id, value, row_number() OVER (PARTITION BY participant_id ORDER BY date) - 1 AS i FROM S) GROUP BY participant_id",
    S,
)
def drift_slope(spark, sf):
    return reliability.drift(views.order_series(spark, sf), "value").drop("t")


@query()
def participant_stability(spark, sf):
    return reliability.participant_stability(views.daily(spark, sf), "resting_hr")


@query()
def test_retest_bootstrap(spark, sf):
    return reliability.cohort_test_retest_table(views.order_series(spark, sf), ["value"])


_SPLITS = """v AS (SELECT participant_id, resting_hr AS x, row_number() OVER o AS i, count(*) OVER (PARTITION BY participant_id) AS n, sum(resting_hr) OVER (PARTITION BY participant_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS s, sum(resting_hr) OVER (PARTITION BY participant_id) AS t FROM D WINDOW o AS (PARTITION BY participant_id ORDER BY date)),
g AS (SELECT participant_id, i, round(s * s / i + (t - s) * (t - s) / (n - i) - t * t / n, 6) AS gain FROM v WHERE n >= 5 AND i >= 2 AND i < n - 2)"""


@query("SELECT participant_id, arg_max(i, {'g': gain, 'i': -i}) AS split, max(gain) AS gain FROM g GROUP BY participant_id", D, _SPLITS)
def single_change_point(spark, sf):
    """One level of binary segmentation: the best split of each series by the kernel that the scans use."""
    return arrow.best_splits(views.daily(spark, sf), "resting_hr")


@query()
def binary_segmentation_scan(spark, sf):
    return arrow.scan_changes(views.daily(spark, sf), "resting_hr")


@query()
def bocpd_scan(spark, sf):
    return arrow.scan_changes(views.daily(spark, sf), "resting_hr", method="bocpd")


@query(
    """SELECT participant_id, idx AS index, n_before, n_after, round(mb, 6) AS mean_before, round(ma, 6) AS mean_after, round(sb, 6) AS std_before, round(sa, 6) AS std_after, round(ma - mb, 6) AS delta FROM (
SELECT participant_id, 10 AS idx, count(*) FILTER (i < 10) AS n_before, count(*) FILTER (i >= 10) AS n_after, avg(resting_hr) FILTER (i < 10) AS mb, avg(resting_hr) FILTER (i >= 10) AS ma, stddev_samp(resting_hr) FILTER (i < 10) AS sb, stddev_samp(resting_hr) FILTER (i >= 10) AS sa
FROM (SELECT participant_id, resting_hr, row_number() OVER (PARTITION BY participant_id ORDER BY date) - 1 AS i FROM D) GROUP BY participant_id) WHERE n_before > 0 AND n_after > 0""",
    D,
)
def before_after_stats(spark, sf):
    d = views.daily(spark, sf)
    return arrow.stratify_before_after(d, "resting_hr", d.select("participant_id", F.lit(10).alias("index")))


# agreement

_KAPPA = "CASE WHEN avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b})) < 1 - 1e-9 THEN (avg(({a} = {b})::INT) - (avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b})))) / (1 - (avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b})))) END"


@query(f"SELECT round({_KAPPA.format(a='quality', b='toxic')}, 6) AS kappa FROM L", L)
def kappa_pair(spark, sf):
    return views.scored_labels(spark, sf).agg(kappa("quality", "toxic").alias("kappa"))


@query(
    f"""SELECT n11, n10, n01, n00, round(k, 6) AS kappa, round(2 * po - 1, 6) AS pabak, round((po - 2 * q * (1 - q)) / (1 - 2 * q * (1 - q)), 6) AS ac1, round((n11 * n00 - n10 * n01) / sqrt((n11 + n10)::DOUBLE * (n11 + n01) * (n00 + n10) * (n00 + n01)), 6) AS mcc FROM (
SELECT count(*) FILTER (r1 = 1 AND r2 = 1) AS n11, count(*) FILTER (r1 = 1 AND r2 = 0) AS n10, count(*) FILTER (r1 = 0 AND r2 = 1) AS n01, count(*) FILTER (r1 = 0 AND r2 = 0) AS n00, {_KAPPA.format(a='r1', b='r2')} AS k, avg((r1 = r2)::INT) AS po, (avg(r1) + avg(r2)) / 2 AS q FROM R)""",
    R,
)
def crosstab_agreement(spark, sf):
    return agreement.crosstab(views.raters(spark, sf), "r1", "r2")


_IN = "I AS (SELECT *, coalesce((own >= 0.7)::INT, 0) AS in_house FROM R)"
_RATERS = ("in_house", "r1", "r2", "r3")


def _multi_sql(raters: tuple[str, ...]) -> str:
    pub = raters[1:]
    parts = ["count(*) AS n", *[f"round(avg({r}), 6) AS pass_{r}" for r in raters]]
    parts += [f"round({_KAPPA.format(a=a, b=b)}, 6) AS kappa_{a}_{b}" for i, a in enumerate(raters) for b in raters[i + 1 :]]
    ones, zeros = " AND ".join(f"{p} = 1" for p in pub), " AND ".join(f"{p} = 0" for p in pub)
    parts += [f"round(avg(({ones})::INT), 6) AS published_all_pass", f"round(avg(({zeros})::INT), 6) AS published_all_fail", f"round(avg(({zeros} AND in_house = 1)::INT), 6) AS only_in_house_passes"]
    return ", ".join(parts)


@query(f"SELECT *, round(list_sort([kappa_r1_r2, kappa_r1_r3, kappa_r2_r3])[2], 6) AS median_published_kappa FROM (SELECT {_multi_sql(_RATERS)} FROM I)", R, _IN)
def four_way_agreement(spark, sf):
    return agreement.multi_rater(views.raters(spark, sf), "own", ["r1", "r2", "r3"])


def _rank(c: str, src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{c}) - 1) / 2.0::DOUBLE"


def _rho(x: str, y: str, src: str) -> str:
    return f"(SELECT round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) FROM (SELECT {_rank(x, src)} AS a, {_rank(y, src)} AS b FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"


@query(
    f"SELECT {_multi_sql(('in_house', 'r1', 'r2'))}, {_rho('own', 'tpl', 'T')} AS rho_own_tpl, {_rho('own', 'amp', 'T')} AS rho_own_amp, {_rho('tpl', 'amp', 'T')} AS rho_tpl_amp FROM I",
    R, _IN, "T AS (SELECT own, coalesce(template, 0.0) AS tpl, 1 - least(greatest(amplitude_cv, 0.0), 2.0) AS amp FROM R)",
)
def three_way_agreement(spark, sf):
    return agreement.three_way(views.raters(spark, sf), "own", "template", "amplitude_cv", "r1", "r2")


@query(
    f"SELECT count(*) AS n, round({_corr('own', 'ok', 3, '1e-12')}, 6) AS point_biserial, count(*) FILTER (own >= 0.7 AND ok = 1) AS both_pass, count(*) FILTER (own >= 0.7 AND ok = 0) AS only_in_house, count(*) FILTER (own < 0.7 AND ok = 1) AS only_method, count(*) FILTER (own < 0.7 AND ok = 0) AS both_fail, {_rho('own', 'template', 'H')} AS rho FROM H",
    R, "H AS (SELECT own, coalesce(template, 0.0) AS template, r1::DOUBLE AS ok FROM R)",
)
def head_to_head(spark, sf):
    return agreement.head_to_head(views.raters(spark, sf), "own", "template", "r1")


_BA = f"count(*) AS n_pairs, round(avg(abs(listed - paid)), 6) AS mae, round(avg(listed - paid), 6) AS bias, round(avg(listed - paid) - 1.96 * stddev_samp(listed - paid), 6) AS loa_low, round(avg(listed - paid) + 1.96 * stddev_samp(listed - paid), 6) AS loa_high, round({_corr('paid', 'listed', 5, '0')}, 6) AS r, round(avg((abs(listed - paid) <= 5)::INT), 6) AS within_5, round(avg((abs(listed - paid) <= 10)::INT), 6) AS within_10"


@query(f"SELECT {_BA} FROM B", B)
def bland_altman(spark, sf):
    return agreement.bland_altman(views.prices(spark, sf), "paid", "listed")


@query(f"SELECT brand, {_BA} FROM B GROUP BY ROLLUP (brand)", B)
def bland_altman_rollup(spark, sf):
    return agreement.bland_altman(views.prices(spark, sf), "paid", "listed", by=["brand"], rollup=True)


@query(
    f"""SELECT q75, round(avg(stress_proxy) FILTER (active_minutes >= q75), 6) AS error_high, round(avg(stress_proxy) FILTER (active_minutes < q75), 6) AS error_low, count(active_minutes) AS n, {_rho('active_minutes', 'stress_proxy', 'D')} AS rho_stress_proxy, {_rho('active_minutes', 'signal_quality_ground_truth', 'D')} AS rho_signal_quality_ground_truth
FROM D, (SELECT quantile_cont(active_minutes, 0.75) AS q75 FROM D) GROUP BY q75""",
    D,
)
def motion_effect(spark, sf):
    return agreement.motion_effect(views.daily(spark, sf), "active_minutes", "stress_proxy", ["signal_quality_ground_truth"])


# calibration and thresholds

_BINS = "bins AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, avg(score) AS confidence, avg(((score >= 0.5) = (quality = 1))::INT) AS accuracy, avg(quality) AS rate FROM L GROUP BY 1)"


@query("SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(rate, 6) AS rate FROM bins", L, _BINS)
def reliability_curve(spark, sf):
    return agreement.calibration_bins(views.scored_labels(spark, sf), "score", "quality")


@query("SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM bins", L, _BINS)
def expected_calibration_error(spark, sf):
    return agreement.expected_calibration_error(views.scored_labels(spark, sf), "score", "quality")


_CURVE = """c AS (SELECT score, sum(quality)::BIGINT AS pos, sum(1 - quality)::BIGINT AS neg FROM L GROUP BY score),
curve AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (SELECT sum(pos) FROM c) AS p, (SELECT sum(neg) FROM c) AS n FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT score, tp, fp, tp / p AS tpr, fp / n AS fpr, tp / (tp + fp) AS precision, tp / p AS recall, 2 * tp / (2 * tp + fp + p - tp) AS f1, tp / p - fp / n AS youden, (tp / p + 1 - fp / n) / 2 AS balanced_accuracy FROM curve)"""


@query("SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(youden, 6) AS youden, round(balanced_accuracy, 6) AS balanced_accuracy FROM m", L, _CURVE)
def roc_pr_curve(spark, sf):
    return agreement.ranking_curve(views.scored_labels(spark, sf), "score", "quality")


@query(
    """SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auroc, round(sum((recall - t0) * precision), 6) AS average_precision, arg_max(score, {'v': youden, 's': score}) AS youden_threshold, round(max(youden), 6) AS youden, arg_max(score, {'v': f1, 's': score}) AS f1_threshold, round(max(f1), 6) AS f1
FROM (SELECT *, coalesce(lag(fpr) OVER o, 0.0) AS f0, coalesce(lag(tpr) OVER o, 0.0) AS t0 FROM m WINDOW o AS (ORDER BY score DESC))""",
    L, _CURVE,
)
def best_thresholds(spark, sf):
    return agreement.best_thresholds(views.scored_labels(spark, sf), "score", "quality")


GRID = [i / 100 for i in range(10, 100)]
_GRID = "grid AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(10, 100) AS r(i))"
_CELLS = """cells AS (SELECT {by} threshold, count(*) AS n, count(*) FILTER (score >= threshold AND {y} = 1)::DOUBLE AS tp, count(*) FILTER (score >= threshold AND {y} = 0)::DOUBLE AS fp, count(*) FILTER (score < threshold AND {y} = 1)::DOUBLE AS fn, count(*) FILTER (score < threshold AND {y} = 0)::DOUBLE AS tn FROM L, grid GROUP BY ALL)"""
_K = "CASE WHEN pe < 1 - 1e-9 THEN (po - pe) / (1 - pe) END"
_PO = "SELECT *, (tp + tn) / n AS po, (tp + fp) / n * ((tp + fn) / n) + (1 - (tp + fp) / n) * (1 - (tp + fn) / n) AS pe FROM"


@query(f"SELECT threshold, n, (tp + fp)::BIGINT AS n_pass, round(po, 6) AS agreement, round({_K}, 6) AS kappa, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM ({_PO} cells)", L, _GRID, _CELLS.format(by="", y="quality"))
def threshold_sensitivity(spark, sf):
    return agreement.threshold_grid(views.scored_labels(spark, sf), "score", "quality", GRID)


@query(f"SELECT arg_max(threshold, {{'k': k, 't': -threshold}}) AS threshold, round(max(k), 6) AS kappa FROM (SELECT threshold, {_K} AS k FROM ({_PO} cells)) WHERE k IS NOT NULL", L, _GRID, _CELLS.format(by="", y="toxic"))
def threshold_kappa(spark, sf):
    return agreement.recalibrate(views.scored_labels(spark, sf), "score", "toxic", GRID)


@query("SELECT arg_max(threshold, {'k': f1, 't': -threshold}) AS threshold, round(max(f1), 6) AS f1 FROM (SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM cells)", L, _GRID, _CELLS.format(by="", y="quality").replace("score >=", "score >").replace("score < ", "score <= "))
def threshold_f1(spark, sf):
    return agreement.recalibrate(views.scored_labels(spark, sf), "score", "quality", GRID, "f1", strict=True)


@query(
    f"""SELECT lang, arg_max(threshold, {{'k': tk, 't': -threshold}}) AS threshold, round(max(tk), 6) AS train_kappa, round(arg_max(hk, {{'k': tk, 't': -threshold}}), 6) AS held_kappa
FROM (SELECT lang, threshold, hk, {_K} AS tk FROM ({_PO} (SELECT own.lang, own.threshold, own.hk, t.n - own.n AS n, t.tp - own.tp AS tp, t.fp - own.fp AS fp, t.fn - own.fn AS fn, t.tn - own.tn AS tn
  FROM (SELECT *, {_K} AS hk FROM ({_PO} cells)) own JOIN (SELECT threshold, sum(n) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM cells GROUP BY 1) t USING (threshold)))) WHERE tk IS NOT NULL GROUP BY lang""",
    L, _GRID, _CELLS.format(by="lang,", y="quality"),
)
def loso_recalibration(spark, sf):
    return agreement.loso_recalibration(views.scored_labels(spark, sf), "score", "quality", "lang", GRID)


@query(
    f"""SELECT threshold, round(b.k, 6) AS calibration_kappa, round(h.k, 6) AS holdout_kappa, round(h.po, 6) AS holdout_agreement, h.n AS n_holdout FROM (SELECT arg_max(threshold, {{'k': k, 't': -threshold}}) AS threshold, max(k) AS k FROM kappas WHERE half AND k IS NOT NULL) b
JOIN (SELECT * FROM kappas WHERE NOT half) h USING (threshold)""",
    L, "H AS (SELECT *, (('0x' || md5(concat_ws(':', '0', doc_id::VARCHAR))[1:13])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE < 0.5 AS half FROM L)", _GRID,
    _CELLS.format(by="half,", y="quality").replace("FROM L, grid", "FROM H, grid"), f"kappas AS (SELECT *, {_K} AS k FROM ({_PO} cells))",
)
def holdout_recalibration(spark, sf):
    return agreement.recalibrate_with_holdout(views.scored_labels(spark, sf), "score", "quality", "doc_id", GRID)


# ranks and effects


@query(f"SELECT count(*) AS n, {_rho('score', 'quality', 'L')} AS rho FROM L", L)
def spearman_pair(spark, sf):
    return spearman(views.scored_labels(spark, sf), "score", "quality")


_RS = "ranks AS (SELECT {y} = 1 AS g, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM L), sums AS (SELECT count(*) FILTER (g) AS n_a, count(*) FILTER (NOT g) AS n_b, sum(r) FILTER (g) AS w FROM ranks)"


@query("SELECT n_a, n_b, round(w, 6) AS rank_sum_a, round(w - n_a * (n_a + 1) / 2, 6) AS u_a, round((w - n_a * (n_a + 1) / 2) / (n_a * n_b), 6) AS auroc, round(2 * ((w - n_a * (n_a + 1) / 2) / (n_a * n_b)) - 1, 6) AS cliffs_delta, round((w - n_a * (n_a + n_b + 1) / 2) / sqrt(n_a * n_b * (n_a + n_b + 1) / 12), 6) AS z FROM sums", L, _RS.format(y="toxic"))
def mann_whitney(spark, sf):
    return rank_sums(views.scored_labels(spark, sf), "score", F.col("toxic") == 1).drop("ties")


_STATE = "T AS (SELECT participant_id, device_type, missing_wearable_flag AS state, metric, value FROM D UNPIVOT (value FOR metric IN (resting_hr, hrv_rmssd)))"


@query(
    """SELECT participant_id, metric, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_b - mean_a, 6) AS delta, round((w - n_a * (n_a + n_b + 1) / 2) / sqrt(n_a * n_b * (n_a + n_b + 1) / 12), 6) AS z FROM (
SELECT participant_id, metric, count(*) FILTER (state = 0) AS n_a, count(*) FILTER (state = 1) AS n_b, avg(value) FILTER (state = 0) AS mean_a, avg(value) FILTER (state = 1) AS mean_b, sum(r) FILTER (state = 0) AS w
FROM (SELECT *, rank() OVER (PARTITION BY participant_id, metric ORDER BY value) + (count(*) OVER (PARTITION BY participant_id, metric, value) - 1) / 2.0::DOUBLE AS r FROM T) GROUP BY ALL) WHERE n_a >= 3 AND n_b >= 3""",
    D, _STATE,
)
def per_state_comparison(spark, sf):
    return effects.per_state_comparison(views.daily(spark, sf), ["resting_hr", "hrv_rmssd"], "missing_wearable_flag", 0, 1, by=["participant_id"]).drop("p_value")


@query()
def within_subject_tests(spark, sf):
    return effects.within_subject_tests(views.daily(spark, sf), ["resting_hr", "hrv_rmssd"], "missing_wearable_flag", [(0, 1)], by=["participant_id"])


@query(
    """SELECT metric, n_a, n_b, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS cohens_d FROM (SELECT metric, count(*) FILTER (state = 1) AS n_a, count(*) FILTER (state = 0) AS n_b, avg(value) FILTER (state = 1) AS ma, avg(value) FILTER (state = 0) AS mb, var_samp(value) FILTER (state = 1) AS va, var_samp(value) FILTER (state = 0) AS vb FROM T GROUP BY metric)""",
    D, _STATE,
)
def cohens_d(spark, sf):
    tall = effects.unpivoted(views.daily(spark, sf), ["resting_hr", "hrv_rmssd"], ["missing_wearable_flag"]).filter("value is not null")
    return effects.cohens_d(tall, "value", F.col("missing_wearable_flag") == 1, ["metric"])


@query()
def state_effect_sizes(spark, sf):
    return effects.state_effect_sizes(views.daily(spark, sf), ["resting_hr", "hrv_rmssd"], "missing_wearable_flag", 1, 0, by=["participant_id"])


@query(
    """SELECT device_type, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0.0) AS w_plus FROM (SELECT *, rank() OVER (PARTITION BY device_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY device_type, abs(d)) - 1) / 2.0::DOUBLE AS r
FROM (SELECT device_type, participant_id, round(avg(resting_hr) FILTER (missing_wearable_flag = 1) - avg(resting_hr) FILTER (missing_wearable_flag = 0), 6) AS d FROM D GROUP BY ALL) WHERE d IS NOT NULL AND d <> 0) GROUP BY device_type""",
    D,
)
def paired_signed_rank(spark, sf):
    return effects.signed_ranks(_state_deltas(views.daily(spark, sf)), "d", ["device_type"])


def _state_deltas(d):
    of = lambda s: F.avg(F.when(F.col("missing_wearable_flag") == s, F.col("resting_hr")))
    return d.groupBy("device_type", "participant_id").agg(F.round(of(1) - of(0), 6).alias("d"))


@query()
def paired_wilcoxon(spark, sf):
    return effects.paired_wilcoxon(_state_deltas(views.daily(spark, sf)), "d", ["device_type"])


@query(
    """SELECT device_type, round(exp(0.91 * abs(m)), 6) AS risk_ratio, round(exp(0.91 * abs(m)) + sqrt(exp(0.91 * abs(m)) * (exp(0.91 * abs(m)) - 1)), 6) AS e_value, round(CASE WHEN lo <= 0 AND hi >= 0 THEN 1.0 ELSE exp(0.91 * abs(nb)) + sqrt(exp(0.91 * abs(nb)) * (exp(0.91 * abs(nb)) - 1)) END, 6) AS e_value_bound
FROM (SELECT *, CASE WHEN m >= 0 THEN lo ELSE hi END AS nb FROM (SELECT device_type, m, m - 1.96 * se AS lo, m + 1.96 * se AS hi FROM (SELECT device_type, avg(stress_proxy - 0.2) AS m, stddev_samp(stress_proxy) / sqrt(count(*)) AS se FROM D GROUP BY 1)))""",
    D,
)
def e_value(spark, sf):
    m = views.daily(spark, sf).groupBy("device_type").agg(F.avg(F.col("stress_proxy") - 0.2).alias("m"), (F.stddev_samp("stress_proxy") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    low, high = F.col("m") - 1.96 * F.col("se"), F.col("m") + 1.96 * F.col("se")
    return m.select("device_type", *[c.alias(n) for n, c in effects.e_value(F.col("m"), low, high).items()])


# fairness

Q_OF = "SELECT *, CASE WHEN q0 < q1 AND q1 < q2 AND q2 < q3 AND q3 < q4 THEN CASE WHEN skin_tone_proxy <= q1 THEN 'Q1' WHEN skin_tone_proxy <= q2 THEN 'Q2' WHEN skin_tone_proxy <= q3 THEN 'Q3' ELSE 'Q4' END ELSE CASE WHEN skin_tone_proxy <= q2 THEN 'low' ELSE 'high' END END AS stratum FROM D, (SELECT min(skin_tone_proxy) AS q0, quantile_cont(skin_tone_proxy, 0.25) AS q1, quantile_cont(skin_tone_proxy, 0.5) AS q2, quantile_cont(skin_tone_proxy, 0.75) AS q3, max(skin_tone_proxy) AS q4 FROM D)"
_Q = f"Q AS ({Q_OF})"
_STRATA = _trust_sql("stratum", "Q", "NULL::DOUBLE").replace("least(abs(hr - NULL::DOUBLE) / 10, 1.0)", "NULL::DOUBLE")


@query(f"SELECT stratum, n_days, {_ROUND}, overall, category FROM labelled WHERE n_days >= 10", D, _Q, _STRATA)
def fairness_strata(spark, sf):
    return fairness.fairness_audit(views.daily(spark, sf), "skin_tone_proxy")


@query(
    "SELECT component, round(min(score), 6) AS lowest, round(max(score), 6) AS highest, round(max(score) - min(score), 6) AS disparity, arg_min(stratum, {'v': score, 's': stratum}) AS lowest_stratum, arg_min(stratum, {'v': -score, 's': stratum}) AS highest_stratum FROM "
    f"(SELECT * FROM labelled WHERE n_days >= 10) UNPIVOT (score FOR component IN ({', '.join((*trust.COMPONENTS, 'overall'))})) GROUP BY component HAVING count(*) >= 2",
    D, _Q, _STRATA,
)
def disparity(spark, sf):
    return fairness.disparity_summary(fairness.fairness_audit(views.daily(spark, sf), "skin_tone_proxy"))


@query()
def fairness_bootstrap(spark, sf):
    return fairness.fairness_audit(views.daily(spark, sf), "device_type", replicates=100)


_SIMPLEX = [(4, 2, 1, 1, 1, 1), (1, 4, 2, 1, 1, 1), (1, 1, 4, 2, 1, 1), (1, 1, 1, 4, 2, 1), (2, 1, 1, 1, 1, 4)]


@query(
    f"""SELECT candidate::INT AS candidate, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) AS rho FROM (
SELECT candidate, {_rank('x', '', 'candidate')} AS a, {_rank('y', '', 'candidate')} AS b FROM (
SELECT c.i AS candidate, round(({' + '.join(f'{n} * c.w[{i + 1}]' for i, n in enumerate(trust.COMPONENTS))}) / 10.0::DOUBLE, 9) AS x, y FROM comp JOIN (SELECT participant_id, round(avg(reliability_ground_truth), 6) AS y FROM D GROUP BY 1) USING (participant_id), (SELECT unnest(range(5)) AS i, unnest([{', '.join(str(list(map(float, w))) for w in _SIMPLEX)}]) AS w) c) WHERE x IS NOT NULL) GROUP BY candidate""",
    D, _COHORT,
)
def weight_grid_search(spark, sf):
    import numpy as np

    d = views.daily(spark, sf)
    target = d.groupBy("participant_id").agg(F.round(F.avg("reliability_ground_truth"), 6).alias("reproducibility"))
    return fairness.weight_objectives(trust.component_scores(d, "participant_id"), target, np.array(_SIMPLEX, float))


@query()
def learned_weights(spark, sf):
    d = views.daily(spark, sf)
    target = d.groupBy("participant_id").agg(F.avg("reliability_ground_truth").alias("reproducibility"))
    found = fairness.learn_weights(trust.component_scores(d, "participant_id"), target)
    rows = [(c, float(w), found["rho_train"], found["rho_holdout"], found["evaluations"]) for c, w in found["weights"].items()]
    return spark.createDataFrame(rows, "component string, weight double, rho_train double, rho_holdout double, evaluations long")


@query()
def weight_sensitivity(spark, sf):
    scores = trust.component_scores(views.daily(spark, sf), "participant_id")
    return fairness.sensitivity_table(scores)


@query()
def auroc_bootstrap(spark, sf):
    return agreement.auroc_interval(views.scored_labels(spark, sf), "score", "quality")


# causal


@query(
    """SELECT round(CASE WHEN vt * vc - tc * tc > 0 THEN (ty * vc - cy * tc) / (vt * vc - tc * tc) END, 4) AS effect, n FROM (SELECT covar_pop(y, t) AS ty, covar_pop(y, c) AS cy, covar_pop(t, c) AS tc, var_pop(t) AS vt, var_pop(c) AS vc, count(*) AS n
FROM (SELECT l_extendedprice AS y, (l_discount > (SELECT quantile_cont(l_discount, 0.5) FROM lineitem))::DOUBLE AS t, l_quantity AS c FROM lineitem))"""
)
def ols_adjusted_effect(spark, sf):
    li = views.table(spark, sf, "lineitem").select("l_extendedprice", "l_discount", "l_quantity")
    e = causal.g_computation(li, "l_discount", "l_extendedprice", ["l_quantity"])
    return spark.range(1).select(F.round(F.lit(e.effect), 4).alias("effect"), F.lit(e.n).cast("long").alias("n"))


@query("SELECT round(avg(l_extendedprice) FILTER (t) - avg(l_extendedprice) FILTER (NOT t), 4) AS effect, count(*) AS n FROM (SELECT l_extendedprice, l_discount > (SELECT quantile_cont(l_discount, 0.5) FROM lineitem) AS t FROM lineitem)")
def difference_of_means(spark, sf):
    e = causal.aipw(views.table(spark, sf, "lineitem").select("l_extendedprice", "l_discount"), "l_discount", "l_extendedprice", [])
    return spark.range(1).select(F.round(F.lit(e.effect), 4).alias("effect"), F.lit(e.n).cast("long").alias("n"))


@query()
def aipw_effect(spark, sf):
    e = causal.aipw(views.daily(spark, sf), "heat_index", "hrv_rmssd", ["stress_proxy", "active_minutes"], replicates=200)
    return spark.createDataFrame([(e.treatment, e.outcome, e.effect, e.ci_low, e.ci_high, e.n)], "treatment string, outcome string, effect double, ci_low double, ci_high double, n long")


@query()
def positivity_check(spark, sf):
    return causal.positivity(views.daily(spark, sf), "heat_index", ["stress_proxy", "active_minutes"])


# artifacts on windows

_RUN = """samples AS (SELECT window_idx, unnest(signal) AS x, generate_subscripts(signal, 1) AS i FROM W)"""


@query(
    """SELECT window_idx, (longest >= 8)::INT AS flag, round(least(greatest(longest / 32.0::DOUBLE, 0.0), 1.0), 6) AS severity, longest::INT AS longest FROM (SELECT window_idx, max(l) AS longest FROM (SELECT window_idx, g, sum(b) AS l FROM (SELECT window_idx, b, sum(1 - b) OVER (PARTITION BY window_idx ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, (abs(x) <= 0.05)::INT AS b FROM samples)) GROUP BY ALL) GROUP BY 1)""",
    W, _RUN,
)
def dropout_runs(spark, sf):
    return views.windows(spark, sf).select("window_idx", artifacts.dropout(F.col("signal"), 8, 0.05).alias("d")).select("window_idx", "d.*")


@query(
    """SELECT window_idx, (n > 0)::INT AS flag, round(least(greatest(n / greatest(s * 0.02, 1.0), 0.0), 1.0), 6) AS severity, n::INT AS n_spikes FROM (SELECT window_idx, count(*) AS s, count(*) FILTER (d / (1.4826 * (mad + 1e-6)) > 2.5) AS n FROM (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY window_idx) AS mad FROM (SELECT window_idx, abs(x - quantile_cont(x, 0.5) OVER (PARTITION BY window_idx)) AS d FROM samples)) GROUP BY window_idx)""",
    W, _RUN,
)
def noise_spikes(spark, sf):
    return artifacts.with_noise_spikes(views.windows(spark, sf), "signal", limit=2.5).select("window_idx", "spikes.*")


@query(
    """SELECT window_idx, (n > 0)::INT AS flag, round(least(greatest(n / greatest(f * 0.1, 1.0), 0.0), 1.0), 6) AS severity, n::INT AS n_flat FROM (SELECT window_idx, count(*) AS f, count(*) FILTER (v < 0.01) AS n FROM (SELECT window_idx, i, var_pop(x) OVER (PARTITION BY window_idx ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS v FROM samples) WHERE i >= 16 GROUP BY window_idx)""",
    W, _RUN,
)
def flatline(spark, sf):
    return artifacts.with_flatline(views.windows(spark, sf), "signal", width=16, limit=0.01).select("window_idx", "flatline.*")


@query(
    """SELECT window_idx, round(-sum(n / s * log2(n / s)) / 4, 6) AS entropy FROM (SELECT window_idx, n, sum(n) OVER (PARTITION BY window_idx) AS s FROM (SELECT window_idx, b, count(*)::DOUBLE AS n FROM (SELECT window_idx, least(floor((x - lo) / ((hi - lo) / 16)), 15) AS b FROM (SELECT *, min(x) OVER (PARTITION BY window_idx) AS lo, max(x) OVER (PARTITION BY window_idx) AS hi FROM samples)) GROUP BY ALL)) GROUP BY window_idx""",
    W, _RUN,
)
def window_entropy(spark, sf):
    return artifacts.with_entropy(views.windows(spark, sf), "signal").select("window_idx", "entropy")


@query("SELECT window_idx, round(skewness(x), 6) AS skewness, round(kurtosis(x) + 3, 6) AS kurtosis FROM samples GROUP BY window_idx", W, _RUN)
def window_moments(spark, sf):
    return artifacts.with_moments(views.windows(spark, sf), "signal").select("window_idx", "skewness", "kurtosis")


@query(
    """SELECT window_idx, round(least(greatest(high / (low + high), 0.0), 1.0), 6) AS motion FROM (SELECT window_idx, coalesce(sum(p) FILTER (hz <= 4), 0.0) + 1e-9 AS low, coalesce(sum(p) FILTER (hz > 4), 0.0) AS high FROM (
SELECT window_idx, f * 20 / 64.0::DOUBLE AS hz, pow(sum((x - m) * cos(2 * pi() * f * (i - 1) / 64)), 2) + pow(sum((x - m) * sin(2 * pi() * f * (i - 1) / 64)), 2) AS p FROM (SELECT *, avg(x) OVER (PARTITION BY window_idx) AS m FROM samples), (SELECT unnest(range(1, 33)) AS f) GROUP BY window_idx, f) WHERE hz BETWEEN 0.5 AND 15 GROUP BY window_idx)""",
    W, _RUN,
)
def motion_score_dft(spark, sf):
    return artifacts.with_dft_motion(views.windows(spark, sf), "signal", 20.0, 64).select("window_idx", "motion")


#: Sizes and rates of the paired windows: chest samples, chest rate, pulse samples, pulse rate.
_PAIRED = (256, 85.0, 64, 20.0)


@query(
    """SELECT window_idx, label, motion_flag, round(motion_severity, 6) AS motion_severity, dropout_flag, round(dropout_severity, 6) AS dropout_severity, spikes_flag, round(spikes_severity, 6) AS spikes_severity, flatline_flag, round(flatline_severity, 6) AS flatline_severity,
  greatest(motion_flag, dropout_flag, spikes_flag, flatline_flag) AS any_flag, round((motion_severity + dropout_severity + spikes_severity + flatline_severity) / 4, 6) AS mean_severity
FROM (SELECT window_idx, (fired > 0)::INT AS motion_flag, CASE WHEN fired > 0 THEN least(greatest(0.5 * fired + 0.25 * over, 0.0), 1.0) ELSE 0.0 END AS motion_severity
    FROM (SELECT window_idx, (spread > 0.5)::INT + (fast > 0.4)::INT AS fired, greatest(spread - 0.5, 0.0) / 0.5 + greatest(fast - 0.4, 0.0) / 0.4 AS over FROM spread JOIN fast USING (window_idx)))
JOIN (SELECT window_idx, (longest >= 32)::INT AS dropout_flag, least(longest / 128.0::DOUBLE, 1.0) AS dropout_severity FROM (SELECT window_idx, max(l) AS longest FROM (SELECT window_idx, g, sum(b) AS l FROM (SELECT window_idx, b, sum(1 - b) OVER (PARTITION BY window_idx ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, (abs(x) <= 0.02)::INT AS b FROM samples)) GROUP BY ALL) GROUP BY 1)) USING (window_idx)
JOIN (SELECT window_idx, (n > 0)::INT AS spikes_flag, least(n / greatest(s * 0.02, 1.0), 1.0) AS spikes_severity FROM (SELECT window_idx, count(*) AS s, count(*) FILTER (d / (1.4826 * (mad + 1e-6)) > 4) AS n FROM (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY window_idx) AS mad FROM (SELECT window_idx, abs(x - quantile_cont(x, 0.5) OVER (PARTITION BY window_idx)) AS d FROM samples)) GROUP BY window_idx)) USING (window_idx)
JOIN (SELECT window_idx, (n > 0)::INT AS flatline_flag, least(n / greatest(f * 0.1, 1.0), 1.0) AS flatline_severity FROM (SELECT window_idx, count(*) AS f, count(*) FILTER (v < 1e-4) AS n FROM (SELECT window_idx, i, var_pop(x) OVER (PARTITION BY window_idx ORDER BY i ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS v FROM samples) WHERE i >= 64 GROUP BY window_idx)) USING (window_idx)
JOIN W USING (window_idx)""",
    W, _RUN, "centred AS (SELECT window_idx, i, x - avg(x) OVER (PARTITION BY window_idx) AS d FROM samples)",
    "spread AS (SELECT window_idx, var_pop(d) / pow(quantile_cont(abs(d), 0.95) + 1e-9, 2) AS spread FROM centred GROUP BY window_idx)",
    "fast AS (SELECT window_idx, coalesce(sum(p) FILTER (f * 20 / 64.0::DOUBLE > 4), 0.0) / (sum(p) + 1e-9) AS fast FROM (SELECT window_idx, f, pow(sum(d * cos(2 * pi() * f * (i - 1) / 64)), 2) + pow(sum(d * sin(2 * pi() * f * (i - 1) / 64)), 2) AS p FROM centred, (SELECT unnest(range(0, 33)) AS f) GROUP BY window_idx, f) GROUP BY window_idx)",
)
def window_artifacts(spark, sf):
    return artifacts.evaluate_windows(views.windows(spark, sf), "signal", 20.0).drop("signal")


@query(
    "SELECT PW.window_idx, label::VARCHAR AS subject_id, label, 'class_' || label AS label_name, round(abs(hr_ecg - hr_ppg), 6) AS hr_abs_diff, orphanidou_acceptable, sukor_acceptable, elgendi_acceptable, "
    + ", ".join(f"round({n}, 6) AS {n}" for n, t in arrow.WINDOW_FIELDS if t == "double" and n != "hr_abs_diff")
    + " FROM T JOIN PW USING (window_idx)",
    W, views.PAIRED_SQL, window_table_sql("PW", *_PAIRED).strip(), recursive=True,
)
def window_table(spark, sf):
    return arrow.window_table(views.paired_windows(spark, sf), _PAIRED[1], _PAIRED[3])


_GAPS = "gaps AS (SELECT user_id, ts, event_id, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS d FROM events)"


@query(
    """SELECT user_id, count(*) AS n_intervals, count(*) FILTER (abs(d - 30000000) > 20000000) AS n_jitter, count(*) FILTER (d > 90000000) AS n_gaps, round(least((count(*) FILTER (abs(d - 30000000) > 20000000) + count(*) FILTER (d > 90000000)) / count(*), 1.0), 6) AS severity, ((count(*) FILTER (abs(d - 30000000) > 20000000) + count(*) FILTER (d > 90000000)) > 0)::INT AS flag FROM gaps WHERE d IS NOT NULL GROUP BY user_id""",
    _GAPS,
)
def timestamp_jitter(spark, sf):
    return artifacts.timestamp_jitter(views.table(spark, sf, "events"), _ms(F.col("ts")), 3e7, ["user_id"], 2e7)


def _ms(ts):
    return F.unix_millis(ts.cast("timestamp"))


def _rr(spark, sf):
    """Events' values as intervals of 400 to 1400 ms, by user."""
    return views.table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value") * 2 + 400, 2).alias("rr"))


_RR = "rr AS (SELECT user_id, event_id, round(value * 2 + 400, 2) AS v FROM events), lagged AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS p, quantile_cont(v, 0.5) OVER (PARTITION BY user_id) AS m FROM rr)"


@query(
    """SELECT user_id, policy, count(*) AS n, round(avg(v), 6) AS mean_rr, round(sqrt(avg(d * d)), 6) AS rmssd, round(stddev_samp(v), 6) AS sdnn, round(60000 / avg(v), 6) AS rate FROM (SELECT *, v - lag(v) OVER (PARTITION BY user_id, policy ORDER BY event_id) AS d FROM (
SELECT user_id, event_id, v, unnest(list_filter([CASE WHEN true THEN 'raw' END, CASE WHEN v BETWEEN 400 AND 1500 THEN 'plausible' END, CASE WHEN v BETWEEN 400 AND 1500 AND abs(v - m) / m < 0.25 THEN 'median_25' END, CASE WHEN v BETWEEN 400 AND 1500 AND abs(v - m) / m < 0.1 THEN 'median_10' END, CASE WHEN coalesce(abs(v - p) < 50, true) THEN 'successive_50' END], lambda x: x IS NOT NULL)) AS policy FROM lagged)) GROUP BY ALL""",
    _RR,
)
def rr_clean_policies(spark, sf):
    return artifacts.cleaning_policies(_rr(spark, sf), "rr", ["user_id"], ["event_id"])


@query(
    """SELECT user_id, round(CASE WHEN max(n) >= 2 THEN sqrt(avg(d * d)) END, 6) AS corrected_rmssd FROM (SELECT *, r - lag(r) OVER (PARTITION BY user_id ORDER BY i) AS d FROM (
SELECT user_id, i, n, coalesce(a.v + coalesce((i - a.i) / nullif(b.i - a.i, 0), 0.0) * (b.v - a.v), a.v, b.v) AS r FROM (SELECT user_id, i, last_value(ok IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(ok IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, count(ok) OVER (PARTITION BY user_id) AS n
FROM (SELECT user_id, i, CASE WHEN v BETWEEN 500 AND 1200 THEN {'i': i, 'v': v} END AS ok FROM (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM rr))))) GROUP BY user_id""",
    _RR,
)
def corrected_rmssd(spark, sf):
    return artifacts.interpolated_rmssd(_rr(spark, sf), "rr", ["user_id"], ["event_id"], 500, 1200)


# models, synthetic cohorts, streams


@query()
def model_leaderboard(spark, sf):
    d = views.daily(spark, sf)
    return models.train_baselines(d.withColumn("signal_quality_ground_truth", F.col("signal_quality_ground_truth") + 0.6))


@query()
def loso_classifier(spark, sf):
    rows = views.scored_labels(spark, sf).withColumn("noise", F.pmod("doc_id", F.lit(17)).cast("double"))
    return models.loso_classify(rows, ["score", "noise"], "quality", "source")


@query()
def synthetic_cohort(spark, sf):
    c = synthetic.Cohort(days=20)
    return synthetic.generate(spark, c, ids=views.people(spark, sf)).select("participant_id", "date", "device_type", "resting_hr", "hrv_rmssd", "missing_wearable_flag", "signal_quality_ground_truth")


@query()
def generator_stress_sweep(spark, sf):
    return synthetic.stress_test(spark, synthetic.Cohort(days=30), ids=views.people(spark, sf))


def _streamed(spark, sf, name, mode, f):
    """Runs a stream over the events file to its end, into a table below the checkpoint folder; a batch that is run again
    overwrites its own rows."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = f(source)
    part = lambda i: f"{folder}/rows/batch={i}"

    def keep(rows, i):
        rows.write.mode("overwrite").parquet(part(i if mode == "append" else 0))

    spark.createDataFrame([], out.schema).write.parquet(part(-1))
    out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


@query(
    """SELECT user_id, ts::DATE AS date, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM events GROUP BY 1, 2"""
)
def streaming_daily_summary(spark, sf):
    return _streamed(spark, sf, "daily", "complete", lambda e: audit.daily_summary(e))


@query(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM
(SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOURS)::INT, 1) AS new FROM events)) GROUP BY user_id, g"""
)
def streaming_wear_sessions(spark, sf):
    s = _streamed(spark, sf, "sessions", "complete", lambda e: audit.wear_sessions(e))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def streaming_change_points(spark, sf):
    return _streamed(spark, sf, "changes", "append", lambda e: audit.change_points(e))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import report_queries  # noqa: F401  (registers its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import report_queries  # noqa: F401

    return dict(_SQL)
