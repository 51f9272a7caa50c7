"""DuckDB SQL of the window table: the same scores from the definitions, on lists and rows.

The filter is a recursive query over samples (direct form, forwards and backwards over an odd extension), peaks are folded in the order of their height,
beats are unnested to (window, offset) groups for their median template, and pulses find their troughs by a search in the list.
"""

from __future__ import annotations

from ..functions import kernels as k


def _number(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def passed(name: str, source: str, b, a) -> str:
    """CTEs ``name``: (w, xs) of ``source`` filtered once in the direction of the list, from the state that its first value settles to."""
    n = len(a) - 1
    rest = k.steady_state(b, a)
    state = lambda y, z: ", ".join(f"{z(i + 1)} + {_number(b[i])} * x - {_number(a[i])} * {y} AS z{i}" for i in range(1, n)) + f", {_number(b[n])} * x - {_number(a[n])} * {y} AS z{n}"
    return f"""{name}_f AS (
  SELECT w, 1 AS t, y, {state("y", lambda i: f"{_number(0.0)} + s{i}")} FROM (SELECT w, xs[1] AS x, {_number(b[0])} * xs[1] + {_number(rest[0])} * xs[1] AS y, {", ".join(f"{_number(rest[i - 1])} * xs[1] AS s{i}" for i in range(2, n + 1))} FROM {source})
  UNION ALL
  SELECT w, t, y, {state("y", lambda i: f"p{i}")} FROM (SELECT f.w, f.t + 1 AS t, e.xs[f.t + 1] AS x, {_number(b[0])} * e.xs[f.t + 1] + f.z1 AS y, {", ".join(f"f.z{i} AS p{i}" for i in range(2, n + 1))} FROM {name}_f AS f JOIN {source} AS e ON e.w = f.w WHERE f.t < len(e.xs))),
{name} AS (SELECT w, list(y ORDER BY t) AS xs FROM {name}_f GROUP BY w)"""


def bandpassed(name: str, source: str, size: int, fs: float, band: tuple[float, float]) -> str:
    """CTEs ``name``: (w, xs) of ``source``, lists of ``size`` samples, filtered without a shift in time."""
    b, a = k.butter_bandpass(k.ORDER, *band, float(fs))
    pad = 3 * len(a)
    long = f"list_transform(range(0, {pad}), lambda t: 2 * xs[1] - xs[{pad + 1} - t]) || xs || list_transform(range(0, {pad}), lambda t: 2 * xs[{size}] - xs[{size - 1} - t])"
    return f"""{name}_e AS (SELECT w, {long} AS xs FROM {source}),
{passed(f"{name}_1", f"{name}_e", b, a)},
{name}_r AS (SELECT w, list_reverse(xs) AS xs FROM {name}_1),
{passed(f"{name}_2", f"{name}_r", b, a)},
{name} AS (SELECT w, list_slice(list_reverse(xs), {pad + 1}, {pad + size}) AS xs FROM {name}_2)"""


def peaks(xs: str, size: int, distance: int, height: str | None = None) -> str:
    """Positions (from 1) of local maxima in order; of two closer than ``distance`` the higher stays."""
    own = f"list_filter(range(2, {size}), lambda i: {xs}[i] > {xs}[i - 1] AND {xs}[i] > {xs}[i + 1]{f' AND {xs}[i] >= {height}' if height else ''})"
    first = f"list_transform(list_reverse_sort(list_transform({own}, lambda i: {{'h': {xs}[i], 'i': i}})), lambda s: [s.i])"
    kept = f"list_reduce({first}, lambda a, x: CASE WHEN len(list_filter(a, lambda p: abs(p - x[1]) < {distance})) = 0 THEN a || x ELSE a END)"
    return f"CASE WHEN len({own}) > 0 THEN list_sort({kept}) ELSE []::BIGINT[] END"


def _plausible(n: str, seconds: str) -> str:
    bpm = f"({n} / {seconds} * 60)"
    return f"CASE WHEN {bpm} BETWEEN {k.HR_RANGE[0]} AND {k.HR_RANGE[1]} THEN 1.0 ELSE greatest(0.0, 1 - abs({bpm} - 70) / 200) END"


def _gaps(p: str, fs: float) -> str:
    return f"list_transform(range(1, len({p})), lambda g: ({p}[g + 1] - {p}[g]) / {_number(float(fs))})"


def _rate(p: str, fs: float) -> str:
    held = f"list_filter({_gaps(p, fs)}, lambda g: g BETWEEN 0.4 AND 1.5)"
    return f"CASE WHEN len({p}) >= 3 AND len({held}) >= 2 THEN 60 / list_avg({held}) END"


def _cut(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def window_table_sql(source: str, ecg_size: int, ecg_fs: float, ppg_size: int, ppg_fs: float, pilot: int = 100) -> str:
    """CTEs up to ``T``, the window table of ``source`` (window_idx, ecg, ppg, lists of these sizes without missing values, long enough to be
    usable)."""
    gap, half = max(int(ppg_fs * 0.4), 1), int(0.25 * ppg_fs)
    ecg_gap = max(int(ecg_fs * 250 / 1000), 1)
    n = ppg_size
    return f"""
P AS (SELECT window_idx AS w, ppg AS xs FROM {source}), E AS (SELECT window_idx AS w, ecg AS xs FROM {source}),
{bandpassed("P1", "P", n, ppg_fs, k.PPG_BAND)},
{bandpassed("P2", "P1", n, ppg_fs, k.PPG_BAND)},
{bandpassed("E1", "E", ecg_size, ecg_fs, k.ECG_BAND)},
{bandpassed("E2", "E1", ecg_size, ecg_fs, k.ECG_BAND)},
EP AS (SELECT w, {peaks("xs", ecg_size, ecg_gap, "lim")} AS p FROM (SELECT w, xs, greatest(list_avg(xs) + 2 * list_stddev_pop(xs), 1e-6) AS lim FROM (SELECT w, list_transform(xs, lambda x: x * x) AS xs FROM E1))),
EP2 AS (SELECT w, {peaks("xs", ecg_size, ecg_gap, "lim")} AS p FROM (SELECT w, xs, greatest(list_avg(xs) + 2 * list_stddev_pop(xs), 1e-6) AS lim FROM (SELECT w, list_transform(xs, lambda x: x * x) AS xs FROM E2))),
EQ AS (SELECT w, {_rate("EP2.p", ecg_fs)} AS hr_ecg,
  CASE WHEN list_stddev_pop(E.xs) < 1e-4 THEN 0.0 ELSE {_cut(f"0.6 * {_cut('list_var_pop(E1.xs) / (list_var_pop(E.xs) + 1e-9)')} + 0.4 * {_plausible('len(EP.p)', _number(ecg_size / ecg_fs))}")} END AS inhouse_ecg_sqi
  FROM E JOIN E1 USING (w) JOIN EP USING (w) JOIN EP2 USING (w)),
PP AS (SELECT w, P1.xs AS y, {peaks("P1.xs", n, gap)} AS p, {peaks("m.xs", n, gap)} AS q, {peaks("P2.xs", n, gap)} AS twice
  FROM P1 JOIN P2 USING (w) JOIN (SELECT w, list_transform(xs, lambda x: -x) AS xs FROM P1) AS m USING (w)),
-- spectrum of the unfiltered window
SP AS (SELECT w, i, x, avg(x) OVER (PARTITION BY w) AS m FROM (SELECT w, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS i FROM P)),
MO AS (SELECT w, {_cut("high / (low + high)")} AS motion FROM (SELECT w, coalesce(sum(p) FILTER (hz BETWEEN 0.5 AND 4), 0.0) + 1e-9 AS low, coalesce(sum(p) FILTER (hz > 4 AND hz <= 15), 0.0) AS high FROM (
  SELECT w, f * {_number(ppg_fs / n)} AS hz, pow(sum((x - m) * cos(2 * pi() * f * i / {n})), 2) + pow(sum((x - m) * sin(2 * pi() * f * i / {n})), 2) AS p FROM SP, (SELECT unnest(range(0, {n // 2 + 1})) AS f) GROUP BY w, f) GROUP BY w)),
-- rate, gaps and likeness of beats to their median
BT AS (SELECT w, beat, o, y[beat - {half} + o] AS v FROM (SELECT w, y, unnest(list_filter(twice, lambda b: b - 1 >= {half} AND b - 1 + {half} < {n})) AS beat FROM PP), (SELECT unnest(range(0, {2 * half})) AS o)),
TM AS (SELECT w, o, median(v) AS m FROM BT GROUP BY w, o),
LK AS (SELECT w, CASE WHEN count(*) < 2 THEN NULL WHEN min(flat) < 1e-9 THEN 0.0 ELSE avg(r) FILTER (sd >= 1e-9) END AS corr FROM (
  SELECT w, beat, covar_pop(v, m) / nullif(stddev_pop(v) * stddev_pop(m), 0) AS r, stddev_pop(v) AS sd, stddev_pop(m) AS flat FROM BT JOIN TM USING (w, o) GROUP BY w, beat) GROUP BY w),
ORP AS (SELECT w, CASE WHEN len(twice) >= 2 THEN corr END AS orphanidou_template_corr,
  coalesce(len(twice) >= 2 AND 60 / list_avg(g) BETWEEN {k.HR_RANGE[0]} AND {k.HR_RANGE[1]} AND list_max(g) < {k.MAX_GAP_S} AND list_max(g) / list_min(g) < {k.MAX_RATIO} AND corr > {k.TEMPLATE_PPG}, false)::INT AS orphanidou_acceptable
  FROM (SELECT w, twice, corr, {_gaps("twice", ppg_fs)} AS g FROM PP LEFT JOIN LK USING (w))),
-- pulses and the troughs before and after them
PT AS (SELECT w, y, p, q, beat, list_max(list_filter(q, lambda t: t < beat)) AS before, list_min(list_filter(q, lambda t: t >= beat)) AS after FROM (SELECT w, y, p, q, unnest(p) AS beat FROM PP)),
SH AS (SELECT w, count(before) AS n_amp, stddev_pop(y[beat] - y[before]) FILTER (before IS NOT NULL) / (avg(abs(y[beat] - y[before])) FILTER (before IS NOT NULL) + 1e-9) AS amp,
  count(after) AS n_shape, avg((greatest(y[beat], 1e-9) / greatest(-y[after], 1e-9) BETWEEN {k.SHAPE[0]} AND {k.SHAPE[1]})::INT) FILTER (after IS NOT NULL) AS share FROM PT GROUP BY w),
SK AS (SELECT w, CASE WHEN ok THEN list_stddev_pop(gp) / (list_avg(gp) + 1e-9) END AS pp, CASE WHEN ok THEN list_stddev_pop(gt) / (list_avg(gt) + 1e-9) END AS tt, CASE WHEN ok THEN amp END AS amp, CASE WHEN ok THEN share END AS share
  FROM (SELECT w, {_gaps("p", ppg_fs)} AS gp, {_gaps("q", ppg_fs)} AS gt, amp, share, coalesce(len(p) >= 3 AND len(q) >= 3 AND n_amp >= 3 AND n_shape >= 3, false) AS ok FROM PP LEFT JOIN SH USING (w))),
-- moments and entropy, upside down if most of the first windows are
SM AS (SELECT w, unnest(xs) AS x FROM P1),
FL AS (SELECT CASE WHEN count(s) >= 10 AND median(s) < 0 THEN -1.0 ELSE 1.0 END AS side FROM (SELECT w, skewness(x) AS s FROM SM WHERE w IN (SELECT w FROM P ORDER BY w LIMIT {pilot}) GROUP BY w)),
MM AS (SELECT w, skewness(side * x) AS skew, kurtosis(side * x) + 3 AS kurt, min(side * x) AS lo, max(side * x) AS hi FROM SM, FL GROUP BY w),
EN AS (SELECT w, -sum(c / {n}::DOUBLE * log2(c / {n}::DOUBLE)) / 4 AS entropy FROM (SELECT w, least(floor((side * x - lo) / ((hi - lo) / 16)), 15) AS bin, count(*) AS c FROM SM JOIN MM USING (w), FL GROUP BY ALL) GROUP BY w),
T AS (SELECT w AS window_idx, hr_ecg, {_rate("twice", ppg_fs)} AS hr_ppg, inhouse_ecg_sqi,
  CASE WHEN list_var_pop(P.xs) < 1e-5 THEN 0.0 ELSE {_cut(f"0.55 * (1 - motion) + 0.45 * {_plausible('len(p)', _number(n / ppg_fs))}")} END AS inhouse_ppg_sqi, motion AS inhouse_ppg_motion,
  orphanidou_acceptable, orphanidou_template_corr,
  coalesce(share >= {k.SHAPE_SHARE} AND pp < {k.INTERVAL_CV} AND tt < {k.INTERVAL_CV} AND amp < {k.AMPLITUDE_CV}, false)::INT AS sukor_acceptable, pp AS sukor_pp_cv, amp AS sukor_amp_cv,
  coalesce(skew > {k.SKEW_MIN} AND kurt > {k.KURT_MIN} AND entropy < {k.ENTROPY_MAX}, false)::INT AS elgendi_acceptable, skew AS elgendi_skewness, kurt AS elgendi_kurtosis, entropy AS elgendi_entropy
  FROM P JOIN PP USING (w) JOIN EQ USING (w) JOIN MO USING (w) JOIN ORP USING (w) JOIN SK USING (w) JOIN MM USING (w) JOIN EN USING (w))"""
