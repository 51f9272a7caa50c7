"""Arrow bindings of the numeric kernels: whole rows of a window table in one pass, series scans, p-values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as k


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else k.t_p(a, b) for a, b in zip(t, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else k.pearson_p(a, int(b)) for a, b in zip(r, n)], dtype=float)


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u: pd.Series, n_a: pd.Series, n_b: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else k.mann_whitney_p(x, int(a), int(b), t) for x, a, b, t in zip(u, n_a, n_b, ties)], dtype=float)


@F.pandas_udf(T.DoubleType())
def mann_whitney_p_greater(u: pd.Series, n_a: pd.Series, n_b: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else k.mann_whitney_p(x, int(a), int(b), t, "greater") for x, a, b, t in zip(u, n_a, n_b, ties)], dtype=float)


@F.pandas_udf(T.DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, zeros: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([k.signed_rank_p(x, int(a), int(b), t) for x, a, b, t in zip(w, n, zeros, ties)], dtype=float)


def _array(v) -> np.ndarray:
    return np.zeros(0) if v is None else np.asarray([np.nan if x is None else x for x in v], float)


CHANGES = "index int, score double, before_mean double, after_mean double, delta double, method string"


def scan_changes(df: DataFrame, value: str, key: str = "participant_id", order: str = "date", method: str = "binary_segmentation", least: int = 14, **options) -> DataFrame:
    """A row for each change-point of each series with at least ``least`` finite values. A series is one task's work, as its order matters."""
    find = {"binary_segmentation": k.binary_segmentation, "bocpd": k.bocpd}[method]
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for own, values in zip(pdf[key], pdf["vs"]):
                x = _array(values)
                x = x[np.isfinite(x)]
                if len(x) >= least:
                    found += [{key: own} | c for c in find(x, **options)]
            yield pd.DataFrame(found, columns=[key, "index", "score", "before_mean", "after_mean", "delta", "method"])

    rows = df.filter(F.col(key).isNotNull()).select(key, F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")).alias("s"))
    series = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"]).alias("vs"))
    return series.mapInPandas(scan, f"{key} {kind}, {CHANGES}")


def best_splits(df: DataFrame, value: str, key: str = "participant_id", order: str = "date") -> DataFrame:
    """(key, split, gain) of each series of at least 5 values: the split with the largest fall in squared error."""
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")).alias("s"))
    series = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"]).alias("vs")).filter(F.size("vs") >= 5)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [k.best_split(_array(v)) for v in pdf["vs"]]
            yield pd.DataFrame({key: pdf[key], "split": [i for i, _ in found], "gain": [round(g, 6) for _, g in found]})

    return series.mapInPandas(split, f"{key} {df.schema[key].dataType.simpleString()}, split long, gain double")


def stratify_before_after(df: DataFrame, value: str, changes: DataFrame, key: str = "participant_id", order: str = "date") -> DataFrame:
    """(key, index, side counts, means and deviations, delta) around each change; indexes at an edge give no row."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    placed = df.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("__v"), (F.row_number().over(w) - 1).alias("__i"))
    held = placed.join(changes.select(key, "index").distinct(), key)
    before = F.when(F.col("__i") < F.col("index"), F.col("__v"))
    after = F.when(F.col("__i") >= F.col("index"), F.col("__v"))
    out = held.groupBy(key, "index").agg(
        F.count(before).alias("n_before"), F.count(after).alias("n_after"), F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"), F.stddev_samp(before).alias("std_before"), F.stddev_samp(after).alias("std_after")
    )
    return out.filter("n_before > 0 and n_after > 0").withColumn("delta", F.col("mean_after") - F.col("mean_before"))


WINDOW_FIELDS = [
    ("hr_ecg", "double"), ("hr_ppg", "double"), ("hr_abs_diff", "double"), ("inhouse_ecg_sqi", "double"), ("inhouse_ppg_sqi", "double"), ("inhouse_ppg_motion", "double"),
    ("orphanidou_acceptable", "int"), ("orphanidou_template_corr", "double"), ("sukor_acceptable", "int"), ("sukor_pp_cv", "double"), ("sukor_amp_cv", "double"),
    ("elgendi_acceptable", "int"), ("elgendi_skewness", "double"), ("elgendi_kurtosis", "double"), ("elgendi_entropy", "double"),
]


def window_row(ecg: np.ndarray, ppg: np.ndarray, ecg_fs: float, ppg_fs: float, invert: bool, filtered: np.ndarray | None, again: np.ndarray | None) -> dict:
    """All scores of one window pair; ``filtered`` is the band-passed PPG and ``again`` that filtered once more, None for an unusable window."""
    clean = np.nan_to_num(ppg, nan=0.0)
    gap = max(int(ppg_fs * 0.4), 1)
    twice = k.find_peaks(again, distance=gap) if again is not None else np.zeros(0, int)
    orph = k.orphanidou(clean if filtered is None else filtered, twice, ppg_fs, k.TEMPLATE_PPG)
    sukor = k.sukor_window(ppg, ppg_fs, filtered)
    whole = filtered is not None and np.isfinite(ppg).all() and np.ptp(ppg) >= 1e-12
    elg = k.elgendi_window(filtered, ppg_fs, invert, apply_bandpass=False) if whole else k.elgendi_window(ppg, ppg_fs, invert)
    ecg_ok = len(ecg) >= 3 * ecg_fs and 2 * k.ECG_BAND[1] < ecg_fs
    hr_ecg = k.hr_from_ecg(ecg, ecg_fs) if ecg_ok else np.nan
    hr_ppg = k.heart_rate(twice, ppg_fs)
    quality = k.ppg_quality(clean, ppg_fs, len(k.find_peaks(filtered, distance=gap))) if filtered is not None else np.nan
    return {
        "hr_ecg": hr_ecg, "hr_ppg": hr_ppg, "hr_abs_diff": abs(hr_ecg - hr_ppg),
        "inhouse_ecg_sqi": k.ecg_quality(np.nan_to_num(ecg, nan=0.0), ecg_fs) if len(ecg) and 2 * k.ECG_BAND[1] < ecg_fs else np.nan,
        "inhouse_ppg_sqi": quality, "inhouse_ppg_motion": k.motion_score(clean, ppg_fs),
        "orphanidou_acceptable": int(orph["acceptable"]), "orphanidou_template_corr": orph["template_corr"],
        "sukor_acceptable": int(sukor["acceptable"]), "sukor_pp_cv": sukor["pp_interval_cv"], "sukor_amp_cv": sukor["pulse_amplitude_cv"],
        "elgendi_acceptable": int(elg["acceptable"]), "elgendi_skewness": elg["skewness"], "elgendi_kurtosis": elg["kurtosis"], "elgendi_entropy": elg["entropy"],
    }


def filtered_windows(windows: list[np.ndarray], fs: float) -> tuple[list, list]:
    """Each usable window band-passed once and twice; windows of one length go through the filter together."""
    once, twice = [None] * len(windows), [None] * len(windows)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        if k.usable(w, fs):
            by_length.setdefault(len(w), []).append(i)
    for own in by_length.values():
        y = k.bandpass_many(np.nan_to_num(np.array([windows[i] for i in own]), nan=0.0), fs, k.PPG_BAND)
        z = k.bandpass_many(y, fs, k.PPG_BAND)
        for i, a, b in zip(own, y, z):
            once[i], twice[i] = a, b
    return once, twice


def polarity_inverted(windows: DataFrame, ppg_fs: float, ppg: str = "ppg", order: str = "window_idx", pilot: int = 100) -> bool:
    """Whether the median skewness of the first ``pilot`` windows (ten at least with a value) is negative: the batch is then upside down."""
    rows = windows.select(ppg, order).orderBy(order).limit(pilot).collect()
    skews = [k.elgendi_window(_array(r[0]), ppg_fs)["skewness"] for r in rows]
    skews = [s for s in skews if np.isfinite(s)]
    return len(skews) >= 10 and float(np.median(skews)) < 0


def window_table(windows: DataFrame, ecg_fs: float, ppg_fs: float, ecg: str = "ecg", ppg: str = "ppg", order: str = "window_idx", invert: bool | None = None) -> DataFrame:
    """The 19-column window table: identifying columns and 15 scores, NULL where undefined. One pass without a shuffle;
    the filter runs over whole batches of windows."""
    flip = polarity_inverted(windows, ppg_fs, ppg, order) if invert is None else invert
    meta = [c for c in windows.columns if c not in (ecg, ppg)]
    schema = T.StructType([*[windows.schema[c] for c in meta], *[T.StructField(n, T.DoubleType() if t == "double" else T.IntegerType()) for n, t in WINDOW_FIELDS]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ppgs = [_array(p) for p in pdf[ppg]]
            rows = [window_row(_array(e), p, ecg_fs, ppg_fs, flip, a, b) for e, p, a, b in zip(pdf[ecg], ppgs, *filtered_windows(ppgs, ppg_fs))]
            scores = pd.DataFrame(rows, columns=[n for n, _ in WINDOW_FIELDS], index=pdf.index)
            yield pd.concat([pdf[meta], scores.astype(object).where(scores.notna(), None)], axis=1)

    return windows.select(*meta, ecg, ppg).mapInPandas(run, schema)


@F.pandas_udf(T.StructType([T.StructField("flag", T.IntegerType()), T.StructField("severity", T.DoubleType()), T.StructField("explanation", T.StringType())]))
def motion_artifact(signal: pd.Series, fs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([k.motion_artifact(_array(s), f) for s, f in zip(signal, fs)], columns=["flag", "severity", "explanation"])
