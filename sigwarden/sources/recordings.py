"""Nested recordings: restricted pickle decoding, label-pure tumbling windows, session summaries, JSON and CSV loaders."""

from __future__ import annotations

import io
import pickle
import re
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.stats import safe_corr

# Label codes of the two data sets.
STATES = {0: "transient", 1: "baseline", 2: "stress", 3: "amusement", 4: "meditation"}
ACTIVITIES = {0: "transient", 1: "sitting", 2: "stairs", 3: "table_soccer", 4: "cycling", 5: "driving", 6: "lunch", 7: "walking", 8: "working"}
# The codes whose windows are taken; transient and meditation segments are not.
TAKEN_STATES, TAKEN_ACTIVITIES = (1, 2, 3), (1, 2, 3, 4, 5, 6, 7, 8)
CHEST_HZ, PULSE_HZ, ACC_HZ, ACTIVITY_HZ = 700, 64, 32, 4

RECORDING = "subject_id string, chest_ecg array<double>, wrist_ppg array<double>, wrist_acc array<array<double>>, labels array<int>"


class _ArraysOnly(pickle.Unpickler):
    """Loads arrays and plain containers; anything else in a pickle is refused."""

    ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode"), *((m, f) for m in ("numpy.core.multiarray", "numpy._core.multiarray") for f in ("_reconstruct", "scalar")), *((m, "_frombuffer") for m in ("numpy.core.numeric", "numpy._core.numeric"))}

    def find_class(self, module: str, name: str):
        if (module, name) not in self.ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a recording")
        return super().find_class(module, name)


def decode(content: bytes, path: str, dialect: str = "wesad") -> dict:
    """One recording from a pickled nested dict; the subject is the file's stem where the dict has none."""
    data = _ArraysOnly(io.BytesIO(content), encoding="latin1").load()
    stem = re.sub(r"\.pkl$", "", path.rsplit("/", 1)[-1])
    chest, wrist = data["signal"]["chest"], data["signal"]["wrist"]
    acc = np.asarray(wrist["ACC"], float) if "ACC" in wrist else np.zeros((0, 3))
    ecg, labels = np.ravel(chest["ECG"]).astype(float), np.ravel(data["label"] if "label" in data else data["activity"]).astype(int)
    if dialect == "dalia":
        labels = upsampled(labels, CHEST_HZ // ACTIVITY_HZ, len(ecg))
    subject = stem if dialect == "dalia" else str(data.get("subject", stem))
    return {"subject_id": subject, "chest_ecg": ecg.tolist(), "wrist_ppg": np.ravel(wrist["BVP"]).astype(float).tolist(), "wrist_acc": acc.reshape(-1, 3).tolist(), "labels": labels.tolist()}


def upsampled(labels: np.ndarray, times: int, n: int) -> np.ndarray:
    """Each label ``times`` times, cut or filled up with the last one to ``n``."""
    out = np.repeat(labels, times)[:n]
    return np.concatenate([out, np.full(n - len(out), out[-1] if len(out) else 0)]) if len(out) < n else out


def read_recordings(spark: SparkSession, path: str, dialect: str = "wesad") -> DataFrame:
    """All recordings ``S*.pkl`` below a folder; one file is one task's work. Convert once to Parquet for repeated use."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "S*.pkl").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([decode(bytes(c), p, dialect)])

    if not files.limit(1).count():
        raise FileNotFoundError(f"no recording below {path}")
    return files.repartition("path").mapInPandas(run, RECORDING)


def label_name(label: Column, names: dict[int, str] = STATES) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label.cast("int")), F.lit("unknown"))


def extract_windows(recordings: DataFrame, seconds: int = 5, states: Sequence[int] = TAKEN_STATES, names: dict[int, str] = STATES, chest_hz: int = CHEST_HZ, pulse_hz: int = PULSE_HZ) -> DataFrame:
    """Tumbling windows whose labels are all one of ``states``, with the wrist slice of the same time; windows that overrun it or the
    labels are left out.

    (subject_id, window_idx, label, label_name, start_seconds, end_seconds, ecg, ppg); window_idx is dense over subjects in order.
    """
    wide, pulse = seconds * chest_hz, seconds * pulse_hz
    known = F.least(F.size("chest_ecg"), F.size("labels"))
    starts = F.sequence(F.lit(0), known - wide, F.lit(wide))
    rows = recordings.filter(known >= wide).select("subject_id", "chest_ecg", "wrist_ppg", "labels", F.explode(starts).alias("at"))
    own = F.slice("labels", F.col("at") + 1, wide)
    wrist = F.floor(F.col("at") * pulse_hz / chest_hz).cast("int")
    cut = rows.select("subject_id", "at", F.array_distinct(own).alias("ls"), F.slice("chest_ecg", F.col("at") + 1, wide).alias("ecg"), F.slice("wrist_ppg", wrist + 1, pulse).alias("ppg"))
    held = cut.filter((F.size("ls") == 1) & F.get("ls", F.lit(0)).isin(list(states)) & (F.size("ppg") == pulse)).withColumn("label", F.get("ls", F.lit(0)))
    # The dense number: counts by subject are summed in order (one row a subject), then added within subjects.
    before = held.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).withColumn("__b", F.coalesce(F.sum("n").over(Window.orderBy("subject_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    index = F.col("__b") + F.row_number().over(Window.partitionBy("subject_id").orderBy("at")) - 1
    return held.join(before.select("subject_id", "__b"), "subject_id").select("subject_id", index.cast("int").alias("window_idx"), "label", label_name(F.col("label"), names).alias("label_name"), (F.col("at") / chest_hz).alias("start_seconds"), ((F.col("at") + wide) / chest_hz).alias("end_seconds"), "ecg", "ppg")


def session_summary(recordings: DataFrame, chest_hz: int = CHEST_HZ, acc_hz: int = ACC_HZ) -> DataFrame:
    """One canonical row a session: rate and RMSSD of baseline ECG after two cleaning steps, active minutes, share of stress."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, ecg, labels in zip(pdf["subject_id"], pdf["chest_ecg"], pdf["labels"]):
                ecg, labels = np.asarray(ecg, float), np.asarray(labels, int)
                n = min(len(ecg), len(labels))
                base = ecg[:n][labels[:n] == 1]
                rr = np.diff(k.r_peaks(base, chest_hz)) / chest_hz if len(base) > 3 * chest_hz else np.zeros(0)
                rr = rr[(rr >= 0.4) & (rr <= 1.5)]
                if len(rr) > 10:
                    rr = rr[np.abs(rr - np.median(rr)) / np.median(rr) < 0.25]
                hr = 60 / rr.mean() if len(rr) else None
                out.append((s, hr, float(np.sqrt((np.diff(rr) ** 2).mean()) * 1000) if len(rr) > 2 else None, float((labels == 2).mean()) if len(labels) else None))
            yield pd.DataFrame(out, columns=["subject_id", "resting_hr", "hrv_rmssd", "stress_proxy"])

    beats = recordings.select("subject_id", "chest_ecg", "labels").mapInPandas(run, "subject_id string, resting_hr double, hrv_rmssd double, stress_proxy double")
    size = F.transform("wrist_acc", lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)))
    acc = recordings.select("subject_id", F.explode(size).alias("m"))
    limit = acc.groupBy("subject_id").agg((F.avg("m") + 1.5 * F.stddev_pop("m")).alias("limit"))
    active = acc.join(limit, "subject_id").groupBy("subject_id").agg((F.count_if(F.col("m") > F.col("limit")) / float(acc_hz) / 60).alias("active_minutes"))
    return beats.join(active, "subject_id", "left").select(F.col("subject_id").alias("participant_id"), F.lit("2024-01-01").cast("date").alias("date"), "resting_hr", "hrv_rmssd", "active_minutes", "stress_proxy")


def baseline_rates(recordings: DataFrame, seconds: int = 5, state: int = 1, hz: int = CHEST_HZ) -> DataFrame:
    """(subject_id, window_idx, rate): heart rate of each whole window of a session's ECG in ``state``, NULL where too few
    plausible beats are found. A session is one row, so one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, ecg, labels in zip(pdf["subject_id"], pdf["chest_ecg"], pdf["labels"]):
                ecg, labels = np.asarray(ecg, float), np.asarray(labels, int)
                n, wide = min(len(ecg), len(labels)), seconds * hz
                held = ecg[:n][labels[:n] == state]
                for i in range(len(held) // wide):
                    rr = np.diff(k.r_peaks(held[i * wide : (i + 1) * wide], hz)) / hz
                    rr = rr[(rr >= 0.4) & (rr <= 1.5)]
                    out.append((s, i, 60 / rr.mean() if len(rr) >= 2 else None))
            yield pd.DataFrame(out, columns=["subject_id", "window_idx", "rate"])

    return recordings.select("subject_id", "chest_ecg", "labels").mapInPandas(run, "subject_id string, window_idx int, rate double")


def rate_reliability(rates: DataFrame, subject: str = "subject_id", order: str = "window_idx", least: int = 6, pairs: int = 5) -> DataFrame:
    """By subject with ``least`` windows: windows, those with a rate, its mean, deviation and variation in percent, and the correlation of
    the first half's windows with the second half's (NULL under ``pairs`` complete pairs)."""
    w = Window.partitionBy(subject)
    placed = rates.select(subject, "rate", (F.row_number().over(w.orderBy(order)) - 1).alias("i"), F.floor(F.count(F.lit(1)).over(w) / 2).alias("half"))
    whole = placed.groupBy(subject).agg(F.count(F.lit(1)).alias("n_windows_total"), F.count("rate").alias("n_windows_valid"), F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("deviation"))
    halves = placed.filter("i < 2 * half").groupBy(subject, (F.col("i") % F.col("half")).alias("pair")).agg(F.max(F.when(F.col("i") < F.col("half"), F.col("rate"))).alias("x"), F.max(F.when(F.col("i") >= F.col("half"), F.col("rate"))).alias("y"))
    r = halves.groupBy(subject).agg(safe_corr("x", "y", pairs, 0.0).alias("split_half_r"))
    return whole.filter((F.col("n_windows_total") >= least) & (F.col("n_windows_valid") > 0)).join(r, subject).withColumn("variation_percent", F.try_divide(100 * F.col("deviation"), F.col("mean")))


def subjects_without_recording(spark: SparkSession, path: str) -> list[str]:
    """Folders ``S*`` in ``path`` that lack the file of their own name, by the file system that Spark uses for it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in store.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("S")]
    return sorted(f.getName() for f in folders if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(f, f"{f.getName()}.pkl")))


def adapt_directory(spark: SparkSession, path: str, out: str, dialect: str = "wesad") -> dict[str, int]:
    """Reads all recordings below ``path`` and writes their windows and session rows as Parquet below ``out``; gives the
    numbers of recordings, windows and sessions.

    Windows are of the states that the dialect takes (TAKEN_STATES, TAKEN_ACTIVITIES). A subject's folder without its file gives a warning; a folder
    without any recording is an error.
    """
    for subject in subjects_without_recording(spark, path):
        warnings.warn(f"{path}/{subject}/{subject}.pkl is missing and left out", stacklevel=2)
    found = read_recordings(spark, path, dialect)
    found.write.mode("overwrite").parquet(f"{out}/recordings")
    held = spark.read.parquet(f"{out}/recordings")
    names, taken = (ACTIVITIES, TAKEN_ACTIVITIES) if dialect == "dalia" else (STATES, TAKEN_STATES)
    extract_windows(held, states=taken, names=names).write.mode("overwrite").parquet(f"{out}/windows")
    summary = activity_seconds(held) if dialect == "dalia" else session_summary(held)
    summary.write.mode("overwrite").parquet(f"{out}/sessions")
    return {"recordings": held.count(), "windows": spark.read.parquet(f"{out}/windows").count(), "sessions": spark.read.parquet(f"{out}/sessions").count()}


def activity_seconds(recordings: DataFrame, hz: int = CHEST_HZ) -> DataFrame:
    """(participant_id, n_samples, seconds_<activity> for each known activity)."""
    rows = recordings.select(F.col("subject_id").alias("participant_id"), F.explode("labels").alias("label"))
    counts = [(F.count_if(F.col("label") == code) / float(hz)).alias(f"seconds_{name}") for code, name in ACTIVITIES.items()]
    return rows.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n_samples"), *counts)


def read_window_table(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=True)
    if lacking := sorted(set(required) - set(df.columns)):
        raise KeyError(", ".join(lacking))
    return df


def read_paired_rates(spark: SparkSession, path: str, a: str = "hr_ecg", b: str = "hr_ppg") -> DataFrame:
    """(a, b) pairs from CSV, from a JSON list of records, or from a JSON object of two arrays."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=True)
    else:
        df = spark.read.json(path, multiLine=True)
        if dict(df.dtypes)[a].startswith("array"):
            df = df.select(F.explode(F.arrays_zip(a, b)).alias("z")).select("z.*")
    return df.select(F.col(a).cast("double"), F.col(b).cast("double")).dropna()


def write_json_nulls(df: DataFrame, path: str) -> None:
    """JSON lines with NaN and infinities as null."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
