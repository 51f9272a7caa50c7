"""Canonical inputs made from the test tables: a participant-day frame from events, labelled scores from documents, signal windows from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import NUDGE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as participants and their days of events as days; HRV is missing on days with one event."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("date").alias("date"))
    n, v = F.count(F.lit(1)), F.col("value")
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    spread = F.when(n >= 2, (F.max(v) - F.min(v)) * 0.3)
    cols = {
        "resting_hr": 40 + F.avg(v) / 5,
        "hrv_rmssd": spread,
        "hrv_sdnn": spread * 0.8 + 5,
        "step_count": n * 1500.0,
        "active_minutes": F.sum(v) / 10,
        "sleep_duration": 4 + (F.sum("event_id") % 60) / 10,
        "sleep_efficiency": 0.5 + 0.5 * of("click") / n,
        "stress_proxy": of("error") * 1.0 / n,
        "temperature_c": 15 + F.dayofmonth("date") * 0.5,
        "humidity": 40 + F.min(v) / 10,
        "aqi": F.sum(v) / 20,
        "heat_index": 15 + F.dayofmonth("date") * 0.5 + F.avg(v) * 0.05,
        "wearable_minutes": F.least(F.lit(1440.0), 400 + n * 200.0),
        "signal_quality_ground_truth": F.avg(v) / 500,
        "artifact_burden_ground_truth": F.min(v) / 500,
        "reliability_ground_truth": F.max(v) / 500,
    }
    days = e.groupBy("user_id", "date").agg(*[F.round(c + NUDGE, 6).alias(k) for k, c in cols.items()], (of("error") > 0).cast("int").alias("missing_wearable_flag"))
    third = F.col("user_id") % 3
    return days.select(
        F.concat(F.lit("P"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("participant_id"), "date", *cols, "missing_wearable_flag",
        F.concat(F.lit("device_"), F.when(third == 0, "A").when(third == 1, "B").otherwise("C")).alias("device_type"), F.round((F.col("user_id") * 37 % 101) / 100.0, 6).alias("skin_tone_proxy"),
    )


def people(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The users of the events as participants, of whom synthetic cohorts are made.

    Ids are filled up to five characters, and cut to them unless ``whole``: then all users are participants of their own."""
    user = F.col("user_id").cast("string")
    filled = F.lpad(user, F.greatest(F.lit(5), F.length(user)) if whole else 5, "0")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("P"), filled).alias("participant_id")).distinct()


PEOPLE_SQL = "SELECT DISTINCT 'P' || lpad(user_id::VARCHAR, 5, '0') AS participant_id FROM events"
WHOLE_PEOPLE_SQL = "SELECT DISTINCT 'P' || lpad(user_id::VARCHAR, greatest(5, length(user_id::VARCHAR))::INT, '0') AS participant_id FROM events"


DAILY_SQL = """D AS (
SELECT 'P' || lpad(user_id::VARCHAR, 5, '0') AS participant_id, ts::DATE AS date,
  round(40 + avg(value) / 5, 6) AS resting_hr,
  CASE WHEN count(*) >= 2 THEN round((max(value) - min(value)) * 0.3::DOUBLE, 6) END AS hrv_rmssd,
  CASE WHEN count(*) >= 2 THEN round((max(value) - min(value)) * 0.3::DOUBLE * 0.8::DOUBLE + 5, 6) END AS hrv_sdnn,
  count(*) * 1500.0::DOUBLE AS step_count, round(sum(value) / 10, 6) AS active_minutes,
  round(4 + (sum(event_id) % 60)::DOUBLE / 10, 6) AS sleep_duration,
  round(0.5::DOUBLE + 0.5::DOUBLE * count(*) FILTER (event_type = 'click') / count(*), 6) AS sleep_efficiency,
  round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS stress_proxy,
  round(15 + day(ts::DATE) * 0.5::DOUBLE, 6) AS temperature_c, round(40 + min(value) / 10, 6) AS humidity, round(sum(value) / 20, 6) AS aqi,
  round(15 + day(ts::DATE) * 0.5::DOUBLE + avg(value) * 0.05::DOUBLE, 6) AS heat_index,
  least(1440.0::DOUBLE, 400 + count(*) * 200.0::DOUBLE) AS wearable_minutes,
  round(avg(value) / 500, 6) AS signal_quality_ground_truth, round(min(value) / 500, 6) AS artifact_burden_ground_truth, round(max(value) / 500, 6) AS reliability_ground_truth,
  (count(*) FILTER (event_type = 'error') > 0)::INT AS missing_wearable_flag,
  'device_' || CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS device_type,
  round((user_id * 37 % 101) / 100.0::DOUBLE, 6) AS skin_tone_proxy
FROM events GROUP BY user_id, ts::DATE)"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, quality, toxic, score): a score in (0, 1) from a document's length, in steps of 0.01."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 2).alias("score")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "lang", "source", "quality", "toxic", score)


LABELS_SQL = """L AS (SELECT doc_id, lang, source, quality, toxic, round(n_chars / (n_chars + 1500.0::DOUBLE), 2) AS score FROM labels JOIN documents USING (doc_id))"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items rated by four rules: a score in [0, 1] and three 0/1 flags."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_shipdate", F.round(F.col("l_quantity") / 50, 6).alias("own"), (F.col("l_returnflag") != "R").cast("int").alias("r1"), (F.col("l_discount") < 0.05).cast("int").alias("r2"),
        (F.col("l_tax") < 0.04).cast("int").alias("r3"), F.round(F.col("l_discount") * 10, 6).alias("template"), F.round(F.col("l_tax") * 20, 6).alias("amplitude_cv"),
    )


RATERS_SQL = """R AS (SELECT l_orderkey, l_linenumber, round(l_quantity / 50, 6) AS own, (l_returnflag <> 'R')::INT AS r1, (l_discount < 0.05)::INT AS r2, (l_tax < 0.04)::INT AS r3,
  round(l_discount * 10, 6) AS template, round(l_tax * 20, 6) AS amplitude_cv FROM lineitem)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows of 64 samples."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("window_idx"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("signal"))


WINDOWS_SQL = """W AS (SELECT vec_id AS window_idx, label, embedding::DOUBLE[] AS signal FROM embeddings)"""


def paired_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as pulse windows of 64 samples, each with the 256 samples of its group of four vectors as the longer chest window."""
    w = windows(spark, sf_dir).groupBy(F.floor(F.col("window_idx") / 4).alias("four")).agg(F.sort_array(F.collect_list(F.struct("window_idx", "label", "signal"))).alias("ws"))
    return w.select(F.flatten("ws.signal").alias("ecg"), F.inline("ws")).select("window_idx", F.col("label").cast("string").alias("subject_id"), "label", F.concat(F.lit("class_"), F.col("label")).alias("label_name"), "ecg", F.col("signal").alias("ppg"))


PAIRED_SQL = """PW AS (SELECT window_idx, label, signal AS ppg, flatten(list(signal) OVER (PARTITION BY window_idx // 4 ORDER BY window_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ecg FROM W)"""


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as series: one row a customer and day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("participant_id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


SERIES_SQL = """S AS (SELECT o_custkey AS participant_id, o_orderdate::DATE AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prices of one thing: the price a piece that was paid and the part's list price."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", F.substring("p_brand", 1, 7).alias("brand"))
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select("brand", "p_size", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6).alias("paid"), F.col("p_retailprice").alias("listed"))


PRICES_SQL = """B AS (SELECT substring(p_brand, 1, 7) AS brand, p_size, round(l_extendedprice / l_quantity, 6) AS paid, p_retailprice AS listed FROM lineitem JOIN part ON l_partkey = p_partkey)"""
