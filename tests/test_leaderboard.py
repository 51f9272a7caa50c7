"""The leaderboard's models train in few tasks and score each row once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwarden.operators import models


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(5)
    rows = [(f"P{p}", d, *map(float, rng.normal(size=3)), 0.9 if rng.random() < 0.5 else 0.3) for p in range(20) for d in range(20)]
    df = spark.createDataFrame(rows, "participant_id string, date int, resting_hr double, hrv_rmssd double, aqi double, signal_quality_ground_truth double")
    return df.withColumn("signal_quality_ground_truth", F.col("signal_quality_ground_truth") + F.when(F.col("aqi") > 0, 0.5).otherwise(0.0))


def test_forest_trains_in_tasks_that_do_not_follow_the_shuffle(spark, days, monkeypatch):
    """A task sends the sums of all nodes, so 200 tasks for few rows cost more than the rows; rows are scored once, then once with the noise."""
    seen, passes, held = [], [], spark.conf.get("spark.sql.shuffle.partitions")

    class Forest(models.RandomForestClassifier):
        def fit(self, dataset, params=None):
            seen.append(dataset.rdd.getNumPartitions())
            return super().fit(dataset, params)

    frame = type(days)
    run = frame.mapInPandas
    monkeypatch.setattr(models, "RandomForestClassifier", Forest)
    monkeypatch.setattr(frame, "mapInPandas", lambda self, *a, **k: passes.append(1) or run(self, *a, **k))
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        rows = {r["model"]: r for r in models.train_baselines(days.repartition(60), trees=3, depth=2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert seen == [models.TASKS] and len(passes) == 2
    assert rows["random_forest"]["auroc"] > 0.6 and 0.5 < rows["isolation_forest"]["robustness"] <= 1 and rows["logistic_regression"]["robustness"] > 0.8


def test_rows_without_a_full_key_count_for_robustness(spark, days):
    """A noisy row is compared with its own row, not with the rows of its key."""
    r = models.train_baselines(days.withColumn("date", F.lit(None).cast("int")), trees=3, depth=2).first()
    assert r["robustness"] is not None and r["robustness"] > 0.8


def test_isolation_walks_each_tree_to_its_leaf(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    x[7, 0] = np.nan
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double")
    trees = models.fit_isolation_forest(df.filter("i <> 7"), ["a", "b"], trees=5, sample=64)

    def path(tree, row):
        node = 0
        while tree[node][0] >= 0:
            f, at, left, right, _ = tree[node]
            node = left if row[f] < at else right
        return tree[node][4]

    unit = models._average_path(64)
    got = {r.i: r.isolation for r in models.isolations(df, ["a", "b"], trees, 64).collect()}
    assert [got[i] for i in range(300)] == pytest.approx([2 ** (-np.mean([path(t, r) for t in trees]) / unit) for r in x])
