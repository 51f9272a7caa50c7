"""Quality models on participant-days and leave-one-subject-out tracks on window tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import grouped_medians, quantiles
from ..functions.stacked import design, stacked_logistic
from ..functions.stats import hashed_uniform, rank_sums, spearman
from ..session import cut
from .agreement import expected_calibration_error, f1_score

# Model features.
FEATURES = ("resting_hr", "hrv_rmssd", "hrv_sdnn", "step_count", "active_minutes", "sleep_duration", "sleep_efficiency", "stress_proxy", "temperature_c", "humidity", "aqi", "wearable_minutes")


def prepared(df: DataFrame, features: Sequence[str] = FEATURES, target: str = "signal_quality_ground_truth", threshold: float = 0.7) -> tuple[DataFrame, list[str]]:
    """The features that are there with missing values set to the exact median (0 without any), and the 0/1 target."""
    held = [f for f in features if f in df.columns]
    m = quantiles(df, held, [0.5])
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(m[f][0] if m[f][0] is not None else 0.0)) for f in held}
    return df.withColumns(filled).withColumn("label", (F.col(target) >= threshold).cast("int")), held


def split(df: DataFrame, key: Sequence[str], test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A split by a hash of the row's key within the classes: stratified, and the same on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(10_000)) / 10_000
    return df.filter(u >= test), df.filter(u < test)


def _hashed_normal(seed: int, name: str, key: Sequence[str]):
    """A standard normal number for each row key, the same under any partitioning."""
    u, v = (hashed_uniform(F.lit(seed), F.lit(f"{name}/{x}"), *[F.col(k) for k in key]) for x in "ra")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)


def _hashed_normals(seed: int, names: Sequence[str], key: Sequence[str]):
    """The array of ``_hashed_normal`` of each name. As columns of their own, many draws make a generated method that is too long for the JVM to compile."""
    u = lambda n: hashed_uniform(F.lit(seed), n, *[F.col(k) for k in key])
    return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.sqrt(-2 * F.log(u(F.concat(n, F.lit("/r"))))) * F.cos(2 * np.pi * u(F.concat(n, F.lit("/a")))))


def _scores(df: DataFrame, score: str) -> dict:
    auc = rank_sums(df, score, F.col("label") == 1).first()
    f1 = df.agg(f1_score(F.col(score) >= 0.5, F.col("label") == 1).alias("f1")).first()["f1"]
    return {"auroc": auc["auroc"], "f1": f1}


#: Draws of the noise by which robustness is measured.
TRIALS = 5

#: A task of the forest sends the sums of all nodes, so few tasks, at least TASKS, train on up to TASK_ROWS rows each. The rows' number alone decides how many,
#: as bags are drawn by task.
TASKS, TASK_ROWS = 24, 500_000


def _dealt(df: DataFrame, key: Sequence[str], tasks: int) -> DataFrame:
    return cut(df.repartition(tasks, *key).sortWithinPartitions(*df.columns))


def train_baselines(df: DataFrame, key: Sequence[str] = ("participant_id", "date"), trees: int = 200, depth: int = 12, seed: int = 42) -> DataFrame:
    """(model, auroc, f1, ece, robustness, n_train, n_test) of a logistic model, a random forest and an isolation forest.

    With one class alone the scores are NULL. Robustness is the share of decisions that noise of 5 % of each feature's
    deviation leaves as they are, over TRIALS draws of the noise. The isolation forest decides by the median of its scores in each draw.
    Held-out rows are scored once by all models, then once for each draw of the noise; a draw's row carries the scores without noise.
    """
    spark = df.sparkSession
    rows, held = prepared(cut(df.select(*key, *[f for f in FEATURES if f in df.columns], "signal_quality_ground_truth")))
    parts = [d.select(*key, *held, "label") for d in split(rows, key, seed=seed)]
    n = [d.count() for d in parts]
    train, test = (_dealt(d, key, max(TASKS, -(-sum(n) // TASK_ROWS))) for d in parts)
    names = ("logistic_regression", "random_forest", "isolation_forest")
    if train.select("label").distinct().count() < 2:
        return spark.createDataFrame([(name, None, None, None, None, *n) for name in names], LEADERBOARD)
    scaled = Pipeline(stages=[VectorAssembler(inputCols=held, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(train)
    learners = [LogisticRegression(maxIter=100, regParam=1.0 / max(n[0], 1), standardization=False), RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)]
    known = scaled.transform(train).select("features", "label")
    models = [learner.setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__v{i}").setPredictionCol(f"__d{i}").fit(known) for i, learner in enumerate(learners)]
    grown = fit_isolation_forest(train, held, trees, seed=seed)

    def scored(rows: DataFrame, mark: str, keep: Sequence[str]) -> DataFrame:
        """``keep`` and the models' scores, as ``mark`` with the model's number."""
        out = isolations(rows, held, grown).withColumnRenamed("isolation", f"{mark}2")
        for m in [scaled, *models]:
            out = m.transform(out)
        return cut(out.select(*keep, *[F.get(vector_to_array(f"__v{i}"), F.lit(1)).alias(f"{mark}{i}") for i in range(len(models))], f"{mark}2"))

    spread = train.agg(*[F.stddev_pop(f).alias(f) for f in held]).first()
    base = scored(test, "p", test.columns)
    base = base.withColumn("p2", normality("p2", quantiles(base, ["p2"], [1 - CONTAMINATION])["p2"][0]))
    trials = base.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(TRIALS)))).withColumn("__z", _hashed_normals(seed, held, [*key, "trial"]))
    noise = [(F.col(f) + 0.05 * float(spread[f] or 0.0) * F.get("__z", F.lit(i))).alias(f) for i, f in enumerate(held)]
    shaken = scored(trials.select("trial", "p0", "p1", "p2", *noise), "q", ("trial", "p0", "p1", "p2"))
    shaken = shaken.withColumn("q2", normality("q2", quantiles(shaken, ["q2"], [1 - CONTAMINATION])["q2"][0]))
    # ``normality`` falls with the score of isolation, so being above its median is being below that of the other.
    middle = grouped_medians(shaken, "q2", ["trial"]).select(F.col("trial").alias("at"), F.col("median").alias("q_mid"))
    p_mid = quantiles(base, ["p2"], [0.5])["p2"][0]
    same = lambda i, p, q: F.avg(((F.col(f"p{i}") > p) == (F.col(f"q{i}") > q)).cast("double"))
    kept = shaken.join(F.broadcast(middle), F.col("trial") == F.col("at")).agg(same(0, 0.5, 0.5), same(1, 0.5, 0.5), same(2, p_mid, F.col("q_mid"))).first()
    out = []
    for i, name in enumerate(names):
        s = _scores(base, f"p{i}")
        ece = expected_calibration_error(base, f"p{i}", "label").first()["ece"] if i < len(models) else None
        out.append((name, s["auroc"], s["f1"], ece, kept[i], *n))
    return spark.createDataFrame(out, LEADERBOARD)


LEADERBOARD = "model string, auroc double, f1 double, ece double, robustness double, n_train long, n_test long"


# isolation forest: trees are grown from a bounded sample, rows are scored where they are

SAMPLE = 256


def fit_isolation_forest(df: DataFrame, features: Sequence[str], trees: int = 200, sample: int = SAMPLE, seed: int = 42) -> list[list[tuple]]:
    """Trees over samples of ``sample`` rows, as lists of nodes (feature, split, left, right, path length at a leaf)."""
    rng = np.random.default_rng(seed)
    # The rows of the smallest hashes of their values: a sample of bounded size that does not depend on the partitioning.
    rows = df.select(*features).orderBy(F.xxhash64(F.lit(seed), *features), *features).limit(20 * sample).toPandas().to_numpy(float)
    return [_grow(rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)], rng) for _ in range(trees)] if len(rows) else []


def _average_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    limit, nodes, todo = int(np.ceil(np.log2(max(len(x), 2)))), [], [(x, 0, None, 0)]
    while todo:
        part, depth, parent, side = todo.pop()
        if parent is not None:
            nodes[parent][2 + side] = len(nodes)
        spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 else []
        if depth >= limit or not len(spread):
            nodes.append([-1, 0.0, 0, 0, depth + _average_path(len(part))])
            continue
        f = int(rng.choice(spread))
        at = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        nodes.append([f, at, 0, 0, 0.0])
        here = len(nodes) - 1
        todo += [(part[part[:, f] < at], depth + 1, here, 0), (part[part[:, f] >= at], depth + 1, here, 1)]
    return [tuple(n) for n in nodes]


CONTAMINATION = 0.2


def isolations(df: DataFrame, features: Sequence[str], trees: list[list[tuple]], sample: int = SAMPLE) -> DataFrame:
    """``df`` with ``isolation``: 2 to the negative mean path length through the trees, in units of a sample's average."""
    unit = max(_average_path(sample), 1e-9)
    # A leaf goes on to itself, so all rows take as many steps as the tree is deep.
    packed = []
    for t in trees:
        f, at, left, right, path = (np.array(c) for c in zip(*t))
        leaf, here = f < 0, np.arange(len(f))
        down = np.column_stack([np.where(leaf, here, right), np.where(leaf, here, left)]).ravel()
        packed.append((np.where(leaf, 0, f), at, down, path, _levels(f, left, right)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(features)].to_numpy(float)
            first, x = np.arange(len(x)) * x.shape[1], x.ravel()
            depth = np.zeros(len(pdf))
            for f, at, down, path, levels in packed:
                node = np.zeros(len(pdf), int)
                for _ in range(levels):
                    node = down.take(2 * node + (x.take(first + f.take(node)) < at.take(node)))
                depth += path.take(node)
            yield pdf.assign(isolation=2 ** (-(depth / max(len(packed), 1)) / unit))

    return df.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, isolation double")


def _levels(f: np.ndarray, left: np.ndarray, right: np.ndarray) -> int:
    """Steps from the root to the deepest leaf."""
    levels, here = 0, np.array([0])
    while len(here := here[f[here] >= 0]):
        levels, here = levels + 1, np.concatenate([left[here], right[here]])
    return levels


def normality(isolation: str, limit: float | None):
    return 1 / (1 + F.exp(20 * (F.col(isolation) - F.lit(limit).cast("double"))))


def isolation_scores(df: DataFrame, features: Sequence[str], trees: list[list[tuple]], sample: int = SAMPLE, contamination: float = CONTAMINATION, limit: float | None = None) -> DataFrame:
    """``df`` with ``normality`` in (0, 1): over 0.5 for all but about the ``contamination`` share of the rows."""
    scored = cut(isolations(df, features, trees, sample))
    limit = quantiles(scored, ["isolation"], [1 - contamination])["isolation"][0] if limit is None else limit
    return scored.withColumn("normality", normality("isolation", limit)).drop("isolation")


# reconstruction error of a linear autoencoder: what the retained principal directions don't explain


def train_autoencoder(df: DataFrame, components: int = 4) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Features, means, deviations and directions from one aggregation over rows of good quality. A linear stand-in for a
    neural autoencoder: no deep-learning library is at hand, and its best linear form is closed."""
    from .causal import gram

    rows, held = prepared(df)
    good = rows.filter("label = 1")
    g = gram(good, held)
    n = max(g[0, 0], 1.0)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    _, v = np.linalg.eigh(cov / np.outer(std, std))
    return held, mean, std, v[:, ::-1][:, :components]


def reconstruction_scores(df: DataFrame, model: tuple) -> DataFrame:
    """``df`` with ``reconstruction_error``: the mean squared part of the scaled features outside the directions."""
    held, mean, std, v = model
    rows, _ = prepared(df, held)
    rest = np.eye(len(held)) - v @ v.T
    z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(held, mean, std)]
    err = sum((sum((z[j] * float(rest[i, j]) for j in range(len(held))), F.lit(0.0)) ** 2 for i in range(len(held))), F.lit(0.0)) / len(held)
    return rows.withColumn("reconstruction_error", err).drop("label")


def sequences(df: DataFrame, length: int = 30, features: Sequence[str] = FEATURES, target: str = "reliability_ground_truth", key: str = "participant_id", order: str = "date") -> DataFrame:
    """(key, steps, mask, target): each participant's first ``length`` days as padded feature arrays, for sequence models."""
    rows, held = prepared(df, features)
    step = F.struct(order, F.array(*held).alias("x"))
    by = rows.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(step)), 1, length).alias("s"), F.avg(target).alias("target"))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), len(held)), length - F.size("s"))
    return by.select(key, F.concat(F.transform("s", lambda e: e["x"]), pad).alias("steps"), F.concat(F.array_repeat(F.lit(1), F.size("s")), F.array_repeat(F.lit(0), length - F.size("s"))).alias("mask"), "target")


def sequence_baseline(seq: DataFrame, ridge: float = 1.0) -> dict:
    """Ridge regression of the target on the masked means of the steps; RMSE on held-out participants."""
    from .causal import gram

    width = len(seq.select(F.get("steps", F.lit(0)).alias("x")).first()["x"])
    days = F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    mean = [F.aggregate("steps", F.lit(0.0), _adder(i)) / days for i in range(width)]
    rows = seq.filter("target is not null").select(F.hash(seq.columns[0]).alias("h"), *[m.alias(f"f{i}") for i, m in enumerate(mean)], "target")
    names = [f"f{i}" for i in range(width)]
    train, test = rows.filter("pmod(h, 5) <> 0"), rows.filter("pmod(h, 5) = 0")
    g = gram(train, [*names, "target"])
    scale = np.sqrt(np.maximum(np.diag(g)[:-1], 1e-12))
    a = g[:-1, :-1] / np.outer(scale, scale) + np.diag([0.0] + [ridge / max(g[0, 0], 1)] * width)
    beta = np.linalg.lstsq(a, g[:-1, -1] / scale, rcond=None)[0] / scale
    p = sum((F.col(n) * float(b) for n, b in zip(names, beta[1:])), F.lit(float(beta[0])))
    r = test.agg(F.sqrt(F.avg((F.col("target") - p) ** 2)).alias("rmse"), F.count(F.lit(1)).alias("n")).first()
    return {"rmse": r["rmse"], "n_test": r["n"], "n_train": int(g[0, 0])}


def _adder(i: int):
    return lambda s, x: s + F.get(x, F.lit(i))


# leave one subject out


def loso_classify(df: DataFrame, features: Sequence[str], label: str, subject: str = "subject_id", least: int = 10, tolerance: float = 1e-8, steps: int = 100, classifier: str = "logistic", trees: int = 200, depth: int = 8, seed: int = 42) -> DataFrame:
    """(subject, n, auroc) of models trained on all other subjects; folds under ``least`` rows or with one class are left out.

    A fold's features are scaled by the means and deviations of its own training rows, which are the sums of all less the
    held-out subject's. Logistic folds take their Newton steps together, one pass a step, in which a task adds up its rows' sums for every fold:
    rows aren't multiplied, joined or shuffled. ``classifier="forest"`` fits one random forest a fold, one after the other, so it suits tens
    of subjects.
    """
    if classifier not in ("logistic", "forest"):
        raise ValueError(f"unknown classifier {classifier!r}")
    rows = cut(df.select(F.col(subject), *features, F.col(label).cast("double").alias("y")).dropna())
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("positive"), *[F.sum(f).cast("double").alias(f"s_{f}") for f in features], *[F.sum(F.col(f) * F.col(f)).cast("double").alias(f"q_{f}") for f in features]]
    own = rows.groupBy(subject).agg(*sums).orderBy(subject).collect()
    total = {c: sum(r[c] for r in own) for c in (own[0].asDict() if own else {}) if c != subject}
    # Both classes on either side, and enough rows to be scored. Scores are compared to 9 digits.
    kept = [r for r in own if r["n"] >= least and 0 < r["positive"] < r["n"] and 0 < total["positive"] - r["positive"] < total["n"] - r["n"]]
    kind = df.schema[subject].dataType.simpleString()
    if not kept:
        return df.sparkSession.createDataFrame([], f"{subject} {kind}, n long, auroc double")
    folds = {r[subject]: i for i, r in enumerate(kept)}
    scored = (_logistic_folds(rows, features, subject, kept, total, tolerance, steps) if classifier == "logistic" else _forest_folds(rows, features, subject, list(folds), trees, depth, seed)).withColumn("score", F.round("score", 9))
    out = rank_sums(scored, "score", F.col("y") == 1, [subject])
    return out.select(subject, (F.col("n_a") + F.col("n_b")).alias("n"), "auroc")


def _logistic_folds(rows: DataFrame, features: Sequence[str], subject: str, kept: list, total: dict, tolerance: float, steps: int) -> DataFrame:
    """(subject, score, y): rows of the held-out subjects under their own fold's model."""
    folds = {r[subject]: i for i, r in enumerate(kept)}
    scales = np.zeros((len(kept), 2, len(features)))
    for i, r in enumerate(kept):
        n = total["n"] - r["n"]
        for j, f in enumerate(features):
            mean = (total[f"s_{f}"] - r[f"s_{f}"]) / n
            var = (total[f"q_{f}"] - r[f"q_{f}"]) / n - mean * mean
            scales[i, :, j] = mean, var**0.5 if var > 1e-12 * (1 + mean * mean) else 1.0
    own_fold = lambda pdf: pdf[subject].map(folds).fillna(-1).to_numpy(int)
    weights = lambda pdf: (own_fold(pdf)[:, None] != np.arange(len(folds))).astype(float)
    beta = stacked_logistic(rows, features, "y", weights, len(folds), 1.0, scales, steps, tolerance)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = own_fold(pdf)
            held = pdf[at >= 0]
            yield held[[subject, "y"]].assign(score=(design(held, features) * beta[at[at >= 0]]).sum(1))

    return rows.mapInPandas(score, f"`{subject}` {rows.schema[subject].dataType.simpleString()}, y double, score double")


def _forest_folds(rows: DataFrame, features: Sequence[str], subject: str, subjects: list, trees: int, depth: int, seed: int) -> DataFrame:
    out = None
    for s in subjects:
        model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)]).fit(rows.filter(F.col(subject) != s))
        one = model.transform(rows.filter(F.col(subject) == s)).select(subject, "y", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def add_audit_masks(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    own, orph = F.coalesce(F.col("inhouse_ppg_sqi") >= threshold, F.lit(False)), F.coalesce(F.col("orphanidou_acceptable") == 1, F.lit(False))
    return df.withColumns({"pass_inhouse": own, "pass_orphanidou": orph, "pass_both": own & orph})


MASKS = ("all", "pass_inhouse", "pass_orphanidou", "pass_both")


def classification_track(df: DataFrame, features: Sequence[str], label: str, subject: str = "subject_id", **options) -> DataFrame:
    """(condition, subject, n, auroc) of the leave-one-out track under each mask; ``options`` as for ``loso_classify``."""
    marked, out = add_audit_masks(df).withColumn("all", F.lit(True)), None
    for m in MASKS:
        one = loso_classify(marked.filter(m), features, label, subject, **options).withColumn("condition", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def track_summary(track: DataFrame, score: str = "auroc", replicates: int = 500, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(condition, n_subjects, mean, ci_low, ci_high) of the subjects' scores, with an interval from resampled subjects, which are few."""
    tail = 100 * (1 - confidence) / 2

    def resampled(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[score].to_numpy(float))
        rng = np.random.default_rng(seed)
        low, high = np.percentile([x[rng.integers(0, len(x), len(x))].mean() for _ in range(replicates)], [tail, 100 - tail])
        return pd.DataFrame({"condition": [pdf["condition"].iloc[0]], "n_subjects": [len(x)], "mean": [x.mean()], "ci_low": [low], "ci_high": [high]})

    rows = track.filter(F.col(score).isNotNull()).select("condition", score)
    return rows.groupBy("condition").applyInPandas(resampled, "condition string, n_subjects long, mean double, ci_low double, ci_high double")


def paired_deltas(track: DataFrame, subject: str = "subject_id", score: str = "auroc") -> DataFrame:
    """By condition: n, median gain over ``all``, W+ and the p-value that it is above 0."""
    from .effects import paired_wilcoxon

    base = track.filter("condition = 'all'").select(subject, F.col(score).alias("__b"))
    d = track.filter("condition <> 'all'").join(base, subject).withColumn("delta", F.col(score) - F.col("__b"))
    return paired_wilcoxon(d, "delta", ["condition"])


def biomarker_track(df: DataFrame, a: str, b: str, subject: str = "subject_id", least: int = 30) -> DataFrame:
    """(condition, subject, n, rho): rank correlation of two biomarkers by subject under each mask."""
    marked, out = add_audit_masks(df).withColumn("all", F.lit(True)), None
    for m in MASKS:
        one = spearman(marked.filter(m), a, b, [subject]).filter(F.col("n") >= least).withColumn("condition", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def perturbation_stability(df: DataFrame, scorer, columns: Sequence[str], noise: float = 0.05, trials: int = 10, seed: int = 42) -> float:
    """1 less the mean absolute change of a 0-to-100 score per 100 when the columns get noise of ``noise`` deviations.

    ``scorer`` maps a DataFrame to a column expression over its rows.
    """
    s = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    base = df.withColumn("__base", scorer(df))
    changes = []
    for t in range(trials):
        # The noise of a row follows from its values, so it is the same under any partitioning.
        shaken = base.withColumns({c: F.col(c) + noise * float(s[c] or 0.0) * _hashed_normal(seed, f"{c}/{t}", columns) for c in columns})
        changes.append(shaken.agg(F.avg(F.abs(scorer(shaken) - F.col("__base"))).alias("d")).first()["d"] or 0.0)
    return float(1 - np.mean(changes) / 100)
