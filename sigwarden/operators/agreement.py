"""Agreement of methods and raters, calibration, thresholds and ranking curves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import quantiles, running_sums
from ..functions.stats import both, clip, hashed_uniform, indicator, kappa, ratio, safe_corr, spearman, spearmans
from ..session import cut


def bland_altman(df: DataFrame, a: str, b: str, by: Sequence[str] = (), rollup: bool = False, least: int = 5) -> DataFrame:
    """Differences b - a: n, mae, bias, limits of agreement, r, shares within 5 and 10; NULL under ``least`` pairs.

    ``rollup`` adds the totals over ``by`` (grouping columns NULL).
    """
    x, y = both(a, b)
    rows = df.select(*by, x.alias("__a"), y.alias("__b")).filter("__a is not null")
    d = F.col("__b") - F.col("__a")
    grouped = rows.rollup(*by) if rollup else rows.groupBy(*by)
    n = F.count(F.lit(1))
    keep = lambda e: F.when(n >= least, e)
    return grouped.agg(
        n.alias("n_pairs"), keep(F.avg(F.abs(d))).alias("mae"), keep(F.avg(d)).alias("bias"),
        keep(F.avg(d) - 1.96 * F.stddev_samp(d)).alias("loa_low"), keep(F.avg(d) + 1.96 * F.stddev_samp(d)).alias("loa_high"),
        safe_corr("__a", "__b", least, 0.0).alias("r"), keep(F.avg(indicator(F.abs(d) <= 5))).alias("within_5"), keep(F.avg(indicator(F.abs(d) <= 10))).alias("within_10"),
    )


def pair_kappas(df: DataFrame, raters: Sequence[str], degenerate_zero: bool = False) -> DataFrame:
    """(rater_a, rater_b, kappa) for all pairs of 0/1 columns, in one pass."""
    pairs = list(combinations(raters, 2))
    one = df.agg(*[kappa(a, b, degenerate_zero).alias(f"k{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), F.col(f"k{i}").alias("kappa")) for i, (a, b) in enumerate(pairs)])))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n11, n10, n01, n00, kappa, pabak, ac1, mcc of two 0/1 columns."""
    x, y = both(a, b)
    cell = lambda i, j: F.count_if((x == i) & (y == j))
    one = df.agg(cell(1, 1).alias("n11"), cell(1, 0).alias("n10"), cell(0, 1).alias("n01"), cell(0, 0).alias("n00"), kappa(a, b).alias("kappa"), F.avg((x == y).cast("double")).alias("po"), ((F.avg(x.cast("double")) + F.avg(y.cast("double"))) / 2).alias("q"))
    c = {n: F.col(n).cast("double") for n in ("n11", "n10", "n01", "n00")}
    chance = 2 * F.col("q") * (1 - F.col("q"))
    sides = (c["n11"] + c["n10"]) * (c["n11"] + c["n01"]) * (c["n00"] + c["n10"]) * (c["n00"] + c["n01"])
    return one.select("n11", "n10", "n01", "n00", "kappa", (2 * F.col("po") - 1).alias("pabak"), ratio(F.col("po") - chance, 1 - chance).alias("ac1"), ratio(c["n11"] * c["n00"] - c["n10"] * c["n01"], F.sqrt(sides)).alias("mcc"))


def multi_rater(df: DataFrame, in_house: str, published: Sequence[str], threshold: float = 0.7, least: int = 5) -> DataFrame:
    """One row: n, pass rate of the in-house score (>= ``threshold``) and of each published 0/1 rater, all kappas, the median of the
    published raters' kappas, shares where all published raters pass, all fail, and all fail while in-house passes."""
    own = F.coalesce((F.col(in_house) >= threshold).cast("int"), F.lit(0)).alias("in_house")
    rows = df.select(own, *published)
    raters = ["in_house", *published]
    pairs = list(combinations(raters, 2))
    all_pass, all_fail = F.lit(True), F.lit(True)
    for p in published:
        all_pass, all_fail = all_pass & (F.col(p) == 1), all_fail & (F.col(p) == 0)
    n = F.count(F.lit(1))
    keep = lambda e: F.when(n >= least, e)
    one = rows.agg(
        n.alias("n"), *[keep(F.avg(F.col(r).cast("double"))).alias(f"pass_{r}") for r in raters], *[keep(kappa(a, b)).alias(f"kappa_{a}_{b}") for a, b in pairs],
        keep(F.avg(indicator(all_pass))).alias("published_all_pass"), keep(F.avg(indicator(all_fail))).alias("published_all_fail"), keep(F.avg(indicator(all_fail & (F.col("in_house") == 1)))).alias("only_in_house_passes"),
    )
    own_pairs = F.array_sort(F.array_compact(F.array(*[F.col(f"kappa_{a}_{b}") for a, b in combinations(published, 2)])))
    k = F.size(own_pairs)
    middle = F.when(k > 0, (F.get(own_pairs, F.floor((k - 1) / 2).cast("int")) + F.get(own_pairs, F.floor(k / 2).cast("int"))) / 2)
    return one.withColumn("median_published_kappa", middle)


def three_way(df: DataFrame, in_house: str, template: str, amplitude_cv: str, orphanidou: str, sukor: str, threshold: float = 0.7) -> DataFrame:
    """In-house against two published methods: rank correlations of their scores, kappas and shares.

    A NULL template correlation is 0; the second method's score is 1 less its clipped amplitude variation.
    """
    score = df.select(F.col(in_house).alias("own"), F.coalesce(F.col(template), F.lit(0.0)).alias("tpl"), (1 - clip(amplitude_cv, 0, 2)).alias("amp"))
    out = multi_rater(df, in_house, [orphanidou, sukor], threshold).drop("median_published_kappa")
    return out.join(F.broadcast(spearmans(score, {f"rho_{a}_{b}": (a, b) for a, b in (("own", "tpl"), ("own", "amp"), ("tpl", "amp"))}, least=5)))


def head_to_head(df: DataFrame, in_house: str, template: str, accepted: str, by: Sequence[str] = (), threshold: float = 0.7) -> DataFrame:
    """In-house score against one method: rank correlation with its template score, point-biserial correlation and the 2 x 2 table."""
    rows = df.filter(F.col(in_house).isNotNull()).select(*by, F.col(in_house).alias("own"), F.coalesce(F.col(template), F.lit(0.0)).alias("tpl"), F.col(accepted).cast("double").alias("ok"))
    cell = lambda p, q: F.count_if(((F.col("own") >= threshold) == p) & ((F.col("ok") == 1) == q))
    table = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr("own", "ok", 3, 1e-12).alias("point_biserial"), cell(True, True).alias("both_pass"), cell(True, False).alias("only_in_house"), cell(False, True).alias("only_method"), cell(False, False).alias("both_fail"))
    rho = spearman(rows, "own", "tpl", by).select(*by, "rho")
    return table.join(rho, list(by), "left") if by else table.join(F.broadcast(rho))


def motion_effect(df: DataFrame, motion: str, error: str, quality: Sequence[str]) -> DataFrame:
    """One row: top-quartile motion, mean error above and below it, rank correlations of motion with error and each quality column."""
    q75 = quantiles(df, [motion], [0.75])[motion][0]
    high = F.col(motion) >= F.lit(q75).cast("double")
    out = df.withColumn("q75", F.lit(q75).cast("double")).groupBy("q75").agg(F.avg(F.when(high, F.col(error))).alias("error_high"), F.avg(F.when(~high, F.col(error))).alias("error_low"), F.count(motion).alias("n"))
    return out.join(F.broadcast(spearmans(df, {f"rho_{c}": (motion, c) for c in (error, *quality)})))


# calibration


def _bins(df: DataFrame, p: str, label: str, bins: int) -> DataFrame:
    rows = df.select(F.col(p).alias("__p"), F.col(label).cast("double").alias("__y")).filter("__p is not null and __y is not null")
    return rows.withColumn("bin", F.least(F.floor(F.col("__p") * bins), F.lit(bins - 1)).cast("int"))


def calibration_bins(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, rate): accuracy of the decision at 0.5, rate of positives; 1.0 falls in the last bin, empty bins are left out."""
    hit = indicator((F.col("__p") >= 0.5) == (F.col("__y") == 1))
    return _bins(df, p, label, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("__p").alias("confidence"), F.avg(hit).alias("accuracy"), F.avg("__y").alias("rate"))


def expected_calibration_error(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, p, label, bins)
    return b.agg(ratio(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n").cast("double")).alias("ece"), F.sum("n").alias("n"))


# ranking curves: everything below starts from one table of different scores with their counts


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    rows = df.select(*by, F.col(score).alias("score"), F.col(label).cast("long").alias("__y")).filter("score is not null and __y is not null")
    return rows.groupBy(*by, "score").agg(F.sum("__y").alias("pos"), F.sum(1 - F.col("__y")).alias("neg"))


def _curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """The curve's points, with tpr_before and fpr_before, those of the next higher score (0 at the highest)."""
    counts = cut(score_counts(df, score, label))
    all_pos, all_neg = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first()
    c = running_sums(counts, [F.col("score").desc()], {"tp0": F.col("pos"), "fp0": F.col("neg")}).withColumns({"tp": F.col("tp0") + F.col("pos"), "fp": F.col("fp0") + F.col("neg")})
    tp, fp, p, n = F.col("tp").cast("double"), F.col("fp").cast("double"), F.lit(float(all_pos)), F.lit(float(all_neg))
    return c.select(
        "score", "tp", "fp", ratio(tp, p).alias("tpr"), ratio(fp, n).alias("fpr"), ratio(tp, tp + fp).alias("precision"), ratio(tp, p).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + (p - tp)).alias("f1"), (ratio(tp, p) - ratio(fp, n)).alias("youden"), ((ratio(tp, p) + 1 - ratio(fp, n)) / 2).alias("balanced_accuracy"),
        ratio(F.col("tp0").cast("double"), p).alias("tpr_before"), ratio(F.col("fp0").cast("double"), n).alias("fpr_before"),
    )


def ranking_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, tp, fp, tpr, fpr, precision, recall, f1, youden, balanced_accuracy) when rows from ``score`` up are positive.

    Ties are one point. Different scores are summed in ranges, so no task sees them all.
    """
    return _curve(df, score, label).drop("tpr_before", "fpr_before")


def best_thresholds(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: AUROC, average precision, the thresholds of the best Youden index and F1 (ties: the highest threshold)."""
    best = lambda c: F.max_by("score", F.struct(F.col(c), F.col("score")))
    return _curve(df, score, label).agg(
        F.sum((F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2).alias("auroc"), F.sum((F.col("recall") - F.col("tpr_before")) * F.col("precision")).alias("average_precision"),
        best("youden").alias("youden_threshold"), F.max("youden").alias("youden"), best("f1").alias("f1_threshold"), F.max("f1").alias("f1"),
    )


def threshold_intervals(df: DataFrame, score: str, label: str, replicates: int = 200, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: bounds of AUROC, average precision and the best Youden and F1 thresholds over resampled rows.

    Resampling rows is drawing Poisson counts for the cells (score, label); the curves of all replicates are built from these by sums in
    ranges of (replicate, score), so no task sees all different scores.
    """
    drawn = _drawn(score_counts(df, score, label), 1, replicates, seed)
    sums = running_sums(drawn, [F.col("score").desc()], {"tp_before": F.col("p"), "fp_before": F.col("q")}, ["b"])
    totals = drawn.groupBy("b").agg(F.sum("p").cast("double").alias("all_p"), F.sum("q").cast("double").alias("all_n"))
    c = sums.join(F.broadcast(totals), "b").withColumns({"tp": (F.col("tp_before") + F.col("p")).cast("double"), "fp": (F.col("fp_before") + F.col("q")).cast("double")})
    tp, fp = F.col("tp"), F.col("fp")
    best = lambda e: F.max_by("score", F.struct(e, F.col("score")))
    by = c.groupBy("b").agg(
        F.sum(ratio(F.col("q") * (tp - F.col("p") / 2), F.col("all_p") * F.col("all_n"))).alias("auroc"), F.sum(ratio(F.col("p"), F.col("all_p")) * F.coalesce(ratio(tp, tp + fp), F.lit(0.0))).alias("average_precision"),
        best(ratio(tp, F.col("all_p")) - ratio(fp, F.col("all_n"))).alias("youden_threshold"), best(ratio(2 * tp, tp + fp + F.col("all_p"))).alias("f1_threshold"),
    )
    tail = (1 - confidence) / 2
    return by.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in ("auroc", "average_precision", "youden_threshold", "f1_threshold") for name, q in (("low", tail), ("high", 1 - tail))])


def f1_score(prediction: Column, label: Column) -> Column:
    """0 where undefined."""
    tp, wrong = F.count_if(prediction & label), F.count_if(prediction != label)
    return F.coalesce(ratio(2.0 * tp, (2 * tp + wrong).cast("double")), F.lit(0.0))


def _metrics() -> dict[str, Column]:
    """Of the cells tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    po, pa, pb = ratio(tp + tn, n), ratio(tp + fp, n), ratio(tp + fn, n)
    pe = pa * pb + (1 - pa) * (1 - pb)
    return {"n": n.cast("long"), "n_pass": (tp + fp).cast("long"), "agreement": po, "kappa": F.when(pe < 1 - 1e-9, ratio(po - pe, 1 - pe)), "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))}


def threshold_cells(df: DataFrame, score: str, label: str, thresholds: Sequence[float], by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """(by, threshold, tp, fp, fn, tn) for each threshold of a fixed list.

    Rows are first summed by (score, label), then by how many thresholds the score passes, and the grid
    meets these few sums; rows and thresholds are never paired.
    """
    grid = sorted(float(t) for t in thresholds)
    counts = score_counts(df, score, label, by)
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: (F.col("score") > t) if strict else (F.col("score") >= t)))
    steps = counts.withColumn("passed", passed).groupBy(*by, "passed").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spread = steps.select(*by, "passed", "pos", "neg", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "threshold"))
    hit = F.col("passed") > F.col("i")
    cells = (("tp", hit, "pos"), ("fp", hit, "neg"), ("fn", ~hit, "pos"), ("tn", ~hit, "neg"))
    return spread.groupBy(*by, "threshold").agg(*[F.sum(F.when(c, F.col(v)).otherwise(0)).cast("double").alias(n) for n, c, v in cells])


def threshold_grid(df: DataFrame, score: str, label: str, thresholds: Sequence[float], by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """(by, threshold, n, n_pass, agreement, kappa, f1)."""
    return threshold_cells(df, score, label, thresholds, by, strict).select(*by, "threshold", *[c.alias(n) for n, c in _metrics().items()])


def recalibrate(df: DataFrame, score: str, label: str, thresholds: Sequence[float], metric: str = "kappa", by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """The threshold of the best ``metric``; ties go to the lowest threshold."""
    grid = threshold_grid(df, score, label, thresholds, by, strict).filter(F.col(metric).isNotNull())
    best = F.struct(F.col(metric), -F.col("threshold"))
    return grid.groupBy(*by).agg(F.max_by("threshold", best).alias("threshold"), F.max(metric).alias(metric))


def recalibrate_with_holdout(df: DataFrame, score: str, label: str, row_id: str, thresholds: Sequence[float], seed: int = 0) -> DataFrame:
    """Tunes on one half of the rows and reports kappa and agreement on the other; halves by a hash of the row id."""
    half = hashed_uniform(F.lit(seed), F.col(row_id)) < 0.5
    best = recalibrate(df.filter(half), score, label, thresholds).select("threshold", F.col("kappa").alias("calibration_kappa"))
    held = threshold_grid(df.filter(~half), score, label, thresholds)
    return held.join(F.broadcast(best), "threshold").select("threshold", "calibration_kappa", F.col("kappa").alias("holdout_kappa"), F.col("agreement").alias("holdout_agreement"), F.col("n").alias("n_holdout"))


def loso_recalibration(df: DataFrame, score: str, label: str, group: str, thresholds: Sequence[float]) -> DataFrame:
    """(group, threshold, train_kappa, held_kappa): for each group the threshold tuned on all the others.

    Groups are reduced to their four cells at each threshold; the others' cells are the total less the group's own.
    """
    cells = ["tp", "fp", "fn", "tn"]
    own = threshold_cells(df, score, label, thresholds, [group])
    total = own.groupBy("threshold").agg(*[F.sum(c).alias(f"all_{c}") for c in cells])
    held = own.withColumn("held_kappa", _metrics()["kappa"]).join(total, "threshold")
    rest = held.select(group, "threshold", "held_kappa", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in cells]).withColumn("train_kappa", _metrics()["kappa"]).filter("train_kappa is not null")
    best = F.struct("train_kappa", -F.col("threshold"))
    return rest.groupBy(group).agg(F.max_by("threshold", best).alias("threshold"), F.max("train_kappa").alias("train_kappa"), F.max_by("held_kappa", best).alias("held_kappa"))


def auroc_interval(df: DataFrame, score: str, label: str, replicates: int = 200, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(auroc, ci_low, ci_high, n): AUROC with a bootstrap interval.

    Resampling rows is resampling the counts of (score, label): each replicate draws Poisson counts with these
    means, so the work is different scores x replicates, whatever the number of rows.
    """
    counts = cut(score_counts(df, score, label))
    drawn = running_sums(_drawn(counts, 0, replicates, seed), [F.col("score")], {"below": F.col("q")}, ["b"])
    by = drawn.withColumn("u", F.col("p") * (F.col("below") + F.col("q") / 2)).groupBy("b").agg(ratio(F.sum("u"), (F.sum("p") * F.sum("q")).cast("double")).alias("a"))
    boot, tail = F.when(F.col("b") > 0, F.col("a")), (1 - confidence) / 2
    one = by.agg(F.max(F.when(F.col("b") == 0, F.col("a"))).alias("auroc"), F.percentile(boot, F.lit(tail)).alias("ci_low"), F.percentile(boot, F.lit(1 - tail)).alias("ci_high"))
    return one.join(F.broadcast(counts.agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))))


#: Means up to which a Poisson draw inverts the distribution; above, a normal draw with the skewness put in is rounded.
INVERTED = 30


def _drawn(counts: DataFrame, first: int, last: int, seed: int) -> DataFrame:
    """(b, score, p, q): for replicates ``first`` to ``last`` the Poisson draws of the cells' counts; replicate 0 is the counts themselves."""
    cells = counts.withColumn("b", F.explode(F.sequence(F.lit(first), F.lit(last))))
    draw = lambda c, name: F.when(F.col("b") == 0, F.col(c)).otherwise(_poisson(F.col(c), F.lit(seed), F.lit(name), F.col("b"), F.col("score"))).cast("long")
    return cells.select("b", "score", draw("pos", "pos").alias("p"), draw("neg", "neg").alias("q"))


def _poisson(mean: Column, *key: Column) -> Column:
    """A Poisson draw of ``mean`` from the hash of ``key``: the same on any cluster and in SQL."""
    steps = F.sequence(F.lit(0), F.ceil(mean + 10 * F.sqrt(mean) + 10).cast("int"))
    start = lambda u: F.struct(u.alias("u"), F.exp(-mean.cast("double")).alias("term"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"))

    def step(s, k):
        total = s["total"] + s["term"]
        return F.struct(s["u"].alias("u"), (s["term"] * mean / (k + 1)).alias("term"), total.alias("total"), (s["n"] + (total < s["u"]).cast("long")).alias("n"))

    small = F.aggregate(steps, start(hashed_uniform(*key)), step)["n"]
    z = F.sqrt(-2 * F.log(hashed_uniform(*key, F.lit("r")))) * F.cos(2 * math.pi * hashed_uniform(*key, F.lit("a")))
    large = F.get(F.transform(F.array(z), lambda v: F.floor(F.greatest(F.lit(0.0), mean + F.sqrt(mean) * v + (v * v - 1) / 6) + 0.5)), F.lit(0))
    return F.when(mean == 0, 0).when(mean <= INVERTED, small).otherwise(large)
