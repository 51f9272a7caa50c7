"""Statistics as column expressions. Aggregates skip NULL; undefined values are NULL, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import running_sums

#: Spread below this is flat.
FLAT = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL if b is 0 or either is NULL."""
    return F.try_divide(a, b)


def clip(c: Column | str, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def indicator(condition: Column) -> Column:
    return F.when(condition, 1.0).when(~condition, 0.0)


def flag(condition: Column) -> Column:
    """0 or 1, NULL counting as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def both(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """x and y, each NULL where the other is."""
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def safe_corr(x: Column | str, y: Column | str, least: int = 2, flat: float = FLAT) -> Column:
    """Pearson correlation of complete pairs; NULL for under ``least`` pairs or a spread of at most ``flat``."""
    a, b = both(x, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (sa > flat) & (sb > flat), ratio(F.covar_pop(a, b), sa * sb))


def strict_corr(x: Column | str, y: Column | str, flat: float = FLAT) -> Column:
    """Pearson correlation that is NULL as soon as one value is."""
    x, y = col(x), col(y)
    return F.when((F.count(x) == F.count(F.lit(1))) & (F.count(y) == F.count(F.lit(1))), safe_corr(x, y, 2, flat))


def percentile(c: Column | str, q: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(col(c), F.lit(q))


def kappa(a: Column | str, b: Column | str, degenerate_zero: bool = False) -> Column:
    """Cohen's kappa of two 0/1 raters. If chance agreement is 1: NULL, or 0 with ``degenerate_zero``."""
    a, b = both(a, b)
    po, pa, pb = F.avg((a == b).cast("double")), F.avg(a.cast("double")), F.avg(b.cast("double"))
    pe = pa * pb + (1 - pa) * (1 - pb)
    value = F.when(pe < 1 - 1e-9, ratio(po - pe, 1 - pe))
    if not degenerate_zero:
        return value
    constant = (pa == 0) | (pa == 1) | (pb == 0) | (pb == 1)
    return F.when(constant, 0.0).otherwise(value)


def sample_skewness(c: Column | str) -> Column:
    """Bias-corrected skewness; NULL for under 3 values or a flat group."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1).cast("double")) / (n - 2))


def sample_kurtosis(c: Column | str) -> Column:
    """Bias-corrected kurtosis, 3 for a normal distribution; NULL for under 4 values or a flat group."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6) + 3)


def with_average_rank(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the average rank of ``value`` among its non-null values, within ``by``.

    Ranks come from the counts of different values, summed over ranges of them, so no task sees a group as a whole.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_sums(counts, [F.col(value)], {"__before": F.col("__n")}, by)
    ranked = placed.select(*by, value, (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(ranked, [*by, value], "left") if not by else df.join(ranked, _null_safe(df, ranked, [*by, value]), "left").drop(*[ranked[c] for c in (*by, value)])


def _null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Rank correlation of the complete pairs, by group: columns ``by``, n, rho (NULL for under ``least`` pairs or a flat side)."""
    pairs = df.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).filter("__x is not null and __y is not null")
    ranked = with_average_rank(with_average_rank(pairs, "__x", "__rx", by), "__y", "__ry", by)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr("__rx", "__ry", least, 0.0).alias("rho"))


def spearmans(df: DataFrame, pairs: dict[str, tuple[str, str]], least: int = 3) -> DataFrame:
    """One row with a rank correlation for each of ``pairs``, as ``spearman`` has it, from one pass over ranges for all of them.

    Rows become counts of different pairs of values, the counts of each side's values are summed in ranges of (pair, side, value), and the ranks go back
    to the counts.
    """
    both_of = [F.struct(F.lit(n).alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for n, (x, y) in pairs.items()]
    cells = cut(df.select(F.inline(F.array(*both_of))).filter("x is not null and y is not null").groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    sides = cells.select("pair", "n", F.inline(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("x", "y")])))
    placed = running_sums(sides.groupBy("pair", "side", "v").agg(F.sum("n").alias("n")), [F.col("v")], {"before": F.col("n")}, ["pair", "side"])
    rank = cut(placed.select("pair", "side", "v", (F.col("before") + (F.col("n") + 1) / 2.0).alias("r")))
    side = lambda c: rank.filter(F.col("side") == c).select("pair", F.col("v").alias(c), F.col("r").alias(f"r{c}"))
    ranked = cells.join(side("x"), ["pair", "x"]).join(side("y"), ["pair", "y"])
    total = cells.groupBy("pair").agg(F.sum("n").cast("double").alias("all_n"))
    a, b = (F.col(r) - (F.col("all_n") + 1) / 2 for r in ("rx", "ry"))
    sums = ranked.join(F.broadcast(total), "pair").groupBy("pair", "all_n").agg(*[F.sum(F.col("n") * e).alias(name) for name, e in (("xy", a * b), ("xx", a * a), ("yy", b * b))])
    rho = F.when((F.col("all_n") >= least) & (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return sums.agg(*[F.max(F.when(F.col("pair") == name, rho)).alias(name) for name in pairs])


def rank_sums(df: DataFrame, value: str, group: Column, by: Sequence[str] = ()) -> DataFrame:
    """The rank-sum family for two groups (``group`` true: a, false: b, NULL: neither), within ``by``.

    n_a, n_b, rank_sum_a, u_a (Mann-Whitney), auroc = u / (n_a n_b), cliffs_delta, z (normal, without tie
    correction, as for the rank-sum test) and ties (sum of t^3 - t).
    """
    rows = df.select(*by, F.col(value).alias("__v"), group.alias("__g")).filter("__v is not null and __g is not null")
    counts = rows.groupBy(*by, "__v").agg(F.sum(F.col("__g").cast("long")).alias("__a"), F.count(F.lit(1)).alias("__n"))
    placed = running_sums(counts, [F.col("__v")], {"__before": F.col("__n")}, by)
    ranked = placed.withColumn("__r", F.col("__before") + (F.col("__n") + 1) / 2.0)
    n = F.col("__n").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("__a").alias("n_a"), F.sum(F.col("__n") - F.col("__a")).alias("n_b"), F.sum(F.col("__r") * F.col("__a")).alias("rank_sum_a"), F.sum(n * n * n - n).alias("ties"))
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("rank_sum_a") - a * (a + 1) / 2
    return sums.select(
        *by, "n_a", "n_b", "rank_sum_a", u.alias("u_a"), ratio(u, a * b).alias("auroc"), (2 * ratio(u, a * b) - 1).alias("cliffs_delta"),
        ratio(F.col("rank_sum_a") - a * (a + b + 1) / 2, F.sqrt(a * b * (a + b + 1) / 12)).alias("z"), "ties",
    )


def normal_p(z: Column, sides: int = 2) -> Column:
    """Upper-tail p-value of a standard normal score, doubled for two sides.

    A rational approximation of the error function (Abramowitz and Stegun 7.1.26) keeps it in the JVM;
    its error is below 2e-7.
    """
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    upper = F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)
    return erfc if sides == 2 else upper


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts' texts: the same for equal parts on any cluster and in SQL."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / 2.0**52


#: Added before results are rounded, so that means which end in an exact 5 don't depend on the last bit.
NUDGE = 3e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, as results are reported."""
    return df.select(*[F.round(F.col(c) + NUDGE, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
