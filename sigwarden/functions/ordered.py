"""Running totals over an order without gathering it in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds, for each name of ``sums``, the sum of its column over the rows before, by ``order`` and within ``by``.

    Rows are dealt to ranges of (by, order), summed within their range, and moved on by the totals of the ranges
    before: a range is one task's work, and the only window over many ranges sees one row for each range and group.
    Rows that are equal in (by, order) are summed in no stated order, so make the order total where that matters.
    """
    part = "__range"
    keys = [F.col(b) for b in by]
    ranged = df.withColumns({f"__s_{n}": c for n, c in sums.items()}).repartitionByRange(*[k.asc_nulls_first() for k in keys], *order).withColumn(part, F.spark_partition_id())
    held = cut(ranged)
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*by, part).agg(*[F.sum(f"__s_{n}").alias(n) for n in sums])
    moved = totals.select(*[F.col(b).alias(f"__b_{b}") for b in by], F.col(part).alias("__at"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__t_{n}") for n in sums])
    within = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = held.select("*", *[F.coalesce(F.sum(f"__s_{n}").over(within), F.lit(0)).alias(f"__w_{n}") for n in sums])
    same = F.col(part) == F.col("__at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    return own.join(moved, same).select(*df.columns, *[(F.col(f"__w_{n}") + F.col(f"__t_{n}")).alias(n) for n in sums])


RUN_SUMMARY = "rows long, prefix long, suffix long, longest long, true long, runs long"


def _summaries(flags: np.ndarray) -> tuple[int, ...]:
    """RUN_SUMMARY of flags in order. ``runs`` counts the runs that begin here."""
    n = len(flags)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return n, 0, 0, 0, 0, 0
    lengths = ends - starts
    return n, int(lengths[0] if starts[0] == 0 else 0), int(lengths[-1] if ends[-1] == n else 0), int(lengths.max()), int(lengths.sum()), len(starts)


def merged_runs(summaries: Column) -> Column:
    """One RUN_SUMMARY of an array of them in order: what follows on a run at the end of the one before goes on with it."""
    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(c.split()[0]) for c in RUN_SUMMARY.split(", ")])

    def merge(a, b):
        return F.struct(
            (a["rows"] + b["rows"]).alias("rows"),
            F.when(a["prefix"] == a["rows"], a["rows"] + b["prefix"]).otherwise(a["prefix"]).alias("prefix"),
            F.when(b["suffix"] == b["rows"], a["suffix"] + b["rows"]).otherwise(b["suffix"]).alias("suffix"),
            F.greatest(a["longest"], b["longest"], a["suffix"] + b["prefix"]).alias("longest"),
            (a["true"] + b["true"]).alias("true"),
            (a["runs"] + b["runs"] - ((a["suffix"] > 0) & (b["prefix"] > 0)).cast("long")).alias("runs"),
        )

    return F.aggregate(summaries, start, merge)


def run_summaries(df: DataFrame, key: str, order: Sequence[Column], condition: Column) -> DataFrame:
    """(key, rows, prefix, suffix, longest, true, runs): unbroken runs of rows for which ``condition`` holds, in ``order``, by key.

    A summary is associative: rows are dealt to ranges of (key, order), a range gives one summary for each key in it, and a key's
    summaries are merged in the order of the ranges. So a key with any share of all rows is read by as many tasks as it has ranges.
    NULL keys are left out; a NULL condition is false; rows that are equal in ``order`` come in no stated order.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.coalesce(condition, F.lit(False)).cast("byte").alias("f"))
    by = [F.col("k").asc(), *[F.col(f"o{i}").asc_nulls_first() for i in range(len(order))]]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("k", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, waiting = TaskContext.get().partitionId(), 0, None
        names = ["k", "part", "at", *[c.split()[0] for c in RUN_SUMMARY.split(", ")]]

        def out(keys, found):
            nonlocal at
            at += len(keys)
            cols = [pa.array([x[i] for x in found], pa.int64()) for i in range(6)]
            return pa.RecordBatch.from_arrays([pa.array(keys, waiting), pa.array([part] * len(keys), pa.int32()), pa.array(range(at - len(keys), at), pa.int64()), *cols], names=names)

        # A key that goes on beyond its batch gives a summary for each batch; they are merged like those of ranges.
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting = batch.schema.field(0).type
            runs = pc.run_end_encode(batch.column(0))
            ends = [0, *runs.run_ends.to_pylist()]
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            yield out(runs.values.to_pylist(), [_summaries(flags[a:b]) for a, b in zip(ends, ends[1:])])

    found = ranged.mapInArrow(run, f"k {kind}, part int, at long, {RUN_SUMMARY}")
    part = F.struct("part", "at", *[c.split()[0] for c in RUN_SUMMARY.split(", ")])
    return found.groupBy(F.col("k").alias(key)).agg(merged_runs(F.sort_array(F.collect_list(part))).alias("m")).select(key, "m.*")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of each column's values that are not NULL; None without any.

    Different values are counted and their counts summed in order, so no task holds all different values; what
    reaches the driver is two values for each quantile.
    """
    tall = None
    for c in columns:
        one = df.select(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")).filter("value is not null")
        tall = one if tall is None else tall.unionByName(one)
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    if tall is None:
        return out
    counts = cut(tall.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")))
    totals = {r["name"]: r["n"] for r in counts.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    wanted = {(c, int(x)) for c, n in totals.items() for q in shares for x in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}
    placed = running_sums(counts, [F.col("value")], {"before": F.col("n")}, ["name"])
    spots = F.broadcast(df.sparkSession.createDataFrame(sorted(wanted) or [("", 0)], "spot_name string, spot long"))
    at = placed.join(spots, (F.col("name") == F.col("spot_name")) & (F.col("spot") >= F.col("before")) & (F.col("spot") < F.col("before") + F.col("n")))
    found = {(r["name"], r["spot"]): r["value"] for r in at.select("name", "spot", "value").collect()}
    for c, n in totals.items():
        for k, q in enumerate(shares):
            x = q * (n - 1)
            lo, hi = found[c, math.floor(x)], found[c, math.ceil(x)]
            out[c][k] = lo + (hi - lo) * (x - math.floor(x))
    return out


def grouped_medians(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by, n, median) of the values that are not NULL, exact; no task holds all different values of a group."""
    value = F.col(column).cast("double")
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_sums(counts, [F.col("__v")], {"__before": F.col("__n")}, by)
    sizes = counts.groupBy(*[F.col(b).alias(f"__g_{b}") for b in by]).agg(F.sum("__n").alias("n"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__g_{b}"))
    middle = lambda spot: F.max(F.when((F.col("__before") <= spot) & (spot < F.col("__before") + F.col("__n")), F.col("__v")))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    return placed.join(sizes, same).groupBy(*by, "n").agg(((middle(low) + middle(high)) / 2).alias("median"))
