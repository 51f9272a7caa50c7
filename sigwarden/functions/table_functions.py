"""Table functions for SQL: change-point scans of any table's series.

``SELECT * FROM change_points(TABLE(days), 'participant_id', 'date', 'resting_hr', 'binary_segmentation')`` scans each key's values in order. The
function itself asks for the table by key and in order, so a series is one task's work, as its order matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import kernels as k

SCANS = {"binary_segmentation": k.binary_segmentation, "bocpd": k.bocpd}
#: Finite values that a series must have to be scanned.
LEAST = 14


class ChangePoints:
    """(key, index, score, before_mean, after_mean, delta, method) for each change-point; the key has the table's name and type."""

    def __init__(self, *_):
        self.key, self.values, self.find, self.at = None, [], None, None

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument, method: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        fields = {f.name: f for f in table.dataType}
        for a in (key, order, value, method):
            if a.value is None or (a is not method and a.value not in fields):
                raise ValueError(f"{a.value!r} is no column of the table" if a.value is not None else "names must be constants")
        if method.value not in SCANS:
            raise ValueError(f"method must be one of {sorted(SCANS)}")
        schema = T.StructType([T.StructField(key.value, fields[key.value].dataType), T.StructField("index", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("score", "before_mean", "after_mean", "delta")], T.StructField("method", T.StringType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value, ascending=True, overrideNullsFirst=True)])

    def eval(self, row, key: str, order: str, value: str, method: str) -> None:
        self.key, self.find = row[key], SCANS[method]
        if row[value] is not None:
            self.values.append(float(row[value]))

    def terminate(self) -> Iterator[tuple]:
        x = np.array(self.values)
        x = x[np.isfinite(x)]
        if self.key is not None and len(x) >= LEAST:
            for c in self.find(x):
                yield (self.key, c["index"], c["score"], c["before_mean"], c["after_mean"], c["delta"], c["method"])


def register(spark: SparkSession) -> None:
    spark.udtf.register("change_points", udtf(ChangePoints))
