"""What the operators of this subpackage share: durable intermediate tables and size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder, cut  # noqa: F401

#: A side is broadcast only after it was counted and has at most this many rows (of a few dozen bytes each).
BROADCAST_ROWS = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The white space that separates words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes an intermediate folder of our own through the file system that Spark uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Joins ``left`` to the already cut ``right``, which has one row for each key.

    ``right`` is broadcast only if it was counted to at most BROADCAST_ROWS rows. Else both sides are
    shuffled by plain exchanges, so that adaptive execution can split a hot key of ``left``.
    """
    if rows is None:
        rows = right.limit(BROADCAST_ROWS + 1).count()
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... among the rows that are equal in ``by`` (null-safe), in no stated order.

    Rows are numbered within their partition and moved on by the counts of the partitions before it, so a group,
    however large, is never one task's work and no array of it is built.
    """
    at, before = free_name(rows, "partition_no"), free_name(rows, "rows_before")
    held = cut(rows.withColumn(at, F.spark_partition_id()))
    counts = held.groupBy(*by, at).agg(F.count(F.lit(1)).alias(name))
    earlier = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select(*[F.col(c).alias(f"{before}_{c}") for c in (*by, at)], F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(before)))
    own = held.withColumn(name, F.row_number().over(Window.partitionBy(*by, at).orderBy(F.lit(0))) - 1)
    same = F.lit(True)
    for c in (*by, at):
        same = same & F.col(c).eqNullSafe(F.col(f"{before}_{c}"))
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return own.join(F.broadcast(counts) if few else counts, same).select(*rows.columns, (F.col(name) + F.col(before)).alias(name))


#: Rows and bytes of an Arrow batch of documents; a worker and the JVM each hold a few batches.
ARROW_ROWS, ARROW_BYTES = 1024, 64 << 20


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ARROW_ROWS rows and ARROW_BYTES bytes.

    Both are settings of the session, which are read when the plan runs, so they stay: each is lowered if it is higher.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    limit = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not limit.isdigit() or not 0 < int(limit) <= ARROW_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


#: Bytes of a slice of a batch: what becomes Python objects at once. One longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def slices(batches, rows: int = 512, size: int = SLICE_BYTES):
    """Slices of Arrow batches of at most ``rows`` rows and about ``size`` bytes, so that only a few texts at a time
    become Python objects and no column of a result outgrows its 32-bit offsets.

    After the last one, memory that is free goes back to the system: workers are kept for later stages.
    """
    for batch in batches:
        at, large = 0, batch.nbytes > size
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while large and n > 1 and batch.slice(at, n).nbytes > size:
                n //= 2
            yield batch.slice(at, n)
            at += n
    release()


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def as_bytes(column) -> list:
    """An Arrow string column's values as UTF-8 bytes or None."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def replaced(batch, schema, **columns):
    """``batch`` in the shape of the Arrow ``schema``, with some columns new."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else batch.column(batch.schema.get_field_index(f.name)) for f in schema], names=[f.name for f in schema])
