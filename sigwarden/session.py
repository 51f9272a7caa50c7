"""Sessions with the settings that the operators expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "sigwarden", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with ANSI mode, UTC, Arrow and adaptive execution on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the cluster names the first, and adaptive
    execution coalesces or splits whatever partition count it is configured with.
    """
    conf = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | (extra or {})
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a session on one machine (tests) may leave it unset and then has a
    folder of its own; on a cluster that is an error, since executors could not reach a local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sigwarden-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and writes it to the checkpoint folder that all executors share.

    A lost executor costs no recomputation, and the files go when the result is no longer used.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
