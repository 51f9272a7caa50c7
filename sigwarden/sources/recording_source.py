"""Recordings as a data source: ``spark.read.format("recordings").option("dialect", "wesad").load(path)``.

Each file ``S*/S*.pkl`` is one partition. The folder is listed and its files are read by the file system that their URI names (local, hdfs, s3, ...);
``recordings.read_recordings`` goes through Spark's own readers instead.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .recordings import RECORDING, decode


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return RECORDING

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader(self.options)


class RecordingReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dialect = options["path"].rstrip("/"), options.get("dialect", "wesad")
        if self.dialect not in ("wesad", "dalia"):
            raise ValueError(f"unknown dialect {self.dialect!r}")

    def partitions(self) -> list[InputPartition]:
        """A subject's folder without its file gives a warning; a folder without any recording is an error."""
        from pyarrow import fs

        store, root = _store(self.path)
        folders = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name.startswith("S"))
        files = [f"{f}/{f.rsplit('/', 1)[-1]}.pkl" for f in folders]
        there = [i.type == fs.FileType.File for i in store.get_file_info(files)] if files else []
        for f, ok in zip(files, there):
            if not ok:
                warnings.warn(f"{f} is missing and left out", stacklevel=2)
        if not any(there):
            raise FileNotFoundError(f"no recording below {self.path}")
        return [InputPartition(f) for f, ok in zip(files, there) if ok]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.value) as f:
            found = decode(f.read(), partition.value, self.dialect)
        yield tuple(found[c] for c in ("subject_id", "chest_ecg", "wrist_ppg", "wrist_acc", "labels"))


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingSource)
