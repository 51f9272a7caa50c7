"""Line deduplication: documents probe a sharded minimal perfect hash instead of joining lines.

1. Each document gives its different line keys as 128-bit hashes; a grouped count (partial before
   the shuffle) gives the number of documents of each key.
2. The different hashes are dealt to shards of about ``SHARD_KEYS`` keys, and each shard becomes a
   minimal perfect hash with a 16-bit fingerprint and a saturated 16-bit count a key (see mphf).
3. Documents probe the arrays. Every line was indexed, so a probe always finds its own slot and no
   false hit is possible short of a collision of 128-bit hashes.

If the whole index has at most ``broadcast_bytes`` it is sent to the executors and the probe is a map
over the documents. A larger index stays where it is, and probes (the text's hash and the line's, no
text) are sent to its shards, a shard with many probes being copied to several tasks. What comes back for
a text is the list of the hashes that it loses, by which the documents are joined: through a broadcast if few texts
lose a line, else the documents are shuffled once. Both ways compare the same 128 bits and give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .mphf import Index, build
from .runtime import arrow_map, as_bytes, cut, free_name, lookup, replaced, slices

SHARD_KEYS = 65_536
#: Probes that one task answers in a row before a shard is copied to another task (sharded way only).
SHARD_PROBES = 2_000_000


def line_keys(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines and, for each, the digest of its key, or None if the key is shorter than ``min_chars`` code points."""
    lines = (text or b"").split(b"\n")
    keys = [x.strip().lower() for x in lines]
    if min_chars <= 1:
        long = [len(k) >= min_chars for k in keys]
    else:
        long = [len(k.decode("utf-8", "replace")) >= min_chars for k in keys]
    return lines, [xxhash.xxh3_128_digest(k) if x else None for k, x in zip(keys, long)]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = (np.frombuffer(b"".join(digests), np.uint64) if digests else np.zeros(0, np.uint64)).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _keys(docs: DataFrame, text_col: str, min_chars: int, *with_cols) -> DataFrame:
    """A row (a, b) for each different key of each document, with the columns ``with_cols``."""
    rows = docs.select(F.col(text_col).alias("text"), *with_cols)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, source = [], []
            for i, text in enumerate(as_bytes(batch.column(0))):
                own = {d for d in line_keys(text, min_chars)[1] if d is not None}
                digests += own
                source += [i] * len(own)
            if digests:
                a, b = _halves(digests)
                more = [batch.column(k).take(pa.array(source)) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*more, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=schema.names)

    return arrow_map(rows, run, schema)


def line_index(docs: DataFrame, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """The index: shard, blob, probes (how many document-key pairs fall on the shard). ``shards`` is on every row."""
    counts = cut(_keys(docs, text_col, min_chars).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    shards = max(1, -(-counts.count() // SHARD_KEYS))

    def shard_index(pdf):
        import pandas as pd

        blob = build(pdf["a"].to_numpy(np.int64).view(np.uint64), pdf["b"].to_numpy(np.int64).view(np.uint64), np.minimum(pdf["n"].to_numpy(), min_docs))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "blob": [blob], "probes": [int(pdf["n"].sum())]})

    keyed = counts.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    return cut(keyed.groupBy("shard").applyInPandas(shard_index, "shard int, blob binary, probes long").withColumn("shards", F.lit(shards)))


def _probe(indexes: dict[int, Index], shards: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shard = a.view(np.int64) % shards
    out = np.zeros(len(a), np.uint16)
    order = np.argsort(shard, kind="stable")
    ends = np.flatnonzero(np.diff(shard[order], append=-1))
    at = 0
    for end in ends + 1 if len(a) else []:
        own = order[at:end]
        out[own] = indexes[int(shard[own[0]])].get(a[own], b[own])
        at = end
    return out


_LOADED: dict[str, dict[int, Index]] = {}


def _loaded(key: str, sent) -> dict[int, Index]:
    """The broadcast shards, unpacked once in each Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = {s: Index(blob) for s, blob in sent.value}
    return _LOADED[key]


def _dropping(schema: T.StructType, text_at: str, min_chars: int, flags) -> callable:
    """A function for mapInArrow that takes lines out of texts; ``flags(batch, digests, source)`` tells for each
    digest (of the document with number source in the batch) whether it goes."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, source, docs = [], [], []
            for i, text in enumerate(as_bytes(batch.column(batch.schema.get_field_index(text_at)))):
                lines, own = line_keys(text, min_chars)
                docs.append((lines, own))
                digests += [d for d in own if d is not None]
                source += [i] * (len(own) - own.count(None))
            goes = iter(flags(batch, digests, source))
            texts, n_lines, n_dropped = [], [], []
            for lines, own in docs:
                stay = [x for x, d in zip(lines, own) if d is None or not next(goes)]
                texts.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield replaced(batch, arrow, **{text_at: pa.array(texts, pa.binary()).cast(pa.string()).cast(arrow.field(text_at).type), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    return run


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without the lines whose key is found in at least ``min_docs`` (at most 65,535) documents.

    A text is split at ``\\n``; a line's key is the line without white space (U+0020, U+0009-U+000D)
    at both ends and with A-Z lower-cased. Keys under ``min_chars`` code points are never dropped. The
    columns of ``docs`` stay, with the remaining lines joined by ``\\n`` as the text; ``n_lines`` (before)
    and ``n_dropped`` are added, or replace columns of these names. A null or empty text is one empty
    line and comes back empty. Repeated rows count as documents of their own. An empty table gives none.
    """
    if not 1 <= min_docs <= 65_535:
        raise ValueError("min_docs must be from 1 to 65,535")
    docs = docs.drop("n_lines", "n_dropped")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    index = line_index(docs, text_col, min_docs, min_chars)
    size, shards = index.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)), F.coalesce(F.max("shards"), F.lit(1))).first()
    if size <= broadcast_bytes:
        key = uuid.uuid4().hex
        sent = docs.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in index.select("shard", "blob").toLocalIterator()])

        def flags(batch, digests, source):
            a, b = _halves(digests)
            return (_probe(_loaded(key, sent), shards, a, b) >= min_docs).tolist()

        return arrow_map(docs, _dropping(schema, text_col, min_chars, flags), schema)
    return _drop_sharded(docs, index, schema, text_col, min_docs, min_chars, shards)


def _drop_sharded(docs: DataFrame, index: DataFrame, schema: T.StructType, text_col: str, min_docs: int, min_chars: int, shards: int) -> DataFrame:
    """The way for an index that is too large to be sent to every executor.

    Rows are known by 128 bits of their text, so equal texts are probed and answered once.
    """
    known, lost_col = free_name(docs, "row"), free_name(docs, "lost")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))
    spread = index.select("shard", F.greatest(F.lit(1), F.ceil(F.col("probes") / SHARD_PROBES)).cast("int").alias("copies"))
    probes = _keys(docs, text_col, min_chars, row.alias("row")).withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).distinct()
    probes = lookup(probes, cut(spread), ["shard"], "inner").select("shard", F.pmod(F.xxhash64("row", "a"), F.col("copies")).cast("int").alias("copy"), "row", "a", "b", F.lit(None).cast("binary").alias("blob"))
    none = lambda t: F.lit(None).cast(t)
    blobs = index.join(spread, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), none("struct<x:long,y:long>").alias("row"), none("long").alias("a"), none("long").alias("b"), "blob")
    meeting = probes.unionByName(blobs).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("blob").isNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in slices(batches, 65_536, 1 << 30):
            blob, at = batch.column(5), 0
            heads = np.flatnonzero(blob.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for end in [*heads, batch.num_rows]:
                if end > at and own is not None:
                    part = batch.slice(at, end - at)
                    a, b = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
                    goes = pa.array(own.get(a.view(np.uint64), b.view(np.uint64)) >= min_docs)
                    yield pa.RecordBatch.from_arrays([part.column(2).filter(goes), pa.array(a).filter(goes), pa.array(b).filter(goes)], names=["row", "a", "b"])
                if end < batch.num_rows:
                    own, at = Index(blob[end].as_py()), end + 1

    lost = arrow_map(meeting, answer, "row struct<x:long,y:long>, a long, b long")
    lost = cut(lost.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("lost")).select(F.col("row").alias(known), F.col("lost").alias(lost_col)))
    entries = lost.agg(F.coalesce(F.sum(F.size(lost_col)), F.lit(0))).first()[0]  # the lists' size decides on the broadcast
    joined = lookup(docs.withColumn(known, row), lost, [known], rows=entries).drop(known)

    def flags(batch, digests, source):
        gone = [{(x["a"], x["b"]) for x in own or ()} for own in batch.column(batch.schema.get_field_index(lost_col)).to_pylist()]
        a, b = _halves(digests)
        return [x in gone[i] for x, i in zip(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()), source)]

    return arrow_map(joined, _dropping(schema, text_col, min_chars, flags), schema)
