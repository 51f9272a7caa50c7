"""SimHash near-deduplication to a stated Jaccard similarity: candidates from pigeonring chains and from MinHash bands,
each compared exactly.

SimHash alone can't reach a similarity of 0.8: such texts differ in about 10 of 64 bits, for which pigeonring keys would
be 4 bits wide. So a text's candidates are all texts of its SimHash component (chains within ``bits`` bits) and, in
addition, all that share a MinHash band with it. Only texts that are similar by the exact count are linked.

A text's set holds the XXH64 of its different shingles of ``words`` words. Rows with equal sets are one node. BANDS
keys of BAND_ROWS minima each make two sets of similarity s candidates with probability
1 - (1 - s ** BAND_ROWS) ** BANDS, which is 1 - 3.2e-6 at 0.8. Only sets that share a key with another are sent to
that key. There all sets are compared exactly, breadth first: a set that was reached is not compared again, so a group
of near copies emits a forest and not its pairs. No group is capped: one over BLOCK shingles goes in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .runtime import BROADCAST_ROWS, arrow_map, as_bytes, cut, lookup, slices
from .simhash import fingerprint_links, fingerprint_of, shingle_hashes

BANDS, BAND_ROWS = 24, 4
#: Odd factors that permute the 64-bit values.
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
#: Shingles of one key's sets that are compared at once; a larger group is compared in pairs of such blocks.
BLOCK = 1 << 20


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    return np.unique(shingle_hashes(text, words))


def node_of(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), 7)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(values):
        return np.zeros(0, np.uint64)
    mixed = values ^ (values >> np.uint64(29))
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(mixed), 2048):
        least = np.minimum(least, (mixed[at : at + 2048, None] * _FACTORS).min(0))
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), band) for band, m in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)


def forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links (i, j) of similar sets that give the same components as all similar pairs: one for each set but a component's first."""
    sizes = np.array([len(s) for s in sets], np.int64)
    different, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = codes.astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    own = [codes[starts[i] : starts[i + 1]] for i in range(len(sets))]
    mark = np.zeros(len(different), bool)
    left, flat = np.arange(len(sets)), codes
    at_a, at_b, queue = [], [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left, flat = left[1:], flat[sizes[left[0]] :]
            continue
        i = queue.pop()
        mark[own[i]] = True
        both = np.add.reduceat(mark[flat].astype(np.int32), np.cumsum(sizes[left]) - sizes[left])
        mark[own[i]] = False
        near = both >= similarity * (sizes[i] + sizes[left] - both) - 1e-9
        if near.any():
            reached = left[near].tolist()
            at_a += [i] * len(reached)
            at_b += reached
            queue += reached
            flat = flat[np.repeat(~near, sizes[left])]
            left = left[~near]
    return at_a, at_b


_LINKS = "kind int, key long, block int, a long, b long, shingles array<long>"


def _links_of_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """Kind 0: a link (a, b). Kind 1: a set a of a group over BLOCK, with its block, still to be compared with the
    group's other blocks."""

    def emit(kind: int, key: int, block: int, a: list[int], b: list[int], held: list) -> pa.RecordBatch:
        n = len(a)
        columns = [pa.array([kind] * n, pa.int32()), pa.array([key] * n, pa.int64()), pa.array([block] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.list_(pa.int64()))], names=["kind", "key", "block", "a", "b", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(key: int, block: int, nodes: list[int], held: list, last: bool) -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                i, j = forest(held, similarity)
                if i:
                    yield emit(0, key, block, [nodes[x] for x in i], [nodes[x] for x in j], [None] * len(i))
            if block or not last:
                for at in range(0, len(nodes), 256):
                    yield emit(1, key, block, nodes[at : at + 256], nodes[at : at + 256], held[at : at + 256])

        key, block, nodes, held, size = None, 0, [], [], 0
        for batch in batches:
            keys, ids = (batch.column(k).to_numpy() for k in range(2))
            lists = batch.column(2)
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for n in range(len(keys)):
                new = values[at[n] : at[n + 1]].copy()
                if key is not None and (keys[n] != key or (size + len(new) > BLOCK and ids[n] != nodes[-1])):
                    last = bool(keys[n] != key)
                    yield from group(int(key), block, nodes, held, last)
                    block, nodes, held, size = 0 if last else block + 1, [], [], 0
                key = keys[n]
                if not nodes or nodes[-1] != ids[n]:  # repeated rows repeat a node
                    nodes.append(int(ids[n]))
                    held.append(new)
                    size += len(new)
        if nodes:
            yield from group(int(key), block, nodes, held, True)

    return arrow_map(sets.repartition("key").sortWithinPartitions("key", "node"), compared, _LINKS)


def _links_of_blocks(waiting: DataFrame, similarity: float) -> DataFrame:
    """Compares the blocks of large groups, each pair of blocks in a task of its own size."""
    blocks = waiting.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = waiting.join(blocks, "key").select("key", "block", "a", "shingles", other.alias("other")).filter("block <> other")
    paired = paired.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "a", "shingles")

    def compared(pdf):
        import pandas as pd

        nodes = pdf["a"].to_numpy(np.int64)
        i, j = forest([np.asarray(s, np.int64) for s in pdf["shingles"]], similarity)
        return pd.DataFrame({"a": nodes[i], "b": nodes[j]}, dtype=np.int64)

    return paired.groupBy("key", "one", "two").applyInPandas(compared, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 3) -> DataFrame:
    """Every row's id with an id and its ``component_id``, the smallest id reachable over texts whose shingle sets have a
    Jaccard similarity of ``similarity`` or more. Rows without words are one node. Rows without an id are left out;
    repeated rows give repeated rows; an empty table gives none."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    kind = texts.schema["id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, fps, keys = [], [], []
            for text in as_bytes(batch.column(1)):
                hashes = shingle_hashes(text, words)
                values = np.unique(hashes)
                nodes.append(node_of(values))
                fps.append(fingerprint_of(hashes))
                keys.append(band_keys(values).view(np.int64))
            signed_64 = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed_64(nodes), signed_64(fps), pa.array(keys, pa.list_(pa.int64()))], names=["id", "node", "fp", "keys"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            keys, nodes, held = [], [], []
            for text, node, own in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                values = shingle_set(text, words)
                if np.uint64(node_of(values)).astype(np.int64) == node:  # an id may repeat with other texts
                    keys += own
                    nodes += [node] * len(own)
                    held += [values.view(np.int64)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["key", "node", "shingles"])

    rows = cut(arrow_map(texts, signed, f"id {kind}, node long, fp long, keys array<long>"))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    # A SimHash component of several fingerprints, or of one fingerprint with several sets, is one more key.
    chains = cut(connected_components(fingerprint_links(nodes.select("fp").distinct(), bits)).withColumnRenamed("node", "fp"))
    with_fp = nodes.filter(F.size("keys") > 0).select("node", "least", "fp")
    chained = lookup(with_fp, chains, ["fp"]).select("node", "least", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))
    keyed = nodes.select("node", "least", F.explode("keys").alias("key")).unionByName(chained)
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    wanted = cut(lookup(keyed, shared, ["key"], "inner").groupBy("node", "least").agg(F.collect_list("key").alias("keys")))
    few = wanted.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    sets = texts.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("least")).select("text", F.col("node").alias("at"), "keys")
    found = cut(_links_of_keys(arrow_map(sets, spread, "key long, node long, shingles array<long>"), similarity))
    links = found.filter("kind = 0").select("a", "b").unionByName(_links_of_blocks(found.filter("kind = 1"), similarity)).distinct()
    reach = cut(connected_components(links))
    least = nodes.select("node", "least")
    roots = lookup(least, reach, ["node"]).withColumn("root", F.coalesce("root", "node"))
    linked = cut(lookup(reach, least, ["node"]).groupBy("root").agg(F.min("least").alias("own")))
    classes = cut(lookup(roots, linked, ["root"]).select("node", F.coalesce("own", "least").alias("component_id")))
    return lookup(rows.select("id", "node"), classes, ["node"]).select(F.col("id").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all columns. Rows with a null id stay; rows
    that repeat an id are one document and stay or go together."""
    found = similar_groups(docs, id_col, text_col, words, similarity, bits)
    gone = cut(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti")
