"""SimHash near-deduplication with pigeonring filtering.

A fingerprint has 64 bits in a ring of SEGMENTS segments. If two fingerprints differ in at most ``bits``
bits, then from at least one segment on, every run of l consecutive segments (l = 1 ... SEGMENTS)
differs in at most ``floor(l * bits / SEGMENTS)`` bits (the strong form of the pigeonring principle). For 3
bits and 8 segments these budgets are 0, 0, 1, 1, 1, 2, 2, 3: the first two segments of such a chain agree,
and of the next three, halved, at least one half. So each fingerprint has 8 * 2 keys of 28 bits; only
fingerprints with a key in common are candidates. A candidate's chain is followed from the key's segment
on and dropped as soon as it is over its budget; what is left at l = SEGMENTS is within ``bits``.
No pair within ``bits`` is lost, and there is no cap on a key's fingerprints.

Keys are counted before anything is compared. A key of over BLOCK fingerprints is not gathered: its fingerprints get
deeper keys from the rest of the ring, of whose bits + 2 pieces at least two agree, and meet only where a deeper key
agrees too. For 3 bits the rest of a ring of 8 segments has five pieces of 4 or 5 bits, so a deeper key is 9 or 10 bits longer (37 or 38 of 64) and a
hot key falls into 512 or 1,024 groups for each pair of pieces. A group that is over BLOCK even then (a key of some ten million different
fingerprints) is read by one task in blocks, each compared with itself there, and pairs of its blocks go to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .runtime import BROADCAST_ROWS, arrow_map, as_bytes, cut, lookup, slices

SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Fingerprints of one key that are compared at once. A larger group is split by deeper keys; what is larger even then
#: (fingerprints that agree in 37 bits or more) is compared in pairs of such blocks.
BLOCK = 16_384
#: Shingles whose bits are unpacked at once.
SHINGLES = 65_536


def shingle_hashes(text: bytes | None, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles of ``words`` words, repeats included: A-Z lower-cased, words between white
    space (U+0020, U+0009-U+000D), joined by one space; all words if there are fewer; none without any."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    size = min(words, len(found))
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: len(found) - size]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        counts += np.unpackbits(hashes[at : at + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a text's shingles."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(x, words) for x in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def budgets(bits: int) -> list[int]:
    return [length * bits // SEGMENTS for length in range(1, SEGMENTS + 1)]


def _rotated(fp: np.ndarray, start: int) -> np.ndarray:
    r = start * WIDTH
    return (fp << np.uint64(r)) | (fp >> np.uint64(64 - r)) if r else fp


def chain_keys(fp: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each start and each part of the segments that may differ in one bit: a number for both, and the keys."""
    limit = budgets(bits)
    exact, one = limit.count(0) * WIDTH, limit.count(1) * WIDTH
    half = one // 2
    for start in range(SEGMENTS):
        ring = _rotated(fp, start)
        head = ring >> np.uint64(64 - exact) if exact else np.zeros_like(ring)
        for part, (skip, size) in enumerate(((0, half), (half, one - half)) if exact + one < 64 and one else ((0, 0),)):
            tail = (ring >> np.uint64(64 - exact - skip - size)) & np.uint64((1 << size) - 1) if size else np.zeros_like(ring)
            yield 2 * start + part, (head << np.uint64(size)) | tail


def _key_bits(bits: int) -> int:
    """How many bits from the chain's start on the segments of ``chain_keys`` span."""
    limit = budgets(bits)
    exact, one = limit.count(0) * WIDTH, limit.count(1) * WIDTH
    return exact + one if exact + one < 64 and one else exact


def deep_keys(fp: np.ndarray, start: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each choice of two pieces of the ring beyond the key's segments: its number and the pieces' bits.

    The rest of the ring is cut in ``bits`` + 2 pieces, and at most ``bits`` of them can differ, so two fingerprints
    within ``bits`` agree in two pieces at least.
    """
    ring, first = _rotated(fp, start), _key_bits(bits)
    ends = [first + (64 - first) * k // (bits + 2) for k in range(bits + 3)]
    pieces = [(ring >> np.uint64(64 - hi)) & np.uint64((1 << (hi - lo)) - 1) for lo, hi in zip(ends, ends[1:])]
    for number, (i, j) in enumerate(combinations(range(bits + 2), 2)):
        yield number, (pieces[i] << np.uint64(ends[j + 1] - ends[j])) | pieces[j]


def links_within(a: np.ndarray, b: np.ndarray, start: int, limit: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) of the pairs whose chain from ``start`` keeps to all budgets."""
    ring_a, ring_b = _rotated(a, start), _rotated(b, start)
    at_a, at_b = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for lo in range(0, len(a), step):
        i, j = (x.ravel() for x in np.indices((min(step, len(a) - lo), len(b)), np.int32))
        differ = ring_a[lo + i] ^ ring_b[j]
        for length in range(2, SEGMENTS + 1):
            ok = np.bitwise_count(differ >> np.uint64(64 - length * WIDTH)) <= limit[length - 1]
            i, j, differ = i[ok], j[ok], differ[ok]
        at_a.append(lo + i)
        at_b.append(j)
    return np.concatenate(at_a).astype(np.int64), np.concatenate(at_b).astype(np.int64)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links reach from it."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _group_links(fp: np.ndarray, other: np.ndarray | None, start: int, limit: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block, or of a block with another, thinned to a forest: at most one a fingerprint."""
    if other is None:
        i, j = links_within(fp, fp, start, limit)
        every, i, j = fp, i[i < j], j[i < j]
    else:
        i, j = links_within(fp, other, start, limit)
        every, j = np.concatenate([fp, other]), j + len(fp)
    label = _forest(len(every), i, j) if len(i) else np.arange(len(every))
    linked = np.flatnonzero(label != np.arange(len(every)))
    return every[linked], every[label[linked]]


_GROUP = ["chain", "key", "deep", "part"]
_KEYED = "chain int, key long, deep int, part long, fp long"
_LINKS = "kind int, chain int, key long, deep int, part long, block int, a long, b long"


def _emit(kind: int, group: tuple, block: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    same = lambda x, t: pa.array(np.full(len(a), x, t))
    chain, key, deep, part = group
    columns = [same(kind, np.int32), same(chain, np.int32), same(key, np.int64), same(deep, np.int32), same(part, np.int64), same(block, np.int32), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", *_GROUP, "block", "a", "b"])


def _keyed(fps: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            zero = np.zeros(len(fp), np.int32)
            for chain, key in chain_keys(fp, bits):
                yield pa.RecordBatch.from_arrays([pa.array(zero + np.int32(chain)), pa.array(key.view(np.int64)), pa.array(zero - 1), pa.array(zero.astype(np.int64)), batch.column(0)], names=[*_GROUP, "fp"])

    return arrow_map(fps.select("fp"), run, _KEYED)


def _deeper(keyed: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chain, fp = batch.column(0).to_numpy(), batch.column(4).to_numpy().view(np.uint64)
            for start in np.unique(chain // 2).tolist():
                own = np.flatnonzero(chain // 2 == start)
                some = batch.take(pa.array(own))
                for number, part in deep_keys(fp[own], start, bits):
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.full(len(own), number, np.int32)), pa.array(part.view(np.int64)), some.column(4)], names=[*_GROUP, "fp"])

    return arrow_map(keyed, run, _KEYED)


def _compared(keyed: DataFrame, bits: int) -> DataFrame:
    """Kind 0: a link (a, b). Kind 1: a fingerprint a of a group over BLOCK, with its block, still to be compared
    with the group's other blocks."""
    limit = budgets(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(group: tuple, block: int, fp: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            a, b = _group_links(fp, None, group[0] // 2, limit)
            if len(a):
                yield _emit(0, group, block, a, b)
            if block or not last:
                yield _emit(1, group, block, fp, fp)

        group, block, rest = None, 0, np.zeros(0, np.uint64)  # the group that may go on in the next batch, and its blocks so far
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(4)]
            fp = batch.column(4).to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if len(fp) else []
            bounds = [0, *[int(e) for e in edges], len(fp)]
            for lo, hi in zip(bounds, bounds[1:]):
                own = tuple(int(c[lo]) for c in columns)
                if own != group:
                    if group is not None and (len(rest) > 1 or block):
                        yield from compared(group, block, rest, True)
                    group, block, rest = own, 0, fp[lo:hi]
                else:
                    rest = np.concatenate([rest, fp[lo:hi]])
                while len(rest) > BLOCK:
                    yield from compared(group, block, rest[:BLOCK], False)
                    rest, block = rest[BLOCK:], block + 1
        if group is not None and (len(rest) > 1 or block):
            yield from compared(group, block, rest, True)

    return arrow_map(keyed.repartition(*_GROUP).sortWithinPartitions(*_GROUP), run, _LINKS)


def _links_of_blocks(waiting: DataFrame, bits: int) -> DataFrame:
    """Compares the blocks of large groups, each pair of blocks in a task of its own size."""
    limit = budgets(bits)
    blocks = waiting.groupBy(*_GROUP).agg((F.max("block") + 1).alias("blocks"))
    rows = waiting.join(blocks, _GROUP)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = rows.select(*_GROUP, "block", "a", other.alias("other")).filter("block <> other")
    paired = paired.select(*_GROUP, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "a")

    def compared(pdf):
        import pandas as pd

        first = (pdf["block"] == pdf["one"]).to_numpy()
        fp = pdf["a"].to_numpy(np.int64).view(np.uint64)
        a, b = _group_links(fp[first], fp[~first], int(pdf["chain"].iloc[0]) // 2, limit)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return paired.groupBy(*_GROUP, "one", "two").applyInPandas(compared, "a long, b long")


def fingerprint_links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between different fingerprints of ``fps`` (fp, each once) that give the same components as all
    pairs that differ in at most ``bits`` bits; every row is such a pair or was joined through such pairs of one key."""
    if not 0 < bits < SEGMENTS:
        raise ValueError(f"bits must be from 1 to {SEGMENTS - 1}")
    keyed = _keyed(fps, bits)
    hot = cut(keyed.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("chain", "key"))
    n = hot.limit(BROADCAST_ROWS + 1).count()
    if n:
        few = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        keyed = keyed.join(few, ["chain", "key"], "left_anti").unionByName(_deeper(keyed.join(few, ["chain", "key"], "left_semi").select(*_GROUP, "fp"), bits))
    found = cut(_compared(keyed, bits))
    links = found.filter("kind = 0").select("a", "b")
    waiting = found.filter("kind = 1")
    return links.unionByName(_links_of_blocks(waiting, bits)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """Every row's id, ``fp`` (signed long), ``fingerprint`` (16 hex digits) and ``component_id``.

    Rows whose fingerprints differ in at most ``bits`` bits are linked, also without words (fingerprint 0, as for
    null and empty texts); component_id is the smallest id reachable. Equal fingerprints are one node of
    the graph, so copies, however many, are never paired. Null ids are passed over in the minimum (a
    component of null ids alone has a null component_id); repeated rows give repeated rows; an empty
    table gives none.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    reach = cut(connected_components(fingerprint_links(nodes, bits)))
    roots = lookup(nodes, reach.withColumnsRenamed({"node": "fp"}), ["fp"]).withColumn("root", F.coalesce("root", "fp"))
    linked = cut(lookup(reach, nodes.withColumnRenamed("fp", "node"), ["node"]).groupBy("root").agg(F.min("least").alias("own")))
    classes = cut(lookup(roots, linked, ["root"]).select("fp", F.coalesce("own", "least").alias("component_id")))
    return lookup(rows, classes, ["fp"]).select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all columns. Rows with a null id stay; rows
    that repeat an id are one document and stay or go together."""
    found = near_duplicates(docs, id_col, text_col, words, bits)
    gone = cut(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti")
