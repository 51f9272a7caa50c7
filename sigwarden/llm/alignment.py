"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked token pairs.

1. Texts are cut into chunks that both tokenizers encode each on its own (``chunks``); different chunks are encoded and aligned once
   for each worker. Byte offsets at which tokens of both end cut them into groups, and the two tokens that end there are linked.
2. A link is one int64: the B id in the upper, the A id in the lower half. Each partition gives its different keys with their counts
   (``np.unique``, in bounded steps), the keys are sorted in ranges over all partitions, and runs of equal keys are summed.
3. Each range is written to the shared folder as sorted arrays of keys and counts, in shards of a bounded size. Documents
   look their links up in the memory-mapped shards by ``np.searchsorted``.

There are at most |A| x |B| keys, whatever the corpus, and no worker reads shards as a whole. Of each B id the highest count (as
many numbers as B has ids) goes to the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Cut, Remembered, byte_level, encoded_together, gathered, leads, starts_of, token_bytes
from .runtime import arrow_map, checkpoint_folder, cut, free_name, remove_folder, slices

#: Different chunks that a worker remembers (in each of two generations); each has its links and its groups as text.
REMEMBERED_CHUNKS = 80_000
#: Different keys that a task holds before it passes their counts on, and keys of a shard.
HELD_KEYS, SHARD_KEYS = 4_000_000, 4_000_000


class Piecewise:
    """A sentencepiece BPE with byte fallback and no normalisation, for chunks of texts that begin with a space.

    No piece goes on after a word with a space or holds a line feed, so a chunk that begins with a space or stands next to a line feed is
    encoded as within its text. Other models are refused.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trained, rule, space = model.trainer_spec, model.normalizer_spec, "▁"
        ordinary = [p.piece for p in model.pieces if p.type == p.NORMAL]
        if (
            trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or not rule.escape_whitespaces
            or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces) or any(space in p.lstrip(space) or "\n" in p for p in ordinary)
        ):
            raise ValueError(f"chunks are not known to be exact for the model in {path}")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = {p.piece: bytes([int(p.piece[1:-1], 16)]) for p in model.pieces if p.type == p.BYTE}
        self.bytes = [byte.get(p.piece) or p.piece.replace(space, " ").encode() for p in model.pieces]
        self.feed = [self.model.piece_to_id(space), self.model.piece_to_id("<0x0A>")]

        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def __call__(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The model puts a space before every text; where a chunk has none, a line feed keeps the two apart."""

        def encode(texts: list[str]) -> list[list[int]]:
            spaced = [t[:1] == " " for t in texts]
            coded = self.model.encode([t[1:] if s else "\n" + t for t, s in zip(texts, spaced)], num_threads=1)
            if any(not s and ids[:2] != self.feed for ids, s in zip(coded, spaced)):
                raise ValueError("the model does not keep a line feed apart")
            return [ids if s else ids[2:] for ids, s in zip(coded, spaced)]

        return encoded_together(chunks, encode, self.sizes, lambda c: leads(c) and c[-1] != 0x20)


class Aligner:
    """For each different chunk: numbers of A and B tokens, links (packed) and groups (text); None if the bytes of A's or B's tokens are not the chunk's."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level(path_a, special_as_text=True), Piecewise(path_b)
        self.bytes_a = token_bytes(self.a)
        self.size_a, self.size_b = np.array([len(x) for x in self.bytes_a], np.int64), self.b.sizes

    def __call__(self, chunks: list[bytes]) -> list[tuple | bool]:
        coded_a = encoded_together(chunks, lambda texts: [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.size_a, leads)
        coded_b = self.b(chunks)
        byte_a, byte_b = self.bytes_a.__getitem__, self.b.bytes.__getitem__
        good = [k for k, c in enumerate(chunks) if b"".join(map(byte_a, coded_a[k].tolist())) == c == b"".join(map(byte_b, coded_b[k].tolist()))]
        out: list[tuple | bool] = [False] * len(chunks)
        if not good:
            return out
        a, b = np.concatenate([coded_a[k] for k in good]), np.concatenate([coded_b[k] for k in good])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # All ends are different and in order, and a chunk's last one is common to both.
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        keys = (b[last_b] << 32) | a[last_a]
        sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for p, q in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
            groups.append(f"{sa[i]}|{sb[j]}" if p == i + 1 and q == j + 1 else ",".join(sa[i:p]) + "|" + ",".join(sb[j:q]))
            i, j = p, q
        bounds = np.searchsorted(common, list(accumulate(len(chunks[k]) for k in good)), "right").tolist()
        raw, at = keys.astype("<i8").tobytes(), 0
        for k, to in zip(good, bounds):
            out[k] = (len(coded_a[k]), len(coded_b[k]), raw[8 * at : 8 * to], ";".join(groups[at:to]))
            at = to
        return out


_ALIGNERS: dict[tuple, Remembered] = {}


def _aligner(path_a: str, path_b: str) -> Remembered:
    """One for each Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Remembered(Aligner(path_a, path_b), REMEMBERED_CHUNKS)
    return _ALIGNERS[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (long), ``groups`` (string) and ``links`` (binary: int64 keys).

    A encodes a space and the text, B the text (it adds the space itself). ``groups`` has A and B ids in order, like ``a1,a2|b1;a3|b2``.
    A null or empty text, and one whose tokens' bytes are not those of the space and the text (bytes that are no UTF-8, U+2581 in
    it), has no tokens: zeros and empty values. Repeated rows count each; columns that have the names of new ones are replaced. Nothing
    is shuffled.
    """
    new = (("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups", T.StringType()), ("links", T.BinaryType()))
    docs = docs.drop(*[n for n, _ in new])
    keep = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t) for n, t in new]])
    spaced = F.when(F.length(text_col) > 0, F.concat(F.lit(" "), text_col)).otherwise("").alias(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = _aligner(path_a, path_b)
        for batch in slices(batches, 512):
            chunks = Cut(batch.column(len(keep)), fine=False, lone_spaces=False)
            coded = aligned(chunks.values)
            bad = np.array([x is False for x in coded], bool)
            coded = [x or (0, 0, b"", "") for x in coded]
            index, offsets = chunks.index, chunks.offsets
            before = lambda v: np.concatenate(([0], np.cumsum(v[index])))[offsets]
            fine = np.diff(before(bad.astype(np.int64))) == 0
            n_a, n_b = (np.where(fine, np.diff(before(np.array([x[k] for x in coded], np.int64))), 0) for k in (0, 1))
            sizes = np.array([len(x[2]) // 8 for x in coded], np.int64)
            flat, ends = gathered(np.frombuffer(b"".join([x[2] for x in coded]), "<i8"), starts_of(sizes), sizes, index)
            links, raw = np.where(fine, np.diff(ends[offsets]), 0), flat.tobytes()
            lo, spots = (ends[offsets] * 8).tolist(), offsets.tolist()
            texts, names = [x[3] for x in coded], index.tolist()
            keys = pa.array([raw[p:q] if f else b"" for p, q, f in zip(lo, lo[1:], fine.tolist())], pa.binary())
            groups = pa.array([";".join([texts[i] for i in names[p:q]]) if f else "" for p, q, f in zip(spots, spots[1:], fine.tolist())], pa.string())
            counted = [pa.array(x, pa.int64()) for x in (n_a, n_b, links, links)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counted, groups, keys], names=schema.names)

    return arrow_map(docs.select(*keep, spaced), run, schema)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    own, at = np.unique(key, return_inverse=True)
    return own, np.bincount(at, n, len(own)).astype(np.int64)


def partial_counts(links: DataFrame, links_col: str = "links") -> DataFrame:
    """(key, n) of the keys in each partition of ``links``; a key may come again if a partition has over HELD_KEYS different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        for batch in slices(batches, 4096, 32 << 20):
            own, n = np.unique(np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), "<i8"), return_counts=True)
            keys.append(own)
            counts.append(n)
            waiting += len(own)
            if waiting > HELD_KEYS // 4:
                own, n = _summed(keys, counts)
                keys, counts, waiting = [own], [n], 0
                if len(own) > HELD_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["key", "n"])
                    keys, counts = [], []
        if keys:
            own, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["key", "n"])

    return arrow_map(links.select(links_col), run, "key long, n long")


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different keys and their sums from batches (key, n) in the order of the keys; a run may go on in the next batch."""
    last, total = None, 0
    for batch in batches:
        key, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        if not len(key):
            continue
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        own, sums = key[heads], np.add.reduceat(n, heads)
        if last is not None and own[0] == last:
            sums[0] += total
        elif last is not None:
            yield np.array([last]), np.array([total])
        last, total = int(own[-1]), int(sums[-1])
        if len(own) > 1:
            yield own[:-1], sums[:-1]
    if last is not None:
        yield np.array([last]), np.array([total])


def _written(folder: str, name: str, data: bytes) -> str:
    """The path of a new file in the shared folder. It appears whole, and a task that runs again replaces it by the same bytes."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path, held = f"{root}/{name}", f"{root}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(held) as f:
        f.write(data)
    store.move(held, path)
    return f"{folder}/{name}"


_MAPPED: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _mapped(path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard, mapped where the shared folder is mounted; another store's shard is read into memory."""
    if path not in _MAPPED:
        from pyarrow import fs

        if _MAPPED and next(iter(_MAPPED)).rsplit("/", 1)[0] != path.rsplit("/", 1)[0]:
            _MAPPED.clear()  # shards of an earlier run, whose files are gone

        store, inside = fs.FileSystem.from_uri(path)
        with store.open_input_file(inside) if not isinstance(store, fs.LocalFileSystem) else pa.memory_map(inside) as f:
            data = np.frombuffer(f.read_buffer(), "<i8")
        _MAPPED[path] = data[:n], data[n:]
    return _MAPPED[path]


class PairCounts:
    """The count shards: paths, first keys and sizes in order, and the highest count of each B id."""

    def __init__(self, shards: list[tuple[str, int, int]], best: np.ndarray):
        self.shards = sorted(shards, key=lambda s: s[1])
        self.firsts = np.array([s[1] for s in self.shards], np.int64)
        self.best = best

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of different keys in order; all of them were counted."""
        out = np.zeros(len(keys), np.int64)
        bounds = np.append(np.searchsorted(keys, self.firsts), len(keys)).tolist()
        for (path, _, n), lo, hi in zip(self.shards, bounds, bounds[1:]):
            if hi > lo:
                known, counts = _mapped(path, n)
                at = np.minimum(np.searchsorted(known, keys[lo:hi]), n - 1)
                if (known[at] != keys[lo:hi]).any():
                    raise ValueError("a link was not counted")
                out[lo:hi] = counts[at]
        return out


def pair_counts(links: DataFrame, folder: str, links_col: str = "links") -> PairCounts:
    """Counts of all links, written to ``folder`` (a URI that all executors share) as sorted shards.

    A shard gives the driver one row, and each B id that it holds a number; keys are sorted by B id, so that is as many numbers as
    B has ids and one for each shard.
    """
    held = cut(partial_counts(links, links_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, keys, counts, waiting = TaskContext.get().partitionId(), 0, [], [], 0

        def closed():
            key, n = np.concatenate(keys), np.concatenate(counts)
            path = _written(folder, f"pairs-{part:06d}-{made:04d}", key.astype("<i8").tobytes() + n.astype("<i8").tobytes())
            b = key >> 32
            heads = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array(key[:1]), pa.array([len(key)], pa.int64()), pa.array([b[heads].tolist()]), pa.array([np.maximum.reduceat(n, heads).tolist()])], names=["path", "first", "n", "bs", "best"])

        for key, n in run_lengths(batches):
            keys.append(key)
            counts.append(n)
            waiting += len(key)
            if waiting >= SHARD_KEYS:
                yield closed()
                made, keys, counts, waiting = made + 1, [], [], 0
        if keys:
            yield closed()

    ranged = held.repartitionByRange("key").sortWithinPartitions("key")
    rows = arrow_map(ranged, run, "path string, first long, n long, bs array<long>, best array<long>").collect()
    best = np.zeros(1 + max((b for r in rows for b in r["bs"]), default=0), np.int64)
    for r in rows:
        np.maximum.at(best, r["bs"], r["best"])
    return PairCounts([(r["path"], r["first"], r["n"]) for r in rows], best)


def with_counts(aligned: DataFrame, counts: PairCounts, links_col: str = "links") -> DataFrame:
    """``aligned`` without the links, with ``n_best`` (links whose count is the highest of their B id, ties included) and ``count_sum`` (long)."""
    aligned = aligned.drop("n_best", "count_sum")
    keep = [c for c in aligned.columns if c != links_col]
    schema = T.StructType([*[aligned.schema[c] for c in keep], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            packed = [x or b"" for x in batch.column(len(keep)).to_pylist()]
            keys, at = np.unique(np.frombuffer(b"".join(packed), "<i8"), return_inverse=True)
            n = counts.of(keys)
            best = (n == counts.best[keys >> 32]) if len(keys) else np.zeros(0, bool)
            bounds = np.cumsum([0, *[len(x) // 8 for x in packed]])
            sums = [pa.array(np.diff(np.concatenate(([0], np.cumsum(v[at]))).astype(np.int64)[bounds])) for v in (best.astype(np.int64), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *sums], names=schema.names)

    return arrow_map(aligned.select(*keep, links_col), run, schema)


def align_and_count(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", digest: bool = True) -> DataFrame:
    """``align`` and ``with_counts`` over all of ``docs``; with ``digest``, ``groups_sha256`` (empty without tokens) instead of ``groups``.

    Texts are encoded once: what each document has, links included, is a compressed table in the checkpoint folder until
    the result is written, and the shards go with it. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/alignment-{uuid.uuid4().hex}"
    aligned = align(docs, path_a, path_b, text_col)
    if digest:
        name = free_name(aligned, "groups_sha256") if "groups_sha256" in docs.columns else "groups_sha256"
        aligned = aligned.withColumn(name, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    aligned.write.option("compression", "zstd").parquet(f"{folder}/aligned")
    held = spark.read.parquet(f"{folder}/aligned")
    out = cut(with_counts(held, pair_counts(held, f"{folder}/pairs")))
    remove_folder(spark, folder)
    return out
