"""Best-two-fit packing of documents' tokens into sequences of a fixed length.

The method: a sequence is filled greedily (the largest document that fits, again and again). Then its smallest document
goes back if two unpacked documents fit the gap that it leaves more tightly, and these two take its place.

Whether a document fits depends on its length alone, and lengths are at most ``size`` tokens. So the method runs over the numbers of
documents of each length (at most ``size`` of them, whatever the corpus), and a sequence's composition is repeated as often
as the numbers allow: a plan of a few thousand lines says which ranks of which length go where. Documents of a length are numbered
without gathering them (``runtime.numbered``) and find their line of the plan by a join of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Cut, Remembered, byte_level, encoded_together, gathered, leads, starts_of, token_bytes
from .runtime import BROADCAST_ROWS, arrow_map, cut, free_name, numbered, slices

_ENCODERS: dict[str, Remembered] = {}


def _encoder(path: str) -> Remembered:
    """One for each Python worker."""
    if path not in _ENCODERS:
        tokenizer = byte_level(path, special_as_text=False)
        sizes = np.array([len(x) for x in token_bytes(tokenizer)], np.int64)
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        _ENCODERS[path] = Remembered(lambda chunks: [ids.astype("<u4").tobytes() for ids in encoded_together(chunks, encode, sizes, leads)])
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, a row a piece: ``piece`` (from 0), ``start`` (tokens of the document before it), ``length``, ``ids``
    (binary, 32-bit little-endian).

    A document is its text's ids and then ``end_id``; special tokens in texts are taken as such, as the library does. Longer ones than
    ``size`` are cut from the end, so the first piece may be shorter. A null or empty text is the one token ``end_id``. Repeated rows
    give pieces each; columns that have the names of new ones are replaced. A map over the rows: nothing is shuffled.
    """
    docs = docs.drop("piece", "start", "length", "ids")
    keep = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.IntegerType()), ("ids", T.BinaryType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in slices(batches, 1024):
            chunks = Cut(batch.column(len(keep)), fine=True)
            coded = [*encode(chunks.values), np.array([end_id], "<u4").tobytes()]
            lengths = np.array([len(x) // 4 for x in coded], np.int64)
            index = np.insert(chunks.index, chunks.offsets[1:], len(coded) - 1)
            flat, ends = gathered(np.frombuffer(b"".join(coded), "<u4"), starts_of(lengths), lengths, index)
            bounds = ends[chunks.offsets + np.arange(len(chunks.offsets))]
            tokens = np.diff(bounds)
            n = -(-tokens // size)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(starts_of(n), n)
            first = (tokens - (n - 1) * size)[doc]
            start = np.where(piece > 0, first + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, first)
            lo = (bounds[:-1][doc] + start) * 4
            raw = flat.tobytes()
            ids = pa.array([raw[a:b] for a, b in zip(lo.tolist(), (lo + length * 4).tolist())], pa.binary())
            kept = [batch.column(k).take(pa.array(doc)) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), ids], names=schema.names)

    return arrow_map(docs.select(*keep, text_col), run, schema)


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """The plan for ``counts`` documents of each length: lines (length, first rank, documents in one sequence, offset of the first of
    them in it, first sequence). A line holds up to the first rank of the next line of that length.

    A composition is repeated until a length that it needs runs short, so there are few different ones.
    """
    if any(not 1 <= x <= size for x in counts):
        raise ValueError(f"lengths must be from 1 to {size}")
    left = np.zeros(size + 1, np.int64)
    for x, n in counts.items():
        left[x] = n
    used = np.zeros(size + 1, np.int64)
    plan, sequences = [], 0
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return plan
        # fits[g]: the largest length of at most g that is left.
        fits = np.zeros(size + 1, np.int64)
        fits[have] = have
        fits = np.maximum.accumulate(fits)
        inside: dict[int, int] = {}
        gap, x = size, int(have[-1])
        while x:
            n = int(min(left[x], gap // x))
            inside[x] = n
            gap -= n * x
            # n is all that is left or all that fits, so the next one is a smaller length.
            x = int(fits[min(gap, x - 1)])
        smallest = min(inside)
        need = dict(inside)
        if sum(inside.values()) > 1 and gap:
            spare = left.copy()
            for x, n in inside.items():
                spare[x] -= n
            pair = _tighter_pair(spare, gap + smallest, smallest)
            if pair:
                inside[smallest] -= 1
                for x in pair:
                    inside[x] = inside.get(x, 0) + 1
        # As long as all that was looked at is left, the next sequence is filled alike.
        times = min((int(left[x]) - max(n, need.get(x, 0))) // n + 1 for x, n in inside.items() if n)
        inside = {x: n for x, n in inside.items() if n}
        offset = 0
        for x, n in sorted(inside.items(), reverse=True):
            plan.append((x, int(used[x]), n, offset, sequences))
            used[x] += times * n
            left[x] -= times * n
            offset += n * x
        sequences += times


def _tighter_pair(spare: np.ndarray, gap: int, over: int) -> tuple[int, int] | None:
    """Two spare lengths whose sum is at most ``gap`` and over ``over``, the largest there is; of equal sums, that of the largest length."""
    have = np.flatnonzero(spare[:gap])
    if not len(have):
        return None
    fits = np.zeros(gap + 1, np.int64)
    fits[have] = have
    fits = np.maximum.accumulate(fits)
    # The partner is no larger; a length that is left once is no partner of its own.
    most = np.minimum(gap - have, np.where(spare[have] > 1, have, have - 1))
    partner = fits[np.maximum(most, 0)]
    total = np.where(partner > 0, have + partner, 0)
    best = int(total.max())
    if best <= over:
        return None
    k = int(np.flatnonzero(total == best)[-1])
    return int(have[k]), int(partner[k])


def pack(pieces: DataFrame, size: int = 2048, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: where each goes, without gaps from offset 0 (columns of these names are replaced).

    Every row has a length from 1 to ``size`` (another or null is an error). Which of the rows of one length goes where is not
    stated. The driver sees one number for each length. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    rank = free_name(pieces, "length_rank")
    placed = cut(numbered(pieces, [length_col], rank))
    counts = {r[0]: r[1] for r in placed.groupBy(length_col).agg(F.count(F.lit(1))).collect()}
    if any(x is None for x in counts):
        raise ValueError("a piece has no length")
    return placed.join(F.broadcast(_plan_frame(pieces, counts, size)), (F.col(length_col) == F.col("plan_length")) & (F.col(rank) >= F.col("plan_rank")) & (F.col(rank) < F.col("plan_end"))).select(*pieces.columns, *_place(F.col(rank), F.col(length_col)))


def _place(rank: Column, length: Column) -> list[Column]:
    own = rank - F.col("plan_rank")
    return [
        (F.col("plan_sequence") + F.floor(own / F.col("plan_copies"))).cast("long").alias("sequence_id"),
        (F.col("plan_offset") + F.pmod(own, F.col("plan_copies")) * length).cast("long").alias("offset"),
    ]


def _plan_frame(pieces: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    plan = best_two_fit(counts, size)
    if len(plan) > BROADCAST_ROWS:
        raise ValueError(f"the plan has {len(plan)} lines; take a smaller sequence length")
    end, upto = dict(counts), []
    for x, rank, n, offset, sequence in reversed(plan):
        upto.append((x, rank, end[x], n, offset, sequence))
        end[x] = rank
    return pieces.sparkSession.createDataFrame(upto, "plan_length int, plan_rank long, plan_end long, plan_copies long, plan_offset long, plan_sequence long")


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a sequence: ``sequence_id``, ``ids`` (binary), ``documents`` (structs of id, piece, offset and length, in order).

    ``packed`` is what ``pack`` gives for ``token_pieces``. A sequence has a bounded number of tokens, so a group is bounded.
    """
    part = F.struct("offset", "length", F.col(id_col).alias("id"), "piece", "ids")
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    join = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", join.alias("ids"), F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"))
