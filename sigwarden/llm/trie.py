"""A trie of conversations' prefixes, with sums over subtrees by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest that follows from the running sums of 120-bit digests of the
turns (with their place), so a conversation of any length gets the keys of all its prefixes without a fold, and a child's row has its
parent's key. Sums over subtrees take as many rounds as the depth has binary digits: in each round a node adds its sums to those
of the ancestor that it points to, and then points to where that one points. After k rounds a node has the sums of all that is less than 2^k
below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_sums
from .runtime import BROADCAST_ROWS, WORD, arrow_map, cut, lookup

#: Code points of a piece of a node's list of ends.
PIECE_CHARS = 1 << 20


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn_digest, words) of all turns, in the order of (turn, digest), nulls first.

    Null roles and texts are empty. Rows without a conv_id are of no conversation and left out. Texts are not shuffled: what tells turns apart
    from here on is the MD5 of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = running_sums(narrow, [F.col("turn").asc_nulls_first(), F.col("turn_digest").asc()], {"pos": F.lit(1)}, ["conv_id"])
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "turn_digest", "words")


def with_borrowed_heads(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation c starts with the first h turns of conversation c - c % ``block`` (all if fewer, none if absent), h = crc32(c) %
    ``heads``, and goes on with its own turns after its first h.

    ``turns`` as ``numbered_turns`` gives it. Result: turns in that form, and (conv_id, n) of all conversations, turnless ones too.
    """
    counted = cut(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")))
    few = counted.limit(BROADCAST_ROWS + 1).count()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = counted.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % block).alias("base_id"), h.alias("h"))
    bases = counted.select(F.col("conv_id").alias("base_id"), F.col("own").alias("base_n"))
    convs = lookup(convs, bases, ["base_id"], rows=few).select("conv_id", "own", "base_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    convs = cut(convs.select("conv_id", "base_id", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    own = lookup(turns, convs, ["conv_id"], "inner", few).filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_digest", "words")
    first = turns.filter(F.col("pos") < heads).withColumnRenamed("conv_id", "base_id")
    borrowed = convs.filter("taken > 0").join(first, "base_id").filter("pos <= h").select("conv_id", "pos", "turn_digest", "words")
    return own.unionByName(borrowed), convs.select("conv_id", "n")


def _part(digest: Column, at: int) -> Column:
    """60 bits of a hex digest as a decimal, whose sums don't overflow."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")


def _key(a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("/", a.cast("string"), b.cast("string"))))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, turn_digest, words) of each prefix that isn't empty; ``node`` and ``parent`` are keys."""
    placed = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "turn_digest"), 256)
    salted = turns.withColumns({"a": _part(placed, 1), "b": _part(placed, 17)})
    summed = running_sums(salted, [F.col("pos").asc()], {"sum_a": F.col("a"), "sum_b": F.col("b")}, ["conv_id"])
    before = [F.col(c).cast("decimal(38,0)") for c in ("sum_a", "sum_b")]
    return summed.select("conv_id", F.col("pos").cast("long").alias("depth"), _key(before[0] + F.col("a"), before[1] + F.col("b")).alias("node"), _key(*before).alias("parent"), "turn_digest", "words")


def root_key(spark) -> bytes:
    zero = F.lit(0).cast("decimal(38,0)")
    return bytes(spark.range(1).select(_key(zero, zero)).first()[0])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the decimal conv_ids, ascending and comma-joined, of all that end at a node.

    A node may be where a large part of all conversations ends. So the ids are sorted in ranges over all partitions, each range joins its own to
    texts of at most PIECE_CHARS, and what one task hashes in a row is a stream of these, of which it holds one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0
        out: tuple[list, list, list] = ([], [], [])

        def close():
            for x, v in zip(out, (node, first, ",".join(held))):
                x.append(v)

        for batch in batches:
            for own, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != node or size > PIECE_CHARS:
                    if held:
                        close()
                    node, first, held, size = own, c, [], 0
                held.append(str(c))
                size += 1 + len(held[-1])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["node", "first", "ids"])
                out = ([], [], [])
        if held:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, digests = [], []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if own != node:
                    if state is not None:
                        nodes.append(node)
                        digests.append(state.hexdigest())
                    node, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests)], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    ranged = cut(arrow_map(ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id"), joined, "node binary, first long, ids string"))
    return arrow_map(ranged.repartition("node").sortWithinPartitions("node", "first"), hashed, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str], key: str = "node", parent: str = "parent") -> DataFrame:
    """``nodes`` (key, parent or null for roots, sums) with each sum taken over the node's subtree, itself included. Other columns are dropped.

    Every round is written before the next one, so a lost executor costs no earlier round. What hangs on one node is summed before it
    is sent there. Pointers to a root need no look-up: a root points nowhere.
    """
    state = cut(nodes.select(key, F.col(parent).alias("ptr"), *sums))
    roots = cut(state.filter("ptr is null").select(F.col(key).alias("ptr"), F.lit(True).alias("at_root")))
    n_roots = roots.limit(BROADCAST_ROWS + 1).count()
    rows = state.limit(BROADCAST_ROWS + 1).count()
    while state.filter("ptr is not null").limit(1).count():
        more = state.filter("ptr is not null").groupBy(F.col("ptr").alias(key)).agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        added = lookup(state, more, [key], rows=rows).select(key, "ptr", *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums])
        marked = lookup(added, roots, ["ptr"], rows=n_roots)
        going = marked.withColumn("ptr", F.when(F.col("at_root").isNull(), F.col("ptr"))).drop("at_root")
        # Nodes that have ended look under their own key, so that they don't meet under null.
        jumps = state.filter("ptr is not null").select(F.col(key).alias("jump"), F.col("ptr").alias("next"))
        jumped = lookup(going.withColumn("jump", F.coalesce("ptr", key)), jumps, ["jump"], rows=rows)
        state = cut(jumped.select(key, F.when(F.col("ptr").isNotNull(), F.col("next")).alias("ptr"), *sums))
    return state.drop("ptr")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.

    ``turns`` has (conv_id, pos, turn_digest, words), ``convs`` has (conv_id, n) with all conversations. Members of a node are the conversations
    that start with its turns, the root's all of them. ``saved_tokens`` sums (members - 1) x words of the last turn over the subtree. Without a
    conversation there is no root and the result is empty. Two different last turns or parents under one key are an error.
    """
    spark = turns.sparkSession
    rows = cut(prefixes(turns))
    root = F.lit(root_key(spark))
    nodes = rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("parent").alias("parent"),
        F.min("words").alias("words"),
        ((F.min("parent") != F.max("parent")) | (F.min("turn_digest") != F.max("turn_digest")) | (F.min("depth") != F.max("depth"))).alias("mixed"),
    )
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = top.select(root.alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("mixed"))
    nodes = cut(nodes.select(*top.columns).unionByName(top))
    if nodes.filter("mixed").limit(1).count():
        raise ValueError("two prefixes share a key")
    children = cut(nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")))
    known = cut(lookup(nodes, children, ["node"]).select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children")))
    own = known.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"])
    last = lookup(rows, convs, ["conv_id"], "inner").filter("depth = n").select("node", "conv_id")
    ends = cut(ends_digest(last.unionByName(convs.filter("n = 0").select(root.alias("node"), "conv_id"))))
    n = known.limit(BROADCAST_ROWS + 1).count()
    out = lookup(lookup(known, sums, ["node"], rows=n), ends, ["node"], rows=n)
    parents = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = lookup(out, parents, ["parent"], rows=n)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
