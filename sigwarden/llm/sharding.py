"""Sharding by extendible hashing.

A directory indexed by the leading bits of a 60-bit hash starts with one bucket of depth 0; a bucket over the
byte limit splits on its next bit, and only such a bucket does. A bucket's bytes are never more than its
parent's, so the shard of a document is its shortest prefix whose bytes fit the limit.

Documents are summed to cells (prefixes STEP bits deeper than the last round's); a cell contributes to each of its
own prefixes, which gives all buckets of a round in one aggregation. Each cell then has its bucket, or is still too
large and starts the next round with its documents alone: a round is one lookup of the rows still under way. What
has used up all bits (one id's repeated rows, or a document over the limit) is cut by rows into overflow shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, cut, free_name, lookup, numbered

BITS, STEP = 60, 6


def hash_of(row_id: Column) -> Column:
    """60 bits of the MD5 of the id's decimal text; a null id counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(row_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _name(depth: Column, prefix: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """Of (h, bytes, ...): adds depth, shard, shard_bytes and shard_docs. Only buckets of depth BITS may be over the limit.

    A round costs one aggregation of the rows under way to at most 2**STEP cells a large cell (so cells are in number as
    the bytes over the limit, not as the rows), aggregations of cells, and one join of the rows to their cells.
    """
    active, top, done = rows, 0, []
    while True:
        deep = min(top + STEP, BITS)
        cell = F.shiftright("h", BITS - deep)
        cells = cut(active.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("h").alias("least"), F.max("h").alias("most")))
        n = cells.count()
        at = F.explode(F.sequence(F.lit(top), F.lit(deep))).alias("depth")
        above = cells.select("cell", "bytes", "docs", at).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        buckets = cut(above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")))
        # A leaf fits, and its parent does not; at the first depth of a later round no bucket does.
        over = F.col("shard_bytes") > limit
        split = buckets.filter(over).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fitting = buckets.filter(~over & (F.col("depth") > top)).withColumn("parent", F.shiftright("prefix", 1))
        leaves = lookup(fitting, split, ["depth", "parent"], "left_semi", rows=n).drop("parent")
        if top == 0:
            leaves = leaves.unionByName(buckets.filter(~over & (F.col("depth") == 0)))
        first = lookup(above.select("cell", "depth", "prefix"), leaves, ["depth", "prefix"], "inner", rows=n).select("cell", F.struct("depth", "prefix", "shard_bytes", "shard_docs").alias("b"))
        # A large cell of one hash alone can't be split by further bits.
        alone = F.when((F.col("least") == F.col("most")) & (F.col("bytes") > limit), F.struct(F.lit(BITS).alias("depth"), F.col("least").alias("prefix"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs")))
        entries = cut(lookup(cells, first, ["cell"], rows=n).select("cell", F.coalesce("b", alone).alias("b")).select("cell", "b.*"))
        found = lookup(active.withColumn("cell", cell), entries, ["cell"], "inner", rows=n).drop("cell")
        placed = found.filter("depth is not null").select(*rows.columns, "depth", _name(F.col("depth"), F.col("prefix")).alias("shard"), "shard_bytes", "shard_docs")
        done.append(placed)
        if not entries.filter("depth is null").limit(1).count():
            break
        active, top = cut(found.filter("depth is null").select(*rows.columns)), deep
    out = done[0]
    for placed in done[1:]:
        out = out.unionByName(placed)
    return out


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Cuts placed rows that share all bits: rows of equal size and hash are numbered, and each such group has shards of its own."""
    held = numbered(rows, ["shard", "bytes"], "copy")
    sizes = cut(held.groupBy("shard", "bytes").agg(F.count(F.lit(1)).alias("copies")))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    part = F.floor(F.col("copy") / each).cast("long")
    docs = F.least(each, F.col("copies") - part * each)
    name = F.concat("shard", F.lit("+"), F.col("bytes").cast("string"), F.lit("."), part.cast("string"))
    return lookup(held, sizes, ["shard", "bytes"], "inner").select(*[c for c in rows.columns if c not in ("shard", "shard_bytes", "shard_docs")], name.alias("shard"), (docs * F.col("bytes")).alias("shard_bytes"), docs.alias("shard_docs"))


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bytes, shard, depth, shard_bytes, shard_docs) for every row.

    ``bytes`` is the text's UTF-8 length (null: 0). ``shard`` is the bucket's prefix as binary digits, empty for a
    directory of one bucket. No shard is over ``limit`` bytes unless it is one document that is. Rows that repeat
    an id share all 60 bits; if together they are over the limit, those of one size are numbered and cut into overflow
    shards named ``prefix+size.0``, ``prefix+size.1``, ... An empty table gives none.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), _bytes(text_col).alias("bytes"), hash_of(F.col(id_col)).alias("h")))
    placed = _placed(rows, limit)
    over = placed.filter(F.col("shard_bytes") > limit)
    out = placed.filter(F.col("shard_bytes") <= limit).unionByName(_overflow(over, limit)) if over.limit(1).count() else placed
    return out.select(F.col("id").alias(id_col), "bytes", "shard", "depth", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every row of ``docs``, once and with all its columns, below ``path/shard=<name>``; each shard is written by
    one task. Rows with a null or a repeated id are rows like others; a column named shard is an error. An empty table
    writes no shard.

    The directory is looked up by hash: one shuffle brings the texts to their hashes' entries if these are too many to
    be broadcast, and one brings them to their shards.
    """
    if "shard" in [c.lower() for c in docs.columns]:
        raise ValueError("rename the column shard")
    h, size = free_name(docs, "h"), free_name(docs, "bytes")
    narrow = cut(docs.select(hash_of(F.col(id_col)).alias("h"), _bytes(text_col).alias("bytes")))
    entries = cut(_placed(narrow, limit).select(F.col("h").alias(h), "shard", F.col("shard_bytes")).distinct())
    over = entries.filter(F.col("shard_bytes") > limit)
    wide = docs.withColumns({h: hash_of(F.col(id_col)), size: _bytes(text_col)})
    plain = lookup(wide, entries.select(h, F.when(F.col("shard_bytes") <= limit, F.col("shard")).alias("shard")), [h], "inner")
    out = plain.filter("shard is not null").select(*docs.columns, "shard")
    n = over.limit(BROADCAST_ROWS + 1).count()
    if n:
        hot = over.select(h, F.col("shard"))
        large = numbered(wide.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, h), ["shard", size], free_name(wide, "copy"))
        copy = large.columns[-1]
        part = F.floor(F.col(copy) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col(size), F.lit(1)))).cast("long")).cast("long")
        out = out.unionByName(large.select(*docs.columns, F.concat("shard", F.lit("+"), F.col(size).cast("string"), F.lit("."), part.cast("string")).alias("shard")))
    out.repartition("shard").write.partitionBy("shard").parquet(path)
