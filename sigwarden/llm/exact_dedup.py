"""Exact deduplication by a 128-bit content hash, with bytes compared inside its groups. Native.

Rows are grouped by the digest of their normalised text alone. Only in groups of more than one row are bytes
compared: there the texts themselves are grouped, so texts that share a digest without being equal become groups of
their own. A row finds its group by digest and SHA-256, which tells such texts apart.

A text that no other row has is not sent anywhere while the digests that occur twice are few enough to be broadcast. If they are
more, a bitmap of their hashes (FILTER_BITS, whatever their number) keeps out all single texts but those that share a bit with
one of them: with ten million repeated digests, 7 in 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, ascii_lower, cut, free_name, lookup


#: Bits of the bitmap by which single texts are told from repeated ones; 16 MB in all.
FILTER_BITS = 1 << 27


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest_of(norm: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(norm))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, sha) of every row, computed and kept: all that the grouping and the answer need."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return cut(norm.select("id", digest_of(F.col("norm")).alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha")))


def duplicate_groups(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=digest_of) -> DataFrame:
    """One row for each different text: ``digest``, ``sha``, ``keep_id``, ``group_size``; ``rows`` are the ``digests`` of ``docs``.

    Copies collapse before the shuffle: a text that makes up a third of all rows is sent once by each task. Groups of one
    row are done after the first grouping.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    by_digest = cut(rows.groupBy("digest").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("sha").alias("sha")))
    several = cut(by_digest.filter("group_size > 1").select("digest"))
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    wide, n = norm.withColumn("digest", digest(F.col("norm"))), several.limit(BROADCAST_ROWS + 1).count()
    inside = lookup(wide if n <= BROADCAST_ROWS else possibly_in(wide, several), several, ["digest"], "left_semi", n)
    compared = inside.groupBy("digest", "norm").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    compared = compared.select("digest", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    return by_digest.filter("group_size = 1").select("digest", "sha", "keep_id", "group_size").unionByName(compared)


def possibly_in(rows: DataFrame, several: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``digest`` is one of ``several``, and a few others: a bitmap of ``bits`` bits is broadcast, in parts of 4 KB."""
    spot = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    maps = several.select(F.bitmap_bucket_number(spot).alias("map_no"), F.bitmap_bit_position(spot).alias("bit")).groupBy("map_no").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    probed = rows.withColumn("row_map", F.bitmap_bucket_number(spot)).join(F.broadcast(maps), F.col("row_map") == F.col("map_no"))
    return probed.filter(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    rows = digests(docs, id_col, text_col)
    groups = cut(duplicate_groups(docs, rows, id_col, text_col, keep))
    return rows.join(groups, ["digest", "sha"]).select("id", "digest", "sha", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Every row's id, the id that stays of its group, the group's size, whether the row stays, the text's SHA-256.

    Stable ids decide which row stays: the smallest, or the largest with ``keep="max"``. A null text
    counts as empty. Null ids never stay unless all ids of a group are null (then ``keep_id`` is null
    and all its rows stay). Rows that repeat both id and text cannot be told apart and get the same
    flags. An empty table gives an empty result. Only the two named columns are read.
    """
    return _marked(docs, id_col, text_col, keep).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names; of rows that repeat id and text, any one."""
    marked = cut(_marked(docs, id_col, text_col, keep))
    digest, sha, gone_id = free_name(docs, "digest"), free_name(docs, "sha"), free_name(docs, "gone_id")
    norm = normalised(F.col(text_col))
    wide = docs.withColumns({digest: digest_of(norm), sha: F.unhex(F.sha2(norm, 256))})
    gone = cut(marked.filter("not kept").select(F.col("digest").alias(f"{gone_id}_d"), F.col("sha").alias(f"{gone_id}_s"), F.col("id").alias(gone_id)).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = (F.col(digest) == F.col(f"{gone_id}_d")) & (F.col(sha) == F.col(f"{gone_id}_s")) & F.col(id_col).eqNullSafe(F.col(gone_id))
    stay = wide.join(F.broadcast(gone) if few else gone, same, "left_anti")
    repeated = marked.filter("kept").groupBy("digest", "sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.limit(1).count():
        stay = stay.dropDuplicates([digest, sha])
    return stay.select(*docs.columns)
