"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

#: Links of one node that one task aggregates, at most about.
NODE_LINKS = 1 << 16


def _with_least(pairs: DataFrame, salts: int) -> DataFrame:
    """(u, v, m): m is the least of u and all its v. A hub's pairs are spread over ``salts`` groups; a node of few
    pairs has no more groups than pairs. With one salt all pairs are so few that no node is a hub: they need no join."""
    if salts == 1:
        return pairs.select("u", "v", F.least("u", F.min("v").over(Window.partitionBy("u"))).alias("m"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", "m")


def connected_components(links: DataFrame) -> DataFrame:
    """Of undirected ``links`` (a, b): every node that occurs in a link between two nodes, with the least node of its component, as (node, root)."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        new = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first()
        if tuple(new) == state or not new[0]:
            break
        state = tuple(new)
        salts = 1 if new[0] <= NODE_LINKS else max(16, -(-new[0] // NODE_LINKS))  # no node has more links than there are
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, salts).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _with_least(large, salts)
        small = low.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
