"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share, by weight, of a total budget of words; targets stop at a multiple of the
source's size and the excess is shared anew. A target first takes complete epochs of its source; what
is left takes a sample: every document has an exponential key divided by its quality weight, and
documents are taken by rising key until their words, prefix-summed, fill the budget.

No source is sorted as a whole. Keys are numbers of BITS bits; in each round, sums by (source, next DIGIT bits of
the key) find in which of 64 ranges the budget ends, and only that range's rows go on, until few are left and are
summed in order. What comes out is one cutoff a source; taking documents by it is a map over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running_sums
from .runtime import WORD, cut, free_name, lookup, numbered

#: Rows of one source that are summed in order at the end, at most if their keys differ in BITS bits.
RANGE_ROWS = 64
BITS, DIGIT = 48, 6


def words_of(text: Column) -> Column:
    """Words between white space (U+0020, U+0009-U+000D); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """The share of letters in a text, at least 0.05; 0.05 for null and empty texts."""
    share = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.length(text)
    return F.greatest(F.when(F.length(text) > 0, share).otherwise(0.0), F.lit(0.05))


def sampling_key(row_id: Column, text: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality, with u in (0, 1] from a hash of seed, id and text: the smallest keys are a weighted sample."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"), text))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / 2.0**52
    return -F.log(u) / quality


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Of (source, source_size), each source once: adds ``target``.

    Sources by code point, null last, have the weights in turn. Targets are least(most * size, level *
    weight), with the level at which they add up to ``share`` of all sizes. The level rises to that from below: sources
    that are full at a level pass what they lack on to the others, which raises it, until no more are full. A rise is
    one aggregation over the sources, and the turn is a running count, so no task sees all sources.
    """
    ordered = [F.col("source").asc_nulls_last()]
    placed = running_sums(sizes, ordered, {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    weighted = cut(placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most)))
    budget = (weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        # A source is full if its share at this level is over what it may have; what they lack goes to the others.
        is_full = F.col("most") <= F.lit(level) * F.col("weight")
        n, caps, open_ = weighted.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not open_:
            break
        full, level = n, (budget - caps) / open_
    return weighted.select("source", "source_size", F.least("most", F.lit(float(level)) * F.col("weight")).alias("target"))


def cutoffs(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Of (source, size, key): one row for each source with source_size, target, ``epochs``, ``cutoff``, ``last`` and ``tied``.

    A document is taken ``epochs`` times, once more if its key is under the cutoff, and with ``last`` words more, for all
    ``tied`` rows of that key together, if its key is the cutoff.
    """
    by_source = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    targets = source_targets(by_source, weights, share, most)
    targets = cut(targets.withColumn("epochs", epochs.cast("long")).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")).withColumn("has", F.col("source").isNotNull()).withColumn("name", F.coalesce("source", F.lit(""))))

    number = F.least(F.floor(F.col("key") / (F.col("key") + 1) * 2.0**BITS), F.lit(2.0**BITS - 1)).cast("long")
    active = rows.select(F.col("source").isNotNull().alias("has"), F.coalesce("source", F.lit("")).alias("name"), "size", "key", number.alias("number"))
    rests = targets.filter("rest > 0").select("has", "name", "rest")
    earlier = Window.partitionBy("has", "name").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    for depth in range(DIGIT, BITS + 1, DIGIT):
        digit = F.shiftright("number", BITS - depth).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")
        sums = active.groupBy("has", "name", digit.alias("digit")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        sums = lookup(sums.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))), rests, ["has", "name"], "inner")
        ends = cut(sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))).select("has", "name", "digit", (F.col("rest") - F.col("before")).alias("rest"), "n"))
        active = cut(lookup(active.withColumn("digit", digit), ends.select("has", "name", "digit"), ["has", "name", "digit"], "inner").select("has", "name", "size", "key", "number"))
        rests = ends.select("has", "name", "rest")
        if (ends.agg(F.max("n")).first()[0] or 0) <= RANGE_ROWS:
            break

    last = lookup(active, rests, ["has", "name"], "inner").groupBy("has", "name", "key", "rest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    keys = Window.partitionBy("has", "name").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    over = last.withColumn("before", F.coalesce(F.sum("size").over(keys), F.lit(0))).filter(F.col("before") < F.col("rest"))
    final = over.groupBy("has", "name").agg(F.max_by(F.struct("key", F.least("size", F.col("rest") - F.col("before")).alias("words"), "n"), "key").alias("c"))
    return lookup(targets, cut(final), ["has", "name"]).select(
        "source", "source_size", "target", "epochs", F.coalesce("c.key", F.lit(-1.0)).alias("cutoff"), F.coalesce("c.words", F.lit(0)).cast("long").alias("last"), F.coalesce("c.n", F.lit(0)).cast("long").alias("tied")
    )


def with_shares(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` with mix_size, mix_key and its source's mix_source_size, mix_target, mix_epochs, mix_cutoff, and mix_last,
    the words that the row gets beyond the epochs if its key is the cutoff.

    Columns of these names are replaced; other names don't matter. Reruns give the same rows: keys depend on seed, id and
    text alone. Rows that repeat both have one key; at the cutoff they are numbered and filled one after the other. A
    null source is a source of its own, a null text has no words. An empty table gives none. Without ``keep_text`` the
    text is left out, and sizes and keys are computed once instead of twice.
    """
    text = F.col(text_col)
    size, key = words_of(text), sampling_key(F.col(id_col), text, quality_of(text), seed)
    docs = docs.drop(*[f"mix_{c}" for c in ("size", "key", "source_size", "target", "epochs", "cutoff", "last")])
    has, name, left, tied = (free_name(docs, x) for x in ("has", "name", "left", "tied"))
    keyed = docs.withColumns({"mix_size": size, "mix_key": key, has: F.col(source_col).isNotNull(), name: F.coalesce(source_col, F.lit(""))})
    if not keep_text:
        keyed = cut(keyed.drop(text_col))
        plan = cutoffs(keyed.select(F.col(source_col).alias("source"), F.col("mix_size").alias("size"), F.col("mix_key").alias("key")), weights, share, most)
    else:
        plan = cutoffs(cut(docs.select(F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))), weights, share, most)
    plan = cut(plan.select(F.col("source").isNotNull().alias(has), F.coalesce("source", F.lit("")).alias(name), *[F.col(c).alias(f"mix_{c}") for c in ("source_size", "target", "epochs", "cutoff")], F.col("last").alias(left), F.col("tied").alias(tied)))
    out = lookup(keyed, plan, [has, name])
    columns = [c for c in out.columns if c not in (has, name, left, tied)]
    at = F.col("mix_key") == F.col("mix_cutoff")
    alone = out.select(*columns, F.when(at, F.col(left)).otherwise(0).alias("mix_last"))
    if not plan.filter(F.col(tied) > 1).limit(1).count():
        return alone
    # Only rows of a key that several share at a cutoff are numbered; they have one size, and fill what is left in turn.
    shared = at & (F.col(tied) > 1)
    copy = free_name(out, "copy")
    ties = numbered(out.filter(shared), [has, name], copy)
    fill = F.greatest(F.lit(0), F.least("mix_size", F.col(left) - F.col(copy) * F.col("mix_size")))
    return out.filter(~F.coalesce(shared, F.lit(False))).select(*columns, F.when(at, F.col(left)).otherwise(0).alias("mix_last")).unionByName(ties.select(*columns, fill.cast("long").alias("mix_last")))


def taken_words() -> Column:
    """How many words of a row of ``with_shares`` the mix takes; the document at the cutoff may be taken in part."""
    more = F.when(F.col("mix_key") < F.col("mix_cutoff"), F.col("mix_size")).when(F.col("mix_key") == F.col("mix_cutoff"), F.least("mix_last", "mix_size")).otherwise(0)
    return (F.col("mix_epochs") * F.col("mix_size") + more).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, whole; the document at the cutoff if at least half of it is.

    A null text has no words, a null source is one of its own, repeated rows count each, columns keep their names; an empty table gives none."""
    shared = with_shares(docs, **options)
    whole = (F.col("mix_key") < F.col("mix_cutoff")) | ((F.col("mix_key") == F.col("mix_cutoff")) & (F.col("mix_last") * 2 >= F.col("mix_size")))
    copies = F.col("mix_epochs").cast("int") + whole.cast("int")
    return shared.filter(copies > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), copies)).alias(copy := free_name(docs, "copy"))).drop(copy)
