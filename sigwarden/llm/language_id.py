"""Language identification by Bayesian evidence fusion.

Classes are the languages of a model plus ``und`` (no known language). Evidence of a document:

- text: byte trigrams under each language's smoothed frequencies, tempered to the weight of at most
  TEMPER trigrams, since trigrams of one text are far from independent;
- the language that the markup declares: how often texts of each language declare it;
- the address suffix: how often texts of each language come from it;
- the host: the mix of languages there, smoothed towards that of the registered domain, and that towards
  the mix of all.

The last three are grouped counts over all documents, by the language that the text alone suggests. Only
the trigram frequencies are fitted on a sample, of about FIT_ROWS different labelled texts a language. A label
that a model is fitted on must not be handed in as declared language: it would be evidence for itself.

Classes with equal posterior: the first language by code point, ``und`` last.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import arrow_map, as_bytes, cut, free_name, lookup, slices
from .url_filter import registered_domain_of, suffix_of as _suffix_of

UNKNOWN = "und"
FIT_ROWS = 2000
BUCKETS = 1 << 14
TEMPER = 50.0
#: Weight of the level above in a smoothed mix, in documents.
PRIOR_DOCS = 20.0
#: Prior probability of a text in no known language.
UNKNOWN_PRIOR = 0.001
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(text: bytes | None) -> np.ndarray:
    """Bucket numbers of the byte trigrams of the text between spaces, A-Z lower-cased, runs of other ASCII as one space."""
    words = (text or b"").translate(_LETTERS).split()
    b = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8).astype(np.uint32) if words else np.zeros(0, np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``weights``: BUCKETS x (languages + 1) log frequencies; the last class is UNKNOWN, with equal frequencies."""

    languages: tuple[str, ...]
    weights: np.ndarray

    def log_likelihoods(self, text: bytes | None) -> np.ndarray:
        h = trigrams(text)
        if not len(h):
            return np.zeros(len(self.languages) + 1)
        total = sum((self.weights[h[i : i + 65_536]].sum(0, dtype=np.float64) for i in range(0, len(h), 65_536)), np.zeros(len(self.languages) + 1))
        return total * (TEMPER / (len(h) + TEMPER))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, most: int = 512) -> Model:
    """Fits the trigram frequencies on about ``rows`` different labelled texts of each language, chosen by a hash of the text.

    All labels are languages; over ``most`` of them are an error, since a model has BUCKETS numbers for each. Copies of a
    text count once, so a text that makes up a third of all rows is one of the sample. Rows with a null label or
    text aren't used; with no labelled row at all every text is UNKNOWN.
    """
    used = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h")).filter("text is not null and lang is not null")
    found = used.groupBy("lang", "h").agg(F.lit(1)).groupBy("lang").count().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} languages")
    languages = tuple(sorted(r["lang"] for r in found))
    counts = np.full((BUCKETS, len(languages)), 0.1)
    if languages:
        shares = labelled.sparkSession.createDataFrame([(r["lang"], int((1 << 30) * min(1.0, rows / r["count"]))) for r in found], "lang string, share long")
        chosen = used.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share"))
        sample = chosen.dropDuplicates(["lang", "h"]).select("text", "lang")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[str, np.ndarray] = {}
            for batch in slices(batches):
                for text, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                    own.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    own[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
            for lang, c in own.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

        # One row a language reaches the driver, with its buckets and their counts.
        sums = arrow_map(sample, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        place = {lang: i for i, lang in enumerate(languages)}
        for r in sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).collect():
            counts[np.asarray(r["buckets"], np.int64), place[r["lang"]]] += np.asarray(r["ns"], np.int64)
    logs = np.log(counts / counts.sum(0, keepdims=True)) if languages else np.zeros((BUCKETS, 0))
    return Model(languages, np.hstack([logs, np.full((BUCKETS, 1), -np.log(BUCKETS))]).astype(np.float32))


def suffix_of(host: Column) -> Column:
    """The public suffix of a host with at least two labels; else none."""
    return F.when(F.instr(host, ".") > 0, _suffix_of(host)).otherwise("")


def primary_tag(declared: Column) -> Column:
    """A declared language's primary subtag in lower case; empty if none is declared."""
    return F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]+)", 1))


def _best(scores: np.ndarray, languages: Sequence[str]) -> str:
    return [*languages, UNKNOWN][int(np.argmax(scores))]


def _likelihoods(docs: DataFrame, model: Model, text_col: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``ll``: the text's log likelihoods, null for a text without trigrams."""
    rows = docs.select(*keep, F.col(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ll", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.log_likelihoods(x) if len(trigrams(x)) else None for x in as_bytes(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return arrow_map(rows, run, schema)


def _counts(found: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(host, declared, lang, n) of (host, declared, ll): documents by what their text alone suggests."""
    names = F.array(*[F.lit(x) for x in (*languages, UNKNOWN)])
    best = F.coalesce(F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")), F.lit(UNKNOWN))
    return found.select("host", "declared", best.alias("lang")).groupBy("host", "declared", "lang").agg(F.count(F.lit(1)).alias("n"))


def _mixes(counts: DataFrame, key: str | None, languages: Sequence[str]) -> DataFrame:
    """Counts by ``key`` as one array in the order of the languages."""
    sums = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("double") for x in languages]
    return counts.groupBy(*([key] if key else [])).agg(F.array(*sums).alias(f"{key or 'all'}_n"))


def _smoothed(own: str, above: str) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(own, above, lambda x, p: (x + PRIOR_DOCS * p) / (total + PRIOR_DOCS))


def host_priors(counts: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(host, prior): for each language the log of its smoothed share on the host plus that of the suffix's evidence.

    Aggregates of aggregates: the first grouping has at most hosts x declared x languages rows.
    """
    k = len(languages)
    hosts = _mixes(counts, "host", languages).withColumns({"domain": registered_domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    known = counts.withColumns({"domain": registered_domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    every = _mixes(counts, None, languages).select(F.transform("all_n", lambda x: (x + 1.0)).alias("all_n"))
    every = every.select("all_n", F.transform("all_n", lambda x: x / F.aggregate("all_n", F.lit(0.0), lambda s, y: s + y)).alias("all_p"))
    domains = _mixes(known, "domain", languages).join(F.broadcast(every)).select("domain", _smoothed("domain_n", "all_p").alias("domain_p"))
    # P(suffix | language), with the suffix's overall share as its prior; no suffix says nothing.
    suffixes = _mixes(known, "suffix", languages).join(F.broadcast(every))
    total = F.aggregate("all_n", F.lit(0.0), lambda s, x: s + x)
    share = (F.aggregate("suffix_n", F.lit(0.0), lambda s, x: s + x) + 1.0) / (total + 1.0)
    suffixes = suffixes.select("suffix", F.when(F.col("suffix") == "", F.array_repeat(F.lit(0.0), k)).otherwise(F.zip_with("suffix_n", "all_n", lambda x, n: F.log((x + PRIOR_DOCS * share) / (n + PRIOR_DOCS)))).alias("suffix_log"))
    joined = hosts.join(domains, "domain").join(suffixes, "suffix")
    return joined.select("host", F.zip_with(_smoothed("host_n", "domain_p"), "suffix_log", lambda p, s: F.log(p) + s).alias("prior"))


def declared_logs(counts: DataFrame, languages: Sequence[str]) -> dict[str, np.ndarray]:
    """log P(declared | language) for each language as declared tag, and for ``other``; nothing declared says nothing."""
    tag = F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise("other")
    tally = {t: np.zeros(len(languages)) for t in (*languages, "other")}
    for r in counts.filter("declared <> ''").groupBy(tag.alias("tag"), "lang").agg(F.sum("n").alias("n")).collect():
        if r["lang"] in languages:
            tally[r["tag"]][languages.index(r["lang"])] = r["n"]
    total = sum(tally.values())
    return {t: np.log((c + 1.0) / (total + len(tally))) for t, c in tally.items()}


def _evidence(found: DataFrame, languages: Sequence[str]) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The host priors and the declared tags' logs of (host, declared, ll)."""
    counts = cut(_counts(found, languages))
    return cut(host_priors(counts, languages)), declared_logs(counts, languages)


def posterior(ll: np.ndarray | None, tag: str, prior: Sequence[float] | None, languages: Sequence[str], by_tag: dict[str, np.ndarray]) -> tuple[str, float]:
    """The language and its posterior probability from all evidence of one document; UNKNOWN and 0 without trigrams."""
    if ll is None or not languages:
        return UNKNOWN, 0.0
    score = np.array(ll, float)
    score[:-1] += np.log1p(-UNKNOWN_PRIOR) + (0.0 if prior is None else np.array(prior) - _norm(prior))
    score[-1] += np.log(UNKNOWN_PRIOR)
    if tag:
        logs = by_tag[tag if tag in languages else "other"]
        score[:-1] += logs - _norm(logs) + np.log(len(logs))
    p = np.exp(score - score.max())
    p /= p.sum()
    return _best(p, languages), float(p.max())


_FOUND = [T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def _judged(rows: DataFrame, keep: Sequence[str], languages: Sequence[str], by_tag: dict[str, np.ndarray], min_posterior: float, likelihood) -> DataFrame:
    """The columns ``keep`` (the first of ``rows``) and the decision; after them ``rows`` has tag, prior and what ``likelihood`` reads."""
    schema = T.StructType([*[rows.schema[c] for c in keep], *_FOUND])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [posterior(ll, tag, prior, languages, by_tag) for ll, tag, prior in zip(likelihood(batch.column(k + 2)), batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())]
            names, sure = [x for x, _ in found], [p for _, p in found]
            ok = [x != UNKNOWN and p >= min_posterior for x, p in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(ok, pa.bool_())], names=schema.names)

    return arrow_map(rows, run, schema)


def _given(declared: Column | None, host: Column | None) -> tuple[Column, Column]:
    none = F.lit("")
    return (F.coalesce(host, none) if host is not None else none), (primary_tag(declared) if declared is not None else none)


def judge(docs: DataFrame, model: Model, keep: Sequence[str], text_col: str = "text", declared: Column | None = None, host: Column | None = None, min_posterior: float = 0.5) -> DataFrame:
    """The columns ``keep`` with ``language``, ``posterior`` and ``accepted``, as ``identify`` finds them; the text isn't
    among them, so it is read once and never shuffled: only its likelihoods are kept. Names that ``keep`` shares
    with the result are an error."""
    host, tag = _given(declared, host)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), tag.alias("declared"), F.col(text_col).alias("text"))
    own = [f"k{i}" for i in range(len(keep))]
    found = cut(_likelihoods(rows, model, "text", [*own, "host", "declared"]))
    priors, by_tag = _evidence(found, model.languages)
    joined = lookup(found, priors, ["host"]).select(*own, "declared", "prior", "ll")
    return _judged(joined, own, model.languages, by_tag, min_posterior, lambda column: column.to_pylist()).withColumnsRenamed(dict(zip(own, keep)))


def identify(docs: DataFrame, model: Model, text_col: str = "text", declared: Column | None = None, host: Column | None = None, min_posterior: float = 0.5) -> DataFrame:
    """``docs`` with ``language``, ``posterior`` and ``accepted``.

    ``declared`` is a markup language (any BCP 47 tag) and ``host`` an address's host; a null one, or none, is no
    evidence. A text without letters (null, empty, digits) is ``und`` with posterior 0. A document is accepted if its
    language is known and its posterior is at least ``min_posterior``. Columns of these three names are replaced;
    repeated rows are judged each; an empty table gives none. Host priors are joined by a checked broadcast, beyond
    its bound by a shuffle of the rows in which a hot host is split; ``judge`` shuffles no text.
    """
    host, tag = _given(declared, host)
    first = docs.select(host.alias("host"), tag.alias("declared"), F.col(text_col).alias("text"))
    priors, by_tag = _evidence(_likelihoods(first, model, "text", ["host", "declared"]), model.languages)
    text = F.col(text_col)
    docs = docs.withColumns({(at := free_name(docs, "host")): host, (tag_at := free_name(docs, "declared")): tag, (text_at := free_name(docs, "text")): text}).drop("language", "posterior", "accepted")
    columns = [c for c in docs.columns if c not in (at, tag_at, text_at)]
    prior_at = free_name(docs, "prior")
    joined = lookup(docs, priors.select(F.col("host").alias(at), F.col("prior").alias(prior_at)), [at]).select(*columns, tag_at, prior_at, text_at)
    return _judged(joined, columns, model.languages, by_tag, min_posterior, lambda column: [model.log_likelihoods(x) if len(trigrams(x)) else None for x in as_bytes(column)])


def _norm(logs) -> float:
    """The log of the sum of exponentials."""
    logs = np.asarray(logs, float)
    return float(np.log(np.exp(logs - logs.max()).sum()) + logs.max())
