"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwarden.llm import bpe, jaccard, language_id, line_dedup, mixing
from sigwarden.llm.queries import TOKENIZER
from sigwarden.llm.runtime import checkpoint_folder, remove_folder, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no known language; the text and the source are evidence. The label, on which the trigrams are
    fitted, is none. A null or empty text, or one without letters, is of no known language; an empty table gives none."""
    found = language_id.identify(docs, language_id.fit(docs), host=F.col("source"))
    return found.filter("accepted").select(*docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in 10 documents or more; a document may be left with an empty text."""
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by a Jaccard similarity of 0.8 or more of five-word
    shingles; candidates come from SimHash chains and, as these alone miss most such pairs, from MinHash bands."""
    return jaccard.drop_similar(docs, words=5, similarity=0.8, bits=3).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents, some twice, so that sources come near their targets. A null text has no words and is not taken unless its source is taken
    whole; a null source is one of its own; an empty table gives none."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0, seed=17).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to. A null or empty text has no ids; repeated rows are encoded each."""
    import public_tokenizers

    coded = bpe.encode_and_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", without_common_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("bpe", tokenized),
]

#: SQL has neither the classifier, nor XXH64 over shingles, nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, with each one's result as a table below the checkpoint folder; a table goes
    as soon as the next one is written, the last one with the folder."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
