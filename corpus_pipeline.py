"""A training-data pipeline: quality rules, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. A stage's decisions take effect: rejected documents go, one document of each group of
near duplicates stays, personal data is replaced, and a document stands as often as the mix takes it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.llm.bpe import encode_documents
from srcgraph.llm.common import settled
from srcgraph.llm.mixing import mix_copies, quality_weights
from srcgraph.llm.pii import redact_pii
from srcgraph.llm.prefix_join import jaccard_components
from srcgraph.llm.repetition import score_repetition


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    columns = docs.columns
    # names of our own: the table may have columns called like the measures
    plain = docs.select(docs["doc_id"], docs["text"], *(docs[f"`{c}`"].alias(f"_in{i}") for i, c in enumerate(columns)))
    judged = score_repetition(plain, keep=tuple(f"_in{i}" for i in range(len(columns)))).where("kept")
    return judged.select(*(F.col(f"_in{i}").alias(c) for i, c in enumerate(columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component under likeness 80 % of 5-word shingles: that with the least id, null ids last.

    Rows are told apart by a hash of all their columns, so rows that repeat an id or have none are
    judged by their own texts; of rows that agree in all columns one stays, even without words.
    """
    keyed = docs.withColumn("_key", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    keys = keyed.groupBy("_key").agg(F.min("doc_id").alias("_id"), F.count("*").alias("_rows"))
    found = jaccard_components(keyed.select("_key", "text"), n=5, percent=80, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    found = settled(found.where("_key <> component_id").unionByName(found.select(F.col("component_id").alias("_key"), "component_id").distinct()).join(keys, "_key"), "near-duplicates")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key"))["_key"].alias("_best"))
    marks = found.join(best, "component_id").select(F.col("_key").alias("_k"), (F.col("_key") != F.col("_best")).alias("_gone"), (F.col("_rows") > 1).alias("_twice")).where("_gone or _twice")
    kept = keyed.join(marks, F.col("_key") == F.col("_k"), "left").where("not coalesce(_gone, false)")
    out = kept.where("_twice is null").unionByName(kept.where("_twice").dropDuplicates(["_key"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_copies(docs, quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests and ids of every document."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: SQL cannot express tokenisation or the n-gram join at this size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage but the last ends in a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
