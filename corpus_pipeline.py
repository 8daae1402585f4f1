"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``; ``run`` writes each stage's rows as Parquet to shared storage and reads them for the next.

In every stage a null text counts as empty, texts of any length are read whole, null and repeated ids are rows like any
others, further columns of ``docs`` are left out whatever their names, and a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, pii, quality_cnn, simhash_dedup
from tessera.llm.shared import joined_by_size, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled rows, doesn't reject, repeated rows as often as they
    occur; without labels it is untrained."""
    judged = quality_cnn.quality_classifier(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that of the smallest doc_id (null ids last), of equal ids the
    smallest digest. Rows are known by a digest of all columns, not by doc_id, which may be null or repeated; of rows
    that are equal in all columns one stays. Texts without words are one group."""
    docs = docs.select(*COLUMNS).withColumn("_key", row_digest())
    found = stored(docs.select("doc_id", "_key", simhash_dedup.fingerprints(F.coalesce("text", F.lit(""))).alias("fp")))
    # a fingerprint stands for itself, so that those of null ids alone are linked too
    groups = simhash_dedup.fingerprint_groups(found.select(F.col("fp").alias("doc_id"), "fp")).select("fp", "component")
    groups = groups.join(found.groupBy("fp").agg(F.count("*").alias("_n")).hint("merge"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_key")).alias("first")
    kept = joined_by_size(found, groups, "fp", found.count()).groupBy("component").agg(first).select("first._key")
    # equal rows are made one before the shuffle, in each task, and the join finds them dealt by their key already
    return docs.dropDuplicates(["_key"]).join(kept.hint("merge"), "_key", "left_semi").select(*COLUMNS)


def row_digest() -> Column:
    """A digest of a row's columns, each with its length, nulls apart from empty strings."""
    values = [F.col(c).cast("string") for c in COLUMNS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; null texts stay null."""
    return pii.mask_pii(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's mean repetition rate says, in a global hashed order; a null source is one too."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences and their places; an empty text is its end alone."""
    return packing.best_two_fit(docs.select("doc_id", "text"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: A network's probabilities and tokens are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
