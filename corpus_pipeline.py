"""Training-data pipeline: toxicity, near duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import bagminhash, packing, pii, scratch, toxicity
from trellis.llm.queries import MIXTURE_TEMPERATURE, PII_KEY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject (operator 4)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, labels, {name: make() for name, make in toxicity.CHAIN.items()})
    return toxicity.keep_clean(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id (operator 7)."""
    return bagminhash.keep_one(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal data; n_chars follows the text (operator 2)."""
    out = pii.pseudonymise(docs, PII_KEY)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences at the sources' token shares (operator 3)."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, temperature=MIXTURE_TEMPERATURE)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: The chain, the signatures and the tokenizer are no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written to the shared folder and reread.

    A stage's own intermediate tables and its input are deleted when its result is written; those of the last
    stage stay for whoever reads the result.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        with scratch.scope(spark):
            out = step(spark, docs, sf_dir)
            before, path = path, scratch.new_dir(spark, name)
            out.write.parquet(path)
        if before is not None:
            scratch.remove(spark, before)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
