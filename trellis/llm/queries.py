"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import bpe

    return bpe.round_trip(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


#: Key of the registered query's pseudonyms; a deployment passes its own secret.
PII_KEY = "trellis-demonstration-key"


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import pii

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, count_col="n_replaced")


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    chain = toxicity.train(docs, labels, {k: make() for k, make in toxicity.CHAIN.items()})
    return toxicity.score(docs, chain)


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


#: Sources weigh their size to this power, so that small ones have more than their share of a window.
MIXTURE_TEMPERATURE = 0.7


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, temperature=MIXTURE_TEMPERATURE)


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import ann

    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import bagminhash

    return bagminhash.classes(_table(spark, sf_dir, "documents"))


def op8_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import pq

    return pq.links(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import warc

    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm import eliasfano

    return eliasfano.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_feistel_pii": op2_feistel_pii,
    "op3_mixture_packing": op3_mixture_packing,
    "op4_classifier_chain": op4_classifier_chain,
    "op5_collision_counting": op5_collision_counting,
    "op6_license_rules": op6_license_rules,
    "op7_bagminhash": op7_bagminhash,
    "op8_product_quantisation": op8_product_quantisation,
    "op9_warc_segments": op9_warc_segments,
    "op10_elias_fano": op10_elias_fano,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc_segments": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
        q AS (SELECT page_id, octet_length(payload) AS payload_bytes, digest,
                     max(page_id) OVER (PARTITION BY digest) AS last FROM p)
        SELECT page_id, payload_bytes, digest AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM q
    """,
}
