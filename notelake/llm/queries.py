"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import decontaminate, embed_dedup, html_extract, minhash, mixing, pii, quality, token_output, toxicity, url_filter
from .workspace import fresh_path

#: The tokenizer file and end-of-document id of the token output query.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return quality.judge(table(spark, sf_dir, "documents"), labels)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_output.write_store(table(spark, sf_dir, "documents"), path, TOKENIZER, END_ID)
    return token_output.read_store(spark, path)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__block").alias("block"), F.col("__copies").alias("copies"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHashParams(shingle=2))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_html_extract": op3_html_extract,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_token_output": op7_token_output,
    "op8_mixing": op8_mixing,
    "op9_minhash": op9_minhash,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op8_mixing": mixing.ORACLE_SQL,
}
