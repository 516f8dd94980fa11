"""From raw documents to token shards: five stages, each written as Parquet and read again as the next one's documents.

All stages but the last return the columns of their documents, whatever further ones there are and however they are
named; none changes a row. Texts of any length are read whole, and an empty table passes through empty. What each
does with nulls and repeated rows stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notelake.llm import decontaminate, minhash, mixing, queries, token_output, toxicity
from notelake.llm.workspace import cut, fresh_path
from notelake.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity. Rows without id or text stay; repeated rows stay or go together."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in five-word shingles at 0.8 or more, that of the smallest id. Rows without id or words stay; a row repeated with its id stays once."""
    return minhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. Rows without id or text stay; items without id or text are nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, once or more, as its source's weight asks for. A null source is one of its own; a null text has no words."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's index: doc_id, start, n_tokens and ids_crc32 of each document, as read back from it. A null text is empty; null ids come first; repeated rows are written as often as they stand."""
    path = fresh_path(spark, "token-store")
    token_output.write_store(docs, path, queries.TOKENIZER, queries.END_ID)
    return token_output.read_store(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_passages),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Learned terms and posterior tests aren't SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
