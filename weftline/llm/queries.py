"""The registered queries of this subpackage, thin over the operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.ann import nearest_neighbours
from weftline.llm.line_dedup import line_digest
from weftline.llm.mixing import mix_digest
from weftline.llm.packing import pack_documents
from weftline.llm.passage_dedup import passage_digest
from weftline.llm.quality import ORACLE_SQL as QUALITY_SQL
from weftline.llm.quality import quality_digest
from weftline.llm.sharding import ORACLE_SQL as SHARD_SQL
from weftline.llm.sharding import shard_documents
from weftline.llm.simhash import simhash_digest
from weftline.llm.token_store import store_documents
from weftline.llm.toxicity import toxicity_digest


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_read(spark, sf_dir, "documents"), 24)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(_read(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(_read(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digest(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_store": op5_token_store,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_passage_dedup": op10_passage_dedup,
}

ORACLE: dict[str, str] = {"op6_sharding": SHARD_SQL, "op9_quality": QUALITY_SQL}
