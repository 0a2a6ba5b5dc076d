"""The queries of this subpackage, by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, linededup, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations

    return format_conversations(_table(spark, sf_dir, "conversations"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import TARGETS, label_domains, mix

    found = mix(_table(spark, sf_dir, "documents"), label_domains(_table(spark, sf_dir, "labels")), TARGETS, max_rate=2.0)
    return found.drop("text_hash")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pack import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shared, tokenfile

    folder = shared.fresh_path(spark, "token-file")
    shards = tokenfile.write_documents(_table(spark, sf_dir, "documents"), folder)
    return tokenfile.read_documents(spark, folder, shards)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_documents

    return count_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_nearest": op2_nearest,
    "op3_quality": op3_quality,
    "op4_top_k": op4_top_k,
    "op5_chat": op5_chat,
    "op6_mixing": op6_mixing,
    "op7_pack": op7_pack,
    "op8_token_file": op8_token_file,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op4_top_k": topk.SQL, "op5_chat": chat.SQL, "op9_line_dedup": linededup.SQL}
