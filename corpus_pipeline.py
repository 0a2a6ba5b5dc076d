"""Corpus pipeline: five operators in a row, each stage written as Parquet and read again.

Stages take (spark, docs, sf_dir) and, but for the last, return the columns of ``documents``. Parameters are those of
the operators' own queries where nothing else is said. Decisions are carried by id and text together, null ids included,
so rows with one id are judged each by its own text; rows that agree in both share their decision. Other columns of a
stage's input go, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perron.llm import shared
from perron.llm.linededup import dedup_lines
from perron.llm.mixing import SAFE_TARGETS, label_domains, mix
from perron.llm.neardup import near_duplicates
from perron.llm.pack import pack_documents
from perron.llm.quality import score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))


def _matches(docs: DataFrame, other: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(other["_id"]) & (docs["_hash"] == other["_text"])


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_hash) are among ``rejected``."""
    keyed, keys = _keyed(docs), rejected.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    return keyed.join(keys, _matches(keyed, keys), "left_anti").select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 or more). Null and empty texts are scored as such."""
    scored = score_documents(docs, _labels(spark, sf_dir))
    return _without(docs, scored.where("predicted = 0"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; a document that loses them all goes.

    n_chars follows the text. Rows with one id (the null id, which comes first, too) are one document, so lines that only
    they share stay.
    """
    kept = dedup_lines(docs.select(COLUMNS)).where("n_dropped < n_lines")
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8 or more): that of the smallest id.

    Null ids count as largest; of rows with one id that of the smallest hash of the text stays, and of rows that agree in
    both any one. Null, empty and blank texts are one group.
    """
    found = near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_text"))
    keyed = _keyed(docs)
    # the merge join leaves rows of one key together, so the window needs no exchange of its own
    held = keyed.join(first.hint("merge"), _matches(keyed, first), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy(F.lit(0)))
    return held.withColumn("_place", place).where("_place = 1").select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix asks: rates of at most 1, so clean text stays, and no toxic text by the targets."""
    rates = mix(docs, label_domains(_labels(spark, sf_dir)), SAFE_TARGETS, max_rate=1.0)
    return _without(docs, rates.where("copies = 0"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; null ids stay null, null texts are empty."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicate),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        following = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        shared.discard(spark, docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
