"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm.lines import remove_repeated_lines
from returnlens.llm.mixing import mixed_rows
from returnlens.llm.near import kept_rows
from returnlens.llm.packing import pack
from returnlens.llm.quality import keep_good
from returnlens.llm.shared import documents, ship, stored

ORACLE_SQL = None  # a trained classifier and tokenization are beyond SQL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship(spark)
    return keep_good(docs, documents(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that earlier documents hold; those that were nothing else go."""
    ship(spark)
    cleaned = remove_repeated_lines(docs)
    changed = F.col(cleaned.columns[-1]) > 0
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.where(~changed | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Rows without an id, or
    with one that repeats, are documents of their own."""
    ship(spark)
    return kept_rows(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixed_rows(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the sequences."""
    ship(spark)
    return pack(docs)


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near duplicates", near_stage), ("mix", mix_stage), ("pack", pack_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's result is stored and read again by the next."""
    docs = documents(spark, sf_dir)
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "_"))
    return docs
