"""Detail pages at any depth, from rows stored in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnlens.plans.detail import PAGE_SIZE, detail_projection

ROWS, DIRECTORY, COLUMNS = "linhas", "diretorio", "colunas"
RANGE, POSITION = "faixa", "posicao"
# A row's id is its range times this, plus its position there.
RANGE_BITS = 33


def newest_first() -> list[Column]:
    return [F.desc("data"), F.asc("hash_evento"), F.asc_nulls_last("rejeicao_id")]


def write_pages(rows: DataFrame, path: str) -> None:
    """Store detail rows newest first, in ranges of like size, with a directory of the rows per range.

    The order has no ties within a log and its key is unique, so ranges part a moment or client of any size.
    The directory has one row per range, however many rows there are.
    """
    spark, details = rows.sparkSession, detail_projection(rows)
    ordered = details.repartitionByRange(*newest_first()).sortWithinPartitions(*newest_first()).withColumn("_id", F.monotonically_increasing_id())
    placed = ordered.select(*details.columns, F.shiftright("_id", RANGE_BITS).cast("int").alias(RANGE),
                            F.col("_id").bitwiseAND(F.lit((1 << RANGE_BITS) - 1)).alias(POSITION))
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/{COLUMNS}")
    (placed.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
     .partitionBy(RANGE).parquet(f"{path}/{ROWS}"))
    counts = _rows(spark, path).groupBy(RANGE).agg(F.count(F.lit(1)).alias("linhas"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counts.withColumn("antes", F.coalesce(F.sum("linhas").over(before), F.lit(0))).write.mode("overwrite").parquet(f"{path}/{DIRECTORY}")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/{COLUMNS}").schema).parquet(f"{path}/{ROWS}")


def page_count(spark: SparkSession, path: str, size: int = PAGE_SIZE) -> int:
    total = spark.read.parquet(f"{path}/{DIRECTORY}").agg(F.coalesce(F.sum("linhas"), F.lit(0))).first()[0]
    return -(-total // size)


def page_at(spark: SparkSession, path: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """A page, counted from 1; empty behind the last. It reads the ranges it lies in and sorts only its own rows."""
    start = (number - 1) * size
    directory = spark.read.parquet(f"{path}/{DIRECTORY}")
    # At most one range per row of the page.
    touched = directory.where((F.col("antes") < start + size) & (F.col("antes") + F.col("linhas") > start)).collect()
    parts = [(F.col(RANGE) == r[RANGE]) & F.col(POSITION).between(start - r.antes, start + size - 1 - r.antes) for r in touched]
    chosen = reduce(lambda a, b: a | b, parts, F.lit(False))
    return _rows(spark, path).where(chosen).orderBy(RANGE, POSITION).drop(RANGE, POSITION, "rejeicao_id")
