"""The three flat tables bucketed by log, so that their joins move no rows.

All three are dealt into the same number of buckets by ``log_id``, which is unique per log, so no bucket is hot.
They are partitioned by batch: a repeated batch replaces itself, and a scan reads the same bucket of all
batches in one task. The session's catalog only points to the files; ``open_buckets`` registers them anew.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.operators.model import BucketedLogModel, LogModel
from returnlens.operators.silver import dim_log, fact_entities, fact_rejections
from returnlens.sources.silver import BATCH, _path, _read

KEY = "log_id"
# Enough for tasks of some hundred MB at a few ten TB; fixed when the tables are first written.
BUCKETS = 4096
COUNT = "baldes"
# Logs per bucket where the number of buckets follows the table.
BUCKET_LOGS = 100_000
TABLES = {"dim_log": dim_log, "fact_rejeicoes_semanticas": fact_rejections,
          "fact_entidades_extraidas": lambda nested, keep: fact_entities(nested, keep=(KEY, *keep))}


def _bucket_count(spark: SparkSession, path: str) -> int | None:
    found = _read(spark, f"{path}/{COUNT}")
    return None if found is None else found.first()[COUNT]


def _register(spark: SparkSession, path: str, name: str, columns: str, buckets: int) -> str:
    """Name of the table over the files of a folder, with the batches it holds now."""
    table = f"returnlens_{hashlib.md5(path.encode()).hexdigest()[:12]}_{name}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({BATCH}) "
              f"CLUSTERED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
    system, target = _path(spark, f"{path}/{name}")
    if system.exists(target):
        spark.catalog.recoverPartitions(table)
    return table


def _columns(project, nested: DataFrame) -> tuple[str, str]:
    """Schema of a table as DDL, and its columns in order, the batch last."""
    rows = project(nested, keep=(BATCH,))
    return ", ".join(f"`{n}` {t}" for n, t in rows.dtypes), rows.columns


def buckets_for(logs: int, least: int = 8) -> int:
    """Number of buckets for a table of so many logs, so that the tasks of a join grow in number, not in size."""
    return max(least, min(BUCKETS, -(-logs // BUCKET_LOGS)))


def write_buckets(nested: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the batches of a nested table, which replace themselves and leave the others as they are.

    The number of buckets counts at the first write; later ones keep that of the tables.
    """
    spark = nested.sparkSession
    known = _bucket_count(spark, path)
    if known is None:
        spark.range(1).select(F.lit(buckets).alias(COUNT)).coalesce(1).write.mode("overwrite").parquet(f"{path}/{COUNT}")
    else:
        buckets = known
    for name, project in TABLES.items():
        columns, order = _columns(project, nested)
        table = _register(spark, path, name, columns, buckets)
        rows = project(nested, keep=(BATCH,)).select(*order)
        rows.repartition(buckets, KEY).write.insertInto(table, overwrite=True)


def open_buckets(spark: SparkSession, path: str, nested: DataFrame) -> LogModel:
    """Model over the bucketed tables that were written from a nested table like the given one."""
    buckets = _bucket_count(spark, path)
    names = [_register(spark, path, name, _columns(project, nested)[0], buckets) for name, project in TABLES.items()]
    return BucketedLogModel(*map(spark.table, names))
