"""The classification on a stream of raw log files.

Every step up to the nested table works on one row at a time, so a stream needs neither state nor
watermark; each file that arrives is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from returnlens.operators.canonical import canonicalize
from returnlens.operators.silver import classify_logs
from returnlens.sources.rawlogs import DEFAULT_DELIMITER, UTF8


def stream_raw_logs(
    spark: SparkSession, folder: str, columns: list[str], separator: str = DEFAULT_DELIMITER, encoding: str = UTF8
) -> DataFrame:
    """Raw logs of the files that arrive in a folder. A stream needs its columns named. A row that does
    not fit them comes with its text in ``rejeitada``."""
    schema = ", ".join(f"`{c}` STRING" for c in (*columns, "rejeitada"))
    raw = (
        spark.readStream.schema(schema).option("header", True).option("sep", separator).option("encoding", encoding)
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "rejeitada").option("columnPruning", False)
        .csv(folder)
    )
    return raw.select("*", F.col("_metadata.file_name").alias("arquivo"))


def stream_silver(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the classified logs of the stream to the nested table at ``path``, exactly once, and the
    rows that do not fit to ``path`` with ``_rejeitadas`` behind it."""

    def replace(rows: DataFrame, batch_id: int, target: str) -> None:
        # A batch that is repeated after a failure replaces its own partition.
        (rows.withColumn("lote", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("lote").parquet(target))

    def write(batch: DataFrame, batch_id: int) -> None:
        replace(batch.where("rejeitada IS NOT NULL").select("arquivo", "rejeitada"), batch_id, f"{path}_rejeitadas")
        keyed = batch.where("rejeitada IS NULL").drop("rejeitada").withColumn(
            "log_id", F.concat_ws("_", F.lit("log"), F.lit(batch_id), F.monotonically_increasing_id())
        )
        replace(classify_logs(canonicalize(keyed, keep=("log_id", "arquivo")), keep_columns=("arquivo",)), batch_id, path)

    return raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
