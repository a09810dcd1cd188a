"""Silver tables on shared storage, idempotent ingest and exports."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from returnlens.operators.model import LogModel
from returnlens.operators.silver import classify_logs, dim_log, fact_entities, fact_rejections
from returnlens.sources.rawlogs import describe_files, describe_splits, parse_records, read_lines, read_records

TABLES = {"dim_log": dim_log, "fact_rejeicoes_semanticas": fact_rejections, "fact_entidades_extraidas": fact_entities}
NESTED = "logs_aninhados"
REJECTED = "linhas_rejeitadas"
LEDGER = "arquivos_ingeridos"
STAGING = "_preparo"
# A batch is one ingest; the day is that of the event.
BATCH, DAY = "lote", "dia"


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    system, target = _path(spark, path)
    return spark.read.parquet(path) if system.exists(target) else None


def _write(df: DataFrame, path: str, *by: str) -> None:
    """Replace just the partitions that the rows belong to."""
    (df.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def lay_out(canonical: DataFrame) -> DataFrame:
    """Canonical logs by event day, client and protocol, in ranges of like size. A day or client of any
    size spreads over ranges; a range holds few days, so a batch writes about as many files as it has
    ranges and days."""
    return canonical.withColumn(DAY, F.to_date("data")).repartitionByRange(DAY, "contratante", "cod_protocolo", "log_id")


def write_silver(canonical: DataFrame, root: str, batch: str) -> None:
    """Classify the logs of a batch once into the nested table, then project the three flat tables.

    All tables are partitioned by batch and event day and sorted by client and protocol, so a period
    prunes directories, and statistics skip row groups for the other filters. A repeated batch
    replaces itself.
    """
    spark = canonical.sparkSession
    silver = classify_logs(lay_out(canonical), keep_columns=("file_hash", DAY)).withColumn(BATCH, F.lit(batch))
    _write(silver.sortWithinPartitions(BATCH, DAY, "contratante", "protocolo"), f"{root}/{NESTED}", BATCH, DAY)
    nested = spark.read.schema(silver.schema).parquet(f"{root}/{NESTED}").where(F.col(BATCH) == batch)
    for name, project in TABLES.items():
        _write(project(nested, keep=("file_hash", BATCH, DAY)), f"{root}/{name}", BATCH, DAY)


def ledger(spark: SparkSession, root: str) -> DataFrame | None:
    """(file_hash, lote) of the ingested files; ``None`` before the first ingest."""
    return _read(spark, f"{root}/{LEDGER}")


def _of_file(spark: SparkSession, root: str, table: DataFrame, file_hash: str | None) -> DataFrame:
    if file_hash is None:
        return table
    done = ledger(spark, root).where(F.col("file_hash") == file_hash).first()
    return table.where((F.col(BATCH) == (done[BATCH] if done else "")) & (F.col("file_hash") == file_hash))


def open_silver(spark: SparkSession, root: str, file_hash: str | None = None) -> LogModel:
    """Model over the nested table, of one file, which stands in one batch, or of all."""
    return LogModel.from_nested(_of_file(spark, root, spark.read.parquet(f"{root}/{NESTED}"), file_hash))


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the flat tables; its columns are known even if no batch has a row for it."""
    schema = TABLES[name](spark.read.parquet(f"{root}/{NESTED}"), keep=("file_hash", BATCH, DAY)).schema
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def register_views(spark: SparkSession, root: str, file_hash: str | None = None) -> None:
    """Temporary views of the three flat tables, of one file or of all."""
    for name in TABLES:
        _of_file(spark, root, open_table(spark, root, name), file_hash).createOrReplaceTempView(name)


def _counts(dim: DataFrame) -> DataFrame:
    return dim.agg(F.count(F.lit(1)).alias("total_logs"), F.countDistinct("protocolo").alias("unique_protocols"))


def _known_counts(spark: SparkSession, root: str, files: DataFrame, known: DataFrame | None) -> DataFrame:
    """Counts over the files that were ingested before."""
    if known is None or _read(spark, f"{root}/{NESTED}") is None:
        return spark.range(1).select(F.lit(0).cast("long").alias("total_logs"), F.lit(0).cast("long").alias("unique_protocols"))
    places = known.join(files.select("file_hash"), "file_hash", "left_semi").select("file_hash", BATCH).distinct()
    return _counts(open_table(spark, root, "dim_log").join(places, ["file_hash", BATCH], "left_semi"))


def ingest(spark: SparkSession, paths: str | list[str], root: str, ingest_ts: Column | None = None) -> DataFrame:
    """Ingest raw log files that are not in the silver tables yet; the summary as one row.

    A file is known by its content and the order of its lines. With nothing new the counts of the
    known files return. Records that do not fit their header go to ``linhas_rejeitadas`` with file and
    line number; a file without an identifying column is counted as refused, and the others go on.

    The raw files are read once. What is stored on the way lies under the lake and is removed at the
    end; the ledger comes last, so a file counts as ingested only when all its tables are complete.
    """
    # The ingest time of unreadable dates is fixed once, for every task and retry.
    ingest_ts = F.lit(datetime.now(timezone.utc).isoformat()).cast("timestamp") if ingest_ts is None else ingest_ts
    staging = f"{root}/{STAGING}/{uuid.uuid4().hex}"

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{staging}/{name}")
        return spark.read.schema(df.schema).parquet(f"{staging}/{name}")

    try:
        return _ingest(spark, paths, root, ingest_ts, store)
    finally:
        system, target = _path(spark, staging)
        system.delete(target, True)


def _ingest(spark: SparkSession, paths: str | list[str], root: str, ingest_ts: Column, store) -> DataFrame:
    lines = store(read_lines(spark, paths), "linhas")
    splits = store(describe_splits(lines), "partes")
    files = store(describe_files(splits), "arquivos")
    readable = files.where("problema IS NULL").groupBy("file_hash").agg(F.min("path").alias("path"))
    readable = files.join(readable, ["file_hash", "path"])
    known = ledger(spark, root)
    fresh = store(readable if known is None else readable.join(known, "file_hash", "left_anti"), "novos")
    refused = files.where("problema IS NOT NULL").count()
    # The batch is named by its files, so that a repeated ingest of the same files replaces itself.
    batch = fresh.agg(F.md5(F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("file_hash")), F.sum(F.xxhash64("file_hash").cast("decimal(38,0)")).cast("string")))
                      .alias("lote"), F.count("*").alias("n")).first()
    if not batch.n:
        # Computed now: the files' table is about to go.
        row = _known_counts(spark, root, files, known).first()
        return spark.createDataFrame([("cached", *row, 0, refused)],
                                     "status string, total_logs long, unique_protocols long, linhas_rejeitadas long, arquivos_recusados long")
    seen = Observation("linhas")
    rows = parse_records(read_records(lines, splits, fresh, store), fresh, ingest_ts).withColumn("aceita", F.col("rejeitada").isNull())
    rows = rows.observe(seen, F.count_if(~F.col("aceita")).alias("rejeitadas"), F.count(F.lit(1)).alias("lidas"))
    staged = store(rows, "registros")
    canonical = staged.where("aceita").drop("rejeitada", "aceita", "linha")
    if seen.get["lidas"] > seen.get["rejeitadas"]:
        write_silver(canonical, root, batch.lote)
    bad = staged.where("NOT aceita").select("file_hash", "linha", F.col("rejeitada").alias("texto"), F.lit(batch.lote).alias(BATCH))
    if seen.get["rejeitadas"]:
        _write(bad, f"{root}/{REJECTED}", BATCH)
    fresh.select("file_hash", F.lit(batch.lote).alias(BATCH), "path", F.current_timestamp().alias("ingerido_em")).write.mode("append").parquet(f"{root}/{LEDGER}")
    return _summary(spark, root, batch.lote, seen.get["rejeitadas"], refused)


def _summary(spark: SparkSession, root: str, batch: str, rejected: int, refused: int) -> DataFrame:
    counts = {}
    for name, columns in (("dim_log", ("total_logs", "unique_protocols")), (NESTED, ("total_rejeicoes", "total_entidades"))):
        table = _read(spark, f"{root}/{name}")
        if table is None:  # no file of any batch had a record
            counts |= dict.fromkeys(columns, F.lit(0).cast("long"))
            continue
        chosen = table.where(F.col(BATCH) == batch)
        if name == NESTED:
            found = chosen.select(F.explode("rejeicoes").alias("r")).agg(
                F.count(F.lit(1)).alias("total_rejeicoes"), F.coalesce(F.sum(F.size("r.entidades")), F.lit(0)).cast("long").alias("total_entidades"))
        else:
            found = _counts(chosen)
        counts |= {c: found.select(c).scalar() for c in columns}
    return spark.range(1).select(F.lit("processed").alias("status"), *(v.alias(c) for c, v in counts.items()),
                                 F.lit(rejected).cast("long").alias("linhas_rejeitadas"), F.lit(refused).cast("long").alias("arquivos_recusados"))


def rejected_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file_hash, linha, texto, lote) of every record that did not fit its file's header."""
    found = _read(spark, f"{root}/{REJECTED}")
    return found if found is not None else spark.createDataFrame([], "file_hash string, linha long, texto string, lote string")


def export_csv(rows: DataFrame, path: str, quote_all: bool = True, cap: int | None = None) -> None:
    """CSV files with header and ``;``; the denormalised export quotes every field."""
    rows = rows if cap is None else rows.limit(cap)
    (rows.write.mode("overwrite").option("header", True).option("sep", ";").option("quoteAll", quote_all)
     .option("escape", '"').csv(path))
