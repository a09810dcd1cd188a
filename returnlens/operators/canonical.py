"""Raw columns to the canonical log schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnlens.functions import rules

CANONICAL_COLUMNS = ("contratante", "funcionalidade", "cod_mensagem", "des_resposta", "cod_protocolo", "data")


def quoted(name: str) -> Column:
    """Column reference that survives dots and blanks in raw header names."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Trimmed lower-case names; of names that then collide, the last column stays."""
    chosen = {name.strip().lower(): name for name in raw.columns}
    return raw.select(*(quoted(name).alias(clean) for clean, name in chosen.items()))


def check_columns(raw: DataFrame) -> DataFrame:
    """Refuse a file that holds none of the identifying columns."""
    if not set(rules.REQUIRED_ANY) & set(raw.columns):
        raise ValueError(f"raw log needs at least one of the columns {', '.join(rules.REQUIRED_ANY)}")
    return raw


def parse_timestamp(text: Column, ingest_ts: Column) -> Column:
    """First format that fits the value, else the ingest time."""

    def parse(fmt: str) -> Column:
        parsed = F.try_to_timestamp(text, F.lit(fmt))
        if "yyyy" in fmt:
            return parsed
        century = F.make_ym_interval(F.lit(100), F.lit(0))
        return F.when(F.year(parsed) >= 2000 + rules.TWO_DIGIT_YEAR_PIVOT, parsed - century).otherwise(parsed)

    return F.coalesce(*(parse(fmt) for fmt in rules.DATE_FORMATS), ingest_ts)


def canonicalize(raw: DataFrame, ingest_ts: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Six canonical columns with their defaults, plus the ``keep`` columns as they are."""
    ingest_ts = F.current_timestamp() if ingest_ts is None else ingest_ts
    raw = normalize_columns(raw)
    present = set(raw.columns)

    def text(name: str, default: str) -> Column:
        return F.coalesce(quoted(name).cast("string"), F.lit(default)) if name in present else F.lit(default)

    protocol = next((c for c in rules.PROTOCOL_COLUMNS if c in present), None)
    date = next((c for c in rules.DATE_COLUMNS if c in present), None)
    if date is None:
        event_time = ingest_ts
    elif isinstance(raw.schema[date].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        event_time = F.coalesce(quoted(date).cast("timestamp"), ingest_ts)
    else:
        event_time = parse_timestamp(quoted(date).cast("string"), ingest_ts)

    return raw.select(
        *(text(name, default).alias(name) for name, default in rules.COLUMN_DEFAULTS.items()),
        (quoted(protocol).cast("string") if protocol else F.lit(rules.NO_PROTOCOL)).alias("cod_protocolo"),
        event_time.alias("data"),
        *(F.col(name) for name in keep),
    )


def with_dense_key(df: DataFrame) -> DataFrame:
    """``log_id`` as a gap-free row number in scan order.

    One extra pass counts the rows per partition; only those counts, one per partition, meet on
    the driver. Rows never leave their partition.
    """
    local_bits = 33
    tagged = df.withColumn("_position", F.monotonically_increasing_id())
    partition = F.shiftright("_position", local_bits)
    counts = {r["p"]: r["n"] for r in tagged.groupBy(partition.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, start = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(start)
        start += counts.get(p, 0)
    table = F.lit(offsets) if offsets else F.array(F.lit(0))
    local = F.col("_position") - F.shiftleft(partition, local_bits)
    index = F.get(table, partition.cast("int")).cast("bigint") + local
    return tagged.withColumn("log_id", F.concat(F.lit("log_"), index)).drop("_position")


# Partitions per split of a scan, and the number of splits from which a scan stays as it is.
SPREAD, MOST_SPLITS = 16, 2000
# Number of a row, by which rows are dealt out; what belongs to one log finds together by it without an exchange.
ROW = "fila"


def spread(df: DataFrame, keep_row: bool = False) -> DataFrame:
    """Deal the rows of a scan out evenly before costly steps.

    Splits are cut by bytes, but a Parquet row group is read whole by one of them, so a file with few
    row groups leaves most splits empty however large it is. Rows are dealt by their place in the scan,
    not by a key, which may repeat; unlike dealing in turn, that needs no sort before. Put it right behind
    the scan: what stands before it runs in the splits as they are. A very large scan has row groups
    enough; it stays as it is and is not shuffled, unless the row numbers are kept.
    """
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    if splits >= MOST_SPLITS and not keep_row:
        return df
    dealt = df.withColumn(ROW, F.monotonically_increasing_id()).repartition(max(cores, splits, min(splits * SPREAD, MOST_SPLITS)), ROW)
    return dealt if keep_row else dealt.drop(ROW)
