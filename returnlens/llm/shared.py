"""Helpers the operators share: stored tables, ranks over a whole table, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnlens.session import shared_dir

BATCH_BYTES = 8 << 20
HOT_SHARE = 1000
HOT_PARTS = 64
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, and bound the bytes of a
    batch of rows on its way to Python, so that long texts do not pile up there."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="returnlens-"), "returnlens_llm.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                bundle.write(file, os.path.relpath(file, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, and a lost
    executor costs nothing that was done before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: Sequence[str], name: str) -> str:
    """The name, with underscores in front until no column has it."""
    while name in columns:
        name = f"_{name}"
    return name


def joined_spread(rows: DataFrame, unique: DataFrame, key: str, count: str, spots: Sequence[str], same: Column) -> DataFrame:
    """Rows joined to a stored table of few rows per ``key``, whose column ``count`` says how many rows it meets.

    A key with more than a thousandth of all rows, of which there are fewer than a thousand, is spread
    over several tasks, by the columns ``spots``; ``same`` is what must hold besides equal keys.
    """
    total = unique.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(unique.where(F.col(count) * HOT_SHARE > total).select(F.col(key).alias("_hot")).distinct())
    spot = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*spots), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_spot", spot).drop("_hot")
    right = unique.withColumnRenamed(key, "_key").join(hot, F.col("_key") == F.col("_hot"), "left").withColumn("_to", F.explode(every)).drop("_hot")
    return left.join(right.hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_spot") == F.col("_to")) & same)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Rank of every row (from 1) within its group, for groups of any size.

    ``order`` starts with the group's columns. The rows are range-partitioned and sorted by it, so
    that a large group spreads over partitions; a row's rank is its place in its partition plus the
    group's rows in earlier partitions, of which there is one count per group and partition.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = stored(spread, rank).withColumns({"_part": F.shiftright("_m", 33)})
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    counts = placed.groupBy(*keys, F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    names = [f"_g{i}" for i in range(len(group))]
    window = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(window), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for g, n in zip(group, names):
        same &= F.col(g).eqNullSafe(F.col(n))
    joined = placed.join(starts, same)
    return joined.withColumn(rank, F.col("_m") - F.col("_first") + F.col("_before") + 1).select(*df.columns, rank)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge list; the component is its smallest node.

    Alternating large-star and small-star rounds: each node hands its neighbours the smallest node
    it knows, until no edge changes. A node's neighbours are only ever reduced to their minimum,
    never gathered, and every round is cut off by a stored table.
    """
    links = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct()
    links = stored(links, "edges")
    digest = None
    while True:
        both = links.union(links.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy(F.col("lo").alias("node")).agg(F.min("hi").alias("m")).withColumn("m", F.least("node", "m"))
        large = (both.where("hi > lo").join(least, F.col("lo") == F.col("node"))
                 .select(F.col("m").alias("lo"), "hi").where("lo <> hi").distinct())
        floor = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        small = large.join(floor, F.col("hi") == F.col("node"))
        links = stored(small.select(F.col("m").alias("lo"), "hi").union(
            small.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).distinct(), "edges")
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if digest == tuple(seen):
            return links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).union(
                links.select("lo", "lo").distinct())
        digest = tuple(seen)
