"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnlens.llm.shared import documents, ranked, stored

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_offset(source: Column, seed: str) -> Column:
    """One number in [0, 1) per source, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), source), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE,
                   most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) for one row per source (source, source_size).

    Sources in code point order, null last, take the weights in turn and share ``share`` times all
    sizes. A target stops at ``most`` times its source's size and its excess is shared again, by
    weight, among the others. A round is one aggregation over the sources; there are as many rounds
    as it takes until no target is above its bound.
    """
    order = [F.col("source").asc_nulls_last()]
    spread = ranked(sizes.withColumn("_all", F.lit(0)), ["_all"], order, "place").drop("_all")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(spread.select("source", "source_size", weight.cast("double").alias("w")), "sources")
    full = F.col("source_size") * F.lit(float(most))
    level = None
    while True:
        above = F.lit(False) if level is None else F.col("w") * F.lit(level) >= full
        row = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"),
                        F.coalesce(F.sum(F.when(above, full)), F.lit(0.0)).alias("bound"),
                        F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        new = None if row.w is None else (share * row.size - row.bound) / row.w
        if new is None or new == level:
            break
        level = new
    target = full if level is None else F.least(F.col("w") * F.lit(level), full)
    return table.select("source", "source_size", target.alias("target"))


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", seed: str = "mix", ties: tuple[str, ...] = ()) -> DataFrame:
    """(key, size, source_size, target, copies, taken) for rows (key, size, source, ties) and their targets.

    A document's expected copies are its source's target over its size. Documents of a source stand
    in descending size, so that neighbours, of which one stands for the other, are alike; the prefix
    sum of expected copies plus the source's offset gives a copy per integer boundary crossed.
    Ranks come from ``ranked``; a source may hold any share of all rows.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), *(F.col(c).asc_nulls_last() for c in (*ties, key))]
    rows = ranked(sized.select(key, "size", "source", *ties), ["source"], order)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target", random_offset(F.col("source"), seed).alias("_u"))
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(F.col("rank") * rate + F.col("_u")) - F.floor((F.col("rank") - 1) * rate + F.col("_u"))
    return joined.withColumn("copies", copies.cast("long")).select(
        key, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source")


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Copies of every document (doc_id, text, source).

    A null text has size 0, a null source is a source of its own, rows that repeat are documents of
    their own, an empty table gives no rows; other columns play no part.
    """
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size"), "source")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return mix(sized, source_targets(sizes), seed=seed)


def mixed_rows(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    Every row has a key of its own and comes out by its own copies, whatever ids and sources repeat;
    of rows of one size the smaller id, then the hash of the text, decides.
    """
    rows = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")), "rows")
    sized = rows.select("key", word_count(F.col("row.text")).alias("size"), "row.source", "row.doc_id", F.xxhash64("row.text").alias("check"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = mix(sized, source_targets(sizes), "key", seed, ("doc_id", "check")).where("copies > 0").select("key", "copies")
    return rows.join(copies, "key").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
