"""Multi-party perspective rotation of dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnlens.llm.shared import documents, ranked

SYSTEM = "system"
NOBODY = "unknown"
END = "<|end|>\n"
BLOCK = 1024


def named(role: Column) -> Column:
    """A role that neither ends its marker nor opens one."""
    return F.replace(plain(role), F.lit("|>"), F.lit("| >"))


def header(role: Column, perspective: Column) -> Column:
    """Opening marker of a turn: the system's, the assistant's for the own speaker, else a named user's."""
    name = F.when(role == SYSTEM, SYSTEM).when(role == perspective, "assistant").otherwise(F.concat(F.lit("user name="), named(role)))
    return F.concat(F.lit("<|"), name, F.lit("|>\n"))


def plain(text: Column) -> Column:
    """Text in which no marker can be forged."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(conversations: DataFrame) -> DataFrame:
    """One row per conversation, perspective and turn (conv_id, turn, role, text): the rendered
    ``segment``, its place in the dialogue (``position`` from 0, ``start`` and ``length`` in code
    points) and the part of it to learn (``learn_start``, ``learn_length``).

    Every speaker but the system is a perspective: that speaker's turns are the assistant's, what
    the others say comes from named users, and only the assistant's words and end marker are
    learned. Segments in order of ``position`` are the dialogue; a dialogue is never gathered. Starts
    are sums within blocks of a conversation's turns and of its earlier blocks, so that one
    conversation may hold any share of all rows.

    Markers cannot be forged: in texts and names ``<|`` becomes ``< |``, in names ``|>`` becomes
    ``| >`` as well (the columns keep the role as it is; different roles may be shown by one name).
    A null role is the speaker ``unknown``, together with anyone of that very name, a null text is empty, null turns come last, a null
    conversation is one of its own; equal turns stand in order of role and text; rows that repeat
    are turns of their own; a conversation of system turns alone gives no rows, as does an empty
    table; other columns play no part.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(NOBODY)).alias("role"), plain(F.col("text")).alias("text"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    placed = ranked(turns, ["conv_id"], order, "place").withColumn("block", F.floor((F.col("place") - 1) / BLOCK))
    speakers = turns.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    opening = header(F.col("role"), F.col("perspective"))
    rows = (placed.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
            .withColumn("segment", F.concat(opening, "text", F.lit(END))).withColumn("length", F.char_length("segment"))
            .withColumn("opening", F.char_length(opening)))
    block = ["conv_id", "perspective", "block"]
    before = Window.partitionBy(*block).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*block).agg(F.sum("length").alias("total"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(c).alias(f"_{c}") for c in block), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_start"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective")) & (F.col("block") == F.col("_block"))
    own = F.col("role") == F.col("perspective")
    return (rows.withColumn("inside", F.coalesce(F.sum("length").over(before), F.lit(0))).join(starts, same)
            .withColumn("start", F.col("_start") + F.col("inside")).select(
                "conv_id", "perspective", (F.col("place") - 1).cast("long").alias("position"), "turn", "role", "segment",
                "start", F.col("length").cast("long").alias("length"),
                F.when(own, F.col("start") + F.col("opening")).otherwise(F.col("start")).cast("long").alias("learn_start"),
                F.when(own, F.col("length") - F.col("opening")).otherwise(0).cast("long").alias("learn_length")))


def dialogues(segments: DataFrame) -> DataFrame:
    """Whole dialogues (conv_id, perspective, text, learn) of conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment", "learn_start", "learn_length")))
    return segments.groupBy("conv_id", "perspective").agg(parts.alias("p")).select(
        "conv_id", "perspective", F.expr("array_join(transform(p, x -> x.segment), '')").alias("text"),
        F.expr("transform(filter(p, x -> x.learn_length > 0), x -> struct(x.learn_start AS start, x.learn_length AS length))").alias("learn"))


def op5_rotate_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(documents(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), replace(coalesce(text, ''), '<|', '< |')) - 1 AS position
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
opened AS (
  SELECT t.*, perspective, '<|' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || replace(replace(role, '<|', '< |'), '|>', '| >') END || '|>' || chr(10) AS opening
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
rendered AS (SELECT *, opening || text || '<|end|>' || chr(10) AS segment FROM opened),
placed AS (
  SELECT *, length(segment) AS n, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rendered)
SELECT conv_id, perspective, position, turn, role, segment, start, n::BIGINT AS length,
       CASE WHEN role = perspective THEN start + length(opening) ELSE start END::BIGINT AS learn_start,
       CASE WHEN role = perspective THEN n - length(opening) ELSE 0 END::BIGINT AS learn_length
FROM placed
"""
