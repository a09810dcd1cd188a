"""Building blocks of the reports: shares, top rows, leading value per group, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions import rules

SEVERITY_COUNTS = ("criticos", "altos", "medios", "baixos")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, NULL for an empty whole."""
    return part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))


def with_share(grouped: DataFrame, amount: str, name: str = "percentual") -> DataFrame:
    """Share of each row in the total of an aggregated table.

    The total is a scalar subquery over the same aggregate, so the rows stay distributed; a
    window without partitions would gather them in one task.
    """
    total = grouped.agg(F.sum(amount)).scalar()
    return grouped.withColumn(name, percent(F.col(amount), total))


def tie_break(*columns: str) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]


def top(grouped: DataFrame, n: int, amount: str, *ties: str) -> DataFrame:
    """The ``n`` rows with the highest amount; ties by the given columns."""
    return grouped.orderBy(F.desc(amount), *tie_break(*ties)).limit(n)


def leading(value: str, n: str, among: Column) -> Column:
    """Aggregate: of pre-counted rows that ``among`` picks, the value with the highest count, ties
    to the smallest. It needs no window, so several levels of one table can be ranked in one pass."""
    order = F.struct((-F.col(n)).alias("n"), F.col(value).isNull().alias("nulo"), F.col(value).alias("valor"))
    return F.min(F.when(among, order))["valor"]


def severity_counts(only_errors: bool = True) -> list[Column]:
    """Rejections per severity as ``criticos``, ``altos``, ``medios``, ``baixos``."""
    error = F.col("status_geral") == "ERRO" if only_errors else F.lit(True)
    return [count_if((F.col("severidade") == s) & error).alias(n) for s, n in zip(rules.SEVERITY_PENALTY, SEVERITY_COUNTS)]


def severity_tests() -> dict[str, tuple]:
    """The same counts as tests on a rejection column, for ``LogModel.log_counts``."""
    return {n: ("severidade", F.lit(s).__eq__) for s, n in zip(rules.SEVERITY_PENALTY, SEVERITY_COUNTS)}


def operational_score(total: Column) -> Column:
    """100 minus the weighted severity counts per request, not below zero."""
    weights = zip(SEVERITY_COUNTS, rules.SEVERITY_PENALTY.values())
    penalty = sum((F.col(n) * F.lit(w) for n, w in weights), F.lit(0.0))
    return F.when(total > 0, F.greatest(F.lit(0.0), F.lit(100.0) - penalty / total * 100.0)).otherwise(100.0)


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """One page, counted from 1, of an ordered table."""
    return ordered.offset((number - 1) * size).limit(size)
