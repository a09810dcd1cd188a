"""The three tables as the queries see them.

``LogModel`` hides where the rows come from. From the nested silver table the joins of log,
rejection and entity are explodes of arrays the log already holds: no shuffle, whatever the
size. From three flat tables they are equi-joins on ``log_id`` and ``rejeicao_id``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.operators.filters import LogFilter
from returnlens.operators.ranking import count_if
from returnlens.operators.silver import (
    DIM_COLUMNS,
    ENTITY_COLUMNS,
    FACT_COLUMNS,
    dim_log,
)

# The log's own result is renamed where both results stand in one row.
LOG_RESULT = "resultado_log"
# A rejection column and a test on it.
RejectionTest = tuple[str, Callable[[Column], Column]]
# Partition column of tables laid out by event day.
DAY = "dia"
LOG_COLUMNS = DIM_COLUMNS[:-1]
REJECTION_ONLY = tuple(c for c in FACT_COLUMNS if c != "log_id")
ENTITY_ONLY = tuple(c for c in ENTITY_COLUMNS if c != "rejeicao_id")


def _log_columns(prefix: str = "") -> list:
    return [*(F.col(prefix + c) for c in LOG_COLUMNS), F.col(prefix + DIM_COLUMNS[-1]).alias(LOG_RESULT)]


class LogModel(ABC):
    """Logs under a filter, with their rejections and entities."""

    @staticmethod
    def from_nested(silver: DataFrame) -> LogModel:
        """Over a stored nested table. Of its arrays only the fields a report asks for are read."""
        return NestedLogModel(silver)

    @staticmethod
    def from_tables(dim: DataFrame, rejections: DataFrame, entities: DataFrame) -> LogModel:
        return FlatLogModel(dim, rejections, entities)

    @abstractmethod
    def where(self, log_filter: LogFilter) -> LogModel:
        """The model restricted to the logs the filter picks."""

    @abstractmethod
    def logs(self) -> DataFrame:
        """One row per log."""

    @abstractmethod
    def log_counts(self, **tests: RejectionTest) -> DataFrame:
        """One row per log with its number of rejections, ``n_rejeicoes``, and by name how many of
        them pass a test. Log and rejection figures then come from one pass over the logs."""

    @abstractmethod
    def rejections(self, *columns: str) -> DataFrame:
        """Log INNER JOIN rejection, with the given rejection columns or all."""

    @abstractmethod
    def logs_with_rejections(self, *columns: str) -> DataFrame:
        """Log LEFT JOIN rejection, with the given rejection columns or all. ``entidades``, the
        rejection's entity array, only comes when it is named."""

    @abstractmethod
    def entities(self, *columns: str) -> DataFrame:
        """Entity INNER JOIN rejection INNER JOIN log, with the given rejection columns or all."""

    @abstractmethod
    def all_rejections(self) -> DataFrame:
        """``fact_rejeicoes_semanticas``."""


class NestedLogModel(LogModel):
    """The arrays are zipped from the named fields only. A scan prunes fields read that way,
    but reads whole elements for an explode of which several fields are used."""

    def __init__(self, silver: DataFrame):
        self.silver = silver

    def where(self, log_filter: LogFilter) -> LogModel:
        df = self.silver.where(log_filter.log_predicate())
        if DAY in df.columns:
            df = df.where(log_filter.day_predicate(F.col(DAY)))
        for name, predicate in log_filter.rejection_predicates():
            df = df.where(F.exists(F.col(f"rejeicoes.{name}"), predicate))
        return NestedLogModel(df)

    def logs(self) -> DataFrame:
        return dim_log(self.silver)

    def log_counts(self, **tests: RejectionTest) -> DataFrame:
        def size(array: Column) -> Column:
            return F.coalesce(F.array_size(array), F.lit(0)).cast("long")

        # The severity takes the least room of a rejection's fields.
        return self.silver.select(
            *DIM_COLUMNS, size(F.col("rejeicoes.severidade")).alias("n_rejeicoes"),
            *(size(F.filter(F.col(f"rejeicoes.{column}"), test)).alias(name) for name, (column, test) in tests.items()))

    def _zipped(self, columns: tuple[str, ...], outer: bool) -> DataFrame:
        zipped = F.arrays_zip(*(F.col(f"rejeicoes.{c}") for c in columns))
        rows = self.silver.select(*_log_columns(), (F.inline_outer if outer else F.inline)(zipped))
        return rows.toDF(*LOG_COLUMNS, LOG_RESULT, *columns)

    def rejections(self, *columns: str) -> DataFrame:
        return self._zipped(columns or REJECTION_ONLY, outer=False)

    def logs_with_rejections(self, *columns: str) -> DataFrame:
        return self._zipped(columns or REJECTION_ONLY, outer=True)

    def entities(self, *columns: str) -> DataFrame:
        columns = columns or REJECTION_ONLY
        rows = self._zipped((*columns, "entidades"), outer=False)
        return rows.select(*LOG_COLUMNS, LOG_RESULT, *columns, F.inline("entidades")).select(
            *LOG_COLUMNS, LOG_RESULT, *columns, *ENTITY_ONLY
        )

    def all_rejections(self) -> DataFrame:
        return self.rejections()


class FlatLogModel(LogModel):
    """Both sides of every join here have rows in proportion to the logs, so all of them are merged: by the
    size of its compressed file a table of some million logs would pass for small and be broadcast."""

    def __init__(self, dim: DataFrame, rejections: DataFrame, entities: DataFrame):
        self.dim = dim.select(*DIM_COLUMNS, *(c for c in dim.columns if c == DAY))
        self.fact = rejections.select(*FACT_COLUMNS)
        self.entity = entities.select(*ENTITY_COLUMNS)

    def _over(self, dim: DataFrame) -> LogModel:
        return FlatLogModel(dim, self.fact, self.entity)

    def where(self, log_filter: LogFilter) -> LogModel:
        dim = self.dim.where(log_filter.log_predicate())
        if DAY in dim.columns:
            dim = dim.where(log_filter.day_predicate(F.col(DAY)))
        for name, predicate in log_filter.rejection_predicates():
            chosen = self.fact.where(predicate(F.col(name))).select("log_id")
            dim = dim.join(chosen.hint("merge"), "log_id", "left_semi")
        return self._over(dim)

    def _joined(self, how: str) -> DataFrame:
        return self.dim.select(*_log_columns()).join(self.fact.hint("merge"), "log_id", how)

    def logs(self) -> DataFrame:
        return self.dim.select(*DIM_COLUMNS)

    def log_counts(self, **tests: RejectionTest) -> DataFrame:
        counts = self.fact.groupBy("log_id").agg(
            F.count(F.lit(1)).alias("n_rejeicoes"), *(count_if(test(F.col(column))).alias(name) for name, (column, test) in tests.items()))
        joined = self.dim.select(*DIM_COLUMNS).join(counts.hint("merge"), "log_id", "left")
        return joined.select(*DIM_COLUMNS, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_rejeicoes", *tests)))

    def rejections(self, *columns: str) -> DataFrame:
        return self._joined("inner").select(*LOG_COLUMNS, LOG_RESULT, *(columns or REJECTION_ONLY))

    def logs_with_rejections(self, *columns: str) -> DataFrame:
        joined = self._joined("left")
        if "entidades" in columns:
            item = F.struct(*(F.col(c) for c in ENTITY_ONLY))
            grouped = self.entity.groupBy("rejeicao_id").agg(F.collect_list(item).alias("entidades"))
            joined = joined.join(grouped.hint("merge"), "rejeicao_id", "left")
        return joined.select(*LOG_COLUMNS, LOG_RESULT, *(columns or REJECTION_ONLY))

    def entities(self, *columns: str) -> DataFrame:
        return self._joined("inner").join(self.entity.hint("merge"), "rejeicao_id", "inner").select(
            *LOG_COLUMNS, LOG_RESULT, *(columns or REJECTION_ONLY), *ENTITY_ONLY
        )

    def all_rejections(self) -> DataFrame:
        return self.fact


class BucketedLogModel(FlatLogModel):
    """Over flat tables that share buckets on ``log_id``, the entities with that column too.

    A join on ``rejeicao_id`` would deal rows out anew, also where both sides hold whole logs. So the
    entities of a log come together first, as they do in the nested table, and every join is on the log.
    """

    def __init__(self, dim: DataFrame, rejections: DataFrame, entities: DataFrame):
        super().__init__(dim, rejections, entities)
        self.entity = entities.select("log_id", *ENTITY_COLUMNS)

    def _over(self, dim: DataFrame) -> LogModel:
        return BucketedLogModel(dim, self.fact, self.entity)

    def _with_entities(self, how: str) -> DataFrame:
        """Log, rejection and the rejection's ``entidades``."""
        item = F.struct("rejeicao_id", *(c for c in ENTITY_ONLY))
        of_log = self.entity.groupBy("log_id").agg(F.collect_list(item).alias("_do_log"))
        own = F.filter("_do_log", lambda e: e["rejeicao_id"] == F.col("rejeicao_id"))
        slim = F.transform(own, lambda e: F.struct(*(e[c].alias(c) for c in ENTITY_ONLY)))
        return self._joined(how).join(of_log.hint("merge"), "log_id", how).withColumn("entidades", slim)

    def logs_with_rejections(self, *columns: str) -> DataFrame:
        if "entidades" not in columns:
            return super().logs_with_rejections(*columns)
        return self._with_entities("left").select(*LOG_COLUMNS, LOG_RESULT, *columns)

    def entities(self, *columns: str) -> DataFrame:
        columns = columns or REJECTION_ONLY
        rows = self._with_entities("inner").select(*LOG_COLUMNS, LOG_RESULT, *columns, F.inline("entidades"))
        return rows.select(*LOG_COLUMNS, LOG_RESULT, *columns, *ENTITY_ONLY)
