"""Entities with most rejections and their trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.operators.filters import entity_predicate
from returnlens.operators.model import LogModel
from returnlens.operators.ranking import count_if, leading, page, tie_break, top
from returnlens.plans.overview import temporal_variability

PAGE_SIZE = 10


def _business_entities(model: LogModel, *columns: str) -> DataFrame:
    return model.entities("resultado_operacional", *columns).where(F.col("resultado_operacional") == "REJEICAO_NEGOCIO")


def critical_entities(model: LogModel, kind: str, value: str = "") -> DataFrame:
    """Values of an entity kind or group: rejected protocols, clients hit, leading type and
    functionality."""
    rows = _business_entities(model, "tipo_rejeicao_semantica").where(entity_predicate(kind, value))
    rows = rows.withColumnRenamed("entidade_valor", "entidade")
    # One pass: a set per figure, then the sets of an entity meet in few rows.
    figures = ("protocolo", "contratante", "tipo_rejeicao_semantica", "funcionalidade")
    sets = rows.groupingSets([["entidade", c] for c in figures], "entidade", *figures).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(*(F.when(F.grouping(c) == 0, c) for c in figures)).alias("nivel"))

    def among(column: str) -> Column:
        return F.col("nivel") == column

    return sets.groupBy("entidade").agg(
        count_if(among("protocolo") & F.col("protocolo").isNotNull()).alias("quantidade_rejeicoes"),
        count_if(among("contratante") & F.col("contratante").isNotNull()).alias("quantidade_clientes"),
        leading("tipo_rejeicao_semantica", "n", among("tipo_rejeicao_semantica")).alias("principal_rejeicao"),
        leading("funcionalidade", "n", among("funcionalidade")).alias("principal_funcionalidade"),
    ).orderBy(F.desc("quantidade_rejeicoes"), *tie_break("entidade"))


def critical_entities_page(model: LogModel, kind: str, value: str = "", number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the critical entities."""
    return page(critical_entities(model, kind, value), number, size)


def top_entities(model: LogModel, n: int = 5) -> DataFrame:
    """Entity values with most business rejections."""
    counts = _business_entities(model).groupBy("entidade_valor").agg(F.count(F.lit(1)).alias("total"))
    return top(counts, n, "total", "entidade_valor")


def entity_trend(model: LogModel, n: int = 5) -> DataFrame:
    """Business rejections per day of the leading entity values; empty when the logs hardly vary
    in time."""
    varies = temporal_variability(model).select("variavel").scalar()
    # The leaders are at most n rows.
    leaders = F.broadcast(top_entities(model, n).select("entidade_valor"))
    return (
        _business_entities(model).where(varies).join(leaders, "entidade_valor", "left_semi")
        .groupBy(F.date_format("data_evento", "yyyy-MM-dd").alias("dia"), F.col("entidade_valor").alias("entidade"))
        .agg(F.count(F.lit(1)).alias("total_falhas"))
        .orderBy("dia", *tie_break("entidade"))
    )
