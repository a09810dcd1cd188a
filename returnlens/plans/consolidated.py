"""Rejections consolidated by day, functionality and masked message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.operators.filters import ilike_contains
from returnlens.operators.model import LogModel
from returnlens.operators.ranking import page, tie_break, with_share

NO_MESSAGE = "Erro de sistema ou resposta vazia"
PAGE_SIZE = 15


def consolidated_rejections(model: LogModel, search: str = "") -> DataFrame:
    """Failures per day, functionality and masked message with their share. The search applies
    after the share, which keeps the whole as its base."""
    template = F.coalesce(F.nullif("mensagem_normalizada", F.lit("")), F.lit(NO_MESSAGE))
    counts = (
        model.rejections("mensagem_normalizada").where(F.col("status_geral") == "ERRO")
        .groupBy(F.to_date("data_evento").alias("dia"), "funcionalidade", template.alias("mensagem_normalizada"))
        .agg(F.count(F.lit(1)).alias("quantidade"))
    )
    shared = with_share(counts, "quantidade", "representatividade").withColumn(
        "representatividade", F.round("representatividade", 3)
    )
    if search.strip():
        shared = shared.where(
            ilike_contains(F.col("mensagem_normalizada"), search) | ilike_contains(F.col("funcionalidade"), search)
        )
    ordered = shared.orderBy(F.desc("dia"), F.desc("quantidade"), *tie_break("funcionalidade", "mensagem_normalizada"))
    return ordered.select(
        F.date_format("dia", "dd/MM/yyyy").alias("data"), "funcionalidade", "mensagem_normalizada", "quantidade",
        "representatividade",
    )


def consolidated_page(model: LogModel, search: str = "", number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the consolidated table."""
    return page(consolidated_rejections(model, search), number, size)


def consolidated_totals(model: LogModel, search: str = "") -> DataFrame:
    """Occurrences and rows of the consolidated table."""
    return consolidated_rejections(model, search).agg(
        F.coalesce(F.sum("quantidade"), F.lit(0)).alias("total_quantidade"), F.count(F.lit(1)).alias("total_linhas")
    )
