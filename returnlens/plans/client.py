"""Diagnosis per client. Every report covers all clients in one pass; ``contratante`` narrows it
to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from returnlens.functions import rules
from returnlens.operators.filters import LogFilter
from returnlens.operators.model import LogModel
from returnlens.operators.ranking import count_if, operational_score, severity_counts, tie_break

REGISTRATION_CATEGORIES = ("TRANSPORTADOR", "GEOLOCALIZACAO", "PLACA")


def _of(model: LogModel, contratante: str | None) -> LogModel:
    return model if contratante is None else model.where(LogFilter(contratantes=(contratante,)))


def client_list(model: LogModel) -> DataFrame:
    """Clients under the filter, sorted."""
    return model.logs().select("contratante").distinct().orderBy(*tie_break("contratante"))


def client_scorecard(model: LogModel, contratante: str | None = None) -> DataFrame:
    """Requests, severities, score, rejections, failures and registration quality per client."""
    model = _of(model, contratante)
    business = F.col("resultado_operacional") == "REJEICAO_NEGOCIO"
    totals = model.logs().groupBy("contratante").agg(F.count(F.lit(1)).alias("total"))
    rejected = model.rejections("severidade", "resultado_operacional", "categoria_operacional").groupBy("contratante").agg(
        *severity_counts(only_errors=False),
        count_if(business).alias("rejeicoes_negocio"),
        count_if(F.col("resultado_operacional").isin(*rules.TECHNICAL_RESULTS)).alias("erros_tecnicos"),
        count_if(business & F.col("categoria_operacional").isin(*REGISTRATION_CATEGORIES)).alias("erros_cadastro"),
    )
    measures = [c for c in rejected.columns if c != "contratante"]
    joined = totals.join(rejected, "contratante", "left").fillna(0, measures)
    return joined.select(
        "*",
        operational_score(F.col("total")).alias("score"),
        ((1.0 - F.col("erros_cadastro") / F.col("total")) * 100.0).alias("perc_controlavel"),
    ).orderBy(*tie_break("contratante"))


def _business(model: LogModel, contratante: str | None):
    return _of(model, contratante), F.col("resultado_operacional") == "REJEICAO_NEGOCIO"


def client_recurrent_entities(model: LogModel, contratante: str | None = None, n: int = 8) -> DataFrame:
    """Entities with most business rejections per client, with one of their types."""
    model, business = _business(model, contratante)
    counts = model.entities("resultado_operacional", "tipo_rejeicao_semantica").where(business).groupBy("contratante", "entidade_tipo", "entidade_valor").agg(
        F.count(F.lit(1)).alias("total_falhas"), F.max("tipo_rejeicao_semantica").alias("rejeicao_predominante")
    )
    order = Window.partitionBy("contratante").orderBy(
        F.desc("total_falhas"), *tie_break("entidade_tipo", "entidade_valor")
    )
    return counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def client_error_categories(model: LogModel, contratante: str | None = None) -> DataFrame:
    """Business rejections per client and category."""
    model, business = _business(model, contratante)
    return (
        model.rejections("resultado_operacional", "categoria_operacional").where(business)
        .groupBy("contratante", "categoria_operacional")
        .agg(F.count(F.lit(1)).alias("volume"))
        .orderBy("contratante", F.desc("volume"), *tie_break("categoria_operacional"))
    )


def corrective_actions(model: LogModel, contratante: str | None = None) -> DataFrame:
    """Business rejections per client by category, type, subtype and guidance, with an example."""
    model, business = _business(model, contratante)
    keys = ("categoria_operacional", "tipo_rejeicao_semantica", "subtipo_rejeicao", "orientacao_operacional")
    return (
        model.rejections("resultado_operacional", "mensagem", *keys).where(business).groupBy("contratante", *keys)
        .agg(F.count(F.lit(1)).alias("ocorrencias"), F.max("mensagem").alias("exemplo"))
        .orderBy("contratante", F.desc("ocorrencias"), *tie_break(*keys))
    )
