"""Crosstab, unknown codes and traffic anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.functions import rules
from returnlens.operators.model import LogModel
from returnlens.operators.ranking import tie_break, top
from returnlens.plans.overview import hourly_spans, variability_of

DEVIATIONS = 2
MIN_HOURS = 3


def client_rejection_matrix(model: LogModel, clients: int = 20, kinds: int = 15) -> DataFrame:
    """Business rejections of the leading clients by the leading types, in long form."""
    counts = (
        model.rejections("resultado_operacional", "tipo_rejeicao_semantica")
        .where((F.col("resultado_operacional") == "REJEICAO_NEGOCIO")
               & F.col("contratante").isNotNull() & F.col("tipo_rejeicao_semantica").isNotNull())
        .groupBy("contratante", "tipo_rejeicao_semantica").agg(F.count(F.lit(1)).alias("total"))
    )

    def leaders(column: str, n: int) -> DataFrame:
        # At most n rows.
        return F.broadcast(top(counts.groupBy(column).agg(F.sum("total").alias("t")), n, "t", column).select(column))

    return counts.join(leaders("contratante", clients), "contratante", "left_semi").join(
        leaders("tipo_rejeicao_semantica", kinds), "tipo_rejeicao_semantica", "left_semi"
    ).select("contratante", "tipo_rejeicao_semantica", "total").orderBy(
        *tie_break("contratante", "tipo_rejeicao_semantica"))


def client_rejection_crosstab(model: LogModel, clients: int = 20, kinds: int = 15) -> DataFrame:
    """The matrix in wide form: one column per leading type, zero where nothing occurred."""
    matrix = client_rejection_matrix(model, clients, kinds)
    # At most ``kinds`` names reach the driver; they become the columns.
    names = sorted(r[0] for r in matrix.select("tipo_rejeicao_semantica").distinct().collect())
    wide = matrix.groupBy("contratante").pivot("tipo_rejeicao_semantica", names).sum("total")
    return wide.fillna(0).orderBy("contratante")


def uncatalogued_codes(model: LogModel) -> DataFrame:
    """Codes of unclassified rejections per functionality, first and last time, an example."""
    return (
        model.rejections("tipo_rejeicao_semantica", "codigo_antt", "mensagem_original")
        .where((F.col("tipo_rejeicao_semantica") == rules.UNCATEGORISED) & (F.col("codigo_antt") != ""))
        .groupBy("codigo_antt", "funcionalidade")
        .agg(
            F.max("mensagem_original").alias("exemplo"),
            F.count(F.lit(1)).alias("quantidade"),
            F.min("data_evento").alias("primeira_ocorrencia"),
            F.max("data_evento").alias("ultima_ocorrencia"),
        )
        .orderBy(F.desc("quantidade"), *tie_break("codigo_antt", "funcionalidade"))
    )


def hourly_errors(model: LogModel) -> DataFrame:
    """Rejections per hour."""
    return (
        model.rejections("severidade").groupBy(F.date_trunc("hour", "data_evento").alias("hora"))
        .agg(F.count(F.lit(1)).alias("total_erros")).orderBy("hora")
    )


def traffic_anomalies(model: LogModel) -> DataFrame:
    """Hours with rejections over mean plus two sample deviations, from three hours on; empty
    when the logs hardly vary in time."""
    hours = hourly_spans(model.log_counts(), F.sum("n_rejeicoes").alias("total_erros"))
    errors = F.when(F.col("total_erros") > 0, F.col("total_erros"))
    limit = F.when(F.count(errors) >= MIN_HOURS, F.avg(errors) + DEVIATIONS * F.stddev_samp(errors))
    # NULL where the logs hardly vary: no hour is over it.
    threshold = variability_of(hours, limit.alias("limite")).select(F.when(F.col("variavel"), F.col("limite"))).scalar()
    return hours.where(F.col("total_erros") > threshold).select("hora", "total_erros").orderBy("hora")
