"""Detail page, exports and the local search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from returnlens.functions import rules
from returnlens.operators.filters import ilike_contains, like_contains
from returnlens.operators.model import LOG_RESULT, REJECTION_ONLY, LogModel
from returnlens.operators.ranking import page

PAGE_SIZE = 50
ALL_FUNCTIONS = ALL_TYPES = "TODAS"
ALL_CLIENTS = "TODOS"
SUCCESS_MESSAGE = "Operação concluída com sucesso"


def _entity_text() -> Column:
    """Entities of the rejection as sorted ``TIPO:valor`` list."""
    pairs = F.transform(F.coalesce("entidades", F.array()), lambda e: F.concat_ws(":", e["entidade_tipo"], e["entidade_valor"]))
    return F.array_join(F.array_sort(pairs), " | ")


def detail_rows(
    model: LogModel,
    search: str = "",
    funcionalidade: str = ALL_FUNCTIONS,
    tipo: str = ALL_TYPES,
    contratante: str = ALL_CLIENTS,
) -> DataFrame:
    """Logs with their rejections under the local filters: text in protocol, message or entity
    value, and equal functionality, type and client."""
    rows = model.logs_with_rejections(*REJECTION_ONLY, "entidades")
    if search.strip():
        in_entity = F.exists(F.coalesce("entidades", F.array()), lambda e: like_contains(e["entidade_valor"], search))
        rows = rows.where(
            like_contains(F.col("protocolo"), search) | ilike_contains(F.col("mensagem_original"), search) | in_entity
        )
    if funcionalidade != ALL_FUNCTIONS:
        rows = rows.where(F.col("funcionalidade") == funcionalidade)
    if tipo != ALL_TYPES:
        rows = rows.where(F.col("tipo_rejeicao_semantica") == tipo)
    if contratante != ALL_CLIENTS:
        rows = rows.where(F.col("contratante") == contratante)
    return rows


def detail_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def detail_projection(rows: DataFrame) -> DataFrame:
    """The 19 columns of the detail table."""
    score = F.lit(0.0)
    for severity, penalty in rules.SEVERITY_PENALTY.items():
        score = F.when(F.col("severidade") == severity, -penalty).otherwise(score)
    return rows.select(
        "protocolo", F.col("data_evento").alias("data"), "contratante", "funcionalidade", "status_geral",
        F.col(LOG_RESULT).alias("resultado_operacional"), "codigo_antt", "tipo_rejeicao_semantica",
        "tipo_erro_tecnico", "causa_raiz", "orientacao_operacional",
        _entity_text().alias("entidades_extraidas"),
        F.coalesce("mensagem_original", F.lit(SUCCESS_MESSAGE)).alias("mensagem_original"),
        "severidade", F.col("categoria_operacional").alias("categoria"), score.alias("score"),
        F.col("subtipo_rejeicao").alias("rejeicao_oficial"),
        F.col("mensagem_normalizada").alias("template_normalizado"), F.col("log_id").alias("hash_evento"),
        "rejeicao_id",
    )


def detail_page(rows: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page, newest first."""
    ordered = detail_projection(rows).orderBy(F.desc("data"), "hash_evento", F.asc_nulls_last("rejeicao_id"))
    return page(ordered, number, size).drop("rejeicao_id")


def detail_page_after(rows: DataFrame, after: Row | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """The page behind a row of an earlier one, newest first, with its cursor column ``rejeicao_id``.

    However far the page lies, no earlier rows are sorted or sent along.
    """
    found = detail_projection(rows)
    if after is not None:
        same = (F.col("data") == F.lit(after["data"])) & (F.col("hash_evento") == after["hash_evento"])
        later = F.lit(False) if after["rejeicao_id"] is None else (
            F.col("rejeicao_id").isNull() | (F.col("rejeicao_id") > after["rejeicao_id"]))
        found = found.where((F.col("data") < F.lit(after["data"])) | (
            (F.col("data") == F.lit(after["data"])) & (F.col("hash_evento") > after["hash_evento"])) | (same & later))
    return found.orderBy(F.desc("data"), "hash_evento", F.asc_nulls_last("rejeicao_id")).limit(size)


def export_rows(model: LogModel) -> DataFrame:
    """The 22 columns of the denormalised export. Sort it only where the order matters."""
    success = F.col(LOG_RESULT).isin(*rules.SUCCESS_RESULTS)
    return model.logs_with_rejections(*REJECTION_ONLY, "entidades").select(
        "protocolo", F.col("data_evento").alias("data"), "contratante", "funcionalidade", "status_geral",
        F.col(LOG_RESULT).alias("resultado_operacional"), "tipo_rejeicao_semantica", "tipo_erro_tecnico",
        F.coalesce("mensagem_original", F.lit(SUCCESS_MESSAGE)).alias("mensagem_original"),
        F.coalesce("mensagem_normalizada", F.lit(SUCCESS_MESSAGE)).alias("mensagem_normalizada"),
        F.when(F.col("status_geral") == "SUCESSO", "SIM").otherwise("NÃO").alias("indicador_sucesso"),
        F.coalesce("severidade", F.lit("INFO")).alias("severidade_operacional"),
        F.coalesce("codigo_antt", F.lit("")).alias("codigo_antt"),
        F.when(success, "Sucesso Operacional").otherwise("Erro/Falha").alias("contexto_operacional"),
        "rejeicao_id",
        F.when(F.col("rejeicao_id").isNotNull(), F.col("log_id")).alias("log_id"),
        "template_oficial", F.col("subtipo_rejeicao").alias("mensagem_padrao"),
        F.col("categoria_operacional").alias("categoria_oficial"), "causa_raiz", "orientacao_operacional",
        _entity_text().alias("entidades_extraidas"),
    )


def filter_domain(model: LogModel) -> DataFrame:
    """Values to choose from, as (campo, valor): date range, clients, functionalities, causes,
    types and codes. One pass over the logs and one over the rejections; no logs, no rows."""

    def named(*columns: str) -> list[Column]:
        return [F.coalesce(*(F.when(F.grouping(c) == 0, c) for c in columns)).alias("campo"),
                F.coalesce(*(F.when(F.grouping(c) == 0, F.col(c)) for c in columns)).alias("valor")]

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("campo"), value.alias("valor"))

    logs, names = model.logs(), ("contratante", "funcionalidade")
    sets = logs.groupingSets([["contratante"], ["funcionalidade"], []], *names).agg(
        *named(*names), F.min("data_evento").alias("a"), F.max("data_evento").alias("b"))
    bounds = F.array(*(pair(n, F.date_format(c, "yyyy-MM-dd")) for n, c in (("data_min", "a"), ("data_max", "b"))))
    values = F.filter(F.array(F.struct("campo", "valor")), lambda p: p["valor"].isNotNull())
    of_logs = sets.select(F.inline(F.when(F.col("campo").isNull(), bounds).otherwise(values)))
    names = ("causa_raiz", "tipo_rejeicao_semantica", "codigo_antt")
    of_rejections = model.rejections(*names).groupingSets([[n] for n in names], *names).agg(*named(*names)).select("campo", "valor").where(
        "valor IS NOT NULL AND (campo <> 'codigo_antt' OR valor <> '')")
    return of_logs.unionByName(of_rejections).orderBy("campo", "valor")
