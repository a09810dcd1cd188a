"""Executive overview: indicators, rankings, quality, flows and the error time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnlens.functions import rules
from returnlens.functions.classify import evitability_class, evitability_description
from returnlens.operators.model import LogModel
from returnlens.operators.ranking import (
    SEVERITY_COUNTS,
    count_if,
    leading,
    operational_score,
    percent,
    severity_tests,
    tie_break,
    top,
    with_share,
)

EVITABLE = rules.EVITABILITY_CLASSES[0][1]
SUCCESS_TYPES = ("SUCESSO_GERACAO", "SUCESSO_INSERCAO", "SUCESSO")
OTHERS = "OUTROS"
AFFECTED_FROM = 3
HEATMAP_SEVERITIES = ("BAIXO", "MEDIO", "ALTO", "CRITICO")

# Quality domains: (name, categories, types, entity kinds or none, functionalities that count).
ISSUING = ("Emitir CIOT", "Retificar CIOT")
ISSUING_AND_LOOKUP = (*ISSUING, "Consultar CIOT")
QUALITY_DOMAINS = (
    ("PLACA", ("PLACA",), (), (), ISSUING),
    ("RNTRC", ("TRANSPORTADOR",), ("TRANSPORTADOR_NAO_ENCONTRADO", "RNTRC_INATIVO"), ("RNTRC",), ISSUING_AND_LOOKUP),
    ("CEP", ("GEOLOCALIZACAO", "LOCALIZAÇÃO"), ("LOCALIZACAO_ORIGEM_INVALIDA", "CEP_NAO_CADASTRADO"), ("CEP",), ISSUING),
    ("MUNICIPIO", ("GEOLOCALIZACAO", "LOCALIZAÇÃO"), ("MUNICIPIO_DESTINO_INVALIDO", "MUNICIPIO_INVALIDO"),
     ("MUNICIPIO",), ISSUING),
    ("CPF_CNPJ", ("TRANSPORTADOR",), ("TRANSPORTADOR_NAO_ENCONTRADO",), ("CPF", "CNPJ", "DOC"), ISSUING_AND_LOOKUP),
)


def _error() -> Column:
    return F.col("status_geral") == "ERRO"


def _failed(column: str) -> Column:
    """Sum of a column over failed logs."""
    return F.coalesce(F.sum(F.when(_error(), F.col(column))), F.lit(0))


def _joined_rows() -> Column:
    """Rows of a log in the view joined with its rejections: one each, and one if it has none."""
    return F.greatest("n_rejeicoes", F.lit(1))


def executive_counts(model: LogModel) -> DataFrame:
    """Twelve counts over logs joined with their rejections: a log counts once per rejection,
    and once if it has none.

    One pass: grouping sets by client and by protocol; the sums come from the rows by client, the
    distinct values are the rows of each set.
    """
    logs = model.log_counts(**severity_tests(), count_evitavel=("categoria_operacional", lambda c: c.isin(*EVITABLE)))
    logs = logs.withColumn("total_requests", _joined_rows())
    groups = logs.groupingSets([["contratante"], ["protocolo"]], "contratante", "protocolo").agg(
        (F.grouping("contratante") == 0).alias("por_cliente"),
        F.sum("total_requests").alias("total_requests"),
        F.sum(F.when(F.col("status_geral") == "SUCESSO", F.col("total_requests"))).alias("count_sucesso"),
        _failed("total_requests").alias("count_erro"),
        *(_failed(n).alias(n) for n in (*SEVERITY_COUNTS, "count_evitavel")),
        _failed("n_rejeicoes").alias("total_rejeicoes"),
        count_if(_error()).alias("falhas"),
    )
    client = F.col("por_cliente")
    sums = ("total_requests", "count_sucesso", "count_erro", *SEVERITY_COUNTS, "count_evitavel", "total_rejeicoes")
    return groups.agg(
        *(F.coalesce(F.sum(F.when(client, F.col(n))), F.lit(0)).alias(n) for n in sums),
        count_if(~client & F.col("protocolo").isNotNull()).alias("unique_protocols"),
        count_if(client & F.col("contratante").isNotNull()).alias("total_contratantes"),
        count_if(client & (F.col("falhas") >= AFFECTED_FROM)).alias("clientes_afetados"),
    )


def executive_kpis(model: LogModel) -> DataFrame:
    """The counts with score, success rate and evitability rate."""
    total, errors = F.col("total_requests"), F.col("count_erro")
    return executive_counts(model).select(
        "*",
        operational_score(total).alias("score_operacional"),
        F.coalesce(percent(F.col("count_sucesso"), total), F.lit(100.0)).alias("taxa_sucesso"),
        F.coalesce(percent(F.col("count_evitavel"), errors), F.lit(0.0)).alias("taxa_evitabilidade"),
    )


def top_category(model: LogModel) -> DataFrame:
    """Most frequent rejection category of failed logs and its share of their rejections."""
    counts = model.rejections("categoria_operacional").where(_error()).groupBy("categoria_operacional").agg(F.count(F.lit(1)).alias("erros"))
    return top(with_share(counts, "erros"), 1, "erros", "categoria_operacional")


def _error_rows(model: LogModel) -> Column:
    """Failed rows of the joined view, the denominator of the error shares."""
    return model.logs_with_rejections("severidade").agg(count_if(_error())).scalar()


def top_functionality(model: LogModel) -> DataFrame:
    """Functionality with most failed logs and their share of the failed joined rows."""
    counts = model.logs().where(_error()).groupBy("funcionalidade").agg(F.count(F.lit(1)).alias("erros"))
    return top(counts, 1, "erros", "funcionalidade").withColumn(
        "percentual", percent(F.col("erros"), _error_rows(model))
    )


def top2_client_share(model: LogModel) -> DataFrame:
    """The two clients with most failed protocols and their part of the failed joined rows."""
    counts = model.logs().where(_error()).groupBy("contratante").agg(F.countDistinct("protocolo").alias("erros"))
    return top(counts, 2, "erros", "contratante").agg(
        F.count(F.lit(1)).alias("clientes"), F.coalesce(F.sum("erros"), F.lit(0)).alias("erros")
    ).withColumn("percentual", F.coalesce(percent(F.col("erros"), _error_rows(model)), F.lit(0.0)))


def executive_insights(model: LogModel) -> DataFrame:
    """The leading category, functionality, evitability and client share as one record.

    Two passes over failed logs, one by log and one by rejection. Every level keeps its two leading
    rows (the limit is applied before the shuffle), and those make the record.
    """
    logs = model.log_counts(evitaveis=("categoria_operacional", lambda c: c.isin(*EVITABLE))).where(_error())
    sets = logs.groupingSets([["funcionalidade"], ["contratante", "protocolo"], []], "funcionalidade", "contratante", "protocolo").agg(
        F.when(F.grouping("funcionalidade") == 0, "funcionalidade").when(F.grouping("contratante") == 0, "contratante")
        .otherwise("total").alias("nivel"),
        F.count(F.lit(1)).alias("erros"), F.sum(_joined_rows()).alias("linhas"),
        F.sum("n_rejeicoes").alias("rejeicoes"), F.sum("evitaveis").alias("evitaveis"))
    # A client's failures are its distinct protocols, which are the rows of that set.
    amount = F.when(F.col("nivel") != "contratante", F.col("erros")).otherwise(F.col("protocolo").isNotNull().cast("long"))
    levels = sets.groupBy("nivel", F.coalesce("funcionalidade", "contratante").alias("chave")).agg(
        F.sum(amount).alias("erros"), *(F.sum(n).alias(n) for n in ("linhas", "rejeicoes", "evitaveis")))
    categories = (
        model.rejections("categoria_operacional").where(_error()).groupBy(F.col("categoria_operacional").alias("chave"))
        .agg(F.count(F.lit(1)).alias("erros")).withColumn("nivel", F.lit("categoria"))
    )
    order = Window.partitionBy("nivel").orderBy(F.desc("erros"), *tie_break("chave"))
    leaders = levels.unionByName(categories, allowMissingColumns=True).withColumn("lugar", F.row_number().over(order)).where("lugar <= 2")

    def value(level: str, column: str) -> Column:
        return F.max(F.when((F.col("nivel") == level) & (F.col("lugar") == 1), F.col(column)))

    clients = F.col("nivel") == "contratante"
    lines = value("total", "linhas")
    return leaders.agg(
        F.coalesce(value("categoria", "chave"), F.lit("N/A")).alias("top_categoria"),
        F.coalesce(percent(value("categoria", "erros"), value("total", "rejeicoes")), F.lit(0.0)).alias("top_categoria_pct"),
        F.coalesce(value("funcionalidade", "chave"), F.lit("N/A")).alias("top_funcionalidade"),
        F.coalesce(percent(value("funcionalidade", "erros"), lines), F.lit(0.0)).alias("top_funcionalidade_pct"),
        F.coalesce(percent(value("total", "evitaveis"), lines), F.lit(0.0)).alias("taxa_evitabilidade"),
        count_if(clients).alias("top_clientes"),
        F.coalesce(percent(F.sum(F.when(clients, F.col("erros"))), lines), F.lit(0.0)).alias("top_clientes_pct"),
    )


def top_clients(model: LogModel, n: int = 10) -> DataFrame:
    """Clients with most failed protocols: share, score, leading rejection and functionality.

    Two passes, one by log and one by rejection. The total behind the shares is a row of the rollup.
    """
    logs = model.log_counts(**severity_tests())
    protocol = F.col("por_protocolo")
    sets = logs.groupingSets([["contratante", "protocolo"], ["contratante", "funcionalidade"]], "contratante", "protocolo", "funcionalidade").agg(
        (F.grouping("protocolo") == 0).alias("por_protocolo"),
        count_if(_error()).alias("falhas"), F.sum(_joined_rows()).alias("linhas"),
        _failed("n_rejeicoes").alias("rejeitadas"), *(_failed(s).alias(s) for s in SEVERITY_COUNTS))
    clients = sets.rollup("contratante").agg(
        (F.grouping("contratante") == 1).alias("todos"),
        count_if(protocol & (F.col("falhas") > 0) & F.col("protocolo").isNotNull()).alias("total_rejeicoes"),
        *(F.sum(F.when(protocol, F.col(c))).alias(c) for c in ("falhas", "linhas", *SEVERITY_COUNTS)),
        leading("funcionalidade", "rejeitadas", ~protocol & (F.col("rejeitadas") > 0)).alias("principal_funcionalidade"),
    ).where("falhas > 0")
    # The total and the n leaders: the window below, and the broadcast, hold at most n + 1 rows.
    leaders = clients.orderBy(F.desc("todos"), F.desc("total_rejeicoes"), *tie_break("contratante")).limit(n + 1)
    total = F.max(F.when(F.col("todos"), F.col("total_rejeicoes"))).over(Window.partitionBy(F.lit(0)))
    leaders = leaders.withColumn("percentual", percent(F.col("total_rejeicoes"), total)).where("NOT todos AND contratante IS NOT NULL")
    kinds = model.rejections("tipo_rejeicao_semantica").where(_error()).groupBy("contratante", "tipo_rejeicao_semantica").agg(
        F.count(F.lit(1)).alias("n"))
    rejection = kinds.groupBy("contratante").agg(leading("tipo_rejeicao_semantica", "n", F.lit(True)).alias("principal_rejeicao"))
    return (
        rejection.join(F.broadcast(leaders), "contratante", "right")
        .select("contratante", "total_rejeicoes", "percentual", operational_score(F.col("linhas")).alias("score_operacional"),
                "principal_rejeicao", "principal_funcionalidade")
        .orderBy(F.desc("total_rejeicoes"), *tie_break("contratante"))
    )


def top_rejections(model: LogModel, n: int = 10) -> DataFrame:
    """Most frequent rejection types of failed logs with their share; no type is a group too."""
    counts = (
        model.rejections("tipo_rejeicao_semantica").where(_error())
        .groupBy("tipo_rejeicao_semantica").agg(F.count(F.lit(1)).alias("volume"))
    )
    return top(with_share(counts, "volume"), n, "volume", "tipo_rejeicao_semantica")


def problem_functionalities(model: LogModel) -> DataFrame:
    """Functionalities with failures: count, rate, leading rejection and severity."""
    calls = model.logs().groupBy("funcionalidade").agg(
        F.count(F.lit(1)).alias("chamadas"), count_if(_error()).alias("total_erros")
    ).where(F.col("total_erros") > 0)
    rejected = model.rejections("tipo_rejeicao_semantica", "severidade").where(_error())
    kind, severity = "tipo_rejeicao_semantica", "severidade"
    sets = rejected.groupingSets([["funcionalidade", kind], ["funcionalidade", severity]], "funcionalidade", kind, severity).agg(
        (F.grouping(kind) == 0).alias("por_tipo"), F.count(F.lit(1)).alias("n"))
    leaders = sets.groupBy("funcionalidade").agg(
        leading(kind, "n", F.col("por_tipo")).alias("rejeicao"), leading(severity, "n", ~F.col("por_tipo")).alias("gravidade"))
    return (
        calls.join(leaders, "funcionalidade", "left")
        .select(
            "funcionalidade", "total_erros",
            percent(F.col("total_erros"), F.col("chamadas")).alias("taxa_erro"),
            F.coalesce("rejeicao", F.lit("Nenhuma")).alias("principal_rejeicao"),
            F.coalesce("gravidade", F.lit("INFO")).alias("severidade_predominante"),
        )
        .orderBy(F.desc("total_erros"), *tie_break("funcionalidade"))
    )


def severity_heatmap(model: LogModel, n: int = 10) -> DataFrame:
    """Rejections per severity of the functionalities with most of them."""
    counts = (
        model.rejections("severidade").where(_error() & F.col("funcionalidade").isNotNull())
        .groupBy("funcionalidade", "severidade").agg(F.count(F.lit(1)).alias("volume"))
    )
    wide = counts.groupBy("funcionalidade").agg(
        *(F.coalesce(F.sum(F.when(F.col("severidade") == s, F.col("volume"))), F.lit(0)).alias(s)
          for s in HEATMAP_SEVERITIES),
        F.sum("volume").alias("total"),
    )
    return top(wide, n, "total", "funcionalidade").drop("total")


def evitability(model: LogModel) -> DataFrame:
    """Rejections per evitability class with share and explanation."""
    rows = model.rejections("categoria_operacional").where(_error()).select(
        F.expr(evitability_class("categoria_operacional")).alias("classe_evitabilidade")
    )
    counts = rows.groupBy("classe_evitabilidade").agg(F.count(F.lit(1)).alias("total"))
    return with_share(counts, "total").withColumn(
        "descricao", F.expr(evitability_description("classe_evitabilidade"))
    ).orderBy(F.desc("total"), *tie_break("classe_evitabilidade"))


def data_quality(model: LogModel) -> DataFrame:
    """Per domain: rejections that name such an entity, operations, and the quality rate."""
    kinds = F.transform(F.coalesce("entidades", F.array()), lambda e: e["entidade_tipo"])
    rows = model.logs_with_rejections("categoria_operacional", "tipo_rejeicao_semantica", "entidades").withColumn(
        "tipos", kinds)
    measures = []
    for name, categories, types, entity_kinds, functions in QUALITY_DOMAINS:
        hit = F.col("categoria_operacional").isin(*categories)
        if types:
            hit |= F.col("tipo_rejeicao_semantica").isin(*types)
        if entity_kinds:
            hit &= F.arrays_overlap("tipos", F.lit(list(entity_kinds)))
        measures += [count_if(hit & _error()).alias(f"{name}_x"),
                     count_if(F.col("funcionalidade").isin(*functions)).alias(f"{name}_y")]
    names = [d[0] for d in QUALITY_DOMAINS]
    stacked = ", ".join(f"'{n}', {n}_x, {n}_y" for n in names)
    table = rows.agg(*measures).selectExpr(f"stack({len(names)}, {stacked}) AS (dominio, erros, operacoes)")
    rate = F.greatest(F.lit(0.0), (1.0 - F.col("erros") / F.nullif(F.col("operacoes").cast("double"), F.lit(0.0))) * 100.0)
    return table.withColumn("qualidade", F.when(F.col("operacoes") > 0, rate))


def flow_triples(model: LogModel) -> DataFrame:
    """Functionality, rejection type and cause of failed logs with their volume."""
    kind = F.coalesce("tipo_rejeicao_semantica", "tipo_erro_tecnico", F.lit(rules.UNCATEGORISED))
    plain = ~F.coalesce("tipo_rejeicao_semantica", F.lit("")).isin(*SUCCESS_TYPES)
    return (
        model.rejections("tipo_rejeicao_semantica", "tipo_erro_tecnico", "causa_raiz").where(_error() & plain)
        .groupBy("funcionalidade", kind.alias("tipo_rejeicao"), "causa_raiz")
        .agg(F.count(F.lit(1)).alias("volume"))
        .orderBy(F.desc("volume"), *tie_break("funcionalidade", "tipo_rejeicao", "causa_raiz"))
    )


def flow_grouped(model: LogModel, functions: int = 5, kinds: int = 7, causes: int = 5, n: int = 20) -> DataFrame:
    """The flow with each level cut to its leading values, the rest as OUTROS.

    The leading values of the three levels come from one pass as one record of short lists.
    """
    triples = flow_triples(model)
    keep = {"funcionalidade": functions, "tipo_rejeicao": kinds, "causa_raiz": causes}
    level = F.coalesce(*(F.when(F.grouping(c) == 0, c) for c in keep))
    totals = triples.groupingSets([[c] for c in keep], *keep).agg(level.alias("nivel"), F.sum("volume").alias("v")).select(
        "nivel", "v", F.coalesce(*keep).alias("lider")).where("lider IS NOT NULL")
    order = Window.partitionBy("nivel").orderBy(F.desc("v"), *tie_break("lider"))
    # The window's limit is applied before the shuffle; the lists hold at most ``keep`` values.
    ranked = totals.withColumn("lugar", F.row_number().over(order)).where(F.col("lugar") <= max(keep.values()))
    lists = ranked.agg(F.struct(*(
        F.collect_list(F.when((F.col("nivel") == c) & (F.col("lugar") <= k), F.col("lider"))).alias(c) for c, k in keep.items())).alias("l")).scalar()

    def group(column: str) -> Column:
        return F.when(F.array_contains(lists[column], F.col(column)), F.col(column)).otherwise(OTHERS)

    names = {"funcionalidade": "func_grupo", "tipo_rejeicao": "tipo_grupo", "causa_raiz": "causa_grupo"}
    grouped = triples.select(*(group(c).alias(g) for c, g in names.items()), "volume")
    sums = grouped.groupBy(*names.values()).agg(F.sum("volume").alias("volume"))
    return top(sums, n, "volume", *names.values())


def flow_links(model: LogModel) -> DataFrame:
    """Edges of the grouped flow: functionality to type and type to cause."""
    def edge(level: str, source: str, target: str) -> Column:
        return F.struct(F.lit(level).alias("nivel"), F.col(source).alias("origem"), F.col(target).alias("destino"), "volume")

    edges = F.array(edge("FUNC_TIPO", "func_grupo", "tipo_grupo"), edge("TIPO_CAUSA", "tipo_grupo", "causa_grupo"))
    return flow_grouped(model).select(F.inline(edges)).groupBy("nivel", "origem", "destino").agg(F.sum("volume").alias("volume"))


def hourly_spans(logs: DataFrame, *aggregates: Column) -> DataFrame:
    """Logs per hour with the first and last time, and other aggregates."""
    return logs.groupBy(F.date_trunc("hour", "data_evento").alias("hora")).agg(
        F.min("data_evento").alias("a"), F.max("data_evento").alias("b"), *aggregates)


def variability_of(hours: DataFrame, *aggregates: Column) -> DataFrame:
    """Temporal variability from ``hourly_spans``, in which few rows are left."""
    # The days follow from the distinct hours, so one distinct pass is enough.
    counts = hours.agg(
        F.countDistinct(F.date_trunc("day", "hora")).alias("dias"),
        F.count("hora").alias("horas"),
        F.datediff(F.max("b"), F.min("a")).cast("bigint").alias("intervalo_dias"),
        *aggregates,
    )
    return counts.withColumn("variavel", (F.col("dias") > 1) | (F.col("horas") >= 4))


def temporal_variability(model: LogModel) -> DataFrame:
    """Distinct days and hours, day span, and whether a time series makes sense."""
    return variability_of(hourly_spans(model.logs()))


def error_timeseries(model: LogModel) -> DataFrame:
    """Rejections per period and category: hours for a span up to three days, else days. Empty
    when the logs hardly vary in time."""
    gate = temporal_variability(model).select(F.struct("variavel", (F.col("intervalo_dias") <= 3).alias("por_hora"))).scalar()
    varies, hourly = gate["variavel"], gate["por_hora"]
    period = F.when(hourly, F.date_format("data_evento", "yyyy-MM-dd HH:00")).otherwise(
        F.date_format("data_evento", "yyyy-MM-dd")
    )
    return (
        model.rejections("categoria_operacional").where(_error() & varies)
        .groupBy(period.alias("periodo"), F.col("categoria_operacional").alias("categoria"))
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy("periodo", *tie_break("categoria"))
    )
