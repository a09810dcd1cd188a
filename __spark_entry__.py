"""

All queries run on API-return logs derived from ``events`` (``returnlens.plans.demo``). The
reports read the silver table, which is classified once per session and data folder and kept in
the shared folder; the operator queries classify the logs themselves.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oracles.cases import CASES
from oracles.operators import OPERATORS
from oracles.reports import FILTERS, REPORTS, filter_sql, report_sql
from returnlens import LogFilter, LogModel, classify_logs, configure_session, shared_dir
from returnlens.functions import classify as C
from returnlens.functions.classify import (
    category_guidance,
    category_severity,
    classification_stages,
    context_stages,
    contextual_result,
    is_success_message,
    prepare_stages,
    semantic_columns,
    semantic_labels,
    semantic_stages,
    severity_label,
)
from returnlens.functions.entities import entity_values
from returnlens.functions.payload import extract_protocol, pair_messages, parse_payload
from returnlens.functions.sqltext import run_on_table
from returnlens.functions.text import mask_stages, strip
from returnlens.operators.canonical import ROW, canonicalize
from returnlens.operators.silver import dim_log, fact_entities, fact_rejections
from returnlens.plans import client, consolidated, critical, detail, observability, overview
from returnlens.plans.cases import rule_logs, wide_logs, write_raw_files
from returnlens.plans.demo import raw_logs
from returnlens.sources.rawlogs import describe_files, describe_splits, read_lines
from returnlens.sources.buckets import buckets_for, open_buckets, write_buckets
from returnlens.sources.pages import page_at, page_count, write_pages
from returnlens.sources.silver import export_csv, ingest, ledger, open_silver, register_views, rejected_lines
from returnlens.sources.textindex import index_texts, open_indexed

try:  # the training-data operators, where they are installed
    import corpus_pipeline
    from returnlens.llm import queries as llm
except ModuleNotFoundError as missing:
    if not str(missing.name).startswith(("corpus_pipeline", "returnlens.llm")):
        raise
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"
Query = Callable[[SparkSession, str], DataFrame]


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalize(raw_logs(spark, sf_dir), keep=("log_id", ROW))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_logs(_canonical(configure_session(spark), sf_dir))


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    key = hashlib.md5(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/returnlens-{spark.sparkContext.applicationId}/{key}/{name}"


_written: set[str] = set()


def silver_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified logs, written once per session and data folder."""
    configure_session(spark)
    path = _folder(spark, sf_dir, "silver")
    if path not in _written:
        _classified(spark, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(path)
        _written.add(path)
    return spark.read.parquet(path)


def _model(spark: SparkSession, sf_dir: str) -> LogModel:
    return LogModel.from_nested(silver_table(spark, sf_dir))


def _flat_model(spark: SparkSession, sf_dir: str) -> LogModel:
    silver = silver_table(spark, sf_dir)
    return LogModel.from_tables(dim_log(silver), fact_rejections(silver), fact_entities(silver))


def _bucketed_model(spark: SparkSession, sf_dir: str) -> LogModel:
    nested, path = silver_table(spark, sf_dir).withColumn("lote", F.lit("1")), _folder(spark, sf_dir, "buckets")
    if path not in _written:
        write_buckets(nested, path, buckets=buckets_for(nested.count()))
        _written.add(path)
    return open_buckets(spark, path, nested)


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, the precision both engines are compared at."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _report(function: Callable[..., DataFrame], *args, source: Callable[[SparkSession, str], LogModel] = _model,
            where: LogFilter | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = source(spark, sf_dir)
        return _rounded(function(model if where is None else model.where(where), *args))

    return run


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per single message of every log."""
    return _pairs_of(_canonical(configure_session(spark), sf_dir))


def _pairs_of(canonical: DataFrame) -> DataFrame:
    payload = canonical.selectExpr("log_id", "funcionalidade", f"{parse_payload('cod_mensagem', 'des_resposta')} AS payload")
    pairs = payload.selectExpr("log_id", "funcionalidade", f"{pair_messages('payload')} AS pares")
    # The outer form, with its empty rows dropped, spares the size test the optimizer would put
    # below a plain generator, and with it a second evaluation of the pairs.
    return pairs.selectExpr("log_id", "funcionalidade", "inline_outer(pares)").where("mensagem IS NOT NULL")


def _on_messages(stages: list, *columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_on_table(_pairs(spark, sf_dir), stages).selectExpr("log_id", "CAST(pos AS BIGINT) AS pos", *columns)

    return run


def _label_stage(r) -> dict[str, str]:
    return {"rotulo": semantic_labels(r("semantica"))}


def _contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = run_on_table(_pairs(spark, sf_dir), [*prepare_stages(), *context_stages()])
    return prepared.selectExpr("log_id", "CAST(pos AS BIGINT) AS pos", f"{contextual_result('contexto')} AS c").selectExpr(
        "log_id", "pos", "c.resultado_operacional AS resultado", "c.tipo_erro_tecnico AS tipo_erro", "c.severidade AS severidade")


def _canonical_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-case names, nulls and missing columns."""
    configure_session(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = events.select(F.col("event_type").alias(" Funcionalidade "), F.col("ts").alias("Data_Hora"),
                        F.expr("IF(event_id % 3 = 0, NULL, props)").alias("DES_RESPOSTA"))
    return canonicalize(raw)


def _timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in the nine formats, and one that does not parse."""
    configure_session(spark)
    formats = ("dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy",
               "yyyy-MM-dd", "dd/MM/yy HH:mm:ss", "dd/MM/yy HH:mm", "dd/MM/yy")
    kind = F.col("event_id") % 10
    stamp = F.coalesce(*(F.when(kind == i, F.date_format("ts", f)) for i, f in enumerate(formats)), F.lit("em breve"))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", stamp.alias("dhr_registro"))
    return canonicalize(raw, F.lit("2024-06-01 00:00:00").cast("timestamp"), keep=("event_id",)).select("event_id", "data")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = _canonical(configure_session(spark), sf_dir)
    parsed = canonical.selectExpr("log_id", f"{parse_payload('cod_mensagem', 'des_resposta')} AS p")
    return parsed.selectExpr("log_id", "array_join(p.codes, '|') AS codigos", "array_join(p.messages, '|') AS mensagens")


def _protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocols in JSON, in the code column, in the text, in the original column, or nowhere."""
    configure_session(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id",
        """CASE event_id % 6 WHEN 0 THEN concat('{"PROTOCOLO":"J', event_id, '","Codigo":"217"}') WHEN 1 THEN '217' ELSE '' END AS cod_mensagem""",
        """CASE event_id % 6 WHEN 2 THEN concat('Falha no Protocolo: ABC-', event_id, ' e protocolo XYZ') WHEN 3 THEN 'protocolo 12 negado'
           WHEN 5 THEN concat('{"protocolo":0,"Protocolo":"K', event_id, '"}') ELSE 'Retorno' END AS des_resposta""",
        "CASE event_id % 6 WHEN 1 THEN concat(' P', event_id, ' ') WHEN 4 THEN 'SEM_PROTOCOLO' ELSE '' END AS cod_protocolo",
        "CASE event_id % 6 WHEN 3 THEN concat('O', event_id) ELSE '' END AS protocolo",
    )
    found = extract_protocol("cod_mensagem", "des_resposta", "cod_protocolo", "protocolo")
    return rows.selectExpr("event_id", f"{found} AS protocolo")


def _mask_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_logs(configure_session(spark), sf_dir).selectExpr("log_id", f"{strip('des_resposta')} AS limpa")
    return run_on_table(raw, mask_stages("limpa", "mascara")).select("log_id", "mascara")


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_rejections(silver_table(spark, sf_dir)).selectExpr(
        "rejeicao_id", f"{category_severity('categoria_operacional')} AS severidade_categoria",
        f"{category_guidance('categoria_operacional')} AS orientacao_categoria")


def _entities_of(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rejections = fact_rejections(silver_table(spark, sf_dir))
        return rejections.selectExpr("rejeicao_id", f"explode({entity_values('mensagem', kind)}) AS entidade_valor")

    return run


def _raw_files(spark: SparkSession, sf_dir: str) -> str:
    """The derived logs as raw files."""
    configure_session(spark)
    path = _folder(spark, sf_dir, "raw")
    if path not in _written:
        write_raw_files(spark, sf_dir, path)
        _written.add(path)
    return path


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _raw_files(spark, sf_dir)
    root = _folder(spark, sf_dir, f"lake{len(_written)}")
    _written.add(root)
    return ingest(spark, files, root)


def _lake(spark: SparkSession, sf_dir: str) -> str:
    """The raw files as a lake, ingested once per session and data folder."""
    files, root = _raw_files(spark, sf_dir), _folder(spark, sf_dir, "lake")
    if root not in _written:
        ingest(spark, files, root)
        _written.add(root)
    return root


def _ingest_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(spark, _raw_files(spark, sf_dir), _lake(spark, sf_dir))


def _ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_silver(spark, _lake(spark, sf_dir)).logs().drop("log_id")


def _ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(spark, _lake(spark, sf_dir)).select("linha", "texto")


def _row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in its file each log stands, as its key says."""
    return open_silver(spark, _lake(spark, sf_dir)).logs().select(
        "protocolo", F.substring_index("log_id", "_", -1).cast("long").alias("linha"))


def _file_number(path: str) -> Column:
    return F.regexp_extract(path, "arquivo=(-?[0-9]+)", 1).cast("long")


def _file_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = describe_files(describe_splits(read_lines(spark, _raw_files(spark, sf_dir))))
    return files.select(_file_number("path").alias("arquivo"), F.col("separator").alias("separador"), F.col("encoding").alias("codificacao"),
                        F.col("multiline").alias("aspas_abertas"), F.col("problema").isNotNull().alias("recusado"))


def _file_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of one file, the first."""
    root = _lake(spark, sf_dir)
    register_views(spark, root, ledger(spark, root).where(_file_number("path") == 0).first().file_hash)
    return spark.sql("""SELECT protocolo, status_geral, count(rejeicao_id) AS rejeicoes FROM dim_log
        LEFT JOIN fact_rejeicoes_semanticas USING (log_id) GROUP BY dim_log.log_id, protocolo, status_geral""")


def _lake_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_silver(spark, _lake(spark, sf_dir)).where(LOG_FILTERS["filter_period"]).logs().select("protocolo", "status_geral")


def _indexed(search: str = "", where: LogFilter | None = None) -> Query:
    """Detail rows found through the postings of the lake, without the keys that come from its files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _lake(spark, sf_dir)
        index_texts(spark, root)
        return _projection(detail.detail_rows(open_indexed(spark, root, search, where), search)).drop("hash_evento")

    return run


def _pages_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, a middle and the last page of the stored detail rows."""
    path = _folder(spark, sf_dir, "pages")
    if path not in _written:
        write_pages(detail.detail_rows(_model(spark, sf_dir)), path)
        _written.add(path)
    last = page_count(spark, path)
    pages = [page_at(spark, path, n).withColumn("pagina", F.lit(n).cast("long")) for n in sorted({1, (last + 1) // 2, max(last, 1)})]
    return reduce(DataFrame.unionByName, pages)


def _exported(quote_all: bool) -> Query:
    """The export written as files and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark, sf_dir, f"export{int(quote_all)}")
        rows = detail.export_rows(_model(spark, sf_dir))
        export_csv(rows.withColumn("data", F.date_format("data", "yyyy-MM-dd HH:mm:ss")), path, quote_all)
        names = ("protocolo", "data", "contratante", "tipo_rejeicao_semantica", "mensagem_original", "mensagem_normalizada", "severidade_operacional",
                 "codigo_antt", "entidades_extraidas")
        back = spark.read.option("header", True).option("sep", ";").option("escape", '"').csv(path)
        return back.select(*(F.coalesce(n, F.lit("")).alias(n) for n in names))

    return run


def _rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_on_table(_pairs_of(rule_logs(configure_session(spark), sf_dir)), [*classification_stages(), _label_stage])
    return rows.selectExpr("log_id", "resultado_operacional AS resultado", "tipo_erro_tecnico AS tipo_erro", "rotulo.template AS tipo", "severidade")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_logs(wide_logs(configure_session(spark), sf_dir))


def _wide_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_rejections(_wide(spark, sf_dir)).select(
        "rejeicao_id", "codigo_antt", "tipo_rejeicao_semantica", F.char_length("mensagem").cast("long").alias("tamanho"), F.md5("mensagem").alias("resumo"))


def _rows(function: Callable[..., DataFrame], **arguments) -> Callable[[LogModel], DataFrame]:
    return lambda model: function(detail.detail_rows(model, **arguments))


def _projection(rows: DataFrame) -> DataFrame:
    return detail.detail_projection(rows).drop("rejeicao_id")


def _second_page(rows: DataFrame) -> DataFrame:
    first = detail.detail_page_after(rows).tail(1)
    return detail.detail_page_after(rows, first[0] if first else None).drop("rejeicao_id")


LOG_FILTERS = {
    "filter_period": LogFilter(inicio=date(2024, 1, 5), fim=date(2024, 1, 9)),
    "filter_single_day": LogFilter(inicio=date(2024, 1, 5)),
    "filter_protocol": LogFilter(protocolo="0_12"),
    "filter_status": LogFilter(status="SUCESSO"),
    "filter_client": LogFilter(contratantes=("CLI3", "CLI17")),
    "filter_functionality": LogFilter(funcionalidades=("Emitir CIOT", "Cancelar CIOT")),
    "filter_cause": LogFilter(causas=("LOCALIZAÇÃO", "PLACA")),
    "filter_type": LogFilter(tipos=("PLACA_SEM_VINCULO_RNTRC",)),
    "filter_code": LogFilter(codigos=("209", "999")),
    "filter_message": LogFilter(mensagem="MUNICÍPIO"),
    "filter_combined": LogFilter(inicio=date(2024, 1, 3), fim=date(2024, 1, 20), status="ERRO",
                                 funcionalidades=("Emitir CIOT", "Cancelar CIOT"), causas=("LOCALIZAÇÃO", "PLACA")),
}
REPORT_FUNCTIONS: dict[str, tuple] = {
    "executive_kpis": (overview.executive_kpis,),
    "top_category": (overview.top_category,),
    "top_functionality": (overview.top_functionality,),
    "top2_client_share": (overview.top2_client_share,),
    "executive_insights": (overview.executive_insights,),
    "top_clients": (overview.top_clients,),
    "top_rejections": (overview.top_rejections,),
    "problem_functionalities": (overview.problem_functionalities,),
    "severity_heatmap": (overview.severity_heatmap,),
    "evitability": (overview.evitability,),
    "data_quality": (overview.data_quality,),
    "flow_triples": (overview.flow_triples,),
    "flow_grouped": (overview.flow_grouped,),
    "flow_links": (overview.flow_links,),
    "temporal_variability": (overview.temporal_variability,),
    "error_timeseries": (overview.error_timeseries,),
    "client_list": (client.client_list,),
    "client_scorecard": (client.client_scorecard,),
    "client_recurrent_entities": (client.client_recurrent_entities,),
    "client_error_categories": (client.client_error_categories,),
    "corrective_actions": (client.corrective_actions,),
    "critical_entities_rntrc": (critical.critical_entities, "RNTRC"),
    "critical_entities_placa": (critical.critical_entities, "PLACA"),
    "critical_entities_doc": (critical.critical_entities, "DOC"),
    "critical_entities_cep_mun": (critical.critical_entities, "CEP_MUN"),
    "critical_entities_search": (critical.critical_entities, "PLACA", "C01"),
    "critical_entities_page": (critical.critical_entities_page, "PLACA", "", 2),
    "top_entities": (critical.top_entities,),
    "entity_trend": (critical.entity_trend,),
    "client_rejection_matrix": (observability.client_rejection_matrix,),
    "uncatalogued_codes": (observability.uncatalogued_codes,),
    "hourly_errors": (observability.hourly_errors,),
    "traffic_anomalies": (observability.traffic_anomalies,),
    "detail_count": (_rows(detail.detail_count),),
    "detail_page": (_rows(lambda rows: detail.detail_page(rows, 2)),),
    "detail_page_after": (_rows(_second_page),),
    "text_search": (_rows(_projection, search="1200004"),),
    "text_search_message": (_rows(_projection, search="PLACA abc-00"),),
    "detail_local_filters": (_rows(_projection, funcionalidade="Emitir CIOT", tipo="PLACA_SEM_VINCULO_RNTRC", contratante="CLI7"),),
    "export_rows": (detail.export_rows,),
    "filter_domain": (detail.filter_domain,),
    "consolidated_rejections": (consolidated.consolidated_rejections,),
    "consolidated_search": (consolidated.consolidated_rejections, "rntrc"),
    "consolidated_page": (consolidated.consolidated_page, "", 2),
    "consolidated_totals": (consolidated.consolidated_totals,),
}
# Reports that also run on the three flat tables, through joins, and under a filter.
FLAT_REPORTS = ("executive_kpis", "top_clients", "data_quality", "critical_entities_doc", "text_search", "export_rows")
FILTERED_REPORTS = ("executive_kpis", "top_rejections", "data_quality", "error_timeseries", "consolidated_rejections")


def entry(spark: SparkSession) -> DataFrame:
    """Most frequent rejection types."""
    return _rounded(overview.top_rejections(_model(spark, SMOKE_DIR)))


def queries() -> dict[str, Query]:
    """Every implemented operator and report."""

    def filtered(log_filter: LogFilter, source: Callable[[SparkSession, str], LogModel] = _model) -> Query:
        return _report(lambda m: m.where(log_filter).logs().select("log_id", "protocolo", "status_geral"), source=source)

    operators: dict[str, Query] = {
        "canonical_columns": lambda s, d: _canonical(configure_session(s), d).drop("log_id", ROW).withColumn(
            "data", F.col("data").cast("timestamp")),
        "canonical_defaults": _canonical_defaults,
        "parse_timestamps": _timestamps,
        "parse_payload": _payloads,
        "extract_protocol": _protocols,
        "split_messages": lambda s, d: _pairs(s, d).selectExpr("log_id", "CAST(pos AS BIGINT) AS pos", "mensagem", "codigo"),
        "mask_message": _on_messages(prepare_stages(), "mascara"),
        "mask_raw_response": _mask_raw,
        "classify_semantic": _on_messages([*prepare_stages(), *semantic_stages(), _label_stage, semantic_columns],
                                          *semantic_columns(str)),
        "contextual_result": _contextual,
        "success_flag": _on_messages([], f"{is_success_message('mensagem', 'codigo', 'funcionalidade')} AS sucesso"),
        "operational_result": _on_messages(classification_stages(), *C.RESULT_FIELDS),
        "severity_norm": _on_messages([*prepare_stages(), *semantic_stages(), _label_stage],
                                      f"{severity_label('rotulo.severidade')} AS severidade"),
        "category_lookups": _lookups,
        "worst_result": lambda s, d: _classified(s, d).select("log_id", "resultado_operacional"),
        "dim_log": lambda s, d: dim_log(_classified(s, d)),
        "rejections": lambda s, d: fact_rejections(_classified(s, d)),
        "entities_all": lambda s, d: fact_entities(_classified(s, d)),
        **{name: _entities_of(name.removeprefix("entities_").upper()) for name in OPERATORS
           if name.startswith("entities_") and name != "entities_all"},
        "rule_labels": _rule_labels,
        "wide_rejections": _wide_rejections,
        "wide_entities": lambda s, d: fact_entities(_wide(s, d)).drop("entidade_id"),
        "ingest_summary": _ingest,
        "ingest_again": _ingest_again,
        "ingest_rows": _ingest_rows,
        "ingest_rejects": _ingest_rejects,
        "row_keys": _row_keys,
        "file_dialects": _file_dialects,
        "file_views": _file_views,
        "lake_period": _lake_period,
        "text_search_indexed": _indexed("1200004"),
        "text_search_message_indexed": _indexed("PLACA abc-00"),
        "filter_combined_indexed": _indexed("ABC-0", LogFilter(protocolo="0_12", status="ERRO", mensagem="placa%RNTRC")),
        "detail_page_at": _pages_at,
        "export_quoted": _exported(True),
        "export_plain": _exported(False),
    }
    reports = {name: _report(*spec) for name, spec in REPORT_FUNCTIONS.items()}
    flat = {f"{name}_flat": _report(*REPORT_FUNCTIONS[name], source=_flat_model) for name in FLAT_REPORTS}
    bucketed = {f"{name}_bucketed": _report(*REPORT_FUNCTIONS[name], source=_bucketed_model) for name in FLAT_REPORTS}
    under_filter = {f"{name}_filtered": _report(*REPORT_FUNCTIONS[name], where=LOG_FILTERS["filter_combined"])
                    for name in FILTERED_REPORTS}
    filters = {name: filtered(f) for name, f in LOG_FILTERS.items()}
    semi_joins = {f"{name}_flat": filtered(LOG_FILTERS[name], source=_flat_model)
                  for name in ("filter_cause", "filter_type", "filter_code", "filter_message", "filter_combined")}
    bucketed["filter_combined_bucketed"] = filtered(LOG_FILTERS["filter_combined"], source=_bucketed_model)
    wide = {"client_rejection_crosstab": _report(observability.client_rejection_crosstab)}
    trained = {} if llm is None else llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return operators | reports | flat | bucketed | under_filter | filters | semi_joins | wide | trained


def oracle_sql() -> dict[str, str]:
    """The same queries for DuckDB."""
    pipeline = {} if llm is None or corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return ({} if llm is None else llm.ORACLE_SQL | pipeline) | (
        dict(OPERATORS)
        | CASES
        | {name: report_sql(name) for name in REPORTS}
        | {f"{name}_flat": report_sql(name) for name in FLAT_REPORTS}
        | {f"{name}_bucketed": report_sql(name) for name in FLAT_REPORTS} | {"filter_combined_bucketed": filter_sql("filter_combined")}
        | {f"{name}_filtered": report_sql(name, FILTERS["filter_combined"]) for name in FILTERED_REPORTS}
        | {name: filter_sql(name) for name in FILTERS}
        | {f"{name}_flat": filter_sql(name)
           for name in ("filter_cause", "filter_type", "filter_code", "filter_message", "filter_combined")}
    )
