"""DuckDB SQL of the single operators."""

from __future__ import annotations

from oracles.prelude import (
    UP_TO_CLASSIFIED,
    UP_TO_ENTITIES,
    UP_TO_FACT,
    UP_TO_PAIRS,
    UP_TO_PARSED,
    UP_TO_RAW,
    lit,
    mask,
    success_sql,
    words,
)
from returnlens.functions import rules

FACT = ("rejeicao_id, log_id, codigo_antt, categoria_operacional, tipo_rejeicao_semantica, subtipo_rejeicao, categoria, severidade,"
        " causa_raiz, orientacao_operacional, mensagem, mensagem_original, mensagem_normalizada, template_oficial,"
        " resultado_operacional, tipo_erro_tecnico")
INGEST_TS = "TIMESTAMP '2024-06-01 00:00:00'"
# Python-style formats of the reader, by event_id % 10; 9 does not parse.
STAMPS = ("%d/%m/%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M", "%Y-%m-%dT%H:%M:%S", "%d/%m/%Y", "%Y-%m-%d",
          "%d/%m/%y %H:%M:%S", "%d/%m/%y %H:%M", "%d/%m/%y")
_UNIT = ("second", "second", "minute", "second", "day", "day", "second", "minute", "day")

PROTOCOL_ROWS = """SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN '{"PROTOCOLO":"J' || event_id || '","Codigo":"217"}' WHEN 1 THEN '217' ELSE '' END AS cod_mensagem,
  CASE event_id % 6 WHEN 2 THEN 'Falha no Protocolo: ABC-' || event_id || ' e protocolo XYZ' WHEN 3 THEN 'protocolo 12 negado'
    WHEN 5 THEN '{"protocolo":0,"Protocolo":"K' || event_id || '"}' ELSE 'Retorno' END AS des_resposta,
  CASE event_id % 6 WHEN 1 THEN ' P' || event_id || ' ' WHEN 4 THEN 'SEM_PROTOCOLO' ELSE '' END AS cod_protocolo,
  CASE event_id % 6 WHEN 3 THEN 'O' || event_id ELSE '' END AS protocolo FROM events"""

OPERATORS = {
    "canonical_columns": UP_TO_RAW + "SELECT contratante, funcionalidade, cod_mensagem, des_resposta, cod_protocolo, data_evento AS data FROM raw",
    "canonical_defaults": """SELECT 'CONTRATANTE DESCONHECIDO' AS contratante, coalesce(event_type, 'NÃO ESPECIFICADA') AS funcionalidade,
        '' AS cod_mensagem, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END, '') AS des_resposta, 'SEM_PROTOCOLO' AS cod_protocolo, ts AS data FROM events""",
    "parse_timestamps": "SELECT event_id, CASE event_id % 10 "
        + " ".join(f"WHEN {i} THEN date_trunc('{u}', ts)" for i, u in enumerate(_UNIT)) + f" ELSE {INGEST_TS} END AS data FROM events",
    "parse_payload": UP_TO_PARSED + "SELECT log_id, array_to_string(codes, '|') AS codigos, array_to_string(msgs, '|') AS mensagens FROM parsed",
    "extract_protocol": f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'J' || event_id WHEN 1 THEN 'P' || event_id WHEN 2 THEN 'ABC-' || event_id
        WHEN 3 THEN 'O' || event_id WHEN 5 THEN 'K' || event_id ELSE 'SEM_PROTOCOLO' END AS protocolo FROM ({PROTOCOL_ROWS})""",
    "split_messages": UP_TO_PAIRS + "SELECT log_id, pos, mensagem, codigo FROM pairs",
    "mask_message": UP_TO_PAIRS + f"SELECT log_id, pos, {mask('trim(mensagem)')} AS mascara FROM pairs",
    "mask_raw_response": UP_TO_RAW + f"SELECT log_id, {mask('trim(des_resposta)')} AS mascara FROM raw",
    "classify_semantic": UP_TO_CLASSIFIED + """SELECT log_id, pos, categoria AS categoria_operacional, template AS tipo_rejeicao_semantica,
        CASE WHEN semantica = 19 THEN 'Mensagem não classificada: ' || limpa ELSE descricao END AS subtipo_rejeicao, sev AS severidade_semantica,
        orientacao AS orientacao_operacional, causa AS causa_raiz, CASE WHEN semantica = 19 THEN coalesce(nullif(codigo, ''), 'OUTROS') ELSE codigo_regra END AS codigo_oficial,
        template AS template_oficial, CASE WHEN semantica = 20 THEN '' ELSE mascara END AS mensagem_normalizada FROM classified""",
    "contextual_result": UP_TO_CLASSIFIED + "SELECT log_id, pos, CASE contexto "
        + " ".join(f"WHEN {i} THEN {lit(r.outcome)}" for i, r in enumerate(rules.CONTEXT_RULES)) + " END AS resultado, CASE contexto "
        + " ".join(f"WHEN {i} THEN {lit(r.technical_type)}" for i, r in enumerate(rules.CONTEXT_RULES)) + " END AS tipo_erro, CASE contexto "
        + " ".join(f"WHEN {i} THEN {lit(r.severity)}" for i, r in enumerate(rules.CONTEXT_RULES)) + " END AS severidade FROM classified",
    "success_flag": UP_TO_CLASSIFIED + f"""SELECT log_id, pos, coalesce(mensagem, '') <> '' AND NOT {words('trim(lower(mensagem))', rules.NEGATIONS)}
        AND (codigo IN ('100', '110', '111', '200') OR {success_sql('trim(lower(mensagem))')}) AS sucesso FROM classified""",
    "operational_result": UP_TO_CLASSIFIED + "SELECT log_id, pos, resultado AS resultado_operacional, tipo_erro AS tipo_erro_tecnico, severidade FROM classified",
    "severity_norm": UP_TO_CLASSIFIED + """SELECT log_id, pos, CASE sev WHEN 'CRITICA' THEN 'CRITICO' WHEN 'ALTA' THEN 'ALTO' WHEN 'MEDIA' THEN 'MEDIO'
        WHEN 'BAIXA' THEN 'BAIXO' ELSE 'MEDIO' END AS severidade FROM classified""",
    "category_lookups": UP_TO_FACT + "SELECT rejeicao_id, CASE categoria_operacional "
        + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.SEVERITY_BY_CATEGORY.items()) + " ELSE 'MEDIA' END AS severidade_categoria, CASE categoria_operacional "
        + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.GUIDANCE_BY_CATEGORY.items()) + f" ELSE {lit(rules.DEFAULT_GUIDANCE)} END AS orientacao_categoria FROM fact",
    "worst_result": UP_TO_FACT + "SELECT log_id, resultado_operacional FROM dim_log",
    "dim_log": UP_TO_FACT + "SELECT log_id, protocolo, data_evento, contratante, funcionalidade, status_geral, resultado_operacional FROM dim_log",
    "rejections": UP_TO_FACT + f"SELECT {FACT} FROM fact",
    "entities_all": UP_TO_ENTITIES + "SELECT entidade_id, rejeicao_id, entidade_tipo, entidade_valor FROM ent",
    **{f"entities_{e.kind.lower()}": UP_TO_ENTITIES + f"SELECT rejeicao_id, entidade_valor FROM ent WHERE entidade_tipo = '{e.kind}'" for e in rules.ENTITY_RULES},
}
