"""DuckDB SQL of the ingest, of wide logs and of one case per rule, with the expected labels stated."""

from __future__ import annotations

from oracles.prelude import UP_TO_ENTITIES, UP_TO_RAW, lit
from oracles.reports import DETAIL, SEARCH, VIEWS, report_sql

# Expected (result, technical type, rejection type, severity) of each case.
EXPECTED = (
    ("SUCESSO", None, "SUCESSO_INSERCAO", "INFO"),
    ("SUCESSO", None, "SUCESSO_GERACAO", "INFO"),
    ("REJEICAO_NEGOCIO", None, "TRANSPORTADOR_NAO_ENCONTRADO", "ALTO"),
    ("REJEICAO_NEGOCIO", None, "PAGAMENTO_TAC_NAO_PERMITIDO", "ALTO"),
    ("REJEICAO_NEGOCIO", None, "CAMPO_INVALIDO", "MEDIO"),
    ("REJEICAO_NEGOCIO", None, "TRANSPORTADOR_NAO_ENCONTRADO", "ALTO"),
    ("REJEICAO_NEGOCIO", None, "DATA_INFERIOR_ATUAL", "MEDIO"),
    ("REJEICAO_NEGOCIO", None, "LOCALIZACAO_ORIGEM_INVALIDA", "MEDIO"),
    ("REJEICAO_NEGOCIO", None, "MUNICIPIO_DESTINO_INVALIDO", "MEDIO"),
    ("REJEICAO_NEGOCIO", None, "QUANTIDADE_EIXOS_INVALIDA", "ALTO"),
    ("REJEICAO_NEGOCIO", None, "NATUREZA_CARGA_INEXISTENTE", "MEDIO"),
    ("REJEICAO_NEGOCIO", None, "PLACA_SEM_VINCULO_RNTRC", "ALTO"),
    ("SUCESSO_COM_ALERTA", None, "OPERACAO_JA_CADASTRADA", "INFO"),
    ("REJEICAO_NEGOCIO", None, "OPERACAO_JA_CANCELADA", "MEDIO"),
    ("REJEICAO_NEGOCIO", None, "DATA_INFERIOR_DECLARACAO", "MEDIO"),
    ("REJEICAO_NEGOCIO", None, "INTERVALO_SUPERIOR_90_DIAS", "MEDIO"),
    ("REJEICAO_NEGOCIO", None, "FORA_INTERVALO_TOLERANCIA", "MEDIO"),
    ("ERRO_INFRAESTRUTURA", "CONEXAO", "ERRO_SISTEMA_RNTRC", "CRITICO"),
    ("ERRO_TECNICO", "PARSE", "ERRO_SERIALIZACAO_OBJETO", "CRITICO"),
    ("SUCESSO_COM_ALERTA", None, "OUTROS_NAO_CATEGORIZADO", "INFO"),
    ("SUCESSO", None, "OUTROS_NAO_CATEGORIZADO", "INFO"),
    ("ERRO_INFRAESTRUTURA", "TIMEOUT", "OUTROS_NAO_CATEGORIZADO", "CRITICO"),
    ("ERRO_INFRAESTRUTURA", "TIMEOUT", "OUTROS_NAO_CATEGORIZADO", "CRITICO"),
    ("ERRO_INFRAESTRUTURA", "SSL", "OUTROS_NAO_CATEGORIZADO", "CRITICO"),
    ("ERRO_TECNICO", "AUTH", "OUTROS_NAO_CATEGORIZADO", "CRITICO"),
    ("ERRO_INFRAESTRUTURA", "CONEXAO", "OUTROS_NAO_CATEGORIZADO", "CRITICO"),
    ("ERRO_INFRAESTRUTURA", "RATE_LIMIT", "OUTROS_NAO_CATEGORIZADO", "ALTO"),
    ("ERRO_TECNICO", "PARSE", "OUTROS_NAO_CATEGORIZADO", "CRITICO"),
    ("ERRO_TECNICO", "SOAP_FAULT", "OUTROS_NAO_CATEGORIZADO", "CRITICO"),
)
_LABELS = ", ".join(f"({i}, {', '.join(lit(v) for v in row)})" for i, row in enumerate(EXPECTED))

# Line number of every event in its file: the header, and of the events before it their own lines.
LINES = """placed AS (SELECT event_id, event_id // 4000 AS arquivo, event_id % 24 = 0 AS dobrada, event_id % 101 = 0 AS quebrada,
    1 + coalesce(sum(1 + (event_id % 24 = 0)::INT + (event_id % 101 = 0)::INT) OVER (PARTITION BY event_id // 4000 ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS linha FROM events)"""
_WIDE = """(SELECT 'log_' || event_id || '_rej_' || (i - 1) AS rejeicao_id, '209' AS codigo, 'LOCALIZACAO_ORIGEM_INVALIDA' AS tipo,
    'O CEP 01001-' || lpad(i::VARCHAR, 3, '0') || ' ainda não está cadastrado.' AS mensagem FROM events, range(1, 31) r(i) WHERE event_id % 3 = 0
  UNION ALL SELECT 'log_' || event_id || '_rej_0', '', 'LOCALIZACAO_ORIGEM_INVALIDA',
    'CEP inexistente: ' || array_to_string(list_transform(range(1, 26), lambda i: '02000-' || lpad(i::VARCHAR, 3, '0')), ' ') FROM events WHERE event_id % 3 = 1
  UNION ALL SELECT 'log_' || event_id || '_rej_0', '', 'PLACA_SEM_VINCULO_RNTRC', repeat('x ', 2600) || 'A placa ABC1D23 não pertence ao RNTRC 12345678.'
    FROM events WHERE event_id % 3 = 2)"""
EXPORT = """SELECT protocolo, strftime(data, '%Y-%m-%d %H:%M:%S') AS data, contratante, coalesce(tipo_rejeicao_semantica, '') AS tipo_rejeicao_semantica,
    mensagem_original, mensagem_normalizada, severidade_operacional, codigo_antt, coalesce(entidades_extraidas, '') AS entidades_extraidas FROM ({rows})"""

# Keys come from the files, whose dates hold seconds.
INDEXED = "SELECT * EXCLUDE (hash_evento) REPLACE (date_trunc('second', data) AS data) FROM ({rows})"
NUMBERED = """(SELECT *, n // 50 + 1 AS pagina, (total + 49) // 50 AS paginas FROM
    (SELECT *, row_number() OVER (ORDER BY data_evento DESC, log_id, rejeicao_id NULLS LAST) - 1 AS n, count(*) OVER () AS total FROM pl))"""
UNDER_TEXTS = "status_geral = 'ERRO' AND protocolo LIKE '%0_12%' AND log_id IN (SELECT log_id FROM fact WHERE mensagem ILIKE '%placa%RNTRC%')"

CASES = {
    "rule_labels": f"""SELECT 'log_' || event_id AS log_id, resultado, tipo_erro, tipo, severidade
        FROM events JOIN (VALUES {_LABELS}) v(k, resultado, tipo_erro, tipo, severidade) ON event_id % {len(EXPECTED)} = k""",
    "wide_rejections": f"SELECT rejeicao_id, codigo AS codigo_antt, tipo AS tipo_rejeicao_semantica, length(mensagem)::BIGINT AS tamanho, md5(mensagem) AS resumo FROM {_WIDE}",
    "wide_entities": f"""SELECT rejeicao_id, 'CEP' AS entidade_tipo, substr(mensagem, 7, 9) AS entidade_valor FROM {_WIDE} WHERE mensagem LIKE 'O CEP%'
        UNION ALL SELECT 'log_' || event_id || '_rej_0', 'CEP', '02000-' || lpad(i::VARCHAR, 3, '0') FROM events, range(1, 26) r(i) WHERE event_id % 3 = 1
        UNION ALL SELECT 'log_' || event_id || '_rej_0', t, v FROM events, (VALUES ('PLACA', 'ABC1D23'), ('RNTRC', '12345678'), ('CEP', '12345678')) e(t, v) WHERE event_id % 3 = 2""",
    "ingest_summary": UP_TO_ENTITIES + """SELECT 'processed' AS status, (SELECT count(*) FROM dim_log) AS total_logs, (SELECT count(DISTINCT protocolo) FROM dim_log) AS unique_protocols,
        (SELECT count(*) FROM fact) AS total_rejeicoes, (SELECT count(*) FROM ent) AS total_entidades,
        (SELECT count(*) FROM events WHERE event_id % 101 = 0) AS linhas_rejeitadas, 1::BIGINT AS arquivos_recusados""",
    "ingest_again": UP_TO_RAW + """SELECT 'cached' AS status, count(*) AS total_logs, count(DISTINCT cod_protocolo) AS unique_protocols, 0::BIGINT AS linhas_rejeitadas,
        1::BIGINT AS arquivos_recusados FROM raw""",
    "ingest_rows": UP_TO_ENTITIES.rstrip() + """ SELECT protocolo, date_trunc('second', data_evento) AS data_evento, contratante, funcionalidade, status_geral, resultado_operacional FROM dim_log""",
    "ingest_rejects": f"""WITH {LINES} SELECT linha + 1 + dobrada::INT AS linha, 'linha' || CASE WHEN arquivo % 2 = 1 THEN ',' ELSE ';' END || 'quebrada ' || event_id AS texto
        FROM placed WHERE quebrada""",
    "row_keys": f"WITH {LINES} SELECT 'PROT' || lpad(event_id::VARCHAR, 8, '0') AS protocolo, linha FROM placed",
    "file_dialects": """SELECT arquivo, CASE WHEN arquivo % 2 = 1 THEN ',' ELSE ';' END AS separador, CASE WHEN (arquivo + 3) % 3 = 2 AND arquivo >= 0 THEN 'ISO-8859-1' ELSE 'UTF-8' END AS codificacao,
        arquivo >= 0 AS aspas_abertas, arquivo < 0 AS recusado FROM (SELECT DISTINCT event_id // 4000 AS arquivo FROM events UNION ALL SELECT -1)""",
    "file_views": UP_TO_ENTITIES.rstrip() + """ SELECT protocolo, status_geral, (SELECT count(*) FROM fact f WHERE f.log_id = d.log_id) AS rejeicoes
        FROM dim_log d WHERE substr(log_id, 5)::BIGINT < 4000""",
    "lake_period": UP_TO_ENTITIES.rstrip() + """ SELECT protocolo, status_geral FROM dim_log
        WHERE date_trunc('second', data_evento) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 23:59:59'""",
    "text_search_indexed": INDEXED.format(rows=report_sql("text_search")),
    "text_search_message_indexed": INDEXED.format(rows=report_sql("text_search_message")),
    "filter_combined_indexed": INDEXED.format(
        rows=VIEWS.replace("{where}", UNDER_TEXTS).rstrip() + f" {DETAIL} WHERE {SEARCH.format('ABC-0')}"),
    "detail_page_at": VIEWS.replace("{where}", "1 = 1").rstrip()
        + f" {DETAIL.removesuffix('FROM pl')}, pagina FROM {NUMBERED} pl WHERE pagina IN (1, (paginas + 1) // 2, paginas)",
    "export_quoted": EXPORT.format(rows=report_sql("export_rows")),
    "export_plain": EXPORT.format(rows=report_sql("export_rows")),
}
