"""DuckDB SQL for the three tables, derived from ``events``.

Written against the rule tables, not against the Spark expressions: no guards, no staging, the
patterns run one by one on the raw and on the masked message.
"""

from __future__ import annotations

from returnlens.functions import rules
from returnlens.plans.demo import FUNCTIONALITY, RETURNS


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def hits(column: str, patterns, flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {lit(flags + p)})" for p in patterns) + ")"


def words(column: str, items) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in items) + ")"


def mask(column: str) -> str:
    steps = [*rules.MASK_OBJECTS, *rules.MASK_PREFIX, *rules.MASK_NUMBERS, *rules.MASK_PROTOCOL, *rules.MASK_AMOUNTS, *rules.MASK_LISTS]
    for pattern, replacement in steps:
        column = f"regexp_replace({column}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def _response(template: str) -> str:
    sql = lit(template)
    for name in ("placa", "rntrc", "cep", "cpf"):
        if f"<{name}>" in template:
            sql = f"replace({sql}, '<{name}>', {name})"
    return sql


RAW = f"""raw AS (
  SELECT 'log_' || event_id AS log_id, event_id, 'PROT' || lpad(event_id::VARCHAR, 8, '0') AS cod_protocolo,
    ts AS data_evento, 'CLI' || (user_id % 40) AS contratante,
    CASE event_type {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in FUNCTIONALITY.items())} END AS funcionalidade,
    CASE event_id % 24 {' '.join(f"WHEN {i} THEN {lit(c)}" for i, (c, _) in enumerate(RETURNS))} END AS cod_mensagem,
    CASE event_id % 24 {' '.join(f"WHEN {i} THEN {_response(t)}" for i, (_, t) in enumerate(RETURNS))} END AS des_resposta
  FROM (SELECT *, 'ABC-' || lpad((event_id % 500)::VARCHAR, 4, '0') AS placa,
          (12000000 + event_id % 700)::VARCHAR AS rntrc,
          (10000 + event_id % 80000)::VARCHAR || '-' || lpad((event_id % 1000)::VARCHAR, 3, '0') AS cep,
          lpad((event_id % 1000)::VARCHAR, 3, '0') || '.222.333-44' AS cpf FROM events))"""

PARSED = """docs AS (
  SELECT *, CASE WHEN starts_with(des_resposta, '{') AND json_valid(des_resposta) THEN des_resposta
                 WHEN starts_with(cod_mensagem, '{') AND json_valid(cod_mensagem) THEN cod_mensagem END AS doc FROM raw),
parsed AS (
  SELECT *, CASE WHEN len(c) = 0 THEN [''] ELSE c END AS codes, CASE WHEN len(m) = 0 THEN [''] ELSE m END AS msgs
  FROM (SELECT *,
    list_filter(list_transform(CASE WHEN doc IS NULL THEN string_split(cod_mensagem, ',')
      ELSE string_split(json_extract_string(doc, '$.Codigo'), ',') END, lambda x: trim(x)), lambda x: x <> '') AS c,
    CASE WHEN doc IS NULL THEN [trim(des_resposta)]
         WHEN json_type(doc, '$.Mensagem') = 'ARRAY' THEN list_transform(json_extract_string(doc, '$.Mensagem[*]'), lambda x: trim(x))
         ELSE [trim(json_extract_string(doc, '$.Mensagem'))] END AS m FROM docs))"""


def _peel(value: str, brackets: bool) -> str:
    bracket = "(starts_with(a, '[') AND ends_with(a, ']')) OR " if brackets else ""
    quotes = "(starts_with(a, '\"') AND ends_with(a, '\"')) OR (starts_with(a, '''') AND ends_with(a, ''''))"
    return (f"list_reduce(list_prepend({value}, list_transform(range(16), lambda k: '')), lambda a, b: "
            f"CASE WHEN {bracket}{quotes} THEN trim(substring(a, 2, greatest(length(a) - 2, 0))) ELSE a END)")


PAIRS = f"""indexed AS (
  SELECT *, unnest(range(1, len(msgs) + 1)) AS i FROM parsed),
messages AS (
  SELECT *, coalesce(codes[i], codes[1]) AS codigo, msgs[i] AS msg FROM indexed),
singles AS (
  SELECT *, CASE WHEN msg = '' THEN [''] ELSE list_filter(list_transform(regexp_split_to_array(
      {_peel("trim(replace(msg, chr(92) || '\"', '\"'))", True)}, '["'']\\s*,\\s*["'']'),
      lambda p: {_peel('trim(p)', False)}), lambda p: p <> '') END AS parts FROM messages),
pairs AS (
  SELECT log_id, event_id, funcionalidade, codigo, parts[j] AS mensagem,
    row_number() OVER (PARTITION BY log_id ORDER BY i, j) - 1 AS pos
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM singles))"""


def _semantic_case() -> str:
    sql = "CASE WHEN limpa IN ('', 'None', 'nan') THEN 20"
    for i, rule in enumerate(rules.SEMANTIC_RULES):
        sql += f" WHEN {hits('limpa', rule.patterns)} OR {hits('mascara', rule.patterns)} THEN {i}"
    for i, rule in enumerate(rules.SEMANTIC_RULES):
        if rule.code is None:
            continue
        if rule.code == "210":
            axle = words("lower(limpa)", ("eixo", "veiculo", "veículo"))
            sql += f" WHEN codigo = '210' AND {axle if rule.category == 'EIXOS' else f'NOT {axle}'} THEN {i}"
        else:
            sql += f" WHEN codigo = {lit(rule.code)} THEN {i}"
    return sql + " ELSE 19 END"


def _context_case() -> str:
    sql = "CASE"
    for i, rule in enumerate(rules.CONTEXT_RULES):
        sql += (f" WHEN {hits('funcionalidade', rule.functionalities, '(?i)^')} AND {hits('codigo', rule.codes, '(?i)^')}"
                f" AND {hits('limpa', rule.patterns)}{' AND NOT negada' if rule.outcome == 'SUCESSO' else ''} THEN {i}")
    return sql + " END"


def _normal(severity: str) -> str:
    return {"CRITICA": "CRITICO", "ALTA": "ALTO", "MEDIA": "MEDIO", "BAIXA": "BAIXO"}[severity]


def _label_values() -> str:
    rows = []
    for i, r in enumerate(rules.SEMANTIC_RULES):
        severity = r.severity or rules.SEVERITY_BY_CATEGORY[r.category]
        rows.append(f"({i}, {lits((r.category, r.template, r.description, severity, _normal(severity), r.guidance or rules.GUIDANCE_BY_CATEGORY[r.category], r.cause or r.category))}, {lit(r.code)})")
    other = "OUTROS_NAO_CATEGORIZADO"
    rows.append(f"(19, '{other}', '{other}', NULL, 'MEDIA', 'MEDIO', {lit(rules.GUIDANCE_BY_CATEGORY[other])}, '{other}', NULL)")
    rows.append(f"(20, '{other}', '{other}', 'Erro de sistema ou resposta vazia.', 'CRITICA', 'CRITICO', {lit(rules.GUIDANCE_BY_CATEGORY['SISTEMA'])}, '{other}', 'OUTROS')")
    return ", ".join(rows)


def success_sql(low: str) -> str:
    return (f"(({words(low, ('localizado', 'encontrado', 'existente', 'ativo'))} AND "
            f"{words('lower(funcionalidade)', ('consultar', 'pesquisar', 'obter', 'query', 'get', 'retornar'))}) OR "
            f"{hits(low, rules.SUCCESS_PATTERNS)})")


def _outcome_case() -> str:
    """Outcome as 'resultado/tipo/severidade'; an empty severity is the rule's own."""
    sql = "CASE WHEN codigo = '500' OR contains(baixa, '500 internal server error') OR contains(baixa, 'http 500') THEN 'ERRO_TECNICO/HTTP_500/CRITICO'"
    for i, r in enumerate(rules.CONTEXT_RULES):
        if r.outcome in ("ERRO_TECNICO", "ERRO_INFRAESTRUTURA"):
            sql += f" WHEN contexto = {i} THEN '{r.outcome}/{r.technical_type}/{r.severity}'"
    for g in rules.KEYWORD_GROUPS:
        java = f" OR {hits('limpa', (rules.JAVA_OBJECT,))}" if g.technical_type == "PARSE" else ""
        sql += f" WHEN {words('baixa', g.keywords)}{java} THEN '{g.outcome}/{g.technical_type}/{g.severity}'"
    return sql + f""" WHEN categoria IN ('INTEGRAÇÃO', 'INTEGRACAO') THEN 'ERRO_INFRAESTRUTURA/CONEXAO/CRITICO'
      WHEN codigo IN ('100', '110', '111', '200') THEN 'SUCESSO//INFO'
      WHEN NOT negada AND ((limpa <> '' AND {success_sql('baixa')}) OR coalesce(contexto, -1) = 1 OR categoria = 'SUCESSO') THEN 'SUCESSO//INFO'
      WHEN contexto = 0 THEN 'SUCESSO_COM_ALERTA//INFO'
      WHEN template <> 'OUTROS_NAO_CATEGORIZADO' THEN 'REJEICAO_NEGOCIO//'
      WHEN regexp_full_match(codigo, '2[0-9]*') OR NOT negada THEN 'REJEICAO_NEGOCIO//MEDIO'
      ELSE 'ERRO_TECNICO/PARSE/MEDIO' END"""


CLASSIFIED = f"""rotulos(ix, categoria, template, descricao, sev, sev_norm, orientacao, causa, codigo_regra) AS (VALUES {_label_values()}),
prepared AS (
  SELECT *, lower(limpa) AS baixa, {words('lower(limpa)', rules.NEGATIONS)} AS negada, {mask('limpa')} AS mascara
  FROM (SELECT *, trim(mensagem) AS limpa FROM pairs)),
positions AS (
  SELECT *, {_semantic_case()} AS semantica, {_context_case()} AS contexto FROM prepared),
outcomes AS (
  SELECT p.*, l.*, string_split({_outcome_case()}, '/') AS o FROM positions p JOIN rotulos l ON l.ix = p.semantica),
classified AS (
  SELECT *, o[1] AS resultado, nullif(o[2], '') AS tipo_erro, coalesce(nullif(o[3], ''), sev_norm) AS severidade FROM outcomes)"""

TABLES = """worst AS (
  SELECT log_id, max(CASE resultado WHEN 'ERRO_INFRAESTRUTURA' THEN 5 WHEN 'ERRO_TECNICO' THEN 4 WHEN 'REJEICAO_NEGOCIO' THEN 3
    WHEN 'ALERTA_OPERACIONAL' THEN 2 WHEN 'SUCESSO_COM_ALERTA' THEN 1 ELSE 0 END) AS w FROM classified GROUP BY 1),
dim_log AS (
  SELECT r.log_id, r.cod_protocolo AS protocolo, r.data_evento, r.contratante, r.funcionalidade,
    CASE WHEN coalesce(w, 0) <= 1 THEN 'SUCESSO' ELSE 'ERRO' END AS status_geral,
    CASE coalesce(w, 0) WHEN 5 THEN 'ERRO_INFRAESTRUTURA' WHEN 4 THEN 'ERRO_TECNICO' WHEN 3 THEN 'REJEICAO_NEGOCIO'
      WHEN 2 THEN 'ALERTA_OPERACIONAL' WHEN 1 THEN 'SUCESSO_COM_ALERTA' ELSE 'SUCESSO' END AS resultado_operacional
  FROM raw r LEFT JOIN worst USING (log_id)),
kept AS (
  SELECT * FROM classified WHERE resultado IN ('REJEICAO_NEGOCIO', 'ERRO_TECNICO', 'ERRO_INFRAESTRUTURA')),
fact AS (
  SELECT log_id || '_rej_' || pos AS rejeicao_id, log_id, codigo AS codigo_antt,
    CASE WHEN tec THEN 'INTEGRAÇÃO' ELSE categoria END AS categoria_operacional,
    CASE WHEN tec THEN NULL ELSE template END AS tipo_rejeicao_semantica,
    CASE WHEN tec THEN 'Erro técnico: ' || coalesce(tipo_erro, 'None')
         WHEN semantica = 19 THEN 'Mensagem não classificada: ' || limpa ELSE descricao END AS subtipo_rejeicao,
    CASE WHEN tec THEN 'INTEGRAÇÃO' ELSE categoria END AS categoria, severidade,
    CASE WHEN tec THEN 'INTEGRAÇÃO' ELSE causa END AS causa_raiz,
    CASE WHEN tec THEN 'Erro técnico detectado (' || coalesce(tipo_erro, 'None') || '). Contatar suporte.' ELSE orientacao END AS orientacao_operacional,
    mensagem, mensagem AS mensagem_original, CASE WHEN semantica = 20 THEN '' ELSE mascara END AS mensagem_normalizada,
    CASE WHEN tec THEN NULL ELSE template END AS template_oficial, resultado AS resultado_operacional, tipo_erro AS tipo_erro_tecnico
  FROM (SELECT *, resultado IN ('ERRO_TECNICO', 'ERRO_INFRAESTRUTURA') AND semantica >= 19 AS tec FROM kept))"""

# Entity kinds, their pattern, and what to do with the whole match.
_ENTITY = {
    "CEP": (r"\b\d{5}-\d{3}\b|\b\d{8}\b", "v"),
    "PLACA": (r"\b[A-Za-z]{3}[- ]?[0-9][A-Za-z0-9][0-9]{2}\b", "regexp_replace(upper(v), '[- ]', '', 'g')"),
    "RNTRC": (r"(?i)rntrc\s*:?\s*\b(\d{8,12})\b", r"regexp_replace(v, '(?i)rntrc\s*:?\s*', '', 'g')"),
    "CPF": (r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|\b\d{11}\b", "v"),
    "CNPJ": (r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b|\b\d{14}\b", "v"),
    "CIOT": (r"(?i)ciot\s*:?\s*\b(\d{12,16})\b", r"regexp_replace(v, '(?i)ciot\s*:?\s*', '', 'g')"),
    "EIXOS": (r"\b(\d+)\s*(?:eixo|eixos)\b", r"regexp_replace(v, '(?i)\s*eixos?', '', 'g')"),
    "MUNICIPIO": (r"(?i)munic(?:i|í)pio\s*:?\s*\b(\d{7})\b", r"regexp_replace(v, '(?i)munic(?:i|í)pio\s*:?\s*', '', 'g')"),
}
_FOUND = " UNION ALL ".join(
    f"SELECT rejeicao_id, '{kind}' AS entidade_tipo, unnest(regexp_extract_all(mensagem, {lit(pattern)})) AS v,"
    f" generate_subscripts(regexp_extract_all(mensagem, {lit(pattern)}), 1) AS n FROM fact"
    for kind, (pattern, _) in _ENTITY.items()
)
_CLEAN = "CASE entidade_tipo " + " ".join(f"WHEN '{k}' THEN {e}" for k, (_, e) in _ENTITY.items()) + " END"
ENTITIES = f"""found AS ({_FOUND}),
firsts AS (SELECT rejeicao_id, entidade_tipo, entidade_valor, min(n) AS n FROM
  (SELECT *, {_CLEAN} AS entidade_valor FROM found) GROUP BY 1, 2, 3),
ent AS (SELECT rejeicao_id || '_ent_' || entidade_tipo || '_' || (k - 1) AS entidade_id, rejeicao_id, entidade_tipo, entidade_valor
  FROM (SELECT *, row_number() OVER (PARTITION BY rejeicao_id, entidade_tipo ORDER BY n) AS k FROM firsts))"""

UP_TO_RAW = f"WITH {RAW}\n"
UP_TO_PARSED = f"WITH {RAW},\n{PARSED}\n"
UP_TO_PAIRS = f"WITH {RAW},\n{PARSED},\n{PAIRS}\n"
UP_TO_CLASSIFIED = f"WITH {RAW},\n{PARSED},\n{PAIRS},\n{CLASSIFIED}\n"
UP_TO_FACT = f"WITH {RAW},\n{PARSED},\n{PAIRS},\n{CLASSIFIED},\n{TABLES}\n"
UP_TO_ENTITIES = f"WITH {RAW},\n{PARSED},\n{PAIRS},\n{CLASSIFIED},\n{TABLES},\n{ENTITIES}\n"
