"""Rule tables of the return classification.

Everything in this module is a fixed value: codes, labels, texts and patterns decide the
results, so they are stated literally and in evaluation order. The logic that applies them is
in ``classify.py``, ``text.py`` and ``entities.py``.
"""

from __future__ import annotations

from typing import NamedTuple

RULES_VERSION = "1"


class SemanticRule(NamedTuple):
    code: str | None
    category: str
    template: str
    description: str
    patterns: tuple[str, ...]
    cause: str | None = None
    guidance: str | None = None
    severity: str | None = None


class ContextRule(NamedTuple):
    functionalities: tuple[str, ...]
    codes: tuple[str, ...]
    patterns: tuple[str, ...]
    outcome: str
    technical_type: str | None
    severity: str


class KeywordGroup(NamedTuple):
    keywords: tuple[str, ...]
    outcome: str
    technical_type: str
    severity: str


class EntityRule(NamedTuple):
    kind: str
    pattern: str
    strip: str | None = None
    upper: bool = False


JAVA_OBJECT = r"br\.com\.[\w\.]+\@[a-fA-F0-9]+"

# Semantic rules, first match wins.
SEMANTIC_RULES = (
    SemanticRule("110", "SUCESSO", "SUCESSO_INSERCAO", "Dados inseridos com sucesso", (
        r"(?i)dados.*sucesso",
        r"(?i)sucesso.*inserido",
    )),
    SemanticRule("111", "SUCESSO", "SUCESSO_GERACAO",
                 "Consulta realizada com sucesso. CIOT gerado com sucesso.", (
        r"(?i)consulta.*sucesso",
        r"(?i)ciot.*gerado.*sucesso",
    )),
    SemanticRule("203", "TRANSPORTADOR", "TRANSPORTADOR_NAO_ENCONTRADO",
                 "Transportador não encontrado ou RNTRC inexistente/inativo", (
        r"(?i)transportador.*n(?:ao|ã)o.*encontrado",
        r"(?i)rntrc.*inexistente",
        r"(?i)rntrc.*inativo",
        r"(?i)transportador.*n(?:ao|ã)o.*cadastrado",
        r"(?i)cpf.*cnpj.*transportador.*n(?:ao|ã)o.*encontrado",
        r"(?i)transportador.*n(?:ao|ã)o.*localizado",
        r"(?i)transportador.*incompat(?:i|í)vel",
        r"(?i)transportador.*sem.*v(?:i|í)nculo.*antt",
    )),
    SemanticRule("204", "PAGAMENTO", "PAGAMENTO_TAC_NAO_PERMITIDO",
                 "Não é permitido o tipo de pagamento informado para transportador TAC ou equiparado", (
        r"(?i)n(?:ao|ã)o.*permitido.*tipo.*pagamento",
        r"(?i)pagamento.*tac",
        r"(?i)pagamento.*equiparado",
        r"(?i)dados.*pagamento.*inv(?:a|á)lido",
        r"(?i)modalidade.*pagamento",
        r"(?i)pagamento.*incompat(?:i|í)vel",
    )),
    SemanticRule("205", "VALIDAÇÃO", "CAMPO_INVALIDO", "O campo <nome do campo> é inválido", (
        r"(?i)o.*campo.*(e|é).*inv(?:a|á)lido",
        r"(?i)campo.*inv(?:a|á)lido",
    )),
    SemanticRule("207", "TRANSPORTADOR", "TRANSPORTADOR_NAO_ENCONTRADO",
                 "Não foi encontrado transportador contratado com CPF/CNPJ {0} e RNTRC {1}", (
        r"(?i)n(?:ao|ã)o.*encontrado.*transportador.*contratado",
        r"(?i)transportador.*contratado.*cpf.*cnpj.*rntrc",
    )),
    SemanticRule("208", "DATA", "DATA_INFERIOR_ATUAL",
                 "A data de início da viagem não pode ser inferior à data atual", (
        r"(?i)data.*in(?:i|í)cio.*viagem.*inferior.*data.*atual",
        r"(?i)data.*in(?:i|í)cio.*viagem.*inferior.*atual",
        r"(?i)data.*inferior.*data.*atual",
    )),
    SemanticRule("209", "LOCALIZAÇÃO", "LOCALIZACAO_ORIGEM_INVALIDA", "Município/CEP origem inválido", (
        r"(?i)cep.*origem.*inv(?:a|á)lido",
        r"(?i)cep.*origem.*n(?:ao|ã)o.*cadastrado",
        r"(?i)cep.*n(?:ao|ã)o.*cadastrado",
        r"(?i)cep.*inexistente",
        r"(?i)munic(?:i|í)pio.*origem.*inv",
        r"(?i)ibge.*origem",
        r"(?i)c(?:o|ó)digo.*ibge.*munic(?:i|í)pio.*origem",
    )),
    SemanticRule("210", "LOCALIZAÇÃO", "MUNICIPIO_DESTINO_INVALIDO", "Município destino inválido", (
        r"(?i)munic(?:i|í)pio.*destino.*inv",
        r"(?i)ibge.*destino",
        r"(?i)c(?:o|ó)digo.*ibge.*munic(?:i|í)pio.*destino",
        r"(?i)munic(?:i|í)pio.*destino.*n(?:ao|ã)o.*existe",
        r"(?i)cep.*destino.*n(?:ao|ã)o.*cadastrado",
    )),
    SemanticRule("210", "EIXOS", "QUANTIDADE_EIXOS_INVALIDA",
                 "Quantidade de eixos inválida para o tipo de veículo informado", (
        r"(?i)quantidade.*eixos",
        r"(?i)eixo.*inv(?:a|á)lido",
        r"(?i)eixos.*incompat(?:i|í)vel",
    )),
    SemanticRule("211", "CARGA", "NATUREZA_CARGA_INEXISTENTE",
                 "O código da natureza da carga informado não existe", (
        r"(?i)natureza.*carga.*inv(?:a|á)lid",
        r"(?i)natureza.*carga.*n(?:ao|ã)o.*exist",
        r"(?i)c(?:o|ó)digo.*natureza.*carga",
    )),
    SemanticRule("217", "PLACA", "PLACA_SEM_VINCULO_RNTRC",
                 "A placa {0} não pertence ao transportador de RNTRC {1}, ou o mesmo não está ativo", (
        r"(?i)placa.*n(?:ao|ã)o.*pertence.*rntrc",
        r"(?i)placa.*sem.*v(?:i|í)nculo.*rntrc",
        r"(?i)placa.*n(?:ao|ã)o.*associada.*rntrc",
    )),
    SemanticRule("219", "CIOT", "OPERACAO_JA_CADASTRADA",
                 "Código de identificação da operação já cadastrado", (
        r"(?i)ciot.*duplicado",
        r"(?i)ciot.*j(?:a|á).*existente",
        r"(?i)ciot.*j(?:a|á).*cadastrado",
        r"(?i)contrato.*frete.*j(?:a|á).*cadastrado",
    )),
    SemanticRule("222", "CIOT", "OPERACAO_JA_CANCELADA", "Operação de Transporte já está cancelada", (
        r"(?i)operac(?:ao|ão).*cancelada",
        r"(?i)ciot.*cancelado",
        r"(?i)ciot.*encerrado",
        r"(?i)op.*transp.*cancelada",
    )),
    SemanticRule("225", "DATA", "DATA_INFERIOR_DECLARACAO",
                 "A data de início da viagem não pode ser inferior à data de declaração", (
        r"(?i)data.*in(?:i|í)cio.*viagem.*inferior.*data.*declara[cç]ao",
        r"(?i)data.*in(?:i|í)cio.*inferior.*declara[cç]ao",
        r"(?i)iniciomovi.*invalido",
    )),
    SemanticRule("234", "JANELA OPERACIONAL", "INTERVALO_SUPERIOR_90_DIAS",
                 "O intervalo entre a data de início e a data de fim da viagem não pode ser superior a 90 dias", (
        r"(?i)superior.*90.*dias",
        r"(?i)intervalo.*data.*in(?:i|í)cio.*data.*fim.*superior.*90",
    )),
    SemanticRule("269", "TOLERÂNCIA", "FORA_INTERVALO_TOLERANCIA",
                 "A data e hora da declaração está fora do intervalo de tolerância permitido para esta operação", (
        r"(?i)fora.*intervalo.*toler(?:a|â)ncia",
        r"(?i)toler(?:a|â)ncia.*op",
        r"(?i)fora.*toler(?:a|â)ncia",
    )),
    SemanticRule("500", "INTEGRAÇÃO", "ERRO_SISTEMA_RNTRC",
                 "Erro ao consultar dados da frota no sistema RNTRC", (
        r"(?i)erro.*consultar.*dados.*frota",
        r"(?i)erro.*sistema.*rntrc",
        r"(?i)500.*rntrc",
        r"(?i)comunica[cç]ao.*rntrc",
        r"(?i)comunica[cç]ao.*antt",
        r"(?i)comunica[cç]ao.*api",
        r"(?i)erro.*comunica[cç]ao",
    )),
    SemanticRule(None, "INTEGRACAO", "ERRO_SERIALIZACAO_OBJETO",
                 "Erro de serialização de objeto Java retornado pela API", (JAVA_OBJECT,),
                 cause="FALHA_SERIALIZACAO_RESPONSE",
                 guidance="Validar serialização do objeto retornado pela API e estrutura do response da integração.",
                 severity="CRITICA"),
)

# Words that choose the axle rule when code 210 is ambiguous.
AMBIGUOUS_CODE = "210"
AXLE_CATEGORY = "EIXOS"
AXLE_WORDS = ("eixo", "veiculo", "veículo")

# Labels of an unmatched and of an empty message.
UNCATEGORISED = "OUTROS_NAO_CATEGORIZADO"
UNCATEGORISED_CODE = "OUTROS"
UNCATEGORISED_PREFIX = "Mensagem não classificada: "
EMPTY_DESCRIPTION = "Erro de sistema ou resposta vazia."
EMPTY_GUIDANCE_CATEGORY = "SISTEMA"
EMPTY_SEVERITY = "CRITICA"
INTEGRATION_CATEGORIES = ("INTEGRAÇÃO", "INTEGRACAO", "SISTEMA")

# Corrective action per category.
GUIDANCE_BY_CATEGORY = {
    "SUCESSO": "Transação realizada com sucesso.",
    "TRANSPORTADOR": "Verificar a situação cadastral do RNTRC e do transportador na ANTT.",
    "PAGAMENTO": "Revisar as regras de pagamento para TAC/TAC-Equiparado (ex: pagamento eletrônico obrigatório).",
    "VALIDAÇÃO": "Revisar a estrutura e validação do campo rejeitado.",
    "DATA": "Corrigir a data/hora de início da viagem.",
    "LOCALIZAÇÃO": "Revisar código IBGE do município e a validade do CEP de origem/destino.",
    "EIXOS": "Verificar a quantidade de eixos informada contra o cadastro físico do veículo.",
    "CARGA": "Validar se o código da natureza da carga informado consta na tabela oficial da ANTT.",
    "PLACA": "Validar dados da placa e o seu vínculo cadastral com o RNTRC informado.",
    "CIOT": "Contrato de frete já possui CIOT ativo ou já foi cancelado na ANTT.",
    "JANELA OPERACIONAL": "Reduzir o intervalo entre a data de início e fim da viagem para menos de 90 dias.",
    "TOLERÂNCIA": "Ajustar a data de declaração dentro do limite de tolerância permitido.",
    "INTEGRAÇÃO": "Falha temporária de comunicação com o sistema RNTRC/ANTT. Reenviar após alguns instantes.",
    "INTEGRACAO": "Validar serialização do objeto retornado pela API e estrutura do response da integração.",
    "SISTEMA": "Erro de sistema interno. Contatar suporte técnico.",
    "NOVO_CODIGO_NAO_CLASSIFICADO": "Nova rejeição não classificada. Necessita revisão manual.",
    "OUTROS_NAO_CATEGORIZADO": "Nova rejeição não classificada. Necessita revisão manual.",
}
DEFAULT_GUIDANCE = "Revisar descrição de resposta e códigos do retorno do log operacional."

# Severity per category.
SEVERITY_BY_CATEGORY = {
    "SUCESSO": "BAIXA",
    "TRANSPORTADOR": "ALTA",
    "PAGAMENTO": "ALTA",
    "VALIDAÇÃO": "MEDIA",
    "DATA": "MEDIA",
    "LOCALIZAÇÃO": "MEDIA",
    "EIXOS": "ALTA",
    "CARGA": "MEDIA",
    "PLACA": "ALTA",
    "CIOT": "MEDIA",
    "JANELA OPERACIONAL": "MEDIA",
    "TOLERÂNCIA": "MEDIA",
    "INTEGRAÇÃO": "CRITICA",
    "INTEGRACAO": "CRITICA",
    "SISTEMA": "CRITICA",
    "NOVO_CODIGO_NAO_CLASSIFICADO": "MEDIA",
    "OUTROS_NAO_CATEGORIZADO": "MEDIA",
}
DEFAULT_SEVERITY = "MEDIA"

# Substring of a severity word -> normalised label, first hit wins.
SEVERITY_LABELS = (("CRITIC", "CRITICO"), ("ALT", "ALTO"), ("MED", "MEDIO"), ("BAIX", "BAIXO"), ("INFO", "INFO"))
DEFAULT_SEVERITY_LABEL = "MEDIO"

ANY = (".*",)

# Contextual rules (functionality and code by prefix, message anywhere), first match wins.
CONTEXT_RULES = (
    ContextRule(ANY, ANY, (
        r"(?i)j(?:a|á).*cadastrado",
        r"(?i)j(?:a|á).*existente",
        r"(?i)j(?:a|á).*processado",
        r"(?i)j(?:a|á).*encerrado",
        r"(?i)j(?:a|á).*associado",
        r"(?i)j(?:a|á).*concluido",
        r"(?i)j(?:a|á).*efetivado",
        r"(?i)previamente.*concluido",
        r"(?i)previamente.*realizado",
        r"(?i)duplicado",
    ), "SUCESSO_COM_ALERTA", None, "INFO"),
    ContextRule(
        (".*consultar.*", ".*pesquisar.*", ".*obter.*", ".*query.*", ".*get.*", ".*retornar.*"), ANY, (
            r"(?i)localizado",
            r"(?i)encontrado",
            r"(?i)ativo",
            r"(?i)existente",
        ), "SUCESSO", None, "INFO"),
    ContextRule(ANY, ("503", "502", "504"), ANY, "ERRO_INFRAESTRUTURA", "TIMEOUT", "CRITICO"),
    ContextRule(ANY, ANY, (
        r"(?i)timeout",
        r"(?i)timed.*out",
        r"(?i)tempo.*limite.*esgotado",
        r"(?i)requisic(?:ao|ão).*expirada",
    ), "ERRO_INFRAESTRUTURA", "TIMEOUT", "CRITICO"),
    ContextRule(ANY, ANY, (
        r"(?i)ssl",
        r"(?i)certificate",
        r"(?i)handshake",
        r"(?i)certificado.*inv(?:a|á)lido",
        r"(?i)seguran[cç]a.*conex",
    ), "ERRO_INFRAESTRUTURA", "SSL", "CRITICO"),
    ContextRule(ANY, ANY, (
        r"(?i)auth",
        r"(?i)unauthorized",
        r"(?i)token",
        r"(?i)credencia",
        r"(?i)permissao",
        r"(?i)n(?:ao|ã)o.*autorizado",
        r"(?i)acesso.*negado",
        r"(?i)senha.*inv(?:a|á)lida",
    ), "ERRO_TECNICO", "AUTH", "CRITICO"),
    ContextRule(ANY, ANY, (
        r"(?i)connection",
        r"(?i)conexao",
        r"(?i)indisponivel",
        r"(?i)fora.*ar",
        r"(?i)comunicacao",
        r"(?i)host.*unreachable",
        r"(?i)socket.*error",
    ), "ERRO_INFRAESTRUTURA", "CONEXAO", "CRITICO"),
    ContextRule(ANY, ANY, (
        r"(?i)rate.*limit",
        r"(?i)limite.*requisic",
        r"(?i)excedeu.*requisic",
        r"(?i)too.*many.*requests",
    ), "ERRO_INFRAESTRUTURA", "RATE_LIMIT", "ALTO"),
    ContextRule(ANY, ANY, (
        r"(?i)json",
        r"(?i)xml",
        r"(?i)parser",
        r"(?i)parsing",
        r"(?i)mapeamento",
        r"(?i)deserializ",
        r"(?i)serializ",
        r"(?i)malformado",
    ), "ERRO_TECNICO", "PARSE", "CRITICO"),
    ContextRule(ANY, ANY, (
        r"(?i)soap",
        r"(?i)fault",
        r"(?i)envelope.*inv(?:a|á)lido",
    ), "ERRO_TECNICO", "SOAP_FAULT", "CRITICO"),
)

# Server-error markers, checked before every other rule.
SERVER_ERROR_CODE = "500"
SERVER_ERROR_WORDS = ("500 internal server error", "http 500")

# Keyword groups of technical and infrastructure failures, first hit wins.
KEYWORD_GROUPS = (
    KeywordGroup(("timeout", "timed out", "timed_out", "tempo limite esgotado", "tempo limite excedido",
                  "requisicao expirada", "requisição expirada"), "ERRO_INFRAESTRUTURA", "TIMEOUT", "CRITICO"),
    KeywordGroup(("ssl", "certificate", "handshake", "certificado inválido", "certificado invalido",
                  "segurança conexão", "seguranca conexao"), "ERRO_INFRAESTRUTURA", "SSL", "CRITICO"),
    KeywordGroup(("connection refused", "conexao", "conexão", "indisponivel", "indisponível", "fora do ar",
                  "fora_ar", "comunicacao", "comunicação", "host unreachable", "socket error", "socket_error"),
                 "ERRO_INFRAESTRUTURA", "CONEXAO", "CRITICO"),
    KeywordGroup(("auth", "unauthorized", "token", "credencia", "permissao", "permissão", "não autorizado",
                  "nao autorizado", "acesso negado", "senha inválida", "senha invalida"),
                 "ERRO_TECNICO", "AUTH", "CRITICO"),
    KeywordGroup(("json", "xml", "parser", "parsing", "mapeamento", "deserializ", "serializ", "malformado"),
                 "ERRO_TECNICO", "PARSE", "CRITICO"),
    KeywordGroup(("soap fault", "soapfault", "soap-env:fault", "envelope inválido", "envelope invalido"),
                 "ERRO_TECNICO", "SOAP_FAULT", "CRITICO"),
    KeywordGroup(("rate limit", "rate_limit", "limite requisiç", "limite requisic", "excedeu requisiç",
                  "excedeu requisic", "too many requests"), "ERRO_INFRAESTRUTURA", "RATE_LIMIT", "ALTO"),
)
# The group that a Java object reference in the message also triggers.
JAVA_OBJECT_GROUP = "PARSE"

# Success codes, words and patterns (matched on the lower-cased message).
SUCCESS_CODES = ("100", "110", "111", "200")
LOOKUP_FUNCTIONALITIES = ("consultar", "pesquisar", "obter", "query", "get", "retornar")
LOOKUP_HITS = ("localizado", "encontrado", "existente", "ativo")
SUCCESS_PATTERNS = (
    r"(?i)opera[cç]ã?o.*efetivada",
    r"(?i)inclus[ão]o?.*realizada.*sucesso",
    r"(?i)encerramento.*realizado",
    r"(?i)consulta.*realizada",
    r"(?i)ciot.*gerado",
    r"(?i)protocolo.*gerado",
    r"(?i)opera[cç]ã?o.*conclu[íi]da",
    r"(?i)sucesso",
    r"(?i)sucesso.*inserido",
    r"(?i)consulta.*sucesso",
    r"(?i)ciot.*gerado.*sucesso",
    r"(?i)viagem.*homologada",
    r"(?i)cadastrado.*sucesso",
    r"(?i)cadastro.*realizado",
    r"(?i)efetivado.*sucesso",
    r"(?i)concluido.*sucesso",
    r"(?i)sucesso.*concluido",
)
NEGATIONS = ("não", "nao", "nõo", "sem", "erro", "rejeitado", "rejeicao", "rejeição", "inválido", "invalido",
             "inativa", "inativo", "suspensa", "suspenso", "divergente", "falha")

# Results from the mildest to the worst, and the groups they fall in.
RESULT_ORDER = ("SUCESSO", "SUCESSO_COM_ALERTA", "ALERTA_OPERACIONAL", "REJEICAO_NEGOCIO", "ERRO_TECNICO",
                "ERRO_INFRAESTRUTURA")
TECHNICAL_RESULTS = ("ERRO_TECNICO", "ERRO_INFRAESTRUTURA")
REJECTION_RESULTS = ("REJEICAO_NEGOCIO", "ERRO_TECNICO", "ERRO_INFRAESTRUTURA")
SUCCESS_RESULTS = ("SUCESSO", "SUCESSO_COM_ALERTA")

# Message masking in order, (pattern, replacement).
MASK_OBJECTS = (
    (r"\b(br\.com\.[\w\.]+)\@[a-fA-F0-9]+\b", r"\1@{HEX}"),
    (r"\b([\w\.]+)\@[a-fA-F0-9]{6,}\b", r"\1@{HEX}"),
)
MASK_PREFIX = (
    (r"(?i)^rejei[cç][aã]o\b\s*[-:]?\s*", "Rejeição: "),
    (r"(?i)\brejei[cç][aã]o\s*[-:]\s*", "Rejeição: "),
)
MASK_DATES = (
    (r"\b\d{2}/\d{2}/\d{4}(?:\s+\d{2}:\d{2}(?::\d{2})?)?\b", "{DATA}"),
    (r"\b\d{4}-\d{2}-\d{2}(?:[\sT]\d{2}:\d{2}(?::\d{2})?)?\b", "{DATA}"),
)
MASK_PLATE = (
    (r"\b(?:[A-Za-z]{3}[- ]?[0-9][A-Za-z0-9]{3}|[A-Za-z]{2}[- ]?[0-9][A-Za-z0-9]{3,4})\b", "{PLACA}"),
)
MASK_FORMATTED = (
    (r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", "{DOC}"),
    (r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "{DOC}"),
)
MASK_LONG_NUMBERS = (
    (r"\b\d{14}\b", "{DOC}"),
    (r"\b\d{11}\b", "{DOC}"),
)
MASK_LABELLED = (
    (r"(?i)\brntrc\s*:?\s*\b\d+\b", "RNTRC {RNTRC}"),
)
MASK_BARE = (
    (r"\b\d{8,12}\b", "{RNTRC}"),
)
MASK_POSTCODES = (
    (r"\b\d{5}-\d{3}\b", "{CEP}"),
    (r"\b\d{8}\b", "{CEP}"),
)
MASK_NUMBERS = (*MASK_DATES, *MASK_PLATE, *MASK_FORMATTED, *MASK_LONG_NUMBERS, *MASK_LABELLED, *MASK_BARE, *MASK_POSTCODES)
MASK_PROTOCOL = ((r"(?i)protocolo\s*:?\s*\b[a-zA-Z0-9_-]+\b", "protocolo {PROTOCOLO}"),)
MASK_AMOUNTS = (
    (r"\b\d+,\d{2}\b", "{VALOR}"),
    (r"\b\d+\.\d{2}\b", "{VALOR}"),
)
MASK_LISTS = (
    (r"\{PLACA\}(?:\s*(?:,|\be\b|/)\s*\{PLACA\})+", "{PLACA}"),
    (r"\{DOC\}(?:\s*(?:,|\be\b|/)\s*\{DOC\})+", "{DOC}"),
    (r"\{RNTRC\}(?:\s*(?:,|\be\b|/)\s*\{RNTRC\})+", "{RNTRC}"),
    (r"\{CEP\}(?:\s*(?:,|\be\b|/)\s*\{CEP\})+", "{CEP}"),
)

# Protocol number written out in a message.
PROTOCOL_IN_TEXT = r"(?i)protocolo\s*:?\s*\b([a-zA-Z0-9_-]+)\b"
PROTOCOL_MIN_LENGTH = 3
NO_PROTOCOL = "SEM_PROTOCOLO"

# Separator between the messages of one quoted list.
MESSAGE_SEPARATOR = r"""["']\s*,\s*["']"""

# Entity patterns; ``strip`` is removed from the whole match.
ENTITY_RULES = (
    EntityRule("CEP", r"\b\d{5}-\d{3}\b|\b\d{8}\b"),
    EntityRule("PLACA", r"\b[A-Za-z]{3}[- ]?[0-9][A-Za-z0-9][0-9]{2}\b", r"[- ]", upper=True),
    EntityRule("RNTRC", r"(?i)rntrc\s*:?\s*\b(\d{8,12})\b", r"(?i)rntrc\s*:?\s*"),
    EntityRule("CPF", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|\b\d{11}\b"),
    EntityRule("CNPJ", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b|\b\d{14}\b"),
    EntityRule("CIOT", r"(?i)ciot\s*:?\s*\b(\d{12,16})\b", r"(?i)ciot\s*:?\s*"),
    EntityRule("EIXOS", r"\b(\d+)\s*(?:eixo|eixos)\b", r"(?i)\s*eixos?"),
    EntityRule("MUNICIPIO", r"(?i)munic(?:i|í)pio\s*:?\s*\b(\d{7})\b", r"(?i)munic(?:i|í)pio\s*:?\s*"),
)

# Raw-file columns, defaults and date names.
COLUMN_DEFAULTS = {
    "contratante": "CONTRATANTE DESCONHECIDO",
    "funcionalidade": "NÃO ESPECIFICADA",
    "cod_mensagem": "",
    "des_resposta": "",
}
PROTOCOL_COLUMNS = ("cod_protocolo", "protocolo")
REQUIRED_ANY = ("protocolo", "contratante")
DATE_COLUMNS = ("data", "dhr_registro", "dhr_evento", "dh_registro", "data_evento", "data_registro", "data_hora",
                "timestamp", "created_at")
# Day, month and time parts may come without their leading zero.
DATE_FORMATS = ("d/M/yyyy H:m:s", "yyyy-M-d H:m:s", "d/M/yyyy H:m", "yyyy-M-d'T'H:m:s", "d/M/yyyy", "yyyy-M-d",
                "d/M/yy H:m:s", "d/M/yy H:m", "d/M/yy")
# A two-digit year from this one on belongs to the previous century.
TWO_DIGIT_YEAR_PIVOT = 70

# Evitability classes over categories, and their descriptions.
EVITABILITY_CLASSES = (
    ("Evitável (Dados/Cadastro)",
     ("PLACA", "LOCALIZAÇÃO", "CARGA", "VALIDAÇÃO", "DATA", "JANELA OPERACIONAL", "TOLERÂNCIA"),
     "Evitável: Erros causados por dados incorretos ou inconsistências cadastrais."),
    ("Parcialmente Evitável (Processo)", ("TRANSPORTADOR", "PAGAMENTO", "CIOT"),
     "Parcialmente Evitável: Rejeições cadastrais do transportador ou do RNTRC."),
    ("Não Evitável (Integração/Sistema)", ("INTEGRAÇÃO", "INTEGRACAO", "SISTEMA"),
     "Não Evitável: Instabilidade, timeouts ou falhas de rede da ANTT."),
)
EVITABILITY_DEFAULT = ("Não Classificado",
                       "Não Classificado: Outras mensagens sem categorização de evitabilidade definida.")

# Score penalty per severity.
SEVERITY_PENALTY = {"CRITICO": 1.0, "ALTO": 0.5, "MEDIO": 0.2, "BAIXO": 0.1}
