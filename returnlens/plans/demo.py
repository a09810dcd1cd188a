"""Raw API-return logs derived from the ``events`` table of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.operators.canonical import ROW, spread

FUNCTIONALITY = {"purchase": "Emitir CIOT", "signup": "Retificar CIOT", "view": "Consultar CIOT",
                 "click": "Encerrar CIOT", "error": "Cancelar CIOT"}

# (cod_mensagem, des_resposta) by event_id modulo 24; names in angle brackets are parameters.
RETURNS = (
    ("217", '{"Codigo":"217","Mensagem":"A placa <placa> não pertence ao RNTRC <rntrc>."}'),
    ("209", '{"Codigo":"209","Mensagem":["O CEP <cep> ainda não está cadastrado.",'
            '"O código do município de origem não existe."]}'),
    ("209,210", '{"Codigo":"209,210","Mensagem":["Município origem inválido","Município destino inválido",'
                '"CEP <cep> não cadastrado"]}'),
    ("203", "Transportador CPF/CNPJ <cpf> não encontrado na ANTT."),
    ("110", "Operação realizada com sucesso."),
    ("217,203", '["A placa <placa> não pertence ao RNTRC <rntrc>.",'
                '"Transportador CPF/CNPJ <cpf> não encontrado na ANTT."]'),
    ("207", "Rejeição - Não foi encontrado nenhum transportador com CPF/CNPJ 12345678901 e RNTRC <rntrc>."),
    ("500", "br.com.acme.model.Encerramento@1c25df32"),
    ("504", "Tempo limite excedido"),
    ("", "SSL handshake failed"),
    ("", "Token expirado: acesso negado"),
    ("", "Falha de comunicacao com a API RNTRC"),
    ("", "Too many requests: rate limit"),
    ("", "SOAP Fault: Envelope invalido"),
    ("219", "Código de identificação da operação já cadastrado"),
    ("269", "A data e hora da declaração está fora do intervalo de tolerância permitido para esta operação"),
    ("217", ""),
    ("", "Transportador localizado"),
    ("999", "Retorno desconhecido do provedor"),
    ("", "Falha ao gravar registro"),
    ("222", "CIOT: 123456789012 cancelado"),
    ("210", "Quantidade de 3 eixos incompatível com o veículo"),
    ("210", "Município: 3550308 destino inválido"),
    ("204", "CNPJ 12.345.678/0001-00 com pagamento incompatível"),
)


def _filled(template: str, parameters: dict[str, Column]) -> Column:
    text: Column = F.lit(template)
    for name, value in parameters.items():
        if f"<{name}>" in template:
            text = F.replace(text, F.lit(f"<{name}>"), value)
    return text


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log columns plus ``log_id`` and the row number by which they are dealt out."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type"), keep_row=True)
    key = F.col("event_id")

    def digits(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    parameters = {
        "placa": F.concat(F.lit("ABC-"), digits(key % 500, 4)),
        "rntrc": (F.lit(12000000) + key % 700).cast("string"),
        "cep": F.concat(digits(F.lit(10000) + key % 80000, 5), F.lit("-"), digits(key % 1000, 3)),
        "cpf": F.concat(digits(key % 1000, 3), F.lit(".222.333-44")),
    }
    kind = key % len(RETURNS)
    code = F.get(F.lit([c for c, _ in RETURNS]), kind.cast("int"))
    response = F.coalesce(*(F.when(kind == i, _filled(t, parameters)) for i, (_, t) in enumerate(RETURNS)))
    function = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in FUNCTIONALITY.items()))
    return events.select(
        F.concat(F.lit("log_"), key.cast("string")).alias("log_id"),
        F.concat(F.lit("PROT"), digits(key, 8)).alias("protocolo"),
        F.col("ts").alias("dhr_registro"),
        F.concat(F.lit("CLI"), (F.col("user_id") % 40).cast("string")).alias("contratante"),
        function.alias("funcionalidade"),
        code.alias("cod_mensagem"),
        response.alias("des_resposta"),
        ROW,
    )
