"""The twelve reference scenarios from a raw CSV file to the three tables."""

from __future__ import annotations

import csv

import pytest
from pyspark.sql import functions as F

from returnlens.operators.silver import FACT_COLUMNS
from returnlens.sources.silver import TABLES, ingest, open_silver, register_views

# The expected inputs.
OBJECT = "br.com.acme.frete.model.EncerramentoOperacaoTransporte@"
SCENARIOS = [
    ("PROT001", "26/05/2026 10:00:00", "12.345.678/0001-00", "Emitir CIOT", '{"Codigo":"217"}',
     '{"Codigo":"217", "Mensagem":"A placa AAA-1234 não pertence ao RNTRC 12345678."}'),
    ("PROT002", "31/05/2026 00:00:00", "98.765.432/0001-99", "Emitir CIOT", '{"Codigo":"209"}',
     '{"Codigo":"209", "Mensagem":["O CEP 01001-000 ainda não está cadastrado.", "O código do município de origem não existe."]}'),
    ("PROT003", "26/05/2026 10:30:00", "123.456.789-10", "Retificar CIOT", '{"Codigo":"209,210"}',
     '{"Codigo":"209,210", "Mensagem":["Município origem inválido", "Município destino inválido", "CEP 13010-080 não cadastrado"]}'),
    ("PROT004", "26/05/2026 10:45:00", "45.678.901/0001-22", "Cancelar CIOT", "203",
     "Transportador CPF/CNPJ 111.222.333-44 não encontrado na ANTT. Placa BBB1C23 inativa."),
    ("PROT005", "26/05/2026 11:00:00", "12.345.678/0001-00", "Consultar CIOT", "110", "Operação realizada com sucesso."),
    ("PROT006", "26/05/2026 11:15:00", "12.345.678/0001-00", "Emitir CIOT", "217,203",
     '["A placa AAA-1234 não pertence ao RNTRC 12345678.","Transportador CPF/CNPJ 111.222.333-44 não encontrado na ANTT."]'),
    ("PROT007", "26/05/2026 11:30:00", "12.345.678/0001-00", "Emitir CIOT", "217",
     "A placa AAA-1234 não pertence ao RNTRC, ou o transportador está suspenso."),
    ("PROT008", "26/05/2026 11:45:00", "12.345.678/0001-00", "Emitir CIOT", "207",
     "Rejeição - Não foi encontrado nenhum transportador com CPF/CNPJ 12345678901 e RNTRC 12345678."),
    ("PROT009", "26/05/2026 12:00:00", "12.345.678/0001-00", "Emitir CIOT", "217",
     "Rejeição - A placa EF08H59 não pertence ao transportador de RNTRC 12345678, ou o mesmo não está ativo."),
    ("PROT010", "26/05/2026 12:15:00", "12.345.678/0001-00", "Emitir CIOT", "217",
     "Rejeição: O(s) veículo(s) de placas AAA1234, BBB5678 está(ão) contratado(s) para outro contratante."),
    ("PROT011", "26/05/2026 12:30:00", "12.345.678/0001-00", "Encerrar CIOT", "500", OBJECT + "1c25df32"),
    ("PROT012", "26/05/2026 12:45:00", "12.345.678/0001-00", "Encerrar CIOT", "500", OBJECT + "2d3f4e5a"),
]
HEADER = ("protocolo", "dhr_registro", "contratante", "funcionalidade", "cod_mensagem", "des_resposta")


def write_csv(path, rows, separator=";", encoding="utf-8", header=HEADER):
    with open(path, "w", newline="", encoding=encoding) as file:
        csv.writer(file, delimiter=separator).writerows([header, *rows])
    return str(path)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("scenarios")
    path = write_csv(folder / "logs.csv", SCENARIOS)
    root = str(folder / "lake")
    summary = ingest(spark, path, root).first()
    register_views(spark, root)
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in TABLES}
    return path, root, summary, tables


@pytest.fixture(scope="module")
def rejections(lake):
    tables = lake[3]
    joined = tables["dim_log"].select("log_id", "protocolo").join(tables["fact_rejeicoes_semanticas"], "log_id")
    found: dict[str, list] = {}
    for row in joined.orderBy("rejeicao_id").collect():
        found.setdefault(row["protocolo"], []).append(row)
    return found


def test_summary(lake):
    summary = lake[2].asDict()
    assert (summary["status"], summary["total_logs"], summary["unique_protocols"]) == ("processed", 12, 12)
    assert summary["total_rejeicoes"] == 15


def test_second_ingest_is_cached(spark, lake):
    path, root, _, tables = lake
    again = ingest(spark, path, root).first()
    assert (again["status"], again["total_logs"]) == ("cached", 12)
    assert spark.read.parquet(f"{root}/dim_log").count() == 12


def test_columns_and_views(spark, lake):
    assert set(FACT_COLUMNS) <= set(lake[3]["fact_rejeicoes_semanticas"].columns)
    assert spark.sql("SELECT count(*) FROM dim_log").first()[0] == 12


def test_dates(lake):
    times = {r["protocolo"]: r["t"] for r in lake[3]["dim_log"].select(
        "protocolo", F.date_format("data_evento", "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert times["PROT001"] == "2026-05-26 10:00:00"
    assert times["PROT002"] == "2026-05-31 00:00:00"


@pytest.mark.parametrize("protocol, expected", [
    ("PROT001", [("217", "PLACA_SEM_VINCULO_RNTRC", "REJEICAO_NEGOCIO", "ALTO")]),
    ("PROT002", [("209", "LOCALIZACAO_ORIGEM_INVALIDA", "REJEICAO_NEGOCIO", "MEDIO")] * 2),
    ("PROT003", [("209", "LOCALIZACAO_ORIGEM_INVALIDA", "REJEICAO_NEGOCIO", "MEDIO"),
                 ("210", "MUNICIPIO_DESTINO_INVALIDO", "REJEICAO_NEGOCIO", "MEDIO"),
                 ("209", "LOCALIZACAO_ORIGEM_INVALIDA", "REJEICAO_NEGOCIO", "MEDIO")]),
    ("PROT004", [("203", "TRANSPORTADOR_NAO_ENCONTRADO", "REJEICAO_NEGOCIO", "ALTO")]),
    ("PROT005", []),
    ("PROT006", [("217", "PLACA_SEM_VINCULO_RNTRC", "REJEICAO_NEGOCIO", "ALTO"),
                 ("217", "TRANSPORTADOR_NAO_ENCONTRADO", "REJEICAO_NEGOCIO", "ALTO")]),
    ("PROT007", [("217", "PLACA_SEM_VINCULO_RNTRC", "REJEICAO_NEGOCIO", "ALTO")]),
    ("PROT008", [("207", "TRANSPORTADOR_NAO_ENCONTRADO", "REJEICAO_NEGOCIO", "ALTO")]),
    ("PROT009", [("217", "PLACA_SEM_VINCULO_RNTRC", "REJEICAO_NEGOCIO", "ALTO")]),
    ("PROT010", [("217", "PLACA_SEM_VINCULO_RNTRC", "REJEICAO_NEGOCIO", "ALTO")]),
    ("PROT011", [("500", "ERRO_SERIALIZACAO_OBJETO", "ERRO_TECNICO", "CRITICO")]),
])
def test_labels(rejections, protocol, expected):
    got = [(r["codigo_antt"], r["tipo_rejeicao_semantica"], r["resultado_operacional"], r["severidade"])
           for r in rejections.get(protocol, [])]
    assert got == expected


def test_masks(rejections):
    assert rejections["PROT008"][0]["mensagem_normalizada"] == (
        "Rejeição: Não foi encontrado nenhum transportador com CPF/CNPJ {DOC} e RNTRC {RNTRC}.")
    assert rejections["PROT009"][0]["mensagem_normalizada"].startswith("Rejeição: A placa {PLACA}")
    assert rejections["PROT010"][0]["mensagem_normalizada"].count("{PLACA}") == 1
    masks = {rejections[p][0]["mensagem_normalizada"] for p in ("PROT011", "PROT012")}
    assert masks == {OBJECT + "{HEX}"}
    assert rejections["PROT011"][0]["causa_raiz"] == "FALHA_SERIALIZACAO_RESPONSE"


def test_entities(lake, rejections):
    rows = lake[3]["fact_entidades_extraidas"].collect()

    def of(protocol):
        ids = {r["rejeicao_id"] for r in rejections[protocol]}
        return {(r["entidade_tipo"], r["entidade_valor"]) for r in rows if r["rejeicao_id"] in ids}

    assert of("PROT001") == {("PLACA", "AAA1234"), ("RNTRC", "12345678"), ("CEP", "12345678")}
    assert of("PROT004") == {("CPF", "111.222.333-44"), ("PLACA", "BBB1C23")}
    assert not {e for e in of("PROT009") if e[0] == "PLACA"}
    assert of("PROT010") == {("PLACA", "AAA1234"), ("PLACA", "BBB5678")}


def test_status(lake):
    status = {r["protocolo"]: (r["status_geral"], r["resultado_operacional"]) for r in lake[3]["dim_log"].collect()}
    assert status["PROT005"] == ("SUCESSO", "SUCESSO")
    assert status["PROT011"] == ("ERRO", "ERRO_TECNICO")


def test_nested_model_of_one_file(spark, lake):
    file_hash = lake[3]["dim_log"].first()["file_hash"]
    assert open_silver(spark, lake[1], file_hash).logs().count() == 12
    assert open_silver(spark, lake[1], "absent").logs().count() == 0
