"""Single operators on small inputs."""

from __future__ import annotations

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from returnlens.functions import rules
from returnlens.functions.classify import classification_stages
from returnlens.functions.payload import extract_protocol, parse_payload
from returnlens.functions.regex import java_regex, required_words
from returnlens.functions.sqltext import run_on_table
from returnlens.functions.text import mask_stages, split_message, strip
from returnlens.operators.canonical import canonicalize, check_columns, normalize_columns, with_dense_key
from returnlens.operators.silver import classify_logs, fact_entities, fact_rejections
from returnlens.session import CHECKPOINT_KEY, shared_dir
from returnlens.sources.silver import export_csv

def column(spark, values, expression, name="s"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return [r[0] for r in df.selectExpr(f"{expression} AS r").collect()]


def test_split(spark):
    cases = {
        '"': [], '""': [], "[]": [], "": [], "plain, comma": ["plain, comma"], 'a","b': ["a", "b"],
        "  [ '[\"a\"]' ]  ": ["a"], "['a' , 'b']": ["a", "b"], '[\\"x\\",\\"y\\"]': ["x", "y"],
        "[" * 40 + "deep" + "]" * 40: ["deep"], " x ": ["x"],
    }
    assert column(spark, list(cases), split_message("s")) == list(cases.values())


def test_payload(spark):
    rows = [
        ("217", "texto", ["217"], ["texto"]),
        ("1, 2,,", "", ["1", "2"], [""]),
        ('{"Codigo":217}', "lost", ["217"], [""]),
        ("9", '{"codigo":["1,2",null,0,"0",""],"mensagem":["a",null,0,"0",[],{},false," b "]}', ["1,2", "0"], ["a", "0", "b"]),
        ("9", '{"Codigo":null,"codigo":"5","Mensagem":"m"}', [""], ["m"]),
        ("9", '{"Mensagem":"m"} rest', ["9"], ['{"Mensagem":"m"} rest']),
        ("9", '{"Mensagem":"a"} {"Mensagem":"b"}', ["9"], ['{"Mensagem":"a"} {"Mensagem":"b"}']),
        ("9", '{"Mensagem":"a","Mensagem":"b"}', [""], ["b"]),
        ("None", "nan", [""], [""]), ("9", '{"Codigo":{"a":1,"b":2},"Mensagem":"m"}', ['{"a":1,"b":2}'], ["m"]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "c string, d string")
    got = [tuple(r[0]) for r in df.selectExpr(f"{parse_payload('c', 'd')} AS p").collect()]
    assert got == [(r[2], r[3]) for r in rows]


def test_protocol(spark):
    rows = [
        ("", '{"a":1,"PROTOCOLO":" X1 "}', "P", "X1"), ("", '{"Protocolo":0,"protocolo":"0"}', "P", "0"),
        ("", '["Protocolo"]', " P ", "P"), ("", '{"protocolo":"A","Protocolo":"X","protocolo":"B"}', "", "B"), ("", "Protocolo: ABC-9 e protocolo ZZZ9", "SEM_PROTOCOLO", "ABC-9"),
        ("protocolo 777", "protocolo 12", "", "777"), ("", "nada", "nan", "SEM_PROTOCOLO"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "c string, d string, k string")
    got = [r[0] for r in df.selectExpr(f"{extract_protocol('c', 'd', 'k')} AS p").collect()]
    assert got == [r[3] for r in rows]


def test_mask(spark):
    cases = {
        "emitido em 2024 hoje": "emitido {PLACA} hoje", "AAA1234, BBB5678 e CCC9D99": "{PLACA}",
        "valor 1,50 ou 1.50": "valor {VALOR} ou {VALOR}", "dia 01/02/2024 10:20:30 e 2024-02-01T10:20": "dia {DATA} e {DATA}",
        "12345678 12345678901 123456789012 12345678901234": "{RNTRC} {DOC} {RNTRC} {DOC}",
        "REJEIÇÃO  -  x": "Rejeição: x", "PROTOCOLO: AB1": "protocolo {PROTOCOLO}", "a \t b": "a b",
        "x rntrc: 12 y": "x RNTRC {RNTRC} y", "pkg.Cls@abcdef12": "pkg.Cls@{HEX}",
    }
    df = spark.createDataFrame([(k, i) for i, k in enumerate(cases)], "s string, i int").selectExpr("i", f"{strip('s')} AS s")
    got = [r["m"] for r in run_on_table(df, mask_stages("s", "m")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_guard_words_are_necessary():
    """A text that a pattern matches holds all the words the guard asks for."""
    samples = {
        r"(?i)rntrc\s*:?\s*\b(\d{8,12})\b": "RNTRC: 12345678", r"(?i)opera[cç]ã?o.*efetivada": "Operação x EFETIVADA",
        r"(?i)o.*campo.*(e|é).*inv(?:a|á)lido": "o campo é inválido", r"(?i)comunica[cç]ao.*api": "comunicaçao da api",
        r"br\.com\.[\w\.]+\@[a-fA-F0-9]+": "br.com.x@1f", r"\b\d+,\d{2}\b": "1,50",
        r"(?i)inclus[ão]o?.*realizada.*sucesso": "inclusão realizada com sucesso",
    }
    for pattern, sample in samples.items():
        assert re.search(pattern, sample)
        assert all(word in sample.lower() for word in required_words(pattern) or ())
    assert required_words("a|b") is None
    assert java_regex("(?i)x") == "(?idU)x"


def test_results(spark):
    rows = [
        ("Requisição expirada", "", "X", "ERRO_INFRAESTRUTURA", "TIMEOUT"), ("http 500", "", "X", "ERRO_TECNICO", "HTTP_500"),
        ("qualquer", "5031", "X", "ERRO_INFRAESTRUTURA", "TIMEOUT"), ("TOKEN", "", "X", "ERRO_TECNICO", "AUTH"),
        ("Já CADASTRADO", "219", "X", "SUCESSO_COM_ALERTA", None), ("Transportador localizado", "", "Consultar", "SUCESSO", None),
        ("Transportador não localizado", "", "Consultar", "REJEICAO_NEGOCIO", None), ("erro sem texto", "299", "X", "REJEICAO_NEGOCIO", None),
        ("algo deu erro", "", "X", "ERRO_TECNICO", "PARSE"), ("", "", "X", "REJEICAO_NEGOCIO", None),
        ("erro", "110", "X", "SUCESSO", None), ("viagem homologada", "", "X", "SUCESSO", None),
        ("br.com.acme.X@1f", "7", "X", "ERRO_TECNICO", "PARSE"), ("dados sem sucesso", "", "X", "REJEICAO_NEGOCIO", None),
        ("500 12345678", "1", "X", "ERRO_INFRAESTRUTURA", "CONEXAO"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, mensagem string, codigo string, funcionalidade string")
    got = [(r["resultado_operacional"], r["tipo_erro_tecnico"])
           for r in run_on_table(df, classification_stages()).orderBy("i").collect()]
    assert got == [r[3:] for r in rows]


def canonical(spark, rows):
    return spark.createDataFrame(rows, "log_id string, cod_mensagem string, des_resposta string, funcionalidade string").selectExpr(
        "*", "'C' AS contratante", "'P' AS cod_protocolo", "timestamp'2024-01-01 00:00:00' AS data")


def test_nothing_is_cut(spark):
    many = "[" + ",".join(f'"CEP {i:05d}-000 nao cadastrado"' for i in range(30)) + "]"
    ceps = " ".join(f"{i:05d}-111" for i in range(25))
    long = "x" * 6000 + " cep 01234-567 nao cadastrado"
    silver = classify_logs(canonical(spark, [("a", "209", many, "F"), ("b", "1", f"CEP {ceps}", "F"), ("c", "1", long, "F"),
                                             ("d", "1", '""', "F")]))
    rejected = {}
    for r in fact_rejections(silver).collect():
        rejected.setdefault(r["log_id"], []).append(r)
    assert len(rejected["a"]) == 30 and rejected["c"][0]["mensagem"] == long and "d" not in rejected
    found = {k: [r["entidade_valor"] for r in fact_entities(silver).where(f"rejeicao_id LIKE '{k}%'").orderBy("entidade_valor").collect()]
             for k in "bc"}
    assert found == {"b": [f"{i:05d}-111" for i in range(25)], "c": ["01234-567"]}


def test_array_and_column_paths_agree(spark):
    """A message in a list is classified like the same message alone."""
    messages = [m for _, m in __import__("returnlens.plans.demo", fromlist=["RETURNS"]).RETURNS if m and '"' not in m]
    alone = [(f"s{i}", "1", m, "Consultar CIOT") for i, m in enumerate(messages)]
    listed = [(f"m{i}", "1", f'["{m}","{m}"]', "Consultar CIOT") for i, m in enumerate(messages)]
    facts = fact_rejections(classify_logs(canonical(spark, alone + listed))).collect()
    labels = {r["rejeicao_id"]: r[2:] for r in facts}
    assert labels
    for key, value in labels.items():
        if key.startswith("s"):
            assert value == labels["m" + key[1:]] == labels["m" + key[1:].replace("_rej_0", "_rej_1")]


def test_columns(spark):
    df = spark.createDataFrame([("a", "b")], [" Contratante ", "CONTRATANTE"])
    assert normalize_columns(df).columns == ["contratante"]
    assert normalize_columns(df).first()[0] == "b"
    with pytest.raises(ValueError):
        check_columns(spark.createDataFrame([("a",)], ["x"]))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    row = canonicalize(spark.createDataFrame([("9/3/71",)], ["created_at"]), now).selectExpr("*", "year(data) AS y").first()
    assert (row["contratante"], row["cod_protocolo"], row["y"]) == ("CONTRATANTE DESCONHECIDO", "SEM_PROTOCOLO", 1971)


def test_dense_key(spark):
    ids = [r[0] for r in with_dense_key(spark.range(0, 1000, 1, 7)).orderBy("id").select("log_id").collect()]
    assert ids == [f"log_{i}" for i in range(1000)]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([('a "q"; b', 1), (None, 2), ("c", 3)], "t string, n int").coalesce(1)
    export_csv(rows, str(tmp_path / "quoted"))
    text = next((tmp_path / "quoted").glob("*.csv")).read_text()
    assert text.splitlines()[:2] == ['"t";"n"', '"a ""q""; b";"1"']
    export_csv(rows, str(tmp_path / "capped"), quote_all=False, cap=2)
    assert len(next((tmp_path / "capped").glob("*.csv")).read_text().splitlines()) == 3


@pytest.mark.parametrize("master, folder, answer", [
    ("spark://host:7077", "/shared/", "/shared"), ("spark://host:7077", None, ValueError), ("local-cluster[2,1,1024]", None, ValueError),
    ("local[8]", "/shared", "/shared"), ("local[8]", None, "returnlens-"),
])
def test_shared_folder(master, folder, answer):
    settings = {CHECKPOINT_KEY: folder} if folder else {}
    session = SimpleNamespace(
        conf=SimpleNamespace(get=settings.get, set=settings.__setitem__),
        sparkContext=SimpleNamespace(master=master, getConf=lambda: {}),
    )
    if answer is ValueError:
        with pytest.raises(ValueError):
            shared_dir(session)
    else:
        assert answer in shared_dir(session) and shared_dir(session) == shared_dir(session)
