"""Marks of words and shapes against asking for each of them."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

import __spark_entry__ as registry
from returnlens.functions import rules
from returnlens.functions.classify import context_index, prepare_stages, semantic_index, semantic_stages, success_text
from returnlens.functions.entities import KINDS, entity_values, matches_stage
from returnlens.functions.marks import FIELDS, LOWERED, PIECE, PLACES, WORDS, Marks, _reader
from returnlens.functions.sqltext import run_on_table
from returnlens.functions.text import Text, fold, has_negation, mask_stages, strip

PARTS = ["ABC-1234", "abc1d23", "AB 12345", "ABCD1234", "XY1A2B3C", "CEP 01001-001", "12345678", "RNTRC 123456789", "rntrc:", "12345678901", "123456789012345",
         "12.345.678/0001-00", "123.456.789-00", "01/02/2024", "01/02/2024 10:11:12", "2024-01-02T03:04", "10,50", "1.234.567.89", "3 eixos", "12 eixo",
         "CIOT 123456789012", "Município: 3550308", "municipio 1234567", "protocolo AB-1", "Rejeição - ", "REJEICAO:", "br.com.acme.X@1c25df32", "a.b@abcdef12",
         "٣٤٥٦٧٨٩٠", "placa", "PLACA", "não", "NÃO", "naoo", "pertence", "transportador", "encontrado", "já", "JÁ", "cadastrado", "ıſ", "İnválido", "Key",
         "data de início da viagem", "inferior", "atual", " ", "\t", "\x1c", "  ", "\n", ",", " e ", "/", "-", "_", ".", "ã", "–", "º", "x", "500", "90 dias", "superior"]


@pytest.fixture(scope="module")
def messages(spark):
    draw = random.Random(7)
    texts = [*PARTS, "", *(draw.choice(("", " ")).join(draw.choices((*PARTS, *WORDS), k=draw.randint(2, 9))) for _ in range(1500))]
    rows = [(i, t, draw.choice(("", "210", "217", None)), "Consultar") for i, t in enumerate(texts)] + [(len(texts), None, None, None)]
    return spark.createDataFrame(rows, "i int, mensagem string, codigo string, funcionalidade string").repartition(3)


def test_every_word_and_shape_is_found():
    texts = ["".join(random.Random(n).choices((*WORDS, *PARTS), k=n % 60)).lower().replace("\n", " ") for n in range(600)] + ["", *WORDS, "y" * (PIECE + 5) + "ssl"]
    found = _reader()(pa.array([t + "\n" for t in texts] + [None]).slice(1))
    assert found[-1].as_py() is None
    for t, marks in zip(texts[1:], found):
        held = {m for m, (f, bit) in PLACES.items() if marks[FIELDS[f]].as_py() >> bit & 1}
        assert {w for kind, w in held if kind == "word"} == {w for w in WORDS if w in t}, t
    assert _reader()(pa.array([], pa.string())).type.num_fields == len(FIELDS)


def test_masks_are_those_without_marks(messages):
    rows = run_on_table(run_on_table(messages, prepare_stages()), mask_stages("limpa", "outra")).select("mensagem", "mascara", "outra").collect()
    assert len(rows) > 1500 and not [r for r in rows if r.mascara != r.outra]


def test_entities_are_those_without_marks(messages):
    found = run_on_table(messages, [*prepare_stages(), matches_stage(lambda r: "true")])
    rows = found.selectExpr("mensagem", *(f"array_distinct(achado_{k}) AS a_{k}" for k in KINDS), *(f"{entity_values('mensagem', k)} AS b_{k}" for k in KINDS)).collect()
    strip_of = {r.kind: r.strip for r in rules.ENTITY_RULES}
    for k in KINDS:
        assert any(r[f"a_{k}"] for r in rows), k
        assert not [r for r in rows if r.mensagem is not None and (r[f"a_{k}"] != r[f"b_{k}"] if not strip_of[k] else bool(r[f"a_{k}"]) != bool(r[f"b_{k}"]))], k


def test_rules_are_those_without_marks(messages):
    df = run_on_table(messages, [*prepare_stages(), *semantic_stages(), lambda r: {"vd": fold(r("varrida"))}])
    rows = df.selectExpr(
        "mensagem", "semantica", f"{semantic_index('limpa', 'varrida', Text('vd'), 'codigo_limpo')} AS s",
        f"{context_index('limpa', Marks(lambda n: n), 'negada', 'codigo_limpo', strip('funcionalidade'))} AS c",
        f"{context_index('limpa', Text('dobrada'), 'negada', 'codigo_limpo', strip('funcionalidade'))} AS d",
        f"{success_text('minuscula', 'funcionalidade', Marks(lambda n: n, LOWERED))} AS e", f"{success_text('minuscula', 'funcionalidade')} AS f",
        "negada", f"{has_negation(Text('minuscula'))} AS n").where("mensagem IS NOT NULL").collect()
    assert len({r.semantica for r in rows}) > 5 and len({r.c for r in rows}) > 5
    assert not [r for r in rows if (r.semantica, r.c, r.e, r.negada) != (r.s, r.d, r.f, r.n)]


def test_words_are_not_asked_one_by_one(spark):
    """The words of all rules were several hundred scans of each message."""
    for name in ("wide_rejections", "wide_entities"):
        plan = registry.queries()[name](spark, registry.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and plan.count("Contains(") < 60, plan.count("Contains(")
