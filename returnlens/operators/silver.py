"""Canonical logs to classified logs with their rejections and entities.

Messages, their classification, the worst result and the entities stay in the partition of their log.
``dim_log`` and the two fact tables are projections of this nested table.

Messages are classified as rows of their own, in plain columns and generated code, however many a log
has. The rows of a log stay side by side, so they find together again without a key that is hashed or sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnlens.functions import rules
from returnlens.functions.classify import (
    UNCATEGORISED_INDEX,
    classification_stages,
    description,
    general_status,
    result_rank,
    worst_result,
)
from returnlens.functions.entities import entity_rows, found_stage, matches_stage
from returnlens.functions.marks import FIELDS, FOLDED
from returnlens.functions.payload import extract_protocol, pair_messages, parse_payload
from returnlens.functions.sqltext import Ref, Stage, run_on_table, struct, text, text_list
from returnlens.operators.canonical import ROW

DIM_COLUMNS = ("log_id", "protocolo", "data_evento", "contratante", "funcionalidade", "status_geral",
               "resultado_operacional")
FACT_COLUMNS = ("rejeicao_id", "log_id", "codigo_antt", "categoria_operacional", "tipo_rejeicao_semantica",
                "subtipo_rejeicao", "categoria", "severidade", "causa_raiz", "orientacao_operacional", "mensagem",
                "mensagem_original", "mensagem_normalizada", "template_oficial", "resultado_operacional",
                "tipo_erro_tecnico")
ENTITY_COLUMNS = ("entidade_id", "rejeicao_id", "entidade_tipo", "entidade_valor")


def _rejection_stages(log_id: str = "log_id") -> list[Stage]:
    """Classified message to the fields of its rejection."""
    return [
        matches_stage(lambda r: r("rejeitada")),
        lambda r: {"rejeicao_id": f"concat({log_id}, '_rej_', {r('pos')})", **found_stage(r)},
        lambda r: {"rejeicao": _rejection(r)},
    ]


def _rejection(r: Ref) -> str:
    """Struct of the fact columns plus the entities. A technical failure without a rule of its
    own gets integration labels instead of the semantic ones."""
    label, kind = r("rotulo"), r("tipo_erro_tecnico")
    kind_text = f"coalesce({kind}, 'None')"
    technical = (f"({r('resultado_operacional')} IN ({text_list(rules.TECHNICAL_RESULTS)})"
                 f" AND {r('semantica')} >= {UNCATEGORISED_INDEX})")
    integration = text(rules.INTEGRATION_CATEGORIES[0])

    def choose(for_technical: str, semantic: str) -> str:
        return f"if({technical}, {for_technical}, {semantic})"

    category = choose(integration, f"{label}.categoria")
    return struct(
        rejeicao_id=r("rejeicao_id"),
        codigo_antt=r("codigo"),
        categoria_operacional=category,
        tipo_rejeicao_semantica=choose("NULL", f"{label}.template"),
        subtipo_rejeicao=choose(f"concat('Erro técnico: ', {kind_text})",
                                description(r("semantica"), label, r("limpa"))),
        categoria=category,
        severidade=r("severidade"),
        causa_raiz=choose(integration, f"{label}.causa"),
        orientacao_operacional=choose(f"concat('Erro técnico detectado (', {kind_text}, '). Contatar suporte.')",
                                      f"{label}.orientacao"),
        mensagem=r("mensagem"),
        mensagem_original=r("mensagem"),
        mensagem_normalizada=r("mascara"),
        template_oficial=choose("NULL", f"{label}.template"),
        resultado_operacional=r("resultado_operacional"),
        tipo_erro_tecnico=kind,
        entidades=entity_rows(r("achados"), r("rejeicao_id")),
    )


def _gathered(row: str, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a log, which stand side by side, as one: ``columns`` of the first, the largest ``grau`` and the rejections
    that are not null, in their order. A log may go on from batch to batch."""

    def one_row_each(pieces: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(pieces).combine_chunks()
        at = table[row].to_numpy()
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        worst = np.maximum.reduceat(table["grau"].fill_null(-1).to_numpy(), first)
        kept = table["rejeicao"].is_valid()
        ends = np.cumsum(np.add.reduceat(kept.to_numpy().astype(np.int32), first), dtype=np.int32)
        rejections = table["rejeicao"].filter(kept).combine_chunks()
        if isinstance(rejections, pa.ChunkedArray):
            rejections = rejections.chunk(0) if rejections.num_chunks else pa.array([], rejections.type)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int32), ends))), rejections)
        heads = table.select(columns).take(pa.array(first)).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*heads.columns, pa.array(worst, pa.int32(), mask=worst < 0), lists], [*columns, "grau", "rejeicoes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(row).to_numpy()
            starts = np.flatnonzero(at[1:] != at[:-1]) + 1
            if len(starts):
                yield one_row_each([*held, batch.slice(0, starts[-1])])
                held = [batch.slice(starts[-1])]
            elif held and held[0].column(row)[0].as_py() != at[0]:
                yield one_row_each(held)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield one_row_each(held)

    return run


def classify_logs(canonical: DataFrame, keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """Nested silver table: one row per log, the ``dim_log`` columns and ``rejeicoes``.

    Input: the canonical columns plus ``log_id``; ``keep_columns`` are carried along. A column ``ROW`` that
    numbers the rows is used as it is; else they are numbered here. Rows that repeat stay apart.
    """
    row = ROW if ROW in canonical.columns else f"monotonically_increasing_id() AS {ROW}"
    carried = ["log_id", "contratante", "funcionalidade", "cod_protocolo", *keep_columns]
    log = [ROW, "protocolo", "data_evento", *carried]
    df = canonical.selectExpr(
        row, f"{extract_protocol('cod_mensagem', 'des_resposta', 'cod_protocolo')} AS protocolo", "data AS data_evento",
        *carried, f"{parse_payload('cod_mensagem', 'des_resposta')} AS payload")
    df = df.selectExpr(*log, f"{pair_messages('payload')} AS pares")
    # A log without messages keeps one row, whose position is null.
    df = run_on_table(df.selectExpr(*log, "inline_outer(pares)"), classification_stages())
    df = df.selectExpr(*log, "pos", "mensagem", "codigo", "limpa", "mascara", *(FOLDED + f for f in FIELDS), "semantica", "rotulo", "resultado_operacional",
                       "tipo_erro_tecnico", "severidade",
                       f"pos IS NOT NULL AND resultado_operacional IN ({text_list(rules.REJECTION_RESULTS)}) AS rejeitada")
    *first, last = _rejection_stages()
    df = run_on_table(df, first)
    rejection = last(lambda name: name)["rejeicao"]
    df = df.selectExpr(*log, f"if(pos IS NULL, NULL, {result_rank('resultado_operacional')}) AS grau",
                       f"if(rejeitada, {rejection}, NULL) AS rejeicao")
    kinds = df.schema
    gathered = T.StructType([*(kinds[name] for name in log), kinds["grau"], T.StructField("rejeicoes", T.ArrayType(kinds["rejeicao"].dataType, False))])
    df = df.mapInArrow(_gathered(ROW, log), gathered).selectExpr(*log, "rejeicoes", f"{worst_result('grau')} AS resultado_operacional")
    return df.selectExpr(*DIM_COLUMNS[:-2], f"{general_status('resultado_operacional')} AS status_geral",
                         "resultado_operacional", "rejeicoes", *keep_columns)


def dim_log(silver: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per request."""
    return silver.select(*DIM_COLUMNS, *keep)


def fact_rejections(silver: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per kept rejection.

    ``inline`` hands over whole rows, which suits a table that is still being computed: the
    optimizer pushes no single fields into its expressions.
    """
    rows = silver.select("log_id", *keep, F.inline("rejeicoes"))
    return rows.select(*FACT_COLUMNS, *keep)


def fact_entities(silver: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per kept entity."""
    rejections = silver.select(*keep, F.inline("rejeicoes")).select("rejeicao_id", "entidades", *keep)
    return rejections.select("rejeicao_id", *keep, F.inline("entidades")).select(*ENTITY_COLUMNS, *keep)
