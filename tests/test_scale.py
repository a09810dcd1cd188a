"""Steps that must not gather in one task or on the driver as the tables grow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from returnlens import LogFilter, LogModel, classify_logs
from returnlens.functions.payload import pair_messages, parse_payload
from returnlens.operators.canonical import spread
from returnlens.operators.silver import dim_log, fact_entities, fact_rejections
from returnlens.plans.cases import rule_logs, wide_logs
from returnlens.sources.rawlogs import describe_files, describe_splits, read_lines, read_records


@pytest.fixture
def one_row_group(spark, tmp_path):
    """One file with one row group, cut into many splits, whose keys all are the same."""
    spark.range(40_000).select(F.lit("k").alias("key"), "id").coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    yield spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def partition_sizes(df) -> list[int]:
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_spread_is_even(spark, one_row_group):
    assert one_row_group.rdd.getNumPartitions() >= 8 and max(partition_sizes(one_row_group)) == 40_000
    sizes = partition_sizes(spread(one_row_group))
    assert sum(sizes) == 40_000 and max(sizes) <= 40_000 / spark.sparkContext.defaultParallelism * 1.1


def test_derived_logs_are_spread(spark):
    for logs in (registry._canonical(spark, registry.SMOKE_DIR), wide_logs(spark, registry.SMOKE_DIR), rule_logs(spark, registry.SMOKE_DIR)):
        assert len(partition_sizes(logs)) >= spark.sparkContext.defaultParallelism


def test_flat_joins_broadcast_no_table(spark):
    """The tables here are small, so that the planner would broadcast every one of them."""
    silver = registry.silver_table(spark, registry.SMOKE_DIR)
    model = LogModel.from_tables(dim_log(silver), fact_rejections(silver), fact_entities(silver))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    for df in (model.rejections(), model.entities(), model.log_counts(), model.logs_with_rejections("rejeicao_id", "entidades"),
               model.where(LogFilter(causas=("PLACA",))).logs()):
        assert df.count() > 0
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_lines_of_raw_files_are_not_broadcast(spark, tmp_path):
    """The stored lines are small files here; to the tasks goes the row per split."""
    (tmp_path / "a.csv").write_text("des_resposta;cod_mensagem\n" + "".join(f'"linha {i}\nmais";{i}\n' for i in range(500)))

    def store(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    joins = []

    def watched(df, name):
        joins.extend(line for line in operators_of(df).splitlines() if "Join" in line and name == "linhas_marcadas")
        return store(df, name)

    lines = store(read_lines(spark, str(tmp_path / "a.csv")), "linhas")
    splits = store(describe_splits(lines), "partes")
    records = read_records(lines, splits, store(describe_files(splits), "arquivos"), watched)
    assert records.count() == 500 and "BuildRight" in joins[0] and "SortMergeJoin" not in joins[0]


def operators_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_are_rows_and_find_together_in_place(spark):
    """Messages of a log are classified in columns, not in lambdas; dealing the logs out is the one exchange."""
    for logs in (registry._classified(spark, registry.SMOKE_DIR), registry._wide(spark, registry.SMOKE_DIR)):
        plan = operators_of(logs)
        assert plan.count("Exchange ") == 1 and "hashpartitioning(fila" in plan and "Sort " not in plan.split("Exchange ")[1]
        assert "Generate inline(pares" in plan


def test_patterns_of_entities_run_in_columns(spark):
    """Below a lambda everything is interpreted, so there no pattern of an entity runs over a message."""
    lines = operators_of(registry._classified(spark, registry.SMOKE_DIR)).splitlines()
    own = [i for i, line in enumerate(lines) if "AS achado_" in line]
    assert own and "regexp_extract_all" in lines[own[0]] and "lambda" not in lines[own[0]]
    assert "regexp_extract_all" not in "".join(lines[:own[0]])


def test_single_messages_need_no_lambda(spark):
    """The short way of an only message gives what the long one gives for a list of it."""
    codes = [None, "", " 217 ", "nan", "217,203", " , ", '{"Codigo":"9"}']
    texts = [None, "", "  ", "nan", "None", " a, b ", "[a]", '"a"', "d'água", '"a","b"', "\u00a0x\u00a0", "[", '{"Mensagem":" m "}', '{"Mensagem":[]}']
    rows = spark.createDataFrame([(c, t) for c in codes for t in texts], "c string, t string")
    pairs = rows.selectExpr("c", "t", f"{parse_payload('c', 't')} AS p").selectExpr("c", "t", "p", f"{pair_messages('p')} AS pares").collect()
    for c, t, p, found in pairs:
        assert [f.pos for f in found] == list(range(len(found))) and all(f.codigo in p.codes for f in found), (c, t)
    got = {(c, t): (p.codes, [f.mensagem for f in found]) for c, t, p, found in pairs}
    assert got[None, None] == got["nan", "None"] == ([""], [""]) and got[" 217 ", " a, b "] == (["217"], ["a, b"])
    assert got["217,203", "[a]"] == (["217", "203"], ["a"]) and got[" , ", '"a","b"'] == ([""], ["a", "b"])
    assert got["", "[" ] == ([""], ["["]) and got["", "\u00a0x\u00a0"][1] == ["x"] and got["", "d'água"][1] == ["d'água"]
    assert got[" 217 ", '{"Mensagem":" m "}'] == ([""], ["m"]) and got['{"Codigo":"9"}', "nan"] == (["9"], [""])


def test_logs_that_repeat_stay_apart(spark):
    """Two equal logs, one without any message, one whose messages are of different results."""
    rows = [("a", "209", '{"Codigo":"209","Mensagem":["CEP 01001-001 inexistente","Dados enviados com sucesso"]}')] * 2 + [("b", "", '""')]
    raw = spark.createDataFrame(rows, "log_id string, cod_mensagem string, des_resposta string").selectExpr(
        "*", "'C' AS contratante", "'F' AS funcionalidade", "'P' AS cod_protocolo", "timestamp'2024-01-01' AS data")
    found = [(r.log_id, r.status_geral, [x.rejeicao_id for x in r.rejeicoes], sum(len(x.entidades) for x in r.rejeicoes))
             for r in classify_logs(raw).collect()]
    assert sorted(found) == [("a", "ERRO", ["a_rej_0"], 1)] * 2 + [("b", "SUCESSO", [], 0)]
