"""Bucketed flat tables: same rows as the nested table, and joins without an exchange below them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from returnlens import LogFilter, LogModel
from returnlens.sources.buckets import open_buckets, write_buckets

SCANS = ("logs", "rejections", "entities")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two batches of the derived logs."""
    silver = registry.silver_table(spark, registry.SMOKE_DIR)
    nested = silver.withColumn("lote", F.when(F.crc32("log_id") % 3 == 0, "a").otherwise("b"))
    path = str(tmp_path_factory.mktemp("buckets") / "t")
    write_buckets(nested.where("lote = 'a'"), path, buckets=4)
    write_buckets(nested.where("lote = 'b'"), path, buckets=7)
    return nested, path


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def exchanges_below_joins(plan, below=False) -> int:
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return exchanges_below_joins(plan.executedPlan(), below)
    if name.endswith("QueryStage"):
        return exchanges_below_joins(plan.plan(), below)
    below = below or name.endswith("Join")
    total = int(below and "Exchange" in name)
    children = plan.children().iterator()
    while children.hasNext():
        total += exchanges_below_joins(children.next(), below)
    return total


def same(left, right) -> bool:
    assert sorted(left.columns) == sorted(right.columns)
    columns = sorted(left.columns)
    left, right = ([str(tuple(r)) for r in df.select(*columns).collect()] for df in (left, right))
    return sorted(left) == sorted(right) and len(left) > 0


def test_same_rows(spark, tables):
    nested, path = tables
    ours, theirs = open_buckets(spark, path, nested), LogModel.from_nested(nested)
    for chosen in (LogFilter(), LogFilter(status="ERRO", causas=("PLACA",))):
        a, b = ours.where(chosen), theirs.where(chosen)
        assert all(same(getattr(a, kind)(), getattr(b, kind)()) for kind in SCANS)
        ordered = F.array_sort(F.coalesce("entidades", F.array())).alias("e")  # a log without any has none or no list
        assert same(*(m.logs_with_rejections("rejeicao_id", "entidades").select("log_id", "rejeicao_id", ordered) for m in (a, b)))


def test_joins_move_no_rows(spark, tables, no_broadcast):
    nested, path = tables
    model = open_buckets(spark, path, nested)
    frames = [model.rejections(), model.entities(), model.logs_with_rejections("rejeicao_id", "entidades"), model.log_counts(),
              model.where(LogFilter(causas=("PLACA",))).entities()]
    for df in frames:
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        assert "Join" in plan.toString() and exchanges_below_joins(plan) == 0
    flat = registry._flat_model(spark, registry.SMOKE_DIR).entities()
    flat.collect()
    assert exchanges_below_joins(flat._jdf.queryExecution().executedPlan()) > 0


def test_batches_replace_themselves(spark, tables):
    nested, path = tables
    before = open_buckets(spark, path, nested).logs().count()
    write_buckets(nested.where("lote = 'a'"), path)
    table = open_buckets(spark, path, nested)
    assert table.logs().count() == before == nested.count()
    files = spark.read.parquet(f"{path}/dim_log").where("lote = 'a'").select("_metadata.file_name").distinct().count()
    assert files <= 4  # the number of buckets of the first write holds


def test_no_rows(spark, tables, tmp_path):
    nested = tables[0].where("false")
    write_buckets(nested, str(tmp_path / "t"), buckets=2)
    model = open_buckets(spark, str(tmp_path / "t"), nested)
    assert model.logs().collect() == [] and model.entities().collect() == []


def test_buckets_grow_with_the_table():
    from returnlens.sources.buckets import BUCKETS, buckets_for

    assert buckets_for(0) == buckets_for(100_000) == 8
    assert buckets_for(36_000_000) == 360 and buckets_for(10**12) == BUCKETS
