"""The stream gives the labels of the batch."""

from __future__ import annotations

from returnlens.operators.silver import fact_rejections
from returnlens.streaming.ingest import stream_raw_logs, stream_silver
from tests.test_scenarios import HEADER, SCENARIOS, write_csv


def test_stream(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    for part, rows in enumerate((SCENARIOS[:6], SCENARIOS[6:])):
        write_csv(tmp_path / "in" / f"part{part}.csv", [*rows, ("curta", f"linha {part}")])
        stream_silver(stream_raw_logs(spark, source, list(HEADER)), target, checkpoint).awaitTermination()
    silver = spark.read.parquet(target)
    assert silver.select("protocolo").distinct().count() == 12
    assert silver.select("lote").distinct().count() == 2
    assert fact_rejections(silver).count() == 15
    bad = spark.read.parquet(f"{target}_rejeitadas")
    assert {(r.lote, r.rejeitada) for r in bad.collect()} == {(0, "curta;linha 0"), (1, "curta;linha 1")}
