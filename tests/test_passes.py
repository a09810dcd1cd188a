"""How often the reports read the table, and what they give where there is nothing to read."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from returnlens import LogFilter, LogModel
from returnlens.plans import detail, overview

ONE_OR_TWO = ("executive_kpis", "executive_insights", "top_clients", "problem_functionalities", "flow_grouped", "flow_links",
              "filter_domain", "error_timeseries", "traffic_anomalies", "critical_entities_rntrc", "critical_entities_doc")


def passes(plan) -> int:
    """Scans that ran: those of the final plan and of its subqueries, without what was used again."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return passes(plan.executedPlan())
    if name.endswith("QueryStage"):
        return passes(plan.plan())
    if name.startswith("Reused"):
        return 0
    if name.startswith("Scan"):
        return 1
    total = 0
    for found in (plan.children(), plan.subqueries()):
        nodes = found.iterator()
        while nodes.hasNext():
            total += passes(nodes.next())
    return total


@pytest.mark.parametrize("name", ONE_OR_TWO)
def test_at_most_two_passes(spark, name):
    report = registry.queries()[name](spark, registry.SMOKE_DIR)
    report.collect()
    assert 1 <= passes(report._jdf.queryExecution().executedPlan()) <= 2


def test_reports_without_logs(spark):
    model = registry._model(spark, registry.SMOKE_DIR).where(LogFilter(protocolo="nowhere"))
    insights = overview.executive_insights(model).first()
    assert insights.asDict() == {"top_categoria": "N/A", "top_categoria_pct": 0.0, "top_funcionalidade": "N/A", "top_funcionalidade_pct": 0.0,
                                 "taxa_evitabilidade": 0.0, "top_clientes": 0, "top_clientes_pct": 0.0}
    kpis = overview.executive_kpis(model).first()
    assert (kpis.total_requests, kpis.unique_protocols, kpis.clientes_afetados, kpis.score_operacional, kpis.taxa_sucesso) == (0, 0, 0, 100.0, 100.0)
    for report in (overview.top_clients, overview.flow_links, overview.problem_functionalities, detail.filter_domain):
        assert report(model).collect() == []


def test_nulls_and_ties(spark):
    """Null clients and protocols, a client in several functionalities, equal counts."""
    logs = [("a", None, "X", "F2", "ERRO", ["T2", "T1"]), ("b", "p1", "X", "F1", "ERRO", ["T1", "T2"]), ("c", "p1", None, "F1", "ERRO", []),
            ("d", "p2", "Y", None, "SUCESSO", []), ("e", "p2", "Y", "F2", "ERRO", [None])]
    rejection = ("struct<rejeicao_id string, severidade string, categoria_operacional string, tipo_rejeicao_semantica string, causa_raiz string,"
                 " tipo_erro_tecnico string>")
    rows = [(i, p, "2024-01-01 00:00:00", c, f, s, "R", [(f"{i}{n}", "ALTO", "PLACA", t, None, None) for n, t in enumerate(ts)])
            for i, p, c, f, s, ts in logs]
    silver = spark.createDataFrame(rows, "log_id string, protocolo string, data_evento string, contratante string, funcionalidade string,"
                                   f" status_geral string, resultado_operacional string, rejeicoes array<{rejection}>")
    model = LogModel.from_nested(silver.withColumn("data_evento", silver.data_evento.cast("timestamp")))
    kpis = overview.executive_kpis(model).first()
    assert (kpis.total_requests, kpis.count_erro, kpis.altos, kpis.total_rejeicoes) == (7, 6, 5, 5)
    assert (kpis.unique_protocols, kpis.total_contratantes, kpis.clientes_afetados) == (2, 2, 0)
    clients = [tuple(r) for r in overview.top_clients(model).collect()]
    assert [(c[0], c[1], round(c[2], 4), c[4], c[5]) for c in clients] == [("X", 1, 33.3333, "T1", "F1"), ("Y", 1, 33.3333, None, "F2")]
    leading = {r.funcionalidade: (r.total_erros, r.principal_rejeicao) for r in overview.problem_functionalities(model).collect()}
    assert leading == {"F1": (2, "T1"), "F2": (2, "T1")}
