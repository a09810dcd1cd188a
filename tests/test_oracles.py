"""Every registered query against its DuckDB counterpart on the smallest data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registry
from tests.compare import differences, duck

SF_DIR = registry.SMOKE_DIR
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF_DIR}/events.parquet"), reason="test data not present")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    trained = {name for name in QUERIES if name == "pipeline" or name[:2] == "op" and name[2].isdigit()}
    assert set(QUERIES) - trained <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n[:2] != "op" or not n[2].isdigit()))
def test_query(spark, connection, name):
    assert differences(spark, connection, name, QUERIES[name], ORACLES[name], SF_DIR) == ""


def test_crosstab_agrees_with_the_matrix(spark):
    wide = {r["contratante"]: r.asDict() for r in QUERIES["client_rejection_crosstab"](spark, SF_DIR).collect()}
    long = QUERIES["client_rejection_matrix"](spark, SF_DIR).collect()
    assert long
    for row in long:
        assert wide[row["contratante"]][row["tipo_rejeicao_semantica"]] == row["total"]
    assert sum(r["total"] for r in long) == sum(v for r in wide.values() for k, v in r.items() if k != "contratante")


def test_flagship(spark):
    assert registry.entry(spark).columns == ["tipo_rejeicao_semantica", "volume", "percentual"]
