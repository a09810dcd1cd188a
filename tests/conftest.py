"""Shared session of the tests."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def build_session(cores: str = "8") -> SparkSession:
    from returnlens.session import STATIC_SETTINGS, configure_session

    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("returnlens")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "8g")
    )
    for key, value in STATIC_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure_session(spark)


@pytest.fixture(scope="session")
def spark():
    session = build_session()
    yield session
    session.stop()
