"""Spark-native analytics for semi-structured API-return logs."""

from returnlens.operators.filters import LogFilter
from returnlens.operators.model import LogModel
from returnlens.operators.silver import classify_logs
from returnlens.session import configure_session, shared_dir

__all__ = ["LogFilter", "LogModel", "classify_logs", "configure_session", "shared_dir"]
