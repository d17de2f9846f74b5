"""All registered queries."""

from tidewatch.plans import q_context, q_extract, q_feed, q_history, q_metrics, q_signals, q_stream  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
