"""All registered queries."""

from . import (  # noqa: F401
    q_features,
    q_labels,
    q_regime,
    q_rules,
    q_stats,
    q_stream,
    q_time,
    q_trades,
    q_vectors,
)
from .registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, folder):
    """Features, forward label and rules in one pass: coverage, precision and lift per rule."""
    return QUERIES["u4_rule_evaluation"](spark, folder)
