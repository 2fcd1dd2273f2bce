"""Registered queries over the benchmark tables."""

from panelrec.plans.registry import QUERIES, TWINS
from panelrec.plans import (
    cleaning,
    encoding,
    evaluating,
    features,
    gating,
    joining,
    sampling,
    scoring,
    serving,
)

__all__ = [
    "QUERIES", "TWINS", "cleaning", "encoding", "evaluating", "features", "gating", "joining",
    "sampling", "scoring", "serving",
]
