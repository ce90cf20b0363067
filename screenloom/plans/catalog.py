"""All registered queries; importing the modules fills the registry."""

from screenloom.plans import (  # noqa: F401
    cleaning_queries,
    feature_queries,
    metric_queries,
    model_queries,
    rule_queries,
    split_queries,
)
from screenloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
