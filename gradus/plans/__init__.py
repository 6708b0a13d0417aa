"""Named queries over the test tables; importing registers them all."""

from . import q_eval, q_features, q_models, q_stats  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
