"""Registered queries by subject. Importing this package fills the registry."""

from trailcast.plans.registry import ORACLES, QUERIES
from trailcast.plans import decisions, evaluation, features, files, logs, probes, streams, training

__all__ = ["ORACLES", "QUERIES", "decisions", "evaluation", "features", "files", "logs", "probes", "streams", "training"]
