"""Imports every module that registers queries."""

from pagelake.plans import feeds, labels, logs, maps, prep, scoring, shapes, streams  # noqa: F401
from pagelake.plans.registry import ORACLES, QUERIES  # noqa: F401
