"""Registered queries of the station operators."""

from quern.plans import census, daily, dimensions, extras, hourly, ingestion, learning, leftovers, reports  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES  # noqa: F401
