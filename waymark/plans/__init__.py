"""Registered queries and the SQL each one is checked against."""

from . import views  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from . import scalar, fingerprint, surface, scans, filters, extract  # noqa: F401
from . import ordered, access, graph, telemetry, passive, frontier, quality, streams  # noqa: F401
from . import registered  # noqa: F401
