"""Every registered query; importing this module fills the registry."""

from cinderframe.plans import aggregates, analyses, joining, learned, projections, ranking, scans, spatial  # noqa: F401
from cinderframe.plans.registry import ORACLES, QUERIES  # noqa: F401
