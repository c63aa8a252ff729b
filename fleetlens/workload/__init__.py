"""Queries over the driver tables; importing this package registers all of them."""

from fleetlens.workload import q_fleet, q_ingest, q_inventory, q_kernels, q_reports, q_trends  # noqa: F401
from fleetlens.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
