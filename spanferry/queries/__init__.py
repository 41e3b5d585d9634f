"""Named queries over the driver tables, one per operator."""

from spanferry.queries import copies, graphs, identity, payloads, reports, scans  # noqa: F401
from spanferry.queries.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
