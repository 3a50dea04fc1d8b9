"""Registered queries: each operator run over whole test tables, with its check in SQL."""

from coverlane.plans import catalog, files, flow, logs, messages, pages, reports, tables  # noqa: F401
from coverlane.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
