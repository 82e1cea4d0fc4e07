"""Integrity manifests of file trees and tables, on Spark."""

from .jobs import build, compare_stores, refresh
from .operators import compare, plan_refresh, verdict

__all__ = ["build", "compare", "compare_stores", "plan_refresh", "refresh", "verdict"]
