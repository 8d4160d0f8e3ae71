"""Batch sales analytics in three layers (raw, cleaned, aggregated) as Spark DataFrame operators."""

from saleskiln.plans.runs import ingest, merge, refresh, run_all
from saleskiln.session import recommended_conf
from saleskiln.sources.pages import read_pages
from saleskiln.sources.tables import Warehouse

__all__ = ["Warehouse", "ingest", "merge", "read_pages", "recommended_conf", "refresh", "run_all"]
