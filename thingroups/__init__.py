"""Approximate group-by analytics as Spark jobs."""

from thingroups.sources.catalog import Catalog
from thingroups.spec import AggQuery, JoinSpec, Predicate, RunConfig, TableSpec

__all__ = ["AggQuery", "Catalog", "JoinSpec", "Predicate", "RunConfig", "TableSpec"]
