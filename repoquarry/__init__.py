"""Index snapshots of many code repositories and search them, as Spark jobs."""

from repoquarry.params import IndexParams

__all__ = ["IndexParams"]
