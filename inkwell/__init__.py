"""Document retrieval and corpus preparation as Spark jobs."""

from inkwell.settings import Settings

__all__ = ["Settings"]
