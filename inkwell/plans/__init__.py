"""Whole runs: indexing, search, benchmarks."""

from inkwell.plans.bench import Benchmark
from inkwell.plans.index import index_chunks, index_folder, search_points

__all__ = [
    "Benchmark",
    "index_chunks",
    "index_folder",
    "search_points",
]
