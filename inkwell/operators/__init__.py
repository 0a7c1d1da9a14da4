"""Parsing, chunking, governance, search, ranking and metrics."""

from inkwell.operators.chunking import chunk_length, chunk_recursive, chunk_semantic, chunk_structure
from inkwell.operators.governance import copyright_columns, detect_license, pii_findings, redact
from inkwell.operators.metrics import evaluate, latency_stats, query_metrics
from inkwell.operators.parsing import llm_items, parse_code, parse_latex, parse_markdown, pdf_pages
from inkwell.operators.ranking import compress, rerank
from inkwell.operators.search import Bm25, dense_topk, fuse, hybrid, lexical_topk, sparse_topk

__all__ = [
    "Bm25",
    "chunk_length",
    "chunk_recursive",
    "chunk_semantic",
    "chunk_structure",
    "compress",
    "copyright_columns",
    "dense_topk",
    "detect_license",
    "evaluate",
    "fuse",
    "hybrid",
    "latency_stats",
    "lexical_topk",
    "llm_items",
    "parse_code",
    "parse_latex",
    "parse_markdown",
    "pdf_pages",
    "pii_findings",
    "query_metrics",
    "redact",
    "rerank",
    "sparse_topk",
]
