"""Chunkers: ordered folds over the parts of a text.

A fold needs the parts in order and keeps a little state, so each text is cut in
its own task by a helper; Spark deals the texts out and explodes the chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.batches import by_slice
from inkwell.functions.hashing import content_hash
from inkwell.functions.vectors import cosine

SEPARATORS = ("\n\n", "\n", "。", ".", " ", "")
_SENTENCE_END = re.compile(r"(?<=[。！？.!?])\s*|(?<=\n)\s*")


def _flush(parts: Sequence[str], most: int, overlap: int, joiner: str) -> Iterator[str]:
    """Parts joined until the next would exceed `most`; the end of a chunk begins the next."""
    current = ""
    for part in parts:
        if current and len(current) + len(part) > most:
            yield current
            current = (current[-overlap:] if overlap else "") + joiner + part if overlap else part
        else:
            current = current + joiner + part if current else part
    if current.strip():
        yield current


def structure_chunks(text: str, most: int = 2000, overlap: int = 50, separator: str = "\n\n") -> list[tuple[str, str]]:
    """(content, text that is hashed) of each chunk: paragraphs together, up to a size; a long paragraph stays whole."""
    if len(text) <= most:
        return [(text, text)]
    parts = [p for x in text.split(separator) if (p := x.strip())]
    return [(c.strip(), c) for c in _flush(parts, most, overlap, separator)]


def sentences_of(text: str) -> list[str]:
    return [s for x in _SENTENCE_END.split(text) if (s := x.strip())]


def length_chunks(text: str, most: int = 2000, overlap: int = 50) -> list[tuple[str, str]]:
    """Sentences together, up to a size; one sentence or none leaves the text whole."""
    parts = sentences_of(text)
    if len(parts) <= 1:
        return [(text, text)]
    return [(c.strip(), c) for c in _flush(parts, most, overlap, " ")]


def split_oversize(text: str, most: int) -> list[tuple[str, str]]:
    """(content, text that is hashed) of the parts of a text, each of at most `most` + 1 characters.

    A cut follows the last full stop of the first `most` characters, else their last space, else comes after
    one more.  A part of white space alone is an empty chunk, but for the last.
    """
    out = []
    while len(text) > most:
        at = text.rfind("。", 0, most)
        if at < 0:
            at = text.rfind(" ", 0, most)
        if at < 0:
            at = most
        part = text[: at + 1].strip()
        out.append((part, part))
        text = text[at + 1 :]
    return [*out, (text.strip(), text)] if text.strip() else out


def oversize_parts(df: DataFrame, text_col: str = "text", most: int = 2000) -> DataFrame:
    return _applied(df, text_col, lambda t: split_oversize(t, most), "semantic")


def semantic_chunks(sentences: Sequence[str], breaks: Sequence[int], least: int = 100, most: int = 2000) -> list[tuple[str, str]]:
    """(content, text that is hashed) between breaks; a short chunk joins the next one, a long one is split."""
    out, start = [], 0
    ends = [*sorted(breaks), len(sentences)]
    for end in ends:
        if end <= start:
            continue
        content = " ".join(sentences[start:end])
        if len(content) < least and end < len(sentences):
            continue
        out += split_oversize(content, most) if len(content) > most else [(content, content)]
        start = end
    return out


def _merge(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            if text := "".join(held).strip():
                yield text
            while total > overlap or (total and total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if text := "".join(held).strip():
        yield text


def recursive_chunks(text: str, size: int = 500, overlap: int = 100, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` where a separator allows, the coarsest first; a separator begins its part."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        first, *rest = text.split(mark)
        parts = [p for p in [first, *(mark + x for x in rest)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    fitting: list[str] = []
    for part in parts:
        if len(part) < size:
            fitting.append(part)
            continue
        out += _merge(fitting, size, overlap)
        fitting = []
        out += recursive_chunks(part, size, overlap, finer) if finer else [part]
    return out + list(_merge(fitting, size, overlap))


def _applied(df: DataFrame, text_col: str, cut: Callable[[str], list[tuple[str, str]]], chunk_type: str) -> DataFrame:
    """One row for each chunk; the columns of `df` stay."""

    chunks = by_slice("array<struct<content:string,hashed:string>>", lambda t: [{"content": c, "hashed": h} for c, h in cut(t)] if t is not None else [])
    cut_ = df.withColumn("_chunks", chunks(F.col(text_col)))
    each = cut_.select(*df.columns, F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "_chunk"))
    return each.select(
        *df.columns,
        "chunk_index",
        "total_chunks",
        F.col("_chunk.content").alias("content"),
        content_hash(F.col("_chunk.hashed")).alias("doc_hash"),
        F.lit(chunk_type).alias("chunk_type"),
    )


def chunk_structure(df: DataFrame, text_col: str = "text", most: int = 2000, overlap: int = 50, separator: str = "\n\n") -> DataFrame:
    return _applied(df, text_col, lambda t: structure_chunks(t, most, overlap, separator), "structure")


def chunk_length(df: DataFrame, text_col: str = "text", most: int = 2000, overlap: int = 50) -> DataFrame:
    return _applied(df, text_col, lambda t: length_chunks(t, most, overlap), "semantic_length")


def chunk_recursive(df: DataFrame, text_col: str = "text", size: int = 500, overlap: int = 100, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    return _applied(df, text_col, lambda t: [(c, c) for c in recursive_chunks(t, size, overlap, separators)], "recursive")


def chunk_semantic(
    df: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, text_col: str = "text", threshold: float = 0.5, least: int = 100, most: int = 2000
) -> DataFrame:
    """Chunks between sentences that are unlike each other; without `embed`, chunks by length."""
    if embed is None:
        return chunk_length(df, text_col, most)

    def cut(text: str) -> list[tuple[str, str]]:
        parts = sentences_of(text)
        if len(parts) <= 1:
            return [(text, text)]
        vectors = embed(parts)
        breaks = [i + 1 for i in range(len(parts) - 1) if _cosine(vectors[i], vectors[i + 1]) < threshold]
        return semantic_chunks(parts, breaks, least, most)

    return _applied(df, text_col, cut, "semantic")


def _cosine(a: list[float], b: list[float]) -> float:
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0


def semantic_breaks(sentences: DataFrame, doc_col: str, order_col: str, vector_col: str, threshold: float = 0.5) -> DataFrame:
    """Each sentence's similarity to the next of its document, and whether a chunk ends between them."""
    after = F.lead(vector_col).over(Window.partitionBy(doc_col).orderBy(order_col))
    return (
        sentences.select(doc_col, order_col, F.col(vector_col).alias("_a"), after.alias("_b"))
        .filter("_b is not null")
        .select(doc_col, order_col, cosine(F.col("_a"), F.col("_b")).alias("similarity"))
        .withColumn("is_break", F.col("similarity") < threshold)
    )


def code_chunk_type(kind: Column) -> Column:
    """Chunk type of a code unit by its kind."""
    return F.when(kind.isin("function", "method"), "ast_function").when(kind == "class", "ast_class").when(kind == "module_docstring", "ast_docstring").otherwise("ast_generic")
