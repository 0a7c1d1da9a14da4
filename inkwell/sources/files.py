"""File sources: scanning, checking, skipping what is known, parsing by suffix, and exports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.hashing import filled_hash
from inkwell.operators import chunking, parsing

# Suffixes that may be read, and the largest file.
ALLOWED = (".md", ".pdf", ".py", ".tex", ".txt", ".json", ".jsonl", ".yaml", ".yml", ".html", ".rst", ".csv", ".xml")
MAX_BYTES = 50 * 1024 * 1024


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def scan_files(spark: SparkSession, path: str | list[str], suffixes: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Files below a folder (or at given paths) by lower-cased suffix: path, suffix, length, content, error.

    Too large or unsupported files are rows with an error, from a listing that does not open them.
    Of the others, the filter on the length reaches the scan and stands before their contents.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).withColumn("suffix", suffix(F.col("path")))
    if suffixes is not None:
        files = files.filter(F.col("suffix").isin(*suffixes))
    allowed = F.col("suffix").isin(*ALLOWED)
    good = files.filter(F.col("length") <= MAX_BYTES).filter(allowed).select("path", "suffix", "length", "content", F.lit(None).cast("string").alias("error"))
    error = F.when(~allowed, "unsupported").when(F.col("length") > MAX_BYTES, "too_large")
    listed = files.select("path", "suffix", "length", F.lit(None).cast("binary").alias("content"), error.alias("error"))
    return good.unionByName(listed.filter("error is not null"))


def path_key(path: Column) -> Column:
    """What orders paths component by component, so that a folder's files stay together."""
    return F.split(path, "/")


def inside(path: Column, base: str) -> Column:
    """Whether a path lies in a folder, compared by whole components."""
    base = base.rstrip("/") + "/"
    return F.startswith(F.regexp_replace(path, "^file:/*", "/"), F.lit(base))


def new_files(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose content is not in `processed` (file_hash), one for each content: the first by path."""
    hashed = files.filter("error is null").withColumn("file_hash", F.sha2("content", 256))
    first = hashed.groupBy("file_hash").agg(F.min("path").alias("path"))
    unseen = first.join(processed.select("file_hash").distinct(), "file_hash", "left_anti")
    return hashed.join(unseen, ["file_hash", "path"], "left_semi")


Chunker = Callable[..., DataFrame]


#: What all chunkers give.
CHUNK = ["path", "doc_seq", "chunk_index", "total_chunks", "content", "doc_hash", "chunk_type", "metadata"]
#: Columns of parsed rows that are no metadata.
_PLAIN = {"path", "doc_seq", "content", "text", "error", "source", "chunk_type", "doc_hash", "metadata"}


def _metadata(parsed: DataFrame) -> Column:
    """What a parser found out about a part, as a map of strings; nulls are left out."""
    pairs = [F.struct(F.lit(c).alias("key"), (F.to_json(c) if t.startswith("array") else F.col(c).cast("string")).alias("value")) for c, t in parsed.dtypes if c not in _PLAIN]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))


def _code_chunks(units: DataFrame, max_class_size: int = 3000) -> DataFrame:
    """A chunk for each unit of code; a class that is larger is cut, where its text parses by itself."""

    @F.pandas_udf("array<struct<chunk_type:string,content:string>>")
    def cut(contents: pd.Series) -> pd.Series:
        return pd.Series([[{"chunk_type": k, "content": c} for k, c in parsing.class_chunks(t, max_class_size)] for t in contents])

    kind = chunking.code_chunk_type(F.col("type"))
    good = units.filter("error is null").withColumn("metadata", F.map_concat(_metadata(units), F.create_map(F.lit("chunk_type_name"), kind)))
    large = (F.col("type") == "class") & (F.char_length("content") > max_class_size)
    whole = F.array(F.struct(kind.alias("chunk_type"), F.col("content").alias("content")))
    parts = [good.filter(~F.coalesce(large, F.lit(False))).withColumn("_parts", whole), good.filter(large).withColumn("_parts", cut("content"))]
    each = parts[0].unionByName(parts[1]).select("path", "doc_seq", "metadata", F.size("_parts").alias("total_chunks"), F.posexplode("_parts").alias("chunk_index", "_part"))
    return each.select("path", "doc_seq", "chunk_index", "total_chunks", "_part.content", filled_hash(F.lit(""), F.col("_part.content")).alias("doc_hash"), "_part.chunk_type", "metadata")


def _llm_chunks(items: DataFrame) -> DataFrame:
    """The items of JSON documents as they are; an item without a source has its file's path, and one without a hash its content's."""
    given = F.from_json(F.col("metadata"), "map<string,string>")
    return items.select(
        F.coalesce(F.nullif("source", F.lit("")), "path").alias("path"), "doc_seq", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), "content",
        filled_hash(F.col("doc_hash"), F.col("content")).alias("doc_hash"), "chunk_type", F.coalesce(given, F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def _of_content(chunker: Chunker) -> Chunker:
    def run(parsed: DataFrame, **config: object) -> DataFrame:
        parts = parsed.select("path", "doc_seq", F.col("content").alias("text"), _metadata(parsed).alias("metadata"))
        return chunker(parts, **config).select(*CHUNK)

    return run


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "markdown": parsing.parse_markdown,
    "paper": parsing.parse_latex,
    "code": parsing.parse_code,
    "llm": parsing.llm_items,
    "pdf": parsing.pdf_pages,
}
#: Parsers of bytes; the others take text.
BINARY = ("pdf",)
CHUNKERS: dict[str, Chunker] = {
    "structure": _of_content(chunking.chunk_structure),
    "recursive": _of_content(chunking.chunk_recursive),
    "semantic": _of_content(chunking.chunk_semantic),
    "ast": _code_chunks,
    "llm": _llm_chunks,
}


@dataclass
class Strategy:
    """How files of one suffix are read."""

    parser: str
    chunker: str
    config: dict = field(default_factory=dict)


class Strategies:
    """Strategies by suffix; new ones can be registered or read from YAML."""

    def __init__(self) -> None:
        self.by_suffix = {
            ".md": Strategy("markdown", "structure", {"overlap": 50}),
            ".pdf": Strategy("pdf", "recursive", {"size": 1000, "overlap": 150}),
            ".py": Strategy("code", "ast"),
            ".tex": Strategy("paper", "structure", {"overlap": 100}),
        }

    def register(self, suffix: str, parser: str, chunker: str, **config: object) -> None:
        if parser not in PARSERS or chunker not in CHUNKERS:
            raise ValueError(f"unknown parser or chunker: {parser}, {chunker}")
        if (chunker == "llm" and parser != "llm") or (chunker == "ast" and parser != "code"):
            raise ValueError(f"the chunker {chunker} cannot take what the parser {parser} gives")
        self.by_suffix[suffix.lower() if suffix.startswith(".") else f".{suffix.lower()}"] = Strategy(parser, chunker, dict(config))

    def get(self, suffix: str) -> Strategy:
        return self.by_suffix[suffix.lower() if suffix.startswith(".") else f".{suffix.lower()}"]

    def load_yaml(self, text: str) -> None:
        """Strategies from `{strategies: {suffix: {parser, chunker, config}}}` or the inner mapping alone."""
        import yaml

        found = yaml.safe_load(text)
        if not isinstance(found, dict):
            raise ValueError("a mapping is expected")
        for suffix, s in found.get("strategies", found).items():
            if not isinstance(s, dict) or "parser" not in s or "chunker" not in s:
                raise ValueError(f"{suffix}: parser and chunker are needed")
            self.register(suffix, s["parser"], s["chunker"], **(s.get("config") or {}))


def read_chunks(files: DataFrame, strategies: Strategies | None = None) -> DataFrame:
    """Chunks of files (path, suffix, content): one branch for each strategy, then their union.

    What cannot be parsed, or is no UTF-8, is a row with an error and without content; nothing else of
    such a file comes out.
    """
    strategies = strategies or Strategies()
    out = None
    for suffix_, s in strategies.by_suffix.items():
        own = files.filter(F.col("suffix") == suffix_).select("path", "content")
        failed = []
        if s.parser not in BINARY:
            text = own.select("path", F.col("content").cast("string").alias("text"))
            failed.append(text.filter(~F.is_valid_utf8("text")).select("path", F.lit("encoding").alias("error")))
            own = text.filter(F.is_valid_utf8("text"))
        parsed = PARSERS[s.parser](own)
        good = parsed
        if "error" in parsed.columns:
            bad = parsed.filter("error is not null").select("path", "error")
            failed.append(bad.distinct())
            good = parsed.filter("error is null").join(bad.select("path"), "path", "left_anti") if s.parser == "llm" else parsed.filter("error is null")
        chunks = CHUNKERS[s.chunker](good, **s.config).withColumn("error", F.lit(None).cast("string"))
        for x in failed:
            chunks = chunks.unionByName(x, allowMissingColumns=True)
        out = chunks if out is None else out.unionByName(chunks)
    return out.withColumnRenamed("path", "source")


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that have a content and a source."""
    return chunks.filter("content is not null and source is not null")


def export_chunks(chunks: DataFrame, path: str, format: str = "jsonl") -> None:
    """Chunks as JSON: 'jsonl' is an object a line; 'json' is one array, indented by two.

    One array is one file, so one task writes it, row by row; for large tables there is 'jsonl'.
    """
    if format == "jsonl":
        chunks.write.mode("overwrite").json(path)
    elif format == "json":

        def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            before = "["
            for x in batches:
                for text in x["x"]:
                    own = json.dumps(json.loads(text), ensure_ascii=False, indent=2).split("\n")
                    yield pd.DataFrame({"value": [before, *("  " + line for line in own[:-1])]})
                    before = "  " + own[-1] + ","
            yield pd.DataFrame({"value": [before[:-1], "]"]})

        if chunks.isEmpty():  # which may have no task to write anything
            chunks.sparkSession.range(1).select(F.lit("[]").alias("value")).coalesce(1).write.mode("overwrite").text(path)
            return
        rows = chunks.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("x"))
        rows.coalesce(1).mapInPandas(lines, "value string").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {format}")
