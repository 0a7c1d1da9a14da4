"""Parsers: one text, many sections or units."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.batches import by_slice
from inkwell.functions.text import strip

_STATE = "array<struct<level:int,title:string>>"

# Section titles with their kind.
SECTION_KINDS = {
    "abstract": "摘要", "introduction": "引言", "intro": "引言", "method": "方法", "methodology": "方法", "approach": "方法",
    "experiment": "实验", "experiments": "实验", "evaluation": "实验", "result": "结果", "results": "结果", "conclusion": "结论",
    "conclusions": "结论", "discussion": "讨论", "related work": "相关工作", "relatedwork": "相关工作", "background": "背景",
    "reference": "参考文献", "references": "参考文献", "bibliography": "参考文献", "acknowledgment": "致谢", "acknowledgements": "致谢",
}
LATEX_LEVELS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph")


def section_paths(headings: Column) -> Column:
    """For an array of (level, title): the path of each, titles joined with ' > '.

    A heading closes those of its level and deeper ones.
    """
    start = F.struct(F.array().cast(_STATE).alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(state: Column, h: Column) -> Column:
        own = F.struct(h["level"].cast("int").alias("level"), h["title"].alias("title"))
        open_ = F.concat(F.filter(state["open"], lambda e: e["level"] < h["level"]), F.array(own))
        return F.struct(open_.alias("open"), F.concat(state["paths"], F.array(F.array_join(F.transform(open_, lambda e: e["title"]), " > "))).alias("paths"))

    return F.aggregate(headings, start, step, lambda s: s["paths"])


def is_code_block(content: Column) -> Column:
    """Whether a section is a fenced block, or fenced for the most part."""
    fences = F.regexp_extract_all(content, F.lit(r"```[\s\S]*?```"), F.lit(0))
    size = F.aggregate(fences, F.lit(0), lambda s, x: s + F.char_length(x))
    return (content.startswith("```") & content.endswith("```")) | (size > 0.8 * F.char_length(content))


def parse_markdown(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each section with content: doc_seq, heading_level, section_path, content, is_code_block.

    The other columns stay.  Text before the first heading is a section of level 0 without a path.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.filter(F.split(text, r"(?md)(?=^#{1,6}\s+.+$)"), lambda x: x != "")
    heading = r"(?d)^(#{1,6})\s+(.+)"

    def section(p: Column) -> Column:
        has = p.rlike(heading)
        return F.struct(
            F.when(has, F.char_length(F.regexp_extract(p, heading, 1))).otherwise(0).cast("int").alias("level"),
            strip(F.regexp_extract(p, heading, 2)).alias("title"),
            strip(F.when(has, F.regexp_replace(p, heading, "")).otherwise(p)).alias("content"),
        )

    rest = [c for c in df.columns if c != text_col]
    cut = df.select(*rest, F.transform(parts, section).alias("_sections"))
    titled = F.filter("_sections", lambda s: s["level"] > 0)
    paths = F.concat(F.when(F.get("_sections", F.lit(0))["level"] == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), section_paths(titled))
    zipped = F.arrays_zip(F.col("_sections").alias("s"), paths.alias("p"))
    each = cut.select(*rest, F.posexplode(F.filter(zipped, lambda x: x["s"]["content"] != "")).alias("doc_seq", "x"))
    return each.select(
        *rest, "doc_seq", F.col("x.s.level").alias("heading_level"), F.col("x.p").alias("section_path"), F.col("x.s.content").alias("content"), is_code_block(F.col("x.s.content")).alias("is_code_block")
    )


def clean_latex(text: Column) -> Column:
    """Text of a LaTeX fragment: references go, commands with one argument leave it, others go."""
    for name in ("label", "ref", "cite", "begin", "end"):
        text = F.regexp_replace(text, rf"\\{name}\{{[^}}]*\}}", "")
    text = F.regexp_replace(text, r"\\[a-zA-Z]+\{([^}]*)\}", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\\[a-zA-Z]+", ""), r"[{}]", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def section_kind(title: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTION_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, strip(F.lower(title))), F.lit(""))


def parse_latex(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each part of a LaTeX source: doc_seq, section_name, section_level, section_path, section_type, content.

    Title and abstract come first; sections keep their order, empty ones too; a body without
    sections is one part of level 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = F.when(text.rlike(r"\\begin\{document\}"), F.regexp_extract(text, r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\z)", 1)).otherwise(text)
    command = r"\\(section|subsection|subsubsection|paragraph|subparagraph)\{([^}]+)\}"
    rest = [c for c in df.columns if c != text_col]

    def part(name: Column, level: Column, content: Column, kind: Column) -> Column:
        return F.struct(name.alias("name"), level.cast("int").alias("level"), content.alias("content"), kind.alias("kind"))

    title, abstract = F.regexp_extract(text, r"\\title\{([^}]+)\}", 1), F.regexp_extract(text, r"\\begin\{abstract\}([\s\S]*?)\\end\{abstract\}", 1)
    front = F.concat(
        F.when(text.rlike(r"\\title\{[^}]+\}"), F.array(part(F.lit("标题"), F.lit(0), strip(title), F.lit("标题")))).otherwise(F.array().cast("array<struct<name:string,level:int,content:string,kind:string>>")),
        F.when(text.rlike(r"\\begin\{abstract\}[\s\S]*?\\end\{abstract\}"), F.array(part(F.lit("摘要"), F.lit(0), strip(abstract), F.lit("摘要")))).otherwise(F.array().cast("array<struct<name:string,level:int,content:string,kind:string>>")),
    )
    pieces = F.filter(F.split(body, rf"(?={command})"), lambda x: x.rlike(rf"^{command}"))
    level = F.create_map(*[F.lit(x) for i, k in enumerate(LATEX_LEVELS) for x in (k, i + 1)])

    def section(p: Column) -> Column:
        name = strip(F.regexp_extract(p, command, 2))
        return part(name, F.element_at(level, F.regexp_extract(p, command, 1)), clean_latex(F.regexp_replace(p, rf"^{command}", "")), section_kind(name))

    cut = df.select(*rest, front.alias("_front"), F.transform(pieces, section).alias("_sections"), clean_latex(body).alias("_body"))
    paths = section_paths(F.transform("_sections", lambda s: F.struct(s["level"].alias("level"), s["name"].alias("title"))))
    no_path = F.transform("_front", lambda s: s["name"])
    whole = F.when((F.size("_sections") == 0) & (F.col("_body") != ""), F.array(part(F.lit("body"), F.lit(0), F.col("_body"), F.lit("")))).otherwise(F.col("_sections"))
    paths = F.when(F.size("_sections") == 0, F.array(F.lit("body"))).otherwise(paths)
    zipped = F.concat(F.arrays_zip(F.col("_front").alias("s"), no_path.alias("p")), F.filter(F.arrays_zip(whole.alias("s"), paths.alias("p")), lambda x: x["s"].isNotNull()))
    each = cut.select(*rest, F.posexplode(zipped).alias("doc_seq", "x"))
    return each.select(
        *rest, "doc_seq", F.col("x.s.name").alias("section_name"), F.col("x.s.level").alias("section_level"), F.col("x.p").alias("section_path"), F.col("x.s.kind").alias("section_type"), F.col("x.s.content").alias("content")
    )


UNITS = (
    "array<struct<type:string,name:string,class_name:string,line:int,end_line:int,signature:string,docstring:string,content:string,imports:array<string>,error:string>>"
)


def _signature(lines: list[str], node: ast.AST) -> str:
    """The header up to its first colon, or whole if its first line has none."""
    header = lines[node.lineno - 1 : max(node.body[0].lineno - 1, node.lineno)]
    first = header[0] if header else ""
    if node.body[0].lineno == node.lineno:
        return ""
    return first[: first.index(":")].strip() if ":" in first else "\n".join(header).strip()


#: What the parser raises: for bad sources, for null characters, and for sources that are nested or chained too deeply for it.
UNPARSED = (SyntaxError, ValueError, MemoryError, RecursionError)


def code_units(source: str) -> list[dict]:
    """Docstring, functions, classes and methods of a Python module, in source order; a source that cannot be parsed is one unit with an error."""
    try:
        tree = ast.parse(source)
    except UNPARSED as e:
        kind = "syntax" if isinstance(e, (SyntaxError, ValueError)) else "too deep"
        return [{"type": None, "error": f"{kind}: {e}"}]
    lines = source.splitlines()
    imports = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [f"{node.module}.{a.name}" if node.module else a.name for a in node.names]
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def span(node: ast.AST) -> str:
        return "\n".join(lines[node.lineno - 1 : node.end_lineno])

    def unit(kind: str, node: ast.AST, owner: str = "", content: str | None = None, signed: bool = True) -> dict:
        return {
            "type": kind, "name": node.name, "class_name": owner, "line": node.lineno, "end_line": node.end_lineno, "signature": _signature(lines, node) if signed else None,
            "docstring": ast.get_docstring(node) or "", "content": span(node) if content is None else content, "imports": imports,
        }

    out = []
    if doc := ast.get_docstring(tree):
        out.append({"type": "module_docstring", "name": "", "class_name": "", "line": 1, "content": doc, "docstring": doc, "imports": imports})
    for node in tree.body:
        if isinstance(node, functions):
            out.append(unit("function", node))
        elif isinstance(node, ast.ClassDef):
            header = "\n".join(lines[node.lineno - 1 : node.body[0].lineno - 1])
            doc = ast.get_docstring(node)
            out.append(unit("class", node, node.name, f"{header}\n{doc}" if doc else header, signed=False))
            out += [unit("method", m, node.name) for m in node.body if isinstance(m, functions)]
    return out


def parse_code(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each unit of Python sources; a source that does not parse is one row with an error."""

    keys = ("type", "name", "class_name", "line", "end_line", "signature", "docstring", "content", "imports", "error")
    units = by_slice(UNITS, lambda t: [{k: u.get(k) for k in keys} for u in code_units(t or "")])
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(units(F.col(text_col))).alias("doc_seq", "_u")).select(*rest, "doc_seq", "_u.*")


def class_chunks(content: str, most: int = 3000) -> list[tuple[str, str]]:
    """(chunk type, content) of a class: whole if it is small, else header, methods and the rest."""
    try:
        tree = ast.parse(content)
    except UNPARSED:
        tree = None
    node = next((n for n in tree.body if isinstance(n, ast.ClassDef)), None) if tree else None
    if len(content) <= most or node is None:
        return [("ast_class", content)]
    lines = content.splitlines()
    out = [("ast_class_header", "\n".join(lines[node.lineno - 1 : node.body[0].lineno - 1]))]
    for n in node.body:
        kind = "ast_method" if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) else "ast_class_body"
        out.append((kind, "\n".join(lines[n.lineno - 1 : n.end_lineno])))
    return [(k, c) for k, c in out if c.strip()]


def llm_items(df: DataFrame, json_col: str = "text") -> DataFrame:
    """Items of JSON documents: a list, an object's `chunks`, else its `documents`, else the object itself.

    Adds content, source, chunk_type, doc_hash, metadata (JSON text) and error ('json' or 'item').
    """
    item = "struct<content:string,source:string,chunk_type:string,doc_hash:string,metadata:string>"
    whole = F.try_parse_json(F.col(json_col))

    def at(path: str) -> Column:
        return F.try_variant_get(whole, path, f"array<{item}>")

    single = F.try_variant_get(whole, "$", item)
    items = F.coalesce(at("$"), at("$.chunks"), at("$.documents"), F.when(single.isNotNull(), F.array(single)))
    rest = [c for c in df.columns if c != json_col]
    each = df.select(*rest, whole.isNull().alias("_bad"), F.posexplode_outer(items).alias("doc_seq", "_i"))
    ok = F.col("_i.content").isNotNull()
    return each.select(
        *rest, "doc_seq", F.col("_i.content").alias("content"), F.col("_i.source").alias("source"), F.coalesce("_i.chunk_type", F.lit("text")).alias("chunk_type"),
        F.coalesce("_i.doc_hash", F.lit("")).alias("doc_hash"), F.col("_i.metadata").alias("metadata"), F.when(F.col("_bad"), "json").when(~ok, "item").alias("error"),
    )


def pdf_pages(df: DataFrame, content_col: str = "content") -> DataFrame:
    """A row for each page with text of PDF files; a file that cannot be read is one row with an error.

    Needs the optional package pypdf on the workers; without it every file is an error.
    """
    schema = "array<struct<doc_seq:int,page_number:int,total_pages:int,content:string,error:string>>"

    pages = by_slice(schema, _pages_or_error)
    rest = [c for c in df.columns if c != content_col]
    return df.select(*rest, F.explode(pages(F.col(content_col))).alias("_p")).select(*rest, "_p.*")


def _pages_or_error(content: bytes) -> list[dict]:
    try:
        return [{"doc_seq": p["page_number"] - 1, **p, "error": None} for p in _pages(content)]
    except Exception as e:  # whatever pypdf meets in a broken file
        return [{"doc_seq": 0, "page_number": None, "total_pages": None, "content": None, "error": f"pdf: {e}"}]


def _pages(content: bytes) -> Iterator[dict]:
    from io import BytesIO

    from pypdf import PdfReader

    pages = PdfReader(BytesIO(content)).pages
    for i, page in enumerate(pages):
        if text := (page.extract_text() or "").strip():
            yield {"page_number": i + 1, "total_pages": len(pages), "content": text}
