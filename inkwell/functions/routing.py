"""Routing of queries to retrieval strategies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import bound, strip

# Keywords that count for code and for papers, and the weights of each kind of query.
CODE_KEYWORDS = (
    "函数", "function", "实现", "implement", "代码", "code", "类", "class", "方法", "method", "api", "接口", "import", "def", "return", "变量",
    "variable", "模块", "module", "包", "package", "库", "library", "调试", "debug", "编译", "compile", "运行", "run", "部署", "deploy",
    "参数", "parameter", "argument", "回调", "callback", "继承", "inherit", "封装", "encapsulate", "多态", "polymorphism",
)
PAPER_KEYWORDS = (
    "论文", "paper", "研究", "research", "实验", "experiment", "算法", "algorithm", "模型", "model", "精度", "accuracy", "基准", "benchmark",
    "数据集", "dataset", "训练", "training", "推理", "inference", "微调", "finetune", "预训练", "pretrain", "损失函数", "loss function",
    "优化", "optimization", "收敛", "convergence", "消融", "ablation", "SOTA", "state-of-the-art",
)
PRESETS = {
    "paper": (0.65, 0.35, 0.0, "paper"),
    "doc": (0.6, 0.4, 0.0, "doc"),
    "code": (0.4, 0.6, 0.0, "code"),
    "general": (0.6, 0.4, 0.0, None),
}


def language(query: Column) -> Column:
    """zh, en, or mixed if there are as many ideographs as Latin letters."""
    zh, en = F.regexp_count(query, F.lit("[一-鿿]")), F.regexp_count(query, F.lit("[a-zA-Z]"))
    return F.when(zh > en, "zh").when(en > zh, "en").otherwise("mixed")


def length_class(query: Column) -> Column:
    n = F.char_length(strip(query))
    return F.when(n <= 10, "short").when(n <= 50, "medium").otherwise("long")


def keyword_hits(query: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords occur anywhere in the lower-cased query."""
    low = F.lower(query)
    return F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)))


def _kind(code: Column, paper: Column) -> Column:
    return F.when((code > paper) & (code >= 2), "code").when((paper > code) & (paper >= 2), "paper").otherwise("general")


def query_kind(query: Column) -> Column:
    return bound(F.struct(keyword_hits(query, CODE_KEYWORDS).alias("c"), keyword_hits(query, PAPER_KEYWORDS).alias("p")), lambda n: _kind(n["c"], n["p"]))


def route(query: Column) -> Column:
    """struct<dense, sparse, bm25, doc_type_filter>: the weights of a query's kind, moved by length and language."""
    return bound(F.struct(query_kind(query).alias("kind"), length_class(query).alias("size"), language(query).alias("lang")), _based)


def _based(q: Column) -> Column:
    names = ("dense", "sparse", "bm25", "filter")
    preset = [F.struct(*[F.lit(v).cast("string" if n == "filter" else "double").alias(n) for n, v in zip(names, PRESETS[k], strict=True)]) for k in ("code", "paper", "general")]
    based = F.when(q["kind"] == "code", preset[0]).when(q["kind"] == "paper", preset[1]).otherwise(preset[2])
    return bound(based, lambda p: bound(_moved(p, q["size"], q["lang"]), _shares))


def _moved(p: Column, size: Column, lang: Column) -> Column:
    dense = F.when(size == "short", F.greatest(p["dense"] - 0.1, F.lit(0.3))).when(size == "long", F.least(p["dense"] + 0.1, F.lit(0.7))).otherwise(p["dense"])
    sparse = F.when(size == "short", F.least(p["sparse"] + 0.1, F.lit(0.6))).when(size == "long", F.greatest(p["sparse"] - 0.1, F.lit(0.2))).otherwise(p["sparse"])
    sparse = F.when(lang == "zh", F.least(sparse + 0.05, F.lit(0.6))).otherwise(sparse)
    return F.struct(dense.alias("dense"), sparse.alias("sparse"), p["bm25"].alias("bm25"), p["filter"].alias("filter"))


def _shares(w: Column) -> Column:
    total = w["dense"] + w["sparse"] + w["bm25"]
    share = [F.when(total > 0, w[n] / total).otherwise(w[n]).alias(n) for n in ("dense", "sparse", "bm25")]
    return F.struct(*share, w["filter"].alias("doc_type_filter"))


def route_weights(strategy: Column) -> Column:
    """A strategy's weights as a map."""
    return F.create_map(*[x for k in ("dense", "sparse", "bm25") for x in (F.lit(k), strategy[k])])
