"""Query expansion and stop words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import clean_query, strip

# Abbreviations with what they stand for, and words without weight.
SYNONYMS: dict[str, list[str]] = {
    "k8s": ["kubernetes"],
    "kubernetes": ["k8s"],
    "ml": ["machine learning", "机器学习"],
    "dl": ["deep learning", "深度学习"],
    "nlp": ["natural language processing", "自然语言处理"],
    "llm": ["large language model", "大语言模型"],
    "rag": ["retrieval augmented generation", "检索增强生成"],
    "rnn": ["recurrent neural network", "循环神经网络"],
    "cnn": ["convolutional neural network", "卷积神经网络"],
    "gpt": ["generative pre-trained transformer"],
    "bert": ["bidirectional encoder representations from transformers"],
    "api": ["application programming interface", "应用程序接口"],
    "sql": ["structured query language"],
    "db": ["database", "数据库"],
    "os": ["operating system", "操作系统"],
    "ci": ["continuous integration", "持续集成"],
    "cd": ["continuous deployment", "持续部署", "continuous delivery", "持续交付"],
    "devops": ["development operations"],
    "sre": ["site reliability engineering"],
    "vm": ["virtual machine", "虚拟机"],
    "cpu": ["central processing unit", "中央处理器"],
    "gpu": ["graphics processing unit", "图形处理器"],
    "tpu": ["tensor processing unit"],
    "rdbms": ["relational database management system", "关系型数据库"],
    "orm": ["object-relational mapping", "对象关系映射"],
    "rest": ["representational state transfer"],
    "rpc": ["remote procedure call", "远程过程调用"],
    "grpc": ["google remote procedure call"],
    "etl": ["extract transform load"],
    "olap": ["online analytical processing"],
    "oltp": ["online transaction processing"],
}
ENGLISH_STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through",
    "during", "before", "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "because", "but", "and", "or", "if", "while", "about", "please", "help", "want", "tell", "show", "give", "know",
)
CHINESE_STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有",
    "看", "好", "自己", "这", "他", "她", "它", "们", "那", "些", "什么", "怎么", "如何", "哪", "为什么", "请问", "能", "可以", "吗", "吧", "啊", "呢",
    "嗯", "哦", "呀", "哈", "嘿",
)
STOP_WORDS = frozenset(ENGLISH_STOP_WORDS + CHINESE_STOP_WORDS)
MAX_EXPANSIONS = 3


def expand_synonyms(query: Column, most: int = MAX_EXPANSIONS) -> Column:
    """The query, then the query with each synonym of its tokens that it does not hold yet, `most` of them."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    low = F.lower(query)
    tokens = F.regexp_extract_all(low, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    known = F.filter(tokens, lambda t: F.map_contains_key(table, t))
    new = F.filter(F.flatten(F.transform(known, lambda t: F.element_at(table, t))), lambda s: ~F.contains(low, F.lower(s)))
    longer = F.transform(F.array_distinct(new), lambda s: F.concat(query, F.lit(" "), s))
    return F.slice(F.concat(F.array(query), longer), 1, most + 1)


def remove_stop_words(query: Column) -> Column:
    """The query's words that carry weight, or the query if none does."""
    stop = F.array(*map(F.lit, sorted(STOP_WORDS)))
    words = F.filter(F.split(strip(query), r"(?U)\s+"), lambda t: t != "")
    left = F.filter(words, lambda t: ~F.array_contains(stop, F.regexp_replace(F.lower(t), r"^[.,;:!?]+|[.,;:!?]+$", "")))
    return F.when(F.size(left) == 0, query).otherwise(F.array_join(left, " "))


def expand_query(query: Column, most: int = MAX_EXPANSIONS) -> Column:
    """Forms of a query to search for: cleaned, with synonyms, without stop words; `most` besides the first."""
    clean = clean_query(query)
    forms = F.array_distinct(F.concat(expand_synonyms(clean, most), F.array(remove_stop_words(clean))))
    return F.when(clean == "", F.array(query)).otherwise(F.slice(forms, 1, most + 1))
