"""Text expressions.  All run in the JVM; (?U) makes Java's classes Unicode ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters but for tab, newline and carriage return.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
CONTROL_AND_DEL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

# Patterns of queries that try to steer a model, case-insensitive.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+(instructions?|prompts?)",
    r"forget\s+(all\s+)?previous\s+(instructions?|context)",
    r"disregard\s+(all\s+)?previous",
    r"you\s+are\s+now\s+a",
    r"pretend\s+you\s+are",
    r"act\s+as\s+if\s+you\s+are",
    r"system\s*:\s*",
    r"<\|im_start\|>",
    r"jailbreak",
    r"sudo\s+mode",
    r"developer\s+mode",
    r"DAN\s+mode",
    r"override\s+(safety|security|filter)",
    r"bypass\s+(safety|security|filter|restriction)",
    r"reveal\s+(your|the)\s+(system|initial|original)\s+(prompt|instruction)",
    r"output\s+your\s+(system|initial)\s+prompt",
)

MAX_QUERY_LENGTH = 2000


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is named, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of word characters, in order; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def space_tokens(c: Column) -> Column:
    """Lower-cased runs of anything but white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\S+"), F.lit(0))


def query_error(c: Column, max_length: int = MAX_QUERY_LENGTH) -> Column:
    """'empty' or 'too_long' where a query may not run, else null; the length is that of the raw query."""
    return F.when(c.isNull() | (strip(c) == ""), "empty").when(F.char_length(c) > max_length, "too_long")


def base_query(c: Column) -> Column:
    """Without control characters and without white space at the ends."""
    return strip(F.regexp_replace(c, CONTROL, ""))


def search_query(c: Column) -> Column:
    """`base_query`, without DEL and with single spaces."""
    return strip(one_space(F.regexp_replace(base_query(c), CONTROL_AND_DEL, "")))


def clean_query(c: Column) -> Column:
    """Single spaces, and no punctuation at either end."""
    spaced = strip(one_space(F.regexp_replace(c, CONTROL_AND_DEL, "")))
    return strip(F.regexp_replace(F.regexp_replace(spaced, r"^[.\-,;:!?]+", ""), r"[.\-,;:!?]+$", ""))


def injection_hits(c: Column) -> Column:
    """The patterns of INJECTION_PATTERNS that the raw query matches, in their order."""
    hits = F.array(*[F.when(F.coalesce(c, F.lit("")).rlike(f"(?iU){p}"), F.lit(p)) for p in INJECTION_PATTERNS])
    return F.array_compact(hits)


def sanitized_query(c: Column, max_length: int = MAX_QUERY_LENGTH) -> Column:
    """struct<query, error>: an injection or an invalid query has an error and no query."""
    error = F.when(F.size(injection_hits(c)) > 0, "injection").otherwise(query_error(c, max_length))
    return F.struct(F.when(error.isNull(), search_query(c)).alias("query"), error.alias("error"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; two empty ones are equal."""

    def overlap(x: Column) -> Column:
        union = F.size(F.array_union(x["a"], x["b"]))
        return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / union)

    return bound(F.struct(a.alias("a"), b.alias("b")), overlap)


def preview(c: Column, length: int = 300) -> Column:
    """The beginning of a text, marked if it goes on."""
    return F.when(F.char_length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def compress_sentences(c: Column) -> Column:
    """Stripped sentences; one ends after a full stop, an exclamation or question mark or a newline."""
    parts = F.split(c, r"(?<=[。！？.!?\n])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def chunk_sentences(c: Column) -> Column:
    """Stripped sentences as chunks are built from: white space after an end belongs to neither."""
    parts = F.split(c, r"(?U)(?<=[。！？.!?])\s*|(?<=\n)\s*")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def occurrences(values: Column) -> Column:
    """Map of each value of an array to how often it occurs; null for null.  By a sort, so long arrays take no square of their length."""

    def counted(s: Column) -> Column:
        places = F.transform(s, lambda _, i: i)
        return bound(F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))), lambda starts: runs(s, starts))

    def runs(s: Column, starts: Column) -> Column:
        sizes = F.transform(starts, lambda i, n: F.coalesce(F.get(starts, n + 1), F.size(s)) - i)
        return F.map_from_arrays(F.transform(starts, lambda i: F.get(s, i)), sizes)

    return bound(F.array_sort(values), counted)
