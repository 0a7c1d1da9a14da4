"""Personal data by bootstrapped contextual extraction.

Exact formats give seed entities.  The words around them are lexical patterns.
A graph links patterns to the instances they occur with; Spark scores it in
rounds: a pattern is as good as its instances, an instance as its patterns.
Patterns of high confidence then mark what stands in their place elsewhere, if
it looks like an identifier, in formats that no rule knows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, join_hot, materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring.
ROUNDS = 3
#: A pattern is used if it has this many different instances and its score, bounded from below, is this high.
MIN_INSTANCES = 10
MIN_SCORE = 0.8
#: An instance counts as an entity of a kind from this score on.
ENTITY = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every entity and every candidate holds.
_HINT = re.compile(r"[0-9@]")
_TRIM = "\"'`,;:.!?()[]{}<>="
#: Groups of an identifier that has spaces, and what may stand between two of them: a space or two, with a sign or some capitals.
_GROUP = re.compile(r"[0-9][0-9()./-]*|[A-Za-z]{1,4}[0-9]{1,4}[A-Za-z]{0,2}|(?=[A-Z]*[0-9])[A-Z0-9]{2,6}")
_SPACE = r"[^\S\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]{1,2}"
_GAP = re.compile(rf"{_SPACE}(?:(?:[/–-]|[A-Z]{{2,4}}){_SPACE})?")
#: Letters and digits of the longest identifier that has spaces (an IBAN).
LONGEST = 34
#: Characters that are read at first on each side of a candidate for its context; more are read until the words are whole.
CONTEXT = 64
#: A pattern of more characters goes by its digest.
LONG_PATTERN = 256


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address format, found from their @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        tail = _DOMAIN.match(text, at + 1)
        if tail:
            begin = at
            while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
                begin -= 1
            if begin < at:
                yield begin, tail.end()
                done = tail.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers of at most 255 with dots between; longer chains are cut every four."""
    for chain in _NUMBERS.finditer(text):
        if chain[0].count(".") < 3:
            continue
        at, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


_BASE = (_emails, _addresses, _cards, _phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every entity of a known format."""
    if not _HINT.search(text):
        return []
    return sorted((a, k, b) for k, find in enumerate(_BASE) for a, b in find(text))


def _before(text: str, a: int) -> list[str]:
    """The last two words before a place, whole."""
    size = CONTEXT
    while True:
        left = text[max(0, a - size) : a]
        words = left.split()
        if a > size and words and not left[0].isspace():
            words = words[1:]  # the first may be cut
        if len(words) > 1 or a <= size:
            return words[-2:]
        size *= 4


def _after(text: str, b: int) -> list[str]:
    """The first word after a place, whole."""
    size = CONTEXT
    while True:
        right = text[b : b + size]
        words = right.split(maxsplit=1)
        if b + size >= len(text) or (words and (len(words) > 1 or right[-1].isspace())):
            return words[:1]
        size *= 4


def _contexts(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns at a span: what leads to it in its token, one and two words before, one word after."""
    before, after = [w.lower() for w in _before(text, a)], [w.lower() for w in _after(text, b)]
    out = []
    if before:
        out.append(f"{before[-1]}_")
    if len(before) > 1:
        out.append(f"{before[-2]} {before[-1]}_")
    if before and after:
        out.append(f"{before[-1]}_{after[0]}")
    return [p if len(p) <= LONG_PATTERN else hashlib.md5(p.encode("utf-8", "surrogatepass")).hexdigest() for p in out]


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, list[str]]]:
    """(start, end, instance, kind or -1, patterns) of the seeds and of what else looks like an identifier.

    Groups of digits beside each other in a line are one identifier, up to LONGEST letters and digits.
    """
    out = [(a, b, text[a:b], k, _contexts(text, a, b)) for a, k, b in spans]
    starts = [a for a, _, _ in spans]
    latest, reach = [], 0
    for _, _, b in spans:
        reach = max(reach, b)
        latest.append(reach)

    def add(a: int, b: int) -> None:
        opened = text.count("(", a, b) - text.count(")", a, b)
        if opened < 0 and text[a - 1 : a] == "(":
            a -= 1
        elif opened > 0 and text[b : b + 1] == ")":
            b += 1
        token = text[a:b]
        if b - a >= 5 and ("@" in token or sum(map(str.isdigit, token)) >= 2):
            out.append((a, b, token, -1, _contexts(text, a, b)))

    run: tuple[int, int] | None = None  # groups that may go on, where they end, and their letters and digits
    ended = length = at = 0
    while hint := _HINT.search(text, at):
        begin, end = hint.start(), hint.end()
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        size = len(text)
        while end < size and not text[end].isspace():
            end += 1
        at = end
        first, token = begin, text[begin:end]
        cut = max(token.rfind("="), token.rfind(":")) + 1  # what a key introduces
        if 0 < cut < len(token):
            begin, token = begin + cut, token[cut:]
        a, b = begin + len(token) - len(token.lstrip(_TRIM)), end - len(token) + len(token.rstrip(_TRIM))
        if a >= b:
            continue
        i = bisect_right(starts, b - 1)
        seed = i and latest[i - 1] > a
        group = not seed and _GROUP.fullmatch(text, a, b)
        own = sum(map(str.isalnum, text[a:b])) if group else 0
        if run:
            between = text[ended:first]
            if group and first == begin and text[begin:a] in ("", "(") and length + own <= LONGEST and len(between) <= 9 and _GAP.fullmatch(between):
                run, length = (run[0], b), length + own
            else:
                add(*run)
                run = None
        if not run:
            if group:
                run, length = (a, b), own
            elif not seed:
                add(a, b)
        if run:
            ended = end
            if text[b:end] not in ("", ")"):  # a sign ends it
                add(*run)
                run = None
    if run:
        add(*run)
    return out


def find_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` as (doc_id, h, base, found), h a hash of the text: spans of known formats, and those that patterns found.

    base and found are arrays of (start, kind, end); kind is a place in KINDS, offsets are code
    points, ends exclusive.  See `personal_data` for the cases.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts = ["" if t is None else t for t in x["text"]]
            spans = [base_spans(t) for t in texts]
            yield pd.DataFrame(
                {
                    "doc_id": x["doc_id"],
                    "row": x["row"],
                    "h": x["h"],
                    "base": [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans],
                    "near": [
                        [{"start": a, "end": b, "instance": hashlib.md5(i.encode("utf-8", "surrogatepass")).hexdigest(), "kind": k, "patterns": p} for a, b, i, k, p in _candidates(t, s)]
                        if s or _HINT.search(t)
                        else []
                        for t, s in zip(texts, spans, strict=True)
                    ],
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, row long, h long, base array<struct<start:int,kind:int,end:int>>, near array<struct<start:int,end:int,instance:string,kind:int,patterns:array<string>>>"
    scanned = materialize(rows.mapInPandas(scan, schema), "candidates")
    found = _discover(scanned)
    joined = scanned.select("doc_id", "row", "h", "base").join(found, "row", "left")
    return joined.select("doc_id", "h", "base", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("found"))


def _discover(scanned: DataFrame) -> DataFrame:
    """(row, found): spans that patterns of high confidence mark."""
    seen = materialize(scanned.select("row", F.explode("near").alias("x")).select("row", "x.*"), "seen")
    # One edge for each pattern and instance, however often they meet: copies of a text say no more than one.
    every = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    every = materialize(every, "edges")
    several = every.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") >= 0).alias("seeds"))
    several = several.filter((F.col("n") >= MIN_INSTANCES) & (F.col("seeds") > 0)).select("pattern", "n")
    # A pattern or an instance may have a large part of all edges, so all joins split hot keys.
    edges = materialize(join_hot(every, several, ["pattern"], "n"), "pattern-instance")
    discard(every)
    kinds = F.array(*[F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in range(len(KINDS))])
    # A score for each kind; seeds keep theirs.
    instances = edges.groupBy("instance").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    instances = materialize(instances.select("instance", "n", (F.col("kind") >= 0).alias("seed"), kinds.alias("score")), "instances")
    patterns = None
    for i in range(ROUNDS):
        met = join_hot(edges.select("pattern", "instance"), instances.select("instance", "score", "n"), ["instance"], "n")
        sums = [F.sum(F.element_at("score", k + 1)).alias(f"s{k}") for k in range(len(KINDS))]
        before, patterns = patterns, met.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums)
        # A lower bound of the share of entities among a pattern's instances.
        bound = [_lower(F.col(f"s{k}"), F.col("n")) for k in range(len(KINDS))]
        patterns = materialize(patterns.select("pattern", "n", F.array(*bound).alias("trust")), f"patterns-{i}")
        if before is not None:
            discard(before)
        if i + 1 < ROUNDS:
            # An instance is none of a kind only if all its patterns fail on it.
            back = join_hot(edges.select("pattern", "instance"), patterns, ["pattern"], "n")
            miss = [F.sum(F.log(1.0001 - F.element_at("trust", k + 1))).alias(f"m{k}") for k in range(len(KINDS))]
            hits = back.groupBy("instance").agg(*miss).select("instance", F.array(*[1 - F.exp(F.col(f"m{k}")) for k in range(len(KINDS))]).alias("hit"))
            kept = F.when(F.col("seed"), F.col("score")).otherwise(F.transform("hit", lambda h: F.when(h >= ENTITY, h).otherwise(0.0)))
            scored = materialize(instances.join(hits, "instance").select("instance", "n", "seed", kept.alias("score")), f"instances-{i}")
            discard(instances)
            instances = scored
    best = F.array_max("trust")
    sure = patterns.filter(best >= MIN_SCORE).select("pattern", best.alias("trust"), (F.array_position("trust", best) - 1).cast("int").alias("as"))
    unseen = materialize(seen.filter("kind < 0").select("row", "start", "end", F.explode("patterns").alias("pattern")), "unseen")
    marked = join_hot(unseen, sure, ["pattern"]).groupBy("row", "start", "end").agg(F.max_by("as", F.struct("trust", -F.col("as"))).alias("as"))
    found = marked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.col("as").alias("kind"), "end"))).alias("found"))
    found = materialize(found, "found")
    for used in (seen, edges, instances, patterns, unseen):
        discard(used)
    return found


def _lower(hits: Column, n: Column) -> Column:
    """Lower end of the 90 % interval of a share (Wilson)."""
    z = 1.645
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind, joined with commas."""
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"]))
    return F.concat_ws(",", each)


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda x: x == kind


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    The counts and base_sha256 are of the known formats; spans lists these and what patterns found,
    n_found of them.

    A null text counts as empty: no spans and the digest of no bytes.  Every row is searched by
    itself and repeated rows are kept; a repeated instance in a context counts once when patterns are
    scored, so copies of a text decide nothing.  Other columns are ignored.  An empty table gives an
    empty result.
    """
    found = find_entities(docs, id_col, text_col)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_found")
    )


def _replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans, strict=True):
        parts, done = [], 0
        for x in found:
            if x["start"] >= done:
                parts += [text[done : x["start"]], f"[{KINDS[x['kind']].upper()}]"]
            done = max(done, x["end"])
        out.append("".join([*parts, text[done:]]))
    return pd.Series(out)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span of personal data replaced by its kind in brackets, as in [EMAIL].

    Spans that overlap are replaced together, by the kind of the first.  Columns, rows and null
    texts stay as they are.  Rows that repeat an identifier are told apart by their texts.  Texts
    without a digit or an @ have no span and are not moved.
    """
    found = find_entities(docs, id_col, text_col).select("doc_id", "h", F.array_sort(F.concat("base", "found")).alias("_spans")).filter(F.size("_spans") > 0)
    # Rows with one identifier and one text have the same spans.
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.first("_spans").alias("_spans"))
    rows = docs.select(F.struct("*").alias("_row"))
    text, key = F.col("_row").getField(text_col), F.col("_row").getField(id_col).cast("long")
    hint = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    joined = rows.filter(hint).join(found, key.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_h")), "left")
    untouched = rows.filter(~hint).union(joined.filter("_spans is null").select("_row")).select("_row.*")
    same = [F.col("_row").getField(c).alias(c) if c != text_col else F.col("_new").alias(c) for c in docs.columns]
    return untouched.union(joined.filter("_spans is not null").withColumn("_new", F.pandas_udf(_replaced, "string")(text, F.col("_spans"))).select(*same))
