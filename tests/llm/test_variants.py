"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from inkwell.llm import queries, variants
from tests.conftest import SMALL
from tests.llm.conftest import EDGES


def near_words(word, letters):
    """All strings of one edit."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    letters = sorted({c for w in n for c in w})
    out = {}
    for w in n:
        near = [x for x in near_words(w, letters) if x in n and x != w] if len(w) < 1000 else [x for x in n if variants.edit_of_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        out[w] = [form, n[w], len(near), n[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return sorted((w, *row) for w, row in out.items())


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def test_against_all_pairs(spark, docs):
    """Words of few letters, so that bigrams repeat, in chains of forms with ties."""
    dice = random.Random(5)
    texts = []
    for letters in ("ab", "abcé", "aàXyz"):
        words = ["".join(dice.choices(letters, k=dice.randint(6, 10))) for _ in range(150)]
        texts += [" ".join(dice.choices(words, weights=[1 / (k + 1) for k in range(150)], k=400)) for _ in range(20)]
    texts += [" ".join(["aaaaaaaa"] * 400 + ["aaaaaaaab"] * 30 + ["aaaaaaaabb"] * 3 + ["aaaaaaa"] * 2 + ["baaaaaaa"] * 400)]
    given = list(enumerate(texts))
    found = rows(variants.spelling_variants(docs(given)))
    assert found == brute(given)
    assert any(r[1] and r[2] != r[1] for r in found)  # a chain


def test_edges(spark, docs):
    """Nulls, very long runs with and without repeated bigrams, letters beyond ASCII, no words at all."""
    dice = random.Random(6)
    long_run = "".join(dice.choices("abcdefgh", k=60_000))
    given = [*EDGES, (20, "a" * 100_000 + " " + "a" * 100_001), (21, "a" * 100_000 + "-" + "a" * 100_001), (22, f"{long_run} {long_run}"), (23, f"{long_run}x x{long_run}"), (24, f"{long_run}x x{long_run}"), (None, "Straßen straßen STRASSEN"), (None, "straßeÑ straßeñ straßeñ")]
    assert rows(variants.spelling_variants(docs(given))) == brute(given)
    assert rows(variants.spelling_variants(docs([]))) == [] and rows(variants.spelling_variants(docs([(1, None), (2, "")]))) == []


@pytest.mark.parametrize("a,b,want", [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("ab", "abc", True), ("abc", "bc", True), ("abc", "axc", True), ("abcd", "badc", False), ("abc", "a", False), ("aaa", "aa", True), ("abc", "bcd", False), ("", "a", True)])
def test_edit_of_one(a, b, want):
    assert variants.edit_of_one(a, b) is want


def test_prefix_is_bounded():
    order = {"aa": 3, "ab": 2, "ba": 1}
    assert len(variants.prefix("a" * 1000, order)) == variants.OCCURRENCES
    assert variants.prefix("aaaaabaaaa", order) == [5, 4, 0, 1, 2, 3, 6]


def test_gaps_are_small_and_cover():
    """Every edit that leaves a bigram lies in a gap; a word has few gaps, however long it is."""
    for n in (7, 8, 13, 64, 100_000):
        for at in (0, 3, n - 2):
            found = variants.gaps([at], n, n)
            assert all(0 <= n - f - b <= max(2, n // 32) for f, b in found) and len(found) < 4 * variants.GAPS
            for place in (*range(min(n, 70)), n - 1):
                assert at <= place < at + 2 or any(f <= place < n - b for f, b in found)


def test_query(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = rows(queries.QUERIES["op11_variants"](spark, SMALL))
    assert found == brute(given)
    assert sum(r[1] is not None for r in found) >= 10
