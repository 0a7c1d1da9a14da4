"""Substring dedup against all windows; the index against counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import passages
from inkwell.llm.fm_index import FMIndex
from tests.llm.conftest import EDGES, LONG


def brute(rows, words=35):
    """(doc_id, n_words, n_removed, text, removed) of every row."""
    each = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + words]) for w in each for i in range(len(w) - words + 1))
    out = []
    for (doc_id, _), w in zip(rows, each, strict=True):
        gone = set()
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone.update(range(i, i + words))
        spans = [(i, min(j for j in range(i, len(w) + 1) if j not in gone)) for i in sorted(gone) if i - 1 not in gone] if gone else []
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone), spans))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"], [tuple(s) for s in r["removed"]]) for r in df.collect()), key=str)


def corpus(seed, n=60):
    """Passages that many texts share, whole or in part, texts that repeat themselves, near copies and copies."""
    dice = random.Random(seed)
    word = lambda: f"w{int(dice.paretovariate(0.6)) % 5000}"
    shared = [[word() for _ in range(dice.choice((20, 34, 35, 36, 50, 90)))] for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [[word() for _ in range(dice.randint(0, 60))]]
        for _ in range(dice.randint(0, 3)):
            s = dice.choice(shared)
            a = dice.randint(0, len(s) // 3) if dice.random() < 0.5 else 0
            parts += [s[a : len(s) - (dice.randint(0, len(s) // 4) if dice.random() < 0.5 else 0)], [word() for _ in range(dice.randint(0, 40))]]
        texts.append(" ".join(w for p in parts for w in p))
    texts += [texts[0], texts[0], texts[1] + " end", "other " + texts[1]]
    one = "\n".join(["x y z"] * 40)
    return list(enumerate([*texts, one, " ".join(["again"] * 200), " ".join(f"u{i}" for i in range(300)) + " " + " ".join(f"u{i}" for i in range(300))]))


@pytest.mark.parametrize("seed,words,shard_words", [(1, 35, passages.SHARD_WORDS), (2, 35, 200), (3, 8, 100), (4, 100, 300), (5, 3, 1)])
def test_against_all_windows(spark, docs, seed, words, shard_words):
    """A small shard deals hot hashes by window."""
    given = corpus(seed)
    found = passages.remove_repeated(docs(given), words=words, shard_words=shard_words)
    assert found.columns == ["doc_id", "n_words", "n_removed", "text", "removed"]
    want = brute(given, words)
    assert rows(found) == want and any(0 < r[2] < r[1] for r in want)


def test_passage_with_other_words_around(spark, docs):
    """One passage in every text, with a word before and after that no other text has."""
    passage = " ".join(f"p{i}" for i in range(50))
    given = [(i, f"before{i} {passage} after{i}") for i in range(300)]
    for shard_words in (passages.SHARD_WORDS, 500):
        found = rows(passages.remove_repeated(docs(given), shard_words=shard_words))
        assert found == sorted(((i, 52, 50, f"before{i} after{i}", [(1, 51)]) for i, _ in given), key=str)


def test_edges(spark, docs):
    given = [*EDGES, (40, LONG + "tail"), (None, LONG), (None, None), (41, "\x1c".join(f"w{i}" for i in range(50))), (42, " ".join(f"w{i}" for i in range(50)) + " b" * 60)]
    assert rows(passages.remove_repeated(docs(given))) == brute(given)
    assert rows(passages.remove_repeated(docs([]))) == []
    assert rows(passages.remove_repeated(docs([(1, "a b c"), (2, None)]))) == [(1, 3, 0, "a b c", []), (2, 0, 0, "", [])]


@pytest.mark.parametrize("seed", range(6))
def test_index_counts(seed):
    """Backward search gives the longest end of a sequence that occurs with the weight asked for."""
    dice = np.random.default_rng(seed)
    n_words = int(dice.integers(1, 40))
    each = [dice.integers(1, n_words + 1, size=dice.integers(1, 30)) for _ in range(12)]
    each = [np.unique(np.concatenate(each), return_inverse=True)[1].ravel()[sum(map(len, each[:k])) : sum(map(len, each[: k + 1]))] + 1 for k in range(12)]
    copies = dice.integers(1, 3, size=12)
    symbols = np.concatenate([np.append(x, 0) for x in each])
    index = FMIndex(symbols, np.repeat(copies, [len(x) + 1 for x in each]))
    last, want = [], []
    begin = 0
    for x in each:
        for e in range(len(x)):
            last.append(begin + e)
            long = 0
            while long <= e:
                part = x[e - long : e + 1].tolist()
                weight = sum(int(c) for y, c in zip(each, copies, strict=True) for i in range(len(y)) if y[i : i + len(part)].tolist() == part)
                if weight < 3:
                    break
                long += 1
            want.append(long)
        begin += len(x) + 1
    assert index.matched(np.array(last), np.full(len(last), 99), 3).tolist() == want
    assert index.matched(np.array(last), np.full(len(last), 2), 3).tolist() == [min(w, 2) for w in want]
