"""Exact, near and line dedup, quality rules and the pipeline against brute force."""

import hashlib
import random
import re

import pytest
import xxhash

from inkwell.llm import components, exact_dedup, line_dedup, quality, simhash
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_exact(docs):
    rows = [*EDGES, *((100 + i, "Copy Of One" if i % 2 else "copy of one") for i in range(600))]
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    found = exact_dedup.content_sort_dedup(docs(rows)).collect()
    assert len(found) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_hash[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert (r["keep_id"], r["group_size"]) == (max(known) if known else None, len(ids))
    assert sum(r["kept"] for r in found) == len(groups)
    assert exact_dedup.content_sort_dedup(docs([])).count() == 0
    least = exact_dedup.content_sort_dedup(docs(rows), keep="min").filter("kept").count()
    assert least == len(groups)


def near(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def families(seed=1, n=150):
    rng, words = random.Random(seed), [f"w{i}" for i in range(500)]
    rows = []
    while len(rows) < n:
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(rng.choice((1, 1, 2, 5))):
            t = list(base)
            t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((1000 + len(rows), " ".join(t)))
    return rows


def test_simhash(docs):
    rows = [*EDGES, *families()]
    found = simhash.simhash_components(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == near(rows)
    assert simhash.simhash_components(docs([])).count() == 0


def test_trie_join_splits_large_nodes(spark, monkeypatch):
    """Start nodes over the limit are dealt out deeper and lose no link."""
    rng = random.Random(3)
    values = {0}
    for _ in range(40):
        v = rng.getrandbits(64)
        values |= {v, *(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(5))}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    plain = {(r["node"], r["component"]) for r in components.connected_components(simhash.fingerprint_links(fps)).collect()}
    monkeypatch.setattr(simhash, "NODE_SIZE", 1)
    split = {(r["node"], r["component"]) for r in components.connected_components(simhash.fingerprint_links(fps)).collect()}
    assert plain == split and len(plain) >= 200


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components.connected_components(links.limit(0)).count() == 0


def lines_kept(rows, min_lines=2, min_words=5):
    """Later copies of line runs, by comparing every run with all earlier ones."""
    texts = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    out, seen = {}, set()
    for d, t in texts:
        parts = t.split("\n")
        real = [i for i, x in enumerate(parts) if WORD.search(x)]
        gone = set()
        for n in range(len(real)):
            for width in {1, min_lines}:
                run = real[n : n + width]
                key = tuple(parts[i] for i in run)
                if len(run) < width or width == 1 < min_lines and len(WORD.findall(key[0])) < min_words:
                    continue
                if key in seen:
                    gone.update(range(n, n + width))
                seen.add(key)
        dead = {real[n] for n in gone}
        for n in gone:
            if n + 1 in gone:
                dead.update(range(real[n], real[n + 1]))
        out[d, t] = "\n".join(x for i, x in enumerate(parts) if i not in dead)
    return out


def test_lines(docs):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(25)] + ["", " "]
    rows = [*EDGES, *((50 + i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(60))]
    want = lines_kept(rows)
    found = line_dedup.line_dedup(docs(rows)).collect()
    assert len(found) == len(rows)
    left = sorted(((d, want.get((d, t))) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == left
    assert line_dedup.line_dedup(docs([])).count() == 0


def line_tables(seed):
    """Short lines drawn from a pool, and documents that share runs of 40 lines."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(25)] + ["", " "]
    rows = [*EDGES, *((50 + i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(60))]
    long = [" ".join(rng.choices("ijklmnop", k=3)) + str(i) for i in range(40)]
    for i in range(12):
        own = [f"own {i} {k}" for k in range(rng.randint(0, 3))]
        a, b = sorted((rng.randint(0, 40), rng.randint(0, 40)))
        rows.append((200 + i, "\n".join([*own, *long[a if i % 3 else 0 : b if i % 3 else 40], "", *own[:1], *(["x"] * (i % 4))])))
    return rows + rows[20:24]


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4, 5])
def test_lines_of_any_least_run(docs, min_lines):
    rows = line_tables(min_lines)
    want = lines_kept(rows, min_lines)
    found = line_dedup.line_dedup(docs(rows), min_lines=min_lines).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(((d, want.get((d, t))) for d, t in rows), key=str)


def test_repeated_runs_are_maximal(docs):
    """Each run repeats its source and ends where the two begin to differ; 40 shared lines are one run."""
    rows = [(d, t) for d, t in line_tables(9) if d is not None and d != 8]
    real = {d: [x for x in (t or "").split("\n") if WORD.search(x)] for d, t in rows}
    runs = line_dedup.repeated_runs(docs(rows)).collect()
    assert any(r["to"] - r["from"] >= 40 for r in runs)
    for r in runs:
        own, source, n = real[r["doc_id"]], real[r["source_id"]], r["to"] - r["from"]
        assert (r["source_id"], r["source_from"]) < (r["doc_id"], r["from"])
        assert own[r["from"] : r["to"]] == source[r["source_from"] : r["source_from"] + n]
    planted = [r for r in runs if r["doc_id"] in (203, 206, 209)]
    assert all(any(r["doc_id"] == d and r["to"] - r["from"] >= 40 and r["source_id"] == 200 for r in planted) for d in (203, 206, 209))
    assert line_dedup.repeated_runs(docs([])).count() == 0


def measures(text):
    words = WORD.findall(text or "")
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in set(five) if five.count(w) > 1} if len(five) < 2000 else None
    if twice is None:
        counts = {}
        for w in five:
            counts[w] = counts.get(w, 0) + 1
        twice = {w for w, n in counts.items() if n > 1}
    covered = {i + k for i, w in enumerate(five) if w in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def longest_repeat(words):
    return max((k for k in range(len(words)) for i in range(len(words) - k) if k and any(words[i : i + k] == words[j : j + k] for j in range(i + 1, len(words) - k + 1))), default=0)


def test_quality(docs):
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(101))
    rows = [*EDGES, *((20 + i, " ".join(rng.choices("abcd#", k=rng.randint(0, 60)))) for i in range(40)), (90, f"{passage} " + " ".join(f"q{i}" for i in range(2000)) + f" {passage}")]
    found = quality.quality_rules(docs(rows)).collect()
    want = sorted((str(d), *measures(t)) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found) == want
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    last = next(r for r in found if r["doc_id"] == 90)
    assert (last["base_failed"], last["longest_repeat"], last["kept"]) == (False, 101, False)
    short = {d: t for d, t in rows if d and 20 <= d < 60}
    assert all(r["longest_repeat"] == longest_repeat(short[r["doc_id"]].split()) for r in found if r["doc_id"] in short and len(short[r["doc_id"]].split()) > 5)
    assert quality.keep_good(docs(rows)).count() == sum(r["kept"] for r in found)
    assert quality.quality_rules(docs([])).count() == 0
