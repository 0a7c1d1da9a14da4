"""Byte-level BPE against its library, packing against its contract, and token-count rollups."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from inkwell.llm import bpe, packing, queries, token_counts
from tests.conftest import SMALL
from tests.llm.conftest import EDGES


def test_bpe(spark, docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*EDGES, (20, "don't  stop\r\n\n now'S 12345 　 <|endoftext|>"), (21, "ab" * 700)]
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    found = bpe.bpe_round_trip(docs(rows), bpe.load_ranks(spark, path), P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted(want)
    assert bpe.bpe_round_trip(docs([]), ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("long", [0, 40, bpe.LONG])
def test_long_pieces(monkeypatch, long):
    """Pieces of any kind and length, by either way of merging, against the library."""
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "LONG", long)
    rng = np.random.default_rng(3)
    kinds = ["A", "ab", "ACGT", "the in er", "aaab", "=-", "äöü", "会議", " ", " \n", "aeioust", "abcdefghijklmnopqrstuvwxyz"]
    texts = ["".join(rng.choice(list(k), n)) for k in kinds for n in (1, 2, 3, 50, 5_000)] + [" " * 50_000 + "x", "ing" * 3_000]
    own = bpe.Bpe(ranks, P.PATTERN)
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


@pytest.fixture(scope="module")
def word_bpe(spark):
    return packing.read_text(spark, P.path("word_bpe_49k.json"))


def check_packing(found, rows, library, most_padding):
    ids = {}
    for d, t in rows:
        ids.setdefault(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces, sequences = {}, {}
    for r in found:
        own = ids[r["doc_id"]]
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d in {d for d, _ in rows}:
        copies = sum(x == d for x, _ in rows)
        seen = np.zeros(len(ids[d]), int)
        for a, n in pieces[d]:
            seen[a : a + n] += 1
        assert (seen == copies).all()
    padding = 0
    for x in sequences.values():
        at = 0
        for a, n in sorted(x):
            assert a == at and n > 0
            at += n
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at if at & at - 1 else 0
    assert padding <= most_padding


def test_packing(docs, word_bpe):
    library = Tokenizer.from_str(word_bpe)
    rows = [*EDGES, (30, "a<|endoftext|>b <|startoftext|>"), (31, "é ΑΣ ſ it's I'LL")]
    check_packing(packing.pack(docs(rows), word_bpe).collect(), rows, library, 0)
    assert packing.pack(docs([]), word_bpe).count() == 0


@pytest.mark.parametrize("kind", ["equal", "tiny", "mixed"])
def test_packing_plans(docs, word_bpe, kind):
    library = Tokenizer.from_str(word_bpe)
    sizes = {"equal": [1365] * 90, "tiny": [0] * 300, "mixed": [(i * i * 37) % 5000 for i in range(120)]}[kind]
    rows = [(i, "the " * n) for i, n in enumerate(sizes)]
    check_packing(packing.pack(docs(rows), word_bpe).collect(), rows, library, 0.02 * (sum(sizes) + len(sizes)))


def test_word_ids(word_bpe):
    """Random texts of signs that the way by chunks has to tell apart, against the library."""
    own, library = packing.WordTokenizer(word_bpe), Tokenizer.from_str(word_bpe)
    signs = list("abcXYZ019'sStT<|>.,-_! \t\n\x0b\x1c\x1f\x85\xa0\u3000éÉßÿÀ×÷ªº²½µ\u0301\u0307İıſ\u212aÅ中文\u200b😀ǅ")
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 40, 2_000)]
    texts += [None, "", " ", "'S'T'RE'Ve'LL'D'M", "<|endoftext|>", "a<|startoftext|>b", "x" * 50_000, "a!" * 20_000]
    whole = pa.array(["left out", *texts], pa.string()).slice(1)
    ids, ends = own.encode(whole)
    starts = [0, *ends[:-1]]
    assert [ids[a:b].tolist() for a, b in zip(starts, ends, strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.count(whole).tolist() == (ends - starts).tolist()


def test_another_tokenizer_file():
    """A file that prepares texts in another way is followed as it is."""
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    own, library = packing.WordTokenizer(content), Tokenizer.from_str(content)
    texts = ["Hello  World", None, "", "ÄÖ it's 12\n\n x"]
    ids, ends = own.encode(pa.array(texts))
    assert not own.by_chunks and packing.WordTokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read()).by_chunks
    starts = [0, *ends[:-1]]
    assert own.count(pa.array(texts)).tolist() == (ends - starts).tolist()
    assert [ids[a:b].tolist() for a, b in zip(starts, ends, strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_nnls():
    rng = np.random.default_rng(0)
    a = packing.combinations(16, 3).astype(float)
    for _ in range(5):
        b = a @ np.maximum(rng.normal(size=a.shape[1]), 0) + rng.random(16)
        x = packing.nnls(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and slope.min() > -1e-6 and abs(slope[x > 1e-9]).max() < 1e-6  # the optimality conditions
    for _, at, to, _, n, _ in packing.window_plan(np.array([9, 0, 4, 8] * 4), np.array([9, 0, 4, 8] * 4) * packing.GRID):
        assert (to - at) % n == 0


def test_rollup(spark, tmp_path):
    path = f"file://{tmp_path}/rollup"
    schema = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_source string, old_lang string, old_tokenizer_version string, old_n_tokens long"
    first = [("insert", "a", "en", "v1", 10, None, None, None, None), ("insert", "a", "en", "v1", None, None, None, None, None), ("insert", None, "de", "v1", 5, None, None, None, None), ("other", "a", "en", "v1", 99, None, None, None, None)]
    second = [("revise", "a", "en", "v2", 12, "a", "en", "v1", 10), ("delete", None, "de", "v1", 5, None, None, None, None)]
    rollup = token_counts.Rollup(spark, path)
    assert rollup.totals().count() == 0
    assert rollup.apply("one", spark.createDataFrame(first, schema))
    assert not rollup.apply("one", spark.createDataFrame(first, schema))
    again = token_counts.Rollup(spark, path)
    assert again.apply("two", spark.createDataFrame(second, schema)) and not again.apply("two", spark.createDataFrame(second, schema))
    assert again.apply("three", spark.createDataFrame([], schema))
    assert {tuple(r) for r in again.totals().collect()} == {("a", "en", "v1", 1, 0), ("a", "en", "v2", 1, 12)}
    with pytest.raises(ValueError, match="name"):
        again.apply("../x", spark.createDataFrame(first, schema))


def test_rollup_with_two_writers(spark, tmp_path, monkeypatch):
    """A writer that saw the batch uncommitted, but comes second, changes nothing and says so."""
    schema = "op string, source string, lang string, tokenizer_version string, n_tokens long"
    one, two = (spark.createDataFrame([("insert", "a", "en", "v1", n)], schema) for n in (10, 99))
    rollup, other = (token_counts.Rollup(spark, f"file://{tmp_path}/rollup") for _ in range(2))
    monkeypatch.setattr(other, "has", lambda batch: False)
    assert rollup.apply("one", one)
    assert not other.apply("one", two)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 10)]
    assert len(rollup._data.names()) == 1


def test_rollup_compaction(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer_version string, n_tokens long"
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    assert not rollup.compact()
    for i in range(6):
        assert rollup.apply(f"b{i}", spark.createDataFrame([("insert", f"s{i % 2}", "en", "v1", i)], schema))
        if i % 2:
            assert rollup.compact()
            assert not rollup.compact()
        assert not rollup.apply(f"b{i // 2}", spark.createDataFrame([("insert", "x", "en", "v1", 1)], schema))
    want = {("s0", "en", "v1", 3, 6), ("s1", "en", "v1", 3, 9)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.vacuum()
    assert {tuple(r) for r in rollup.totals().collect()} == want and len(rollup._data.names()) == 1
    stale = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    assert stale._snapshots.claim("000000000004", "x") and not stale._snapshots.claim("000000000004", "y")


def test_token_counts_against_the_libraries(spark, docs, word_bpe):
    """Counts of edge cases, and the query's totals on a table, by both libraries."""
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library, words = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_str(word_bpe)

    def counts(t):
        return len(library.encode_ordinary(t or "")), len(words.encode(t or "", add_special_tokens=False).ids)

    found = token_counts.count_tokens(docs(EDGES), ranks, P.PATTERN, word_bpe)
    assert found.columns == [c for c in docs(EDGES).columns if c != "text"] + ["byte_tokens", "word_tokens"]
    assert sorted((str(r["doc_id"]), r["byte_tokens"], r["word_tokens"]) for r in found.collect()) == sorted((str(d), *counts(t)) for d, t in EDGES)
    assert token_counts.count_tokens(docs([]), ranks, P.PATTERN, word_bpe).count() == 0
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 0").collect()}
    want = {}
    for r in rows:
        if r["doc_id"] not in bad:
            at = want.setdefault((r["source"], r["lang"], "word-2"), [0, 0])
            at[0] += 1
            at[1] += counts(r["text"])[1]
    assert {tuple(r)[:3]: list(r)[3:] for r in queries.op10_token_counts(spark, SMALL).collect()} == want
