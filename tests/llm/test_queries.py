"""The registered queries on the smallest tables: SQL twins, and the pipeline against brute force."""

import duckdb
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from inkwell.llm import packing, pii, queries
from tests.conftest import SMALL
from tests.llm.conftest import EDGES
from tests.llm.test_dedup import fingerprint, lines_kept, measures, near
from tests.llm.test_scans import base
from tests.llm.test_tokens import check_packing
from tests.test_oracle import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SMALL).toPandas()) == rows(con.execute(queries.ORACLE_SQL[name]).df())


def test_registry():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries.QUERIES}
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SMALL)
        if name == "packing":
            check_packing(found.collect(), given, Tokenizer.from_str(packing.read_text(spark, P.path("word_bpe_49k.json"))), 0.02 * sum(len(t) for _, t in given))
            break
        assert found.columns == docs.columns
        rows_ = sorted((r["doc_id"], r["text"]) for r in found.collect())
        if name == "quality":
            kept = [(d, t) for d, t in given if (m := measures(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
            assert set(rows_) <= set(kept) and len(rows_) >= 0.95 * len(kept)
        elif name == "line_dedup":
            want = lines_kept(given)
            assert rows_ == sorted((d, want[d, t]) for d, t in given)
        elif name == "near_dedup":
            first = {d for d, _, c in near(given) if d == c}
            assert rows_ == sorted((d, t) for d, t in given if d in first)
            assert len({fingerprint(t) for _, t in rows_}) == len(rows_)
        elif name == "personal_data":
            assert pii.personal_data(docs).agg({"n_found": "sum"}).first()[0] == 0  # so few texts teach no pattern
            assert rows_ == sorted((d, redacted(t)) for d, t in given) and any("[EMAIL]" in t for _, t in rows_)
        given = rows_
        docs = spark.createDataFrame(found.collect(), found.schema)
    pieces = found.collect()
    assert {r["doc_id"] for r in pieces} == {d for d, _ in given}


def redacted(text):
    """Base formats replaced by their kind; what overlaps is replaced together, by the kind of the first."""
    out, done = [], 0
    for span in filter(None, base(text).split(",")):
        kind, a, b = span.split(":")
        if int(a) >= done:
            out += [text[done : int(a)], f"[{kind.upper()}]"]
        done = max(done, int(b))
    return "".join([*out, text[done:]])


def test_pipeline_on_edges(spark, docs):
    """Nulls, empty and very long texts, repeated rows and an empty table pass through every stage; clashing columns are left behind."""
    import corpus_pipeline

    for rows_ in (EDGES, []):
        table = docs([*rows_, *((500 + i, f"{t} a@b.c ") for i, t in enumerate(filter(None, (t for _, t in rows_))))])
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, table, SMALL)
            assert found.columns == corpus_pipeline.COLUMNS, name
            # Each stage gets the table with nulls, and not only what the one before left.
            collected = found.collect()
            assert len(collected) <= table.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, table, SMALL).collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in table.collect()}


def test_one_of_near_with_repeated_identifiers(spark, docs):
    """One row of each group stays, however identifiers repeat or lack."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i * i}" for i in range(60)) for x in "abcd")
    rows_ = [(1, a), (1, a), (2, b), (2, a), (None, a), (None, c), (None, c), (3, d), (None, d), (None, d), (2, b)]
    found = corpus_pipeline.keep_one_of_near(spark, docs(rows_), SMALL)
    assert found.columns == corpus_pipeline.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (3, d)], key=str)
    assert corpus_pipeline.keep_one_of_near(spark, docs([]), SMALL).count() == 0
