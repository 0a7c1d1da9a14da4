import random

import pytest
from pyspark.sql import functions as F

from inkwell.sources import store
from inkwell.sources.claims import Folder
from inkwell.sources.store import ConflictError, Table

SCHEMA = "k string, v int"


def _rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def _content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_any_order_of_changes_equals_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 5)
    folded = []
    fold = Table._folded
    monkeypatch.setattr(Table, "_folded", lambda self, parts, whole: folded.append(whole) or fold(self, parts, whole))
    table, want, r = Table(spark, f"file://{tmp_path}/t", SCHEMA), {}, random.Random(5)
    table.append(_rows(spark, [(f"k{i}", i) for i in range(5_000)]))
    want.update({f"k{i}": i for i in range(5_000)})
    for step in range(14):
        keys = [f"k{r.randrange(60)}" for _ in range(8)]
        if step % 3 == 2:
            table.remove(_rows(spark, [(k, 0) for k in [*keys, None, "absent"]]))
            for k in keys:
                want.pop(k, None)
        elif step % 3 == 1:
            new = sorted({k for k in keys if k not in want} | {f"n{step}"})
            table.append(_rows(spark, [(k, step) for k in new]))
            want.update(dict.fromkeys(new, step))
        else:
            table.upsert(_rows(spark, [(k, 1000 * step + n) for n, k in enumerate(keys)]), "v")
            want.update({k: 1000 * step + n for n, k in enumerate(keys)})
        if step in (0, 2, 7, 13):
            assert _content(table) == sorted(want.items(), key=str)
    assert False in folded  # the large first part was left where it is
    table.compact()
    assert len(table._current()[1]) == 1 and _content(table) == sorted(want.items(), key=str)


def test_edges(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", SCHEMA)
    table.remove(_rows(spark, [("a", 0)]))
    assert _content(table) == []
    table.upsert(_rows(spark, []))
    table.append(_rows(spark, [("a", 1), ("a", 1), (None, 7)]))  # an append does not look for earlier rows
    assert _content(table) == [("a", 1), ("a", 1), (None, 7)]
    table.upsert(_rows(spark, [("a", 2), ("a", 3)]).withColumn("_place", F.lit("clash")), "v")
    assert _content(table) == [("a", 3), (None, 7)]
    table.remove(_rows(spark, [(None, 0)]))
    assert _content(table) == [("a", 3), (None, 7)]


def test_an_upsert_writes_its_own_rows_only(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    table = Table(spark, path, "k long, v string")
    rows = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table.append(rows.coalesce(2))
    before = Folder(spark, f"{path}/data").size("")
    table.upsert(rows.filter("k % 100 = 0").withColumn("v", F.reverse("v")).coalesce(1))
    table.remove(rows.filter("k % 100 = 1").coalesce(1))
    assert Folder(spark, f"{path}/data").size("") - before < 0.03 * before
    assert table.read().agg(F.count("k"), F.sum((F.reverse("v") == F.sha2(F.col("k").cast("string"), 256)).cast("int"))).first() == (198_000, 2_000)
    monkeypatch.setattr(store, "small", lambda df: df)  # too many keys to be sent: a join by shuffle
    assert table.read().count() == 198_000


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    one, two = (Table(spark, f"file://{tmp_path}/t", SCHEMA) for _ in range(2))
    one.append(_rows(spark, [("a", 1)]))
    claim = one._claim

    def late(*args):
        two.upsert(_rows(spark, [("a", 2)]))
        claim(*args)

    monkeypatch.setattr(one, "_claim", late)
    with pytest.raises(ConflictError):
        one.remove(_rows(spark, [("a", 0)]))
    assert _content(two) == [("a", 2)]
    assert len(Folder(spark, f"{one.path}/data").names()) == 2  # what the loser wrote is gone
