"""A folder as a stream gives what runs over the folder give."""

import pytest

from inkwell.plans.index import index_folder
from inkwell.sources.store import PointStore
from inkwell.streaming import folder
from inkwell.streaming.folder import index_folder_stream


def _put(docs, **texts):
    for name, text in texts.items():
        at = docs / name.replace("__", "/").replace("_", ".")
        at.parent.mkdir(exist_ok=True, parents=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


def _points(store):
    return sorted(map(str, store.points("documents").read().drop("copies").collect()))


def _run(spark, store, docs, tmp_path, **options):
    index_folder_stream(spark, store, f"file://{docs}", f"file://{tmp_path}/checkpoint", **options).awaitTermination()


def test_equal_to_a_run(spark, tmp_path):
    """Copies, folders, odd names, other suffixes, broken and empty files."""
    docs = tmp_path / "docs"
    _put(docs, b_md="# A\ngreen apples", a_md="# A\ngreen apples", sub__c_md="# B\nblue whales", d_py="def f():\n    return 1\n", bad_py="def (", bin_md=b"\xff\xfe", x_exe="no", t_txt="no strategy", e_md="")
    (docs / "odd [1] {x} 100% é.md").write_text("# Odd\nred cherries")
    stream, run = PointStore(spark, f"file://{tmp_path}/stream"), PointStore(spark, f"file://{tmp_path}/run")
    index_folder(spark, run, f"file://{docs}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    _run(spark, stream, docs, tmp_path)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert _points(stream) == _points(run) and len(_points(run)) >= 4
    for table in ("errors", "processed"):
        found, want = (sorted(tuple(r)[:2] if table == "errors" else r[0] for r in getattr(s, table)("documents").read().collect()) for s in (stream, run))
        assert found == want and want, table


def test_restart_redelivery_and_copies_in_later_batches(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    _put(docs, a_md="# A\none", b_md="# B\ntwo", bad_py="def (")
    store = PointStore(spark, f"file://{tmp_path}/store")
    _run(spark, store, docs, tmp_path, batch_files=1)  # a batch for each file
    assert store.count("documents") == 2 and store.errors("documents").read().count() == 1
    _run(spark, store, docs, tmp_path)  # restarted with nothing new
    first = _points(store)
    _put(docs, z_md="# A\none", A_md="# B\ntwo", c_md="# C\nthree", worse_py="def (")
    # The batch fails after its points are written and before its files are recorded; then it is delivered again.
    real = folder.index_files

    def lost(*args, **options):
        real(*args, **options)
        raise RuntimeError("executor lost")

    monkeypatch.setattr(folder, "index_files", lost)
    with pytest.raises(Exception, match="executor lost"):
        _run(spark, store, docs, tmp_path)
    monkeypatch.setattr(folder, "index_files", real)
    _run(spark, store, docs, tmp_path)
    assert store.count("documents") == 3 and set(first) < set(_points(store))
    assert {r["path"].rsplit("/", 1)[1] for r in store.errors("documents").read().collect()} == {"bad.py", "worse.py"}
    assert store.processed("documents").read().count() == 3
    # A run over the folder finds nothing new.
    assert index_folder(spark, store, f"file://{docs}")["points"] == 0


def test_what_a_run_has_processed_is_left_out_and_the_state_forgets(spark, tmp_path):
    docs = tmp_path / "docs"
    _put(docs, a_md="# A\none", b_md="# B\ntwo")
    store = PointStore(spark, f"file://{tmp_path}/store")
    assert index_folder(spark, store, f"file://{docs}")["points"] == 2
    store.points("documents").replace(store.points("documents").read().limit(0))
    _run(spark, store, docs, tmp_path, remembered=1)  # expires at once
    _put(docs, c_md="# A\none", d_md="# D\nfour")
    _run(spark, store, docs, tmp_path, remembered=1)
    assert [r["content"].split()[-1] for r in store.points("documents").read().collect()] == ["four"]


def test_a_file_that_is_gone(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    _put(docs, a_md="# A\none", b_md="# B\ntwo")
    store = PointStore(spark, f"file://{tmp_path}/store")
    has = folder.Folder.has
    monkeypatch.setattr(folder.Folder, "has", lambda self, name: not self.path.endswith("a.md") and has(self, name))
    _run(spark, store, docs, tmp_path)
    assert [(r["path"][-4:], r["error"]) for r in store.errors("documents").read().collect()] == [("a.md", "missing")]
    _put(docs, copy_md="# A\none")  # read in its place
    _run(spark, store, docs, tmp_path)
    assert store.count("documents") == 2
