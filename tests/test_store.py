import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import landed as D
from tidemark.sources import store

SCHEMA = "key string, day string, v int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def merge(spark, path, data, **kw):
    return store.merge(spark.createDataFrame(data, SCHEMA), path, ["key", "day"], [F.desc("v")], F.col("day"), **kw)


def files(root, day):
    return {f: f.stat().st_mtime_ns for f in root.rglob("*.parquet") if f"_part={day}" in str(f)}


def test_many_partitions_in_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [("a", "2026-01-01", 1), ("b", "2026-01-02", 2), ("c", None, 3), ("d", "x/y=%* ü", 4)]
    assert rows(merge(spark, path, first).na.fill("-")) == sorted((k, d or "-", v) for k, d, v in first)
    before = files(tmp_path, "2026-01-01")
    merge(spark, path, [("b", "2026-01-02", 9), ("c", None, 1), ("d", "x/y=%* ü", 5), ("e", "2026-01-03", 6)])
    assert store.current(spark, path).number == 2 and before and files(tmp_path, "2026-01-01") == before
    assert rows(store.read(spark, path).na.fill("-")) == [("a", "2026-01-01", 1), ("b", "2026-01-02", 9), ("c", "-", 3), ("d", "x/y=%* ü", 5), ("e", "2026-01-03", 6)]
    assert rows(store.read(spark, path, number=1).na.fill("-")) == sorted((k, d or "-", v) for k, d, v in first)
    assert rows(store.read(spark, path, parts=["2026-01-03"])) == [("e", "2026-01-03", 6)]
    assert merge(spark, path, []).count() == 5
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("step", ["write_parts", "publish", "half"])
def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    merge(spark, path, [("a", "d1", 1), ("b", "d2", 1)])
    new = [("a", "d1", 5), ("b", "d2", 5), ("c", "d3", 5)]

    def crash(*a, **k):
        if step == "half":
            (tmp_path / "t" / "_versions" / f"{2:020d}.json").write_text('{"parts": {"d1": "da')
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "publish" if step == "half" else step, crash)
        with pytest.raises(RuntimeError, match="killed"):
            merge(spark, path, new)
    assert rows(store.read(spark, path)) == [("a", "d1", 1), ("b", "d2", 1)]
    assert rows(merge(spark, path, new)) == new and rows(store.read(spark, path)) == new


def test_another_writer_in_between(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    merge(spark, path, [("a", "d1", 1)])
    publish, others = store.publish, [[("b", "d1", 2)]]

    def late(*a):
        if others:
            merge(spark, path, others.pop())
        publish(*a)

    monkeypatch.setattr(store, "publish", late)
    assert rows(merge(spark, path, [("c", "d1", 3)])) == [("a", "d1", 1), ("b", "d1", 2), ("c", "d1", 3)]


def test_a_batch_counts_once_and_vacuum_keeps_what_is_named(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, [("a", "d1", 1)], source="s", batch=0)
    merge(spark, path, [("a", "d1", 9)], source="s", batch=0)  # the same batch again
    assert rows(store.read(spark, path)) == [("a", "d1", 1)] and store.current(spark, path).number == 1
    for i in range(1, 4):
        merge(spark, path, [("a", "d1", i + 1), ("b", f"e{i}", i)], source="s", batch=i)
    want = rows(store.read(spark, path))
    assert store.vacuum(spark, path, keep=1) == 3 and rows(store.read(spark, path)) == want
    assert len(list((tmp_path / "t" / "_versions").glob("*.json"))) == 1


def test_features_by_month(spark, tmp_path):
    path = str(tmp_path / "f")
    at = lambda m, d: dt.datetime(2026, m, d)
    make = lambda rs: spark.createDataFrame([("s", "e", "m", a, a, r, v, "r1", "x") for a, r, v in rs], D.FEATURES.names)
    D.store_features(make([(at(1, 5), at(1, 6), "old"), (at(2, 5), at(2, 6), "feb")]), path)
    before = files(tmp_path, "2026-02")
    got = D.store_features(make([(at(1, 5), at(3, 1), "corrected"), (at(1, 5), at(1, 7), "between")]), path)
    assert sorted(r["value"] for r in got.collect()) == ["corrected", "feb"] and before and files(tmp_path, "2026-02") == before


def test_overwrite_keeps_the_table_if_a_move_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "o")
    df = spark.range(3)
    D.overwrite(df, path)
    paths = D._paths

    class Deaf:
        """A file system that answers no to the move of a new table."""

        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if a.getName() != "o" and a.getName() != "o.old" else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(D, "_paths", lambda s, p: (Deaf(paths(s, p)[0]), *paths(s, p)[1:]))
    with pytest.raises(OSError, match="could not move"):
        D.overwrite(spark.range(9), path)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 3
