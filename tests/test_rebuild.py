from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources.artifacts import Step, rebuild, rows_digest


def steps(log, fail=()):
    def make(name):
        def build(*tables, add=0):
            if name in fail:
                raise RuntimeError(f"killed in {name}")
            log.append(name)
            return tables[0].select((F.col("v") + add).alias("v"))

        return build

    return {"c": Step(("b",), make("c")), "a": Step(("x",), make("a"), {"add": 1}), "b": Step(("a", "y"), make("b")), "d": Step(("y",), make("d"))}


def test_only_heirs_of_a_change_are_built(spark, tmp_path):
    log, x, y = [], spark.range(5).toDF("v"), spark.range(3).toDF("v")
    run = lambda s, **kw: rebuild(spark, str(tmp_path), kw, s)
    first = run(steps(log), x=x, y=y)
    assert sorted(log) == ["a", "b", "c", "d"] and log.index("a") < log.index("b") < log.index("c")
    files = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*") if f.is_file()}
    log.clear()
    again = run(steps(log), x=x.repartition(3), y=y)  # equal rows in other files
    assert log == [] and {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*") if f.is_file()} == files
    assert {n: b.digest for n, b in again.items()} == {n: b.digest for n, b in first.items()}
    run(steps(log), x=x.union(x.limit(1)), y=y)
    assert sorted(log) == ["a", "b", "c"]
    log.clear()
    changed = steps(log)
    changed["a"] = changed["a"]._replace(params={"add": 2})
    assert sorted(r["v"] for r in run(changed, x=x, y=y)["c"].table.collect()) == [2, 3, 4, 5, 6] and sorted(log) == ["a", "b", "c"]
    log.clear()
    assert sorted(r["v"] for r in run(steps(log), x=x, y=y)["c"].table.collect()) == [1, 2, 3, 4, 5] and log == []  # back to the first state


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    log, x = [], spark.range(5).toDF("v")
    with pytest.raises(RuntimeError, match="killed in b"):
        rebuild(spark, str(tmp_path), {"x": x, "y": x}, steps(log, fail=("b",)))
    done = list(log)
    log.clear()
    out = rebuild(spark, str(tmp_path), {"x": x, "y": x}, steps(log))
    assert "a" in done and not set(log) & set(done) and {"b", "c"} <= set(log)
    (Path(out["c"].path) / "_SUCCESS").unlink()  # as if killed while writing
    log.clear()
    assert rebuild(spark, str(tmp_path), {"x": x, "y": x}, steps(log))["c"].table.count() == 5 and log == ["c"]


def test_gaps_cycles_and_unknown_names_are_refused(spark, tmp_path):
    x = spark.range(1).toDF("v")
    same = lambda t: t
    with pytest.raises(RuntimeError, match="incomplete"):
        rebuild(spark, str(tmp_path), {"x": x}, {"a": Step(("x",), same)}, missing=x)
    with pytest.raises(ValueError, match="neither"):
        rebuild(spark, str(tmp_path), {"x": x}, {"a": Step(("z",), same)})
    with pytest.raises(ValueError, match="each other"):
        rebuild(spark, str(tmp_path), {"x": x}, {"a": Step(("b",), same), "b": Step(("a",), same)})
    assert rebuild(spark, str(tmp_path), {"x": x}, {"a": Step(("x",), same)}, missing=x.limit(0))["a"].fresh
    assert rows_digest(x) != rows_digest(x.withColumnRenamed("v", "w")) != rows_digest(x.union(x))
