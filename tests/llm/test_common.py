import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import common


def test_join_dealt_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "NEVER_HOT", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 50)
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 700).alias("k"), F.col("id").alias("v")).union(spark.sql("select null, -1L"))
    side = common.stage(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).where("n > 2"))
    got = common.join_dealt(rows, side, ["k"], "v")
    assert sorted(got.columns) == ["k", "n", "v"]
    assert sorted(map(tuple, got.select("k", "n", "v").collect())) == sorted(map(tuple, rows.join(side, "k").select("k", "n", "v").collect()))
    assert common.join_dealt(rows.limit(0), side.limit(0), ["k"], "v").count() == 0


def test_coded_words():
    texts = pa.array([" a b\t a\n", None, "", "\x0b\x0c\r", "é  🙂 a\x1cb"])
    codes, lens, words = common.coded_words(texts)
    assert lens.tolist() == [3, 0, 0, 0, 3] and [words[c] for c in codes] == ["a", "b", "a", "é", "🙂", "a\x1cb"]
    assert [x.tolist() if hasattr(x, "tolist") else x for x in common.coded_words(pa.array([], pa.string()))] == [[], [], []]
