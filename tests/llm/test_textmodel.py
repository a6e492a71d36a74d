from pyspark.sql import functions as F

from tidemark.llm.textmodel import labelled_sample


def test_the_sample_is_bounded_whatever_ids_repeat(spark):
    docs = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("y"))
    docs = docs.unionByName(spark.createDataFrame([(i, None if i == 3 else f"t{i}", 0) for i in range(30)] + [(None, "x", 0)], "doc_id int, text string, y int"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, 0), (7, 1), (None, 1), (5, None)], "doc_id long, y int")
    got = labelled_sample(docs, labels, 10).collect()
    assert len(got) <= 10 and len({r["doc_id"] for r in got}) == len(got)
    whole = {r["doc_id"]: (r["y"], r["text"]) for r in labelled_sample(docs, labels, 100).collect()}
    assert set(whole) == set(range(30)) and whole[7][0] == 1 and whole[3] == (1, None)
    assert labelled_sample(docs, labels.limit(0), 10).count() == 0
