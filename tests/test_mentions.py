import datetime as dt
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import mentions as M
from tidemark.operators.mentions import mention_features, mentions


def test_the_index_finds_what_comparing_all_finds(spark):
    texts = [
        "Jane Roe spoke", "Jane X. Roe", "Mr. Roe spoke", "in place of vice chair Roe", "Roe alone", "Roebuck and Jane", "jane roe", "no one", "O'Neil, Tip; Tip O'Neil", "Peña and Ana Peña", "Jane " + "x " * 30 + "Roe",
        "cloture on Jane Roe Jr", "Jane Roe before the cloture vote on Roe", "A-B C", "C A-B", "_Roe Roe_", "Ñ", "中 文", "", None, "Roe\n\nJane\tRoe " * 3, "Jane Roe" + " z" * 100_000,
    ]
    names = ["Jane Roe", "Jane Roe Jr.", "Tip O'Neil", "Ana Peña", "C A-B", "Roe", "No Body", "中 文", "Ñ", " ", None, "Jane Roe", "x --"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again")], "doc_id int, text string, word string")
    entities = spark.createDataFrame([(n, 1) for n in names], "entity string, signal int")
    every = docs.where("doc_id is not null and text <> ''").select("doc_id", "text").crossJoin(entities.where("trim(entity) <> ''").select("entity").distinct())
    want = every.select("doc_id", "entity", T.mention_signal(F.col("entity"), F.col("text")).alias("signal")).where("signal <> 'CLEAR'")
    found = mentions(docs, entities)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert {r["signal"] for r in found.collect()} == {"HOT", "WARM", "UNKNOWN"}
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert mentions(docs.limit(0), entities).count() == 0 and mentions(docs, entities.limit(0)).count() == 0

    features = {r["entity"]: (r["value"], r["evidence"], r["available_at"]) for r in mention_features(found, entities, F.lit("2026-01-02 00:00:00")).collect()}
    at = dt.datetime(2026, 1, 2)
    assert features["Jane Roe"] == ("HOT", "11", at) and features["No Body"] == ("CLEAR", "", at) and len(features) == len({n for n in names if n and n.strip()})


def test_places_of_tokens_tell_what_patterns_tell(spark):
    rng = random.Random(4)
    parts = ["Jane", "Roe", "Roe", "Mr", "Mrs", "Messrs", "vice", "Cloture", "the", "x" * 18, "y", "Zoë", "Ñu", "a\u0301b", "中", "I\u0307", "İ", "😀", "O'Neil", "_Roe", "Roebuck", "7"]
    gaps = [" ", " ", " ", ". ", ".", ".   ", ".    ", ", ", "\n", " 😀 ", "-", "'", " \u0301", ".\u00a0", " " * 19]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.choice([3, 8, 30, 120]))) for _ in range(250)]
    texts += ["vice Roe vice Roe", "vice vice", "vice Mr. Roe Roe", "Mr. Mr. Roe", "vice " + "x" * 30 + " Roe y Roe y Roe", "vice x Roe y" + "y" * 40 + " Roe", "Mr.", "lathe Roe", "Roe the", "Roe the Roebuck", "Jane" + " " * 40 + "Roe", "Jane" + " " * 41 + "Roe", "Jane" + "😀" * 40 + "Roe"]
    names = ["Jane Roe", "Roe", "Roe Jane", "Jane Mr", "Mr Roe", "x vice", "vice", "Zoë Ñu", "Ñu Zoë", "a\u0301b Roe", "y 中", "Tip O'Neil", "O'Neil Roe", "Jane 7", "y y", "Jane İ", "😀 Roe", "Roe 😀", "Mrs Messrs", "\u0301 Roe"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    entities = spark.createDataFrame([(n,) for n in names], "entity string")
    for marks in ({}, {"section_word": "the", "span": 9, "near": 3}):
        want = docs.crossJoin(entities).select("doc_id", "entity", T.mention_signal(F.col("entity"), F.col("text"), **marks).alias("signal")).where("signal <> 'CLEAR'").collect()
        assert sorted(map(tuple, mentions(docs, entities, **marks).collect())) == sorted(map(tuple, want)) and len(want) > 500
        assert {r["signal"] for r in want} == {"HOT", "WARM", "UNKNOWN"}


def test_parts_of_a_batch_give_the_same(spark, monkeypatch):
    tokens = [["Jane", " ", "Roe", " "] * 5, ["vice", " ", "Roe", ""], [""], ["Roe", ". ", "Jane"] * 4]
    names = [[{"entity": f"{a} {b}", "first": a, "last": b} for a, b in (("Jane", "Roe"), ("Roe", "Jane"), ("No", "Body"))]] * 4
    batch = pa.RecordBatch.from_pydict({"doc_id": [5, 6, 7, 8], "names": names, "tokens": tokens, "section": [["Roe"], [], [], ["Jane"]]})
    schema = pa.schema([("doc_id", pa.int32()), ("entity", pa.string()), ("signal", pa.string())])
    rows = lambda: sorted(tuple(r.values()) for b in M._judge(40, schema)([batch, batch.slice(1, 2)]) for r in b.to_pylist())
    want = rows()
    assert want == [(5, "Jane Roe", "HOT"), (5, "Roe Jane", "WARM"), (8, "Jane Roe", "WARM"), (8, "Roe Jane", "HOT")]
    for n in (1, 7):
        monkeypatch.setattr(M, "_TOGETHER", n)
        assert rows() == want


def test_many_names_cost_little_more_than_few(spark):
    names = [(f"A{i} B{i}",) for i in range(400)]
    text = " ".join(f"B{i} {'w' * 60}" for i in range(400))
    docs = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string").repartition(2).cache()

    def took(k):
        began = time.time()
        assert mentions(docs, spark.createDataFrame(names[:k], "entity string")).count() == 12 * k
        return time.time() - began

    took(2)
    assert took(400) < 4 * took(2) + 2
