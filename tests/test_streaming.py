import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.panel import bars, select_shocks, shock_features
from tidemark.sources import store
from tidemark.sources.tables import trades
from tidemark.streaming import jobs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tape(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tape") / "t")
    trades(spark, DATA).withColumn("created_time", F.col("created_time").cast("timestamp")).repartition(1).sortWithinPartitions("created_time").write.parquet(path)
    return spark.read.parquet(path).schema, path


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streamed_bars_equal_batch_bars(spark, tape):
    schema, path = tape
    streamed = drain(jobs.hourly_bars(spark.readStream.schema(schema).parquet(path)), "bars", "append")
    batch = bars(spark.read.parquet(path)).withColumn("hour", F.col("hour").cast("timestamp"))
    end = streamed.agg(F.max("hour")).first()[0]
    a = sorted(tuple(r) for r in streamed.select("ticker", "hour", "total_volume", "yes_volume", "close_price", "yes_close").collect())
    b = sorted(tuple(r) for r in batch.where(F.col("hour") <= F.lit(end)).select("ticker", "hour", "total_volume", "yes_volume", "close_price", "yes_close").collect())
    assert a and {x for x in a if x[1] < end} == {x for x in b if x[1] < end}


def test_streamed_shocks_equal_batch_shocks(spark, tape, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rule = dict(volume=4, multiple=0.5, share=0.5, jump=1, gap_hours=1000)
    batch = bars(spark.read.parquet(tape[1])).withColumn("hour", F.col("hour").cast("timestamp"))
    batch.repartition(1).sortWithinPartitions("hour").write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "b"))
    got = drain(jobs.shocks(stream, jobs.ShockDetector(least=3, **rule)), "shocks", "append").collect()
    want = select_shocks(shock_features(batch.withColumn("hour", F.col("hour").cast("timestamp_ntz")), least=3), **rule).collect()
    assert {(r["ticker"], r["hour"]) for r in got} == {(r["ticker"], r["hour"]) for r in want} and want


def test_latest_book_and_upsert(spark, tmp_path):
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "a.json").write_text('{"ts": "1", "ticker": "A", "yes": [["1", "2"]], "no": []}\nbroken\n{"ts": "3", "ticker": "A", "yes": [], "no": [["9", "9"]]}\n')
    from tidemark.sources.landed import book_capture

    got = drain(jobs.latest_books(book_capture(spark, str(tmp_path / "books"), stream=True)), "books", "complete").where("ticker is not null").collect()
    assert [(r["ticker"], r["ts"]) for r in got] == [("A", "3")]
    src = str(tmp_path / "rows")
    at = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("k", at, 1), ("k", at + dt.timedelta(hours=1), 2), ("l", at, 3)], "key string, ts timestamp, v int")
    rows.write.parquet(src)
    for _ in range(2):
        q = jobs.incremental_upsert(spark.readStream.schema(rows.schema).parquet(src), str(tmp_path / "t"), str(tmp_path / "c"), ["key"], "ts")
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_running_extremes_and_late_features(spark, tmp_path):
    from tidemark.sources.landed import FEATURES

    at = lambda h, d=1: dt.datetime(2026, 1, d, h)
    src = str(tmp_path / "r")
    readings = spark.createDataFrame([("s", at(1), at(1), 5.0), ("s", at(3), at(3), 9.0), ("s", at(2), at(2), 1.0), ("s", at(1, 2), at(1, 2), 4.0)], "station string, local_time timestamp, ts timestamp, value double")
    readings.write.parquet(src)
    got = drain(jobs.running_extremes(spark.readStream.schema(readings.schema).parquet(src)), "extremes", "complete").collect()
    assert sorted((r["local_date"].day, r["max_so_far"], r["min_so_far"], r["available_at"]) for r in got) == [(1, 9.0, 1.0, at(4)), (2, 4.0, 4.0, at(2, 2))]

    names = [f.name for f in FEATURES.fields]
    rows = [("s", "e", "m", at(5, 20), at(5, 20), at(6, 20), "new", "r2", "x"), ("s", "e", "m", at(5), at(5), at(6), "late", "r1", "x"), ("s", "e", "m", at(5), at(5), at(7), "again", "r1", "x")]
    for i, r in enumerate(rows):  # the second lands weeks behind the first
        spark.createDataFrame([r], names).select([F.col(f.name).cast(f.dataType) for f in FEATURES.fields]).write.mode("append").parquet(str(tmp_path / "f"))
        q = jobs.feature_append(spark.readStream.schema(FEATURES).parquet(str(tmp_path / "f")), str(tmp_path / "t"), str(tmp_path / "c"))
        q.awaitTermination(120)
    assert sorted(r["value"] for r in store.read(spark, str(tmp_path / "t")).collect()) == ["again", "new"]


def test_ingest_of_overlapping_and_late_pieces(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2026, 1, 1) + dt.timedelta(days=d, hours=h)
    pieces = [
        [(i, at(i)) for i in range(0, 40) if i != 38],
        [(i, at(i)) for i in range(38, 70)],  # 38 comes late, 39 again
        [(i, at(i)) for i in range(68, 90)] + [(3, at(3))],  # 3 is older than the overlap: it was taken long ago
    ]
    kind, touched = "k long, at timestamp", []
    for n, piece in enumerate(pieces):
        before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("_part=2026-01/*.parquet")}
        spark.createDataFrame(piece, kind).repartition(2).write.mode("append").parquet(str(tmp_path / "landed"))
        for _ in range(2):  # the second run finds nothing new
            rows = spark.readStream.schema(kind).parquet(str(tmp_path / "landed"))
            jobs.incremental_ingest(rows, str(tmp_path / "t"), str(tmp_path / "log"), ["k", "at"], "at", F.date_format("at", "yyyy-MM")).awaitTermination()
        if n == 2:
            assert before and {f: f.stat().st_mtime_ns for f in before} == before
    assert sorted(r["k"] for r in store.read(spark, str(tmp_path / "t")).collect()) == list(range(90))
    assert set(store.current(spark, str(tmp_path / "t")).parts) == {"2026-01", "2026-02", "2026-03"}


def test_shocks_from_trades_out_of_order(spark, tape, tmp_path):
    """Files whose trades are mixed within the watermark, in several runs, give the shocks of the batch form."""
    rule = dict(volume=4, multiple=0.5, share=0.5, jump=1, gap_hours=1000)
    schema, path = tape
    t = spark.read.parquet(path)
    low, high = t.agg(F.min("created_time"), F.max("created_time")).first()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = []
    keep = lambda b, _: rows.extend(b.collect())
    for part in range(3):
        cut = lambda k: low + (high - low) * k / 3
        late = F.col("created_time") - F.expr("interval 20 minutes") * F.pmod("trade_id", F.lit(3))  # up to 40 minutes later than its time
        piece = t.where((late >= F.lit(cut(part))) & (late < F.lit(cut(part + 1)))) if part else t.where(late < F.lit(cut(1)))
        piece = piece if part < 2 else t.where(late >= F.lit(cut(2)))
        piece.repartition(2).write.mode("append").parquet(str(tmp_path / "landed"))
        stream = jobs.tape_shocks(spark.readStream.schema(schema).parquet(str(tmp_path / "landed")), detector=jobs.ShockDetector(least=3, **rule))
        stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    batch = select_shocks(shock_features(bars(t), least=3), **rule)
    closed = high - dt.timedelta(hours=2)
    want = {(r["ticker"], r["hour"]) for r in batch.collect() if r["hour"] <= closed}
    assert want and {(r["ticker"], r["hour"].replace(tzinfo=None)) for r in rows} == want


def test_chunks_after_a_kill(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq
    from pyspark.errors import StreamingQueryException
    from pyspark.sql import DataFrameWriter

    rows = spark.range(900).union(spark.range(5))
    rows.repartition(6).write.parquet(str(tmp_path / "landed"))

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "landed"))
        jobs.chunked_flush(stream, str(tmp_path / "t"), str(tmp_path / "log"), ["id"], 100).awaitTermination(120)

    write = DataFrameWriter.parquet

    def killed(self, path, *a, **k):
        if path.endswith("chunk-00000001"):
            write(self, path, *a, **k)
            (tmp_path / "t" / "chunk-00000001" / "_SUCCESS").unlink()  # as if killed before all of it was written
            raise RuntimeError("killed")
        write(self, path, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", killed)
        with pytest.raises(StreamingQueryException):
            run()
    first = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "chunk-00000000").glob("*.parquet")}
    assert first and jobs.flushed(spark, str(tmp_path / "t"), rows.schema).count() < 400
    run()
    got = jobs.flushed(spark, str(tmp_path / "t"), rows.schema)
    assert {r["id"] for r in got.collect()} == set(range(900)) and got.count() <= 905
    assert {f: f.stat().st_mtime_ns for f in first} == first
    sizes = [pq.read_metadata(f).num_rows for f in (tmp_path / "t").rglob("*.parquet")]
    assert max(sizes) <= 100 and len(list((tmp_path / "t").iterdir())) == 3
    assert jobs.flushed(spark, str(tmp_path / "none"), rows.schema).count() == 0
