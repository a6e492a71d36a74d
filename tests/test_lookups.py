import datetime as dt

from pyspark.sql import functions as F

from tidemark.plans import lookups


def test_hourly_payloads_are_bounded(spark, tmp_path, monkeypatch):
    start = dt.datetime(2025, 3, 1)
    # One station holds nearly all events: 3 days, each second used many times over.
    rows = [(i, 1, start + dt.timedelta(hours=i % 72, seconds=i % 5, microseconds=i), float(i % 997)) for i in range(40_000)]
    rows += [(50_000, 2, start, 3.5), (50_001, 2, start + dt.timedelta(hours=1), None)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    seen, plain = [], lookups.D.hourly_forecasts
    monkeypatch.setattr(lookups.D, "hourly_forecasts", lambda payloads: seen.append(payloads) or plain(payloads))
    got = {(r["station"], r["lead_days"], r["target_date"], r["weather_stat"]): (r["forecast_f"], r["available_at"]) for r in lookups.hourly(spark, str(tmp_path)).collect()}
    want = {}
    for station in (1, 2):
        for day in {r[2].date() for r in rows if r[1] == station}:
            of = [r for r in rows if r[1] == station and r[2].date() == day and r[3] is not None]
            last = max(r[2] for r in of).replace(microsecond=0)
            for lead in (1, 2):
                for stat, f in (("max", max), ("min", min)):
                    want[station, lead, str(day), stat] = (f(r[3] for r in of) + lead, last - dt.timedelta(days=lead) + dt.timedelta(hours=6))
    assert got == want
    assert seen[0].agg(F.max(F.length("payload"))).first()[0] < 2000


def test_tiers_read_whole_texts(spark, tmp_path):
    rows = [(1, "plain words " * 100 + "football", "en", "src1"), (2, "plain words " * 100, "en", "src1"), (3, "tennis", "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["tier"] for r in lookups.tiers(spark, str(tmp_path)).collect()}
    assert got == {1: "instrumentation", 2: "deployment", 3: "instrumentation"}
