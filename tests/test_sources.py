"""Sources, sinks, streams and the driver contract."""

from __future__ import annotations

import json
import sqlite3

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from quantloom.sources import files, sinks
from quantloom.streaming import bars as stream


def test_csv_parquet_and_sqlite_prices_agree(spark, tmp_path):
    rows = [("AAA", "US", "2024-01-02T00:00:00Z", "1", "2", "1", "1.5", "10"), ("BBB", "US", "2024-01-03T00:00:00+01:00", "1", "2", "1", "1.6", "")]
    (tmp_path / "p.csv").write_text(",".join(files.PRICE_COLUMNS) + "\n" + "\n".join(map(",".join, rows)) + "\n")
    csv = files.csv_prices(spark, str(tmp_path / "p.csv"))
    csv.write.parquet(str(tmp_path / "p.parquet"))
    with sqlite3.connect(tmp_path / "p.db") as db:
        db.execute(f"CREATE TABLE prices ({', '.join(files.PRICE_COLUMNS)})")
        db.executemany("INSERT INTO prices VALUES (?,?,?,?,?,?,?,?)", [[x or None for x in r] for r in rows])
    want = sorted(map(tuple, csv.collect()), key=str)
    assert sorted(map(tuple, files.parquet_prices(spark, str(tmp_path / "p.parquet")).collect()), key=str) == want
    lite = files.sqlite_table(spark, str(tmp_path / "p.db"))
    assert sorted(map(tuple, lite.collect()), key=str) == want
    assert lite.where("symbol = 'BBB'").count() == 1
    (tmp_path / "bad.csv").write_text("symbol,observed_at,close\nA,2024-01-02 00:00:00,1\n")
    with pytest.raises(Exception, match="zone"):
        files.csv_prices(spark, str(tmp_path / "bad.csv")).collect()


def test_observations_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("A", "m", 1.0)], "symbol string, metric string, value double")
    sinks.save_observations(df, str(tmp_path / "o"), "r1")
    assert sinks.load_observations(spark, str(tmp_path / "o"), "r1").drop("run_id").collect() == df.collect()
    with pytest.raises(Exception, match="exist"):
        sinks.save_observations(df, str(tmp_path / "o"), "r1")
    assert json.loads(sinks.as_json(df).first().value) == {"metric": "m", "symbol": "A", "value": 1.0}


def test_request_queue_runs_each_request_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"request_id": "1", "analyst": "x", "symbol": "A"}\n')
    run = lambda s, name: s.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, value double")
    for _ in range(2):
        sinks.run_queue(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), run)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(400).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 7 + 1.0).alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    read = spark.readStream.schema("symbol string, ts timestamp, value double").parquet(str(tmp_path / "t"))
    q = stream.tick_bars(read).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("bars").collect()}
    assert got == {tuple(r) for r in stream.tick_bars(rows).collect()} and len(got) == 134
    closes = spark.readStream.schema("symbol string, ts timestamp, value double").parquet(str(tmp_path / "t")).withColumnRenamed("value", "close")
    q = stream.running_ema(closes, 10).writeStream.format("memory").queryName("ema").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    from quantloom.operators.indicators import ema

    got = [r.ema for r in spark.table("ema").orderBy("ts").collect()]
    want = ema(rows.orderBy("ts").toPandas().value.to_numpy(), 10)
    assert got[:9] == [None] * 9 and got[9:] == pytest.approx(want[9:].tolist())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
