"""Sinks: observations as typed Parquet by run, versioned JSON reports, and a micro-batched request queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "request_id string, analyst string, symbol string"


def save_observations(df: DataFrame, path: str, run_id: str) -> None:
    """One folder a run; a run is written once, and seen by readers only after Spark's commit."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("error").parquet(f"{path}/run={run_id}")


def load_observations(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/run={run_id}").drop("run")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def save_report(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("error").text(path)


def bounded(observations: DataFrame, most: int = 256, key: str = "symbol") -> DataFrame:
    """The export's bound: the first ``most`` metrics of each instrument by name."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy(key).orderBy("metric")
    return observations.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def run_queue(spark: SparkSession, requests: str, out: str, checkpoint: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    """Work off request files: each micro-batch runs every analyst asked for once; the checkpoint is the claim, and a
    repeated batch finds its results written. ``run`` refuses an analyst that it doesn't know with a KeyError; the
    requests of that analyst, and those without one, go to ``{out}_refused`` with the reason."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        refused = df.where("analyst is null").withColumn("reason", F.lit("no analyst"))
        for row in df.where("analyst is not null").select("analyst").distinct().toLocalIterator():
            asked = df.where(F.col("analyst") == row.analyst)
            try:
                found = run(spark, row.analyst)
            except KeyError:
                refused = refused.unionByName(asked.withColumn("reason", F.lit("unknown analyst")))
                continue
            folder = "".join(c if c.isalnum() or c in "-_." else f"%{ord(c):02X}" for c in row.analyst)
            found.join(asked.select("request_id", "symbol"), "symbol").write.mode("overwrite").parquet(f"{out}/batch={number}/analyst={folder}")
        refused.write.mode("overwrite").parquet(f"{out}_refused/batch={number}")
        df.unpersist()

    stream = spark.readStream.schema(REQUEST).json(requests)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
