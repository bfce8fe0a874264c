"""Expressions over streams: the same query, kept up to date as files arrive.

The operators compile to DataFrame plans, and a plan over a stream is a stream.
So a query needs nothing new; a table of the catalog only has to be a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import Engine


def stream_table(engine: Engine, name: str, folder: str, event_time: str | None = None, late_by: str = "10 minutes", files_per_step: int = 64) -> DataFrame:
    """Makes a folder of Parquet files a table that grows.  With `event_time`, rows
    later than `late_by` behind the latest one may be left out, which bounds the state of aggregations."""
    spark = engine.spark
    schema = spark.read.parquet(folder).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(folder)
    engine.catalog[name.lower()] = df.withWatermark(event_time, late_by) if event_time else df
    return engine.catalog[name.lower()]


def run_available(engine: Engine, expression, path: str, checkpoint: str, mode: str = "append"):
    """Works through what has arrived since the last call with this checkpoint, writes it to `path` as Parquet, and stops.

    Aggregates without event time have no final rows; they go through keep_table()."""
    query = engine.evaluate(expression).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    running = query.outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def keep_table(engine: Engine, expression, path: str, checkpoint: str):
    """Like run_available(), for aggregates: `path` holds their whole result as of the last step."""

    def put(step: DataFrame, _: int) -> None:
        step.write.mode("overwrite").parquet(path)

    running = engine.evaluate(expression).writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint)
    running = running.trigger(availableNow=True).start()
    running.awaitTermination()
    return running
