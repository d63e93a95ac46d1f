"""Streaming forms of keep-first dedup and of counts, as an extension: event time, watermark, tumbling windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame, column: str = "ts", late: str = "2 days") -> DataFrame:
    """The column as a timestamp with zone, which watermarks need, and the watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def first_seen(events: DataFrame, *keys: str, column: str = "ts", late: str = "2 days") -> DataFrame:
    """One event per key within the watermark; the state of old keys goes."""
    return timed(events, column, late).dropDuplicatesWithinWatermark(list(keys))


def counts(events: DataFrame, *keys: str, column: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and key."""
    return timed(events, column, late).groupBy(F.window(column, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and returns its result from files; in complete mode each batch writes the whole
    result anew, and the last one counts."""
    spark: SparkSession = stream.sparkSession
    name = f"s{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/{name}.state").trigger(availableNow=True)
    if mode == "complete":
        last: list[str] = []

        def write(batch: DataFrame, number: int) -> None:
            path = f"{folder}/{name}/{number}"
            batch.write.mode("overwrite").parquet(path)
            last[:] = [path]

        writer.outputMode("complete").foreachBatch(write).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
    writer.outputMode(mode).format("parquet").option("path", f"{folder}/{name}").start().awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")
