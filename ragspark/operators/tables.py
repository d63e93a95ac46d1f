"""Tables made on the way: kept in the folder that all executors share, and numbered without one task for all rows."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="shared-")


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, this process's own (a
    running session takes no value for that setting)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or _own()).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so its lineage ends here."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int = 20_000, least: int = 500) -> DataFrame:
    """``df``, whose rows a later step works long on, over a task for ``rows`` rows, and where they are fewer over all cores with
    ``least`` rows each: a scan is split by bytes, and a few MB of narrow rows would be one task's work."""
    n = df.count()
    return df.repartition(max(1, -(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // least))))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of ``rows`` rows at most in this session, where a row holds much."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, to be broadcast if it has ``most`` rows at most; a larger one is joined as the planner likes."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``df`` with the rows' numbers from 0 in ``order``, which must be unique: sorted ranges, each counting on from
    those before it. They are saved first, as another run could draw the ranges elsewhere."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    rows = saved(ranged, "numbered").withColumn("_part", part)
    # One row a range.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_id", "_start")


def running(df: DataFrame, size: Column, *order: str | Column, name: str = "used", at: str = "position") -> DataFrame:
    """``df`` with the running sum of ``size`` (null: nothing) in ``order`` and the rows' numbers from 0: the sums of
    ranges of a million numbers, one row each, are added up, and within a range the rows follow one another. No range
    grows with a value that many rows share; rows that tie in ``order`` come in any order, the same in both columns."""
    rows = numbered(df.withColumn("_size", F.coalesce(size, F.lit(0))), *order, name=at).withColumn("_range", F.shiftright(at, 20))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.sum("_size").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(name, F.sum("_size").over(within)).join(F.broadcast(starts), "_range")
    return out.withColumn(name, F.col("_before") + F.col(name)).drop("_range", "_before", "_size")


def within_reach(df: DataFrame, size: Column, budget: int, *order: str) -> DataFrame:
    """The rows of ``df`` that a running sum of ``size`` (not negative) in ``order`` reaches within ``budget``, and those
    after them up to the end of the sorted range in which it exceeds the budget. Only sizes and the order's columns are
    shuffled for it; the end is one row that the driver reads and that filters the table when it is read again."""
    ranged = df.select(F.struct(*order).alias("_end"), size.alias("_size")).repartitionByRange(*[f"_end.{c}" for c in order])
    sums = ranged.groupBy(F.spark_partition_id().alias("_part")).agg(F.sum("_size").alias("_sum"), F.max("_end").alias("_end"))
    # One row a range.
    ends = sums.withColumn("_sum", F.sum("_sum").over(Window.orderBy("_part"))).where(F.col("_sum") > budget).orderBy("_part").select("_end")
    end = ends.first()
    if end is None:
        return df
    first = end["_end"][0]
    if isinstance(first, (int, str)) and not isinstance(first, bool):  # reaches the scan
        df = df.where(F.col(order[0]).isNull() | (F.col(order[0]) <= F.lit(first)))
    return df.join(F.broadcast(df.sparkSession.createDataFrame([end], ends.schema)), F.struct(*order) <= F.col("_end")).drop("_end")
