"""Tables that survive a lost executor: written to the folder all executors share, then read again."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="shared-")


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, this process's own (a
    running session takes no value for that setting)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of ``rows`` rows at most in this session: rows with whole texts are large, and a batch of the
    usual 10,000 would take hundreds of MB in each Python worker and in the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


_made: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _made:
        paths.append(path)
    return path


@contextlib.contextmanager
def noted():
    """Yields a list that gets the paths made meanwhile."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield paths
    finally:
        _made.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    paths.clear()


def save(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: later steps neither repeat it nor depend on an executor's disk."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores appended until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, *names: str):
    """``df`` with its columns of these names renamed, and a function that selects ``df``'s own columns again."""
    taken, moved = list(df.columns), {}
    for c in df.columns:
        if c.lower() in names:
            moved[c] = fresh(taken, c)
            taken.append(moved[c])

    def restore(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns])

    return df.withColumnsRenamed(moved) if moved else df, restore
