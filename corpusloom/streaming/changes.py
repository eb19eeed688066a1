"""Change detection over a stream of file snapshots: the streaming form of `operators.lifecycle.detect_changes`.

Each micro-batch adds the rows that it changed to a state table, under its number; of a key's rows that of the newest
batch counts. Every EVERY-th batch writes the whole state instead, and drops what lies before the whole state that
precedes it. A batch that is run again after a failure reads only older batches and overwrites its own, so it gives the
same state.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lifecycle
from ..session import checkpoint

STATE = "path string, file_mtime double, file_hash string, generation int"
#: Batches from one whole state to the next.
EVERY = 32


def _table(spark: SparkSession, folder: str, before: int | None) -> DataFrame | None:
    """The rows (state, batch, whole) from the last whole state on, of batches before a number; none if there is no table."""
    try:
        rows = spark.read.schema(f"{STATE}, whole int, batch long").parquet(folder)
    except AnalysisException:  # there is no state yet
        return None
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    last = rows.filter("whole = 1").agg(F.max("batch")).first()[0]
    return rows if last is None else rows.filter(F.col("batch") >= last)


def _newest(rows: DataFrame) -> DataFrame:
    return lifecycle.latest(rows, ["path"], [F.desc("batch")]).drop("batch", "whole")


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The state that the last finished batch left; empty before the first."""
    rows = _table(spark, folder, None)
    return spark.createDataFrame([], STATE) if rows is None else _newest(rows)


def _drop_before(spark: SparkSession, folder: str, number: int) -> None:
    """Batches before the last whole state before a number: no batch that may be run again reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(int(s.getPath().getName().split("=")[1]), whole, s.getPath()) for whole in (0, 1) for s in files.globStatus(path(f"{folder}/whole={whole}/batch=*")) or ()]
    last = max((n for n, whole, _ in found if whole and n < number), default=0)
    for n, _, where in found:
        if n < last:
            files.delete(where, True)


def apply(batch: DataFrame, number: int, state_folder: str, actions_folder: str) -> None:
    """One micro-batch of (path, mtime, hash): actions to one table, what it changes of the state to the other."""
    spark = batch.sparkSession
    old = _table(spark, state_folder, number)
    now = checkpoint(lifecycle.latest(batch, ["path"], [F.desc("mtime"), "hash"]))
    # only rows of files in this batch are compared: a small batch is broadcast by AQE, and the state is not shuffled
    state = spark.createDataFrame([], STATE) if old is None else _newest(old.join(now.select("path"), "path", "left_semi"))
    actions = checkpoint(lifecycle.detect_changes(state, now))
    actions.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{actions_folder}/n{number}")
    new = now.join(actions.filter("action <> 'skip_mtime'"), "path")
    new = new.select("path", F.col("mtime").alias("file_mtime"), F.col("hash").alias("file_hash"), F.col("generation").cast("int").alias("generation"))
    whole = number % EVERY == EVERY - 1
    if whole and old is not None:
        new = _newest(old).join(new.select("path"), "path", "left_anti").unionByName(new)
    new.write.mode("overwrite").parquet(f"{state_folder}/whole={int(whole)}/batch={number}")
    if whole:
        _drop_before(spark, state_folder, number)


def follow(snapshots: DataFrame, state_folder: str, actions_folder: str, checkpoint: str) -> StreamingQuery:
    """Start following a stream of snapshots; takes what is there and stops (use a processing-time trigger to go on)."""
    step = lambda batch, number: apply(batch, number, state_folder, actions_folder)
    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
