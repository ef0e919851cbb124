"""Run a streaming frame over everything available and hand back what it wrote."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from rackpulse.session import work_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def disk_state(spark: SparkSession):
    """State on local disk with snapshots in the checkpoint folder, instead of on the heap."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def start(df: DataFrame, output: str, checkpoint: str, available_now: bool = True):
    """Append the stream to Parquet files; restartable from the checkpoint folder."""
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    with disk_state(df.sparkSession):
        return writer.start(output)


def drain(df: DataFrame, label: str) -> DataFrame:
    """Process all input present now, then read the written rows."""
    spark = df.sparkSession
    output, checkpoint = work_path(spark, label), work_path(spark, f"{label}-checkpoint")
    start(df, output, checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(output)
