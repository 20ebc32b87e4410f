"""Incremental indexing: fingerprints that arrive as files are upserted in bounded micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(old: DataFrame | None, new: DataFrame, key: str = "episode_id") -> DataFrame:
    """One row per key: of the new rows the latest created, else the old one."""
    both = new.withColumn("_at", F.lit(1)) if old is None else new.withColumn("_at", F.lit(1)).unionByName(old.withColumn("_at", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("created_at")))
    return both.withColumn("_n", rank).where("_n = 1").drop("_n", "_at")


def index_incrementally(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 100):
    """Run all waiting batches and stop; the checkpoint is the queue of what is still pending.

    Each batch appends to a folder of its own (target/batch=n), so a batch that is run again replaces itself.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def put(batch: DataFrame, n: int) -> None:
        latest(None, batch).write.mode("overwrite").parquet(f"{target}/batch={n}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def indexed(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The index as it stands: of each episode the row of the last batch."""
    rows = spark.read.schema(f"{schema}, batch INT").parquet(target)
    rank = F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("batch")))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n", "batch")
