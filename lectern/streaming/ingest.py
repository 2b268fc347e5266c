"""Files that arrive in a folder, upserted micro-batch by micro-batch.

The stream's checkpoint remembers which files were read, so a restart goes on where it stopped; each batch is one snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import SnapshotTable


def ingest(spark: SparkSession, folder: str, schema: str, table: SnapshotTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = True, max_files: int = 1000) -> StreamingQuery:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            table.upsert(prepare(df))

    out = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def activity(events: DataFrame, length: str = "1 hour", late: str = "1 day", time: str = "ts") -> DataFrame:
    """Counts per window and kind of a stream (or table) of log events; rows later than the watermark are dropped."""
    rows = events.withColumn("ts", F.col(time).cast("timestamp"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
