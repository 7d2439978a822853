"""Pages as a stream: every page operator is complete within a page, so a micro-batch of whole pages is a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies a page operator to every micro-batch and appends its rows under path; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def station_counts(stream: DataFrame, time: str = "loaded_at", late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Rows and mean confidence by station and day of arrival, each row_id once within the allowed lateness."""
    once = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["row_id"])
    return once.groupBy(F.window(time, window).alias("w"), "station").agg(F.count("*").alias("n"), F.avg(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("mean_confidence")).select(F.col("w.start").alias("day"), "station", "n", "mean_confidence")
