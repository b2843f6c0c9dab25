"""A folder of completion markers as a stream: act once every awaited run has reported.

The batch equivalent is ``sources.tables.wait_until``. The stream takes what is there
and ends (trigger availableNow), so it can be scheduled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "run string, status string, completed long, planned long"


def marker_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MARKER).json(folder)


def when_complete(spark: SparkSession, folder: str, checkpoint: str, runs: list[str], act: Callable[[DataFrame], None]) -> bool:
    """Read new markers; call ``act`` with the latest state once all ``runs`` are complete. True if they are."""
    state = marker_stream(spark, folder).groupBy("run").agg(F.max_by("status", "completed").alias("status"), F.max("completed").alias("completed"), F.max("planned").alias("planned"))
    done = []

    def look(batch: DataFrame, _: int) -> None:
        complete = batch.filter(F.col("run").isin(runs) & (F.col("status") == "complete") & (F.col("completed") == F.col("planned")))
        if complete.select("run").distinct().count() == len(set(runs)):
            act(batch)
            done.append(True)

    state.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    return bool(done)
