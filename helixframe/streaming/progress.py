"""The progress of runs as a stateful stream: one row of state for each run, with a timer.

A step marker is (run, step, seconds, planned); steps count from 0. Markers may come late,
out of order or again: the state holds the steps that were seen as merged ranges and the
timings of the ``window`` highest steps, so any order gives what ``batch_progress`` gives.
Of a step's markers the slowest counts. A run that sends nothing for ``patience`` seconds
is stalled until it reports again. That timer goes by the time of arrival (of the batch):
rows behind a watermark of the steps' own times would be dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helixframe.operators.aggregates import remaining_seconds

STEP = "run string, step long, seconds double, planned long"
PROGRESS = "run string, version long, completed long, planned long, mean_seconds double, remaining_seconds double, status string"
NAMES = [c.split()[0] for c in PROGRESS.split(", ")]


def merged(ranges: list[list[int]], steps: np.ndarray) -> list[list[int]]:
    """Disjoint half-open ranges, in order, that also hold ``steps``."""
    steps = np.unique(steps)
    cuts = np.flatnonzero(np.diff(steps) > 1) + 1
    new = [[int(p[0]), int(p[-1]) + 1] for p in np.split(steps, cuts) if len(p)]
    out: list[list[int]] = []
    for a, b in sorted(ranges + new):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def slowest(tail: dict[int, float], steps: np.ndarray, seconds: np.ndarray, window: int) -> dict[int, float]:
    """The largest timing of each of the ``window`` highest steps of both."""
    steps = np.concatenate((np.fromiter(tail.keys(), np.int64, len(tail)), np.asarray(steps, np.int64)))
    seconds = np.concatenate((np.fromiter(tail.values(), float, len(tail)), np.asarray(seconds, float)))
    order = np.lexsort((seconds, steps))
    steps, seconds = steps[order], seconds[order]
    last = np.flatnonzero(np.append(steps[1:] != steps[:-1], True)[: len(steps)])[-window:]
    return dict(zip(steps[last].tolist(), seconds[last].tolist()))


def progress_stream(markers: DataFrame, patience: float = 3600.0, window: int = 100) -> DataFrame:
    """``PROGRESS`` rows of a stream of markers (``STEP``), one for each run that a batch changes; ``version`` grows by one.

    Rows without a step are no markers. Without any planned number a run never completes.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"ranges": [], "tail": {}, "planned": None, "version": 0}
        if not state.hasTimedOut:
            tail = {int(k): v for k, v in held["tail"].items()}
            for frame in frames:  # a few rows as a rule, so arrays and no frames are made of them
                steps, seconds, planned = frame["step"].to_numpy(np.int64), frame["seconds"].to_numpy(float), frame["planned"].dropna().to_numpy()
                held["ranges"] = merged(held["ranges"], steps)
                timed = ~np.isnan(seconds)
                tail = slowest(tail, steps[timed], seconds[timed], window)
                if len(planned):
                    held["planned"] = max(held["planned"] or 0, int(planned.max()))
            held["tail"] = tail
        done = sum(b - a for a, b in held["ranges"])
        complete = held["planned"] is not None and done >= held["planned"]
        held["version"] += 1
        timings = list(held["tail"].values())
        mean = sum(timings) / len(timings) if timings else None
        rest = None if mean is None or held["planned"] is None else mean * max(0, held["planned"] - done)
        status = "complete" if complete else "stalled" if state.hasTimedOut else "running"
        state.update((json.dumps(held),))
        if status == "running":
            state.setTimeoutTimestamp(state.getCurrentProcessingTimeMs() + max(1, int(patience * 1000)))
        row = (key[0], held["version"], done, held["planned"], mean, rest, status)
        yield pd.DataFrame(np.array([row], dtype=object), columns=NAMES)

    arrived = markers.filter("step is not null").withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds")
    return arrived.groupBy("run").applyInPandasWithState(update, PROGRESS, "held string", "update", GroupStateTimeout.EventTimeTimeout)


def keep_progress(progress: DataFrame, folder: str, checkpoint: str) -> None:
    """Take what is there and end; a batch that is run again after a crash replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    progress.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def latest_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each run."""
    rows = spark.read.schema(PROGRESS).parquet(folder)
    rest = [c for c in rows.columns if c != "run"]
    return rows.groupBy("run").agg(F.max_by(F.struct(*rest), "version").alias("_p")).select("run", "_p.*")


def batch_progress(markers: DataFrame, window: int = 100) -> DataFrame:
    """(run, completed, planned, mean_seconds, remaining_seconds, complete) of all markers at once."""
    steps = markers.filter("step is not null").groupBy("run", "step").agg(F.max("seconds").alias("seconds"), F.max("planned").alias("planned"))
    totals = steps.groupBy("run").agg(F.count("*").alias("completed"), F.max("planned").alias("planned"))
    # a limit on the row number is taken before the shuffle as well
    tail = steps.filter("seconds is not null").withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("step")))).filter(F.col("_n") <= window)
    means = tail.groupBy("run").agg(F.avg("seconds").alias("mean_seconds")).withColumnRenamed("run", "_run")
    out = totals.join(means, F.col("run").eqNullSafe(F.col("_run")), "left").drop("_run")
    left = remaining_seconds(F.col("mean_seconds"), F.col("completed"), F.col("planned"))
    return out.select("run", "completed", "planned", "mean_seconds", F.when(F.col("planned").isNotNull(), left).alias("remaining_seconds"), F.coalesce(F.col("completed") >= F.col("planned"), F.lit(False)).alias("complete"))
