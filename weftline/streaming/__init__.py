"""Watching traffic: windowed flows and scores of a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import flow
from weftline.operators.scoring import Profile, assemble, detected


def windowed_flows(packets: DataFrame, key: Column, width: str = "5 minutes", late: str | None = None) -> DataFrame:
    """Flows of each closed window of a stream of packets with a timestamp `ts`; windows wait `late` (one window) for late rows."""
    seen = packets.withWatermark("ts", late or width)
    return seen.groupBy(F.window("ts", width).alias("w"), key.alias("flow_key")).agg(*flow.metrics(F.col("up"), F.col("octets"), F.col("us"))).withColumn("window_start", F.unix_micros("w.start")).drop("w")


def watch(flows: DataFrame, profile: Profile, columns: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, threshold: float | None = None, once: bool = False, timeout: float | None = None) -> StreamingQuery:
    """Scores every micro-batch of closed windows against the profile and hands it to the sink; with a timeout in seconds, waits that long and stops."""

    def each(batch: DataFrame, number: int) -> None:
        scored = profile.score(assemble(batch, columns))
        sink(detected(scored, threshold) if threshold is not None else scored, number)

    writer = flows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if timeout is not None and not query.awaitTermination(timeout):
        query.stop()
    return query


def replay(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Recorded packets as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def paced(packets: DataFrame, path: str, speed: float, slice_us: int = 1_000_000, wait: Callable[[float], None] = time.sleep) -> int:
    """Writes recorded packets into a folder that `replay` reads, at `speed` times the pace of their times `us`.

    A slice of slice_us of recorded time is written when slice offset / speed seconds have passed since the start; packets
    keep their times, slices without packets are waited for but not written. The driver holds one number a slice.
    Returns the number of slices written; an empty table writes none."""
    if speed <= 0:
        raise ValueError("speed must be above 0")
    first = packets.agg(F.min("us")).first()[0]
    if first is None:
        return 0
    numbered = packets.withColumn("_slice", F.expr(f"(us - {first}) div {slice_us}")).cache()
    try:
        slices, start = [r[0] for r in numbered.select("_slice").distinct().orderBy("_slice").toLocalIterator()], time.monotonic()
        for n in slices:
            ahead = n * slice_us / 1e6 / speed - (time.monotonic() - start)
            if ahead > 0:
                wait(ahead)
            numbered.where(F.col("_slice") == n).drop("_slice").coalesce(1).write.mode("append").parquet(path)
    finally:
        numbered.unpersist()
    return len(slices)
