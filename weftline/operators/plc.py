"""Function blocks over ordered signals: edges, counters, on-delay timers, moving statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(df: DataFrame, value: Column, key: str, order: str) -> DataFrame:
    """rising: now true and before false, the state before the first being true; falling: now false and before true."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.lag(value).over(w), F.lit(True))
    return df.withColumns({"rising": value & ~before, "falling": ~value & before})


def up_counter(df: DataFrame, pulse: Column, reset: Column, key: str, order: str, preset: int) -> DataFrame:
    """Pulses since the last reset, and whether they have reached the preset."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = df.withColumn("_r", F.sum(reset.cast("int")).over(w))
    n = F.sum((pulse & ~reset).cast("int")).over(Window.partitionBy(key, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("counter", n.cast("long")).withColumn("done", F.col("counter") >= preset).drop("_r")


def on_delay(df: DataFrame, value: Column, key: str, order: str, at: str, delay: float) -> DataFrame:
    """True once the input has been true without a break for `delay`."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    since = F.min(F.when(value, F.col(at))).over(Window.partitionBy(key, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_g", F.sum((~value).cast("int")).over(w)).withColumn("delayed", value & (F.col(at) - since >= delay)).drop("_g")


def moving_stats(df: DataFrame, value: str, key: str, order: str, n: int = 50) -> DataFrame:
    """Mean, least and greatest of the last n values; places not yet filled count as 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    short = F.count("*").over(w) < n
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumns({"avg_n": F.sum(value).over(w) / n, "min_n": F.when(short, F.least(low, F.lit(0.0))).otherwise(low), "max_n": F.when(short, F.greatest(high, F.lit(0.0))).otherwise(high)})


def down_counter(df: DataFrame, pulse: Column, load: Column, key: str, order: str, preset: int) -> DataFrame:
    """The preset less the pulses since the last load, not below zero; done at zero."""
    counted = up_counter(df, pulse, load, key, order, preset)
    return counted.withColumn("counter", F.greatest(F.lit(preset) - F.col("counter"), F.lit(0)).cast("long")).withColumn("done", F.col("counter") == 0)


def off_delay(df: DataFrame, value: Column, key: str, order: str, at: str, delay: float) -> DataFrame:
    """True while the input is, and for less than `delay` after it last was."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(value, F.col(at)), ignorenulls=True).over(w)
    return df.withColumn("held", F.coalesce(value | (F.col(at) - last < delay), F.lit(False)))


def pid(df: DataFrame, key: str, order: str, at: str, value: str, target: float, kp: float, ki: float, kd: float, low: float, high: float) -> DataFrame:
    """A controller's output at each row; its integral is clamped to [low, high], so each value needs the one before: one key's rows at a time."""

    def run(table):
        table, out, total, before, then = table.sort_values(order), [], 0.0, None, None
        for t, x in zip(table[at], table[value], strict=True):
            step, error = (t - then if then is not None else 0.0), target - x
            total = min(high, max(low, total + ki * error * step))
            slope = (error - before) / step if before is not None and step > 0 else 0.0
            out.append(min(high, max(low, kp * error + total + kd * slope)))
            before, then = error, t
        return table.assign(output=out)

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "output double"])
    return df.groupBy(key).applyInPandas(run, shape)
