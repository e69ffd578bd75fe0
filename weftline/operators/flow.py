"""Packets to flows: metrics, protocol counters, windows, roll-ups, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import functions as X

# Protocol function codes of each counter.
READS = {"read_coils": 1, "read_discrete": 2, "read_holding": 3, "read_input": 4, "read_file": 20, "read_fifo": 24}
WRITES = {"write_coil": 5, "write_register": 6, "write_coils": 15, "write_registers": 16, "write_file": 21, "mask_write": 22, "read_write": 23}
DIAGNOSTIC = {"diagnostic": 8}
OTHERS = (7, 11, 12, 17, 43)
FUNCTIONS = READS | WRITES | DIAGNOSTIC


def metrics(up: Column, octets: Column, at: Column) -> list[Column]:
    """Packets, octets, first and last of either direction, in one pass; 0 stands for an absent time."""
    out = []
    for name, side in (("fwd", up), ("rev", ~up)):
        out += [
            F.count_if(side).alias(f"{name}_packets"),
            F.coalesce(F.sum(F.when(side, octets)), F.lit(0)).alias(f"{name}_octets"),
            F.min(F.when(side & (at != 0), at)).alias(f"{name}_first"),
            F.max(F.when(side & (at != 0), at)).alias(f"{name}_last"),
        ]
    return out


def merged() -> list[Column]:
    """The metrics of flows that are merged: sums, least first, greatest last."""
    pick = {"packets": F.sum, "octets": F.sum, "first": F.min, "last": F.max}
    return [f(f"{side}_{k}").alias(f"{side}_{k}") for side in ("fwd", "rev") for k, f in pick.items()]


def windowed(packets: DataFrame, width_us: int, anchor_us: int | None = 0) -> DataFrame:
    """window_start and window_index; without an anchor windows count from the first packet, one small aggregate."""
    if anchor_us is None:
        anchor_us = packets.agg(F.min("us")).first()[0] or 0
    start = X.tumbling_start(F.col("us"), width_us, anchor_us)
    return packets.withColumns({"window_start": start, "window_index": F.floor((F.col("us") - anchor_us) / width_us).cast("long")})


def first_windows(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("window_index") < n)


def windows_within(timeout_s: float, width_s: float) -> int:
    return min(2**31 - 1, -int(-timeout_s // width_s))


def flows(packets: DataFrame, key: Column, extra: Sequence[Column] = (), by: Sequence[str] = ("window_start",)) -> DataFrame:
    """Flows of a key in each window."""
    return packets.groupBy(*by, key.alias("flow_key")).agg(*metrics(F.col("up"), F.col("octets"), F.col("us")), *extra)


def rollup(biflows: DataFrame, by: Sequence[str] = ("window_start",), extra: Sequence[Column] = ()) -> DataFrame:
    """Biflows to multiflows: the client's port goes, metrics merge, whole-number labels add up."""
    key = F.struct(*(F.col(f"flow_key.{k}").alias(k) for k in ("proto", "client", "server", "server_port")))
    label = F.sum(X.int_or_zero("label").cast("long")).alias("label")
    return biflows.groupBy(*by, key.alias("flow_key")).agg(*merged(), label, *extra)


def duration_s(first: str, last: str) -> Column:
    return F.coalesce((F.col(last) - F.col(first)) / F.lit(1e6), F.lit(0.0))


def counters(request: Column, error: Column, malformed: Column | None = None) -> list[Column]:
    """Requests of each function, and successes and errors of responses."""
    fc, bad = F.col("fc"), F.lit(False) if malformed is None else malformed
    out = [F.count_if(request & ~bad & (fc == c)).alias(f"{k}_requests") for k, c in FUNCTIONS.items()]
    known = (*FUNCTIONS.values(), *OTHERS)
    out += [F.count_if(request & ~bad & fc.isin(*OTHERS)).alias("other_requests"), F.count_if(request & ~bad & ~fc.isin(*known)).alias("undefined_requests")]
    out += [F.count_if(~request & ~bad & ~error).alias("responses_success"), F.count_if(~request & ~bad & error).alias("responses_error")]
    return [*out, F.count_if(request & bad).alias("malformed_requests"), F.lit(0).cast("long").alias("malformed_responses")]


def compact() -> list[Column]:
    """The totals of the counters."""
    add = lambda ks: sum((F.col(f"{k}_requests") for k in ks), F.lit(0).cast("long"))
    return [add(READS).alias("read_requests"), add(WRITES).alias("write_requests"), add(DIAGNOSTIC).alias("diagnostic_requests")] + [F.col(c) for c in ("other_requests", "undefined_requests", "responses_success", "responses_error", "malformed_requests", "malformed_responses")]


def flat(df: DataFrame) -> DataFrame:
    """One row of plain columns for feature vectors; absent metrics are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    names = {"fwd": "Forward", "rev": "Reverse"}
    cols = [zero(f"{s}_{k}").alias(f"{n}Metrics{t}") for s, n in names.items() for k, t in (("packets", "Packets"), ("octets", "Octets"))]
    cols += [duration_s(f"{s}_first", f"{s}_last").alias(f"{n}MetricsDuration") for s, n in names.items()]
    return df.select("window_start", F.col("flow_key"), *cols)


def zip_labels(packets: DataFrame, labels: DataFrame, order: str = "seq", label_order: str = "row") -> DataFrame:
    """The i-th packet with the i-th label; the shorter side ends it. Row numbers are dealt in ranges, not in one task."""
    return numbered(packets, order).join(numbered(labels, label_order).withColumnRenamed(label_order, "_o"), "rn").drop("_o")


def numbered(df: DataFrame, order: str, buckets: int = 64, bucket_rows: int = 500_000) -> DataFrame:
    """rn: 1, 2, ... in the order of a unique whole-number column; counts by range come first, so that no task numbers all rows.

    There are `buckets` ranges, or as many as it takes for bucket_rows rows each if the numbers are spread evenly."""
    low, high, rows = df.agg(F.min(order), F.max(order), F.count("*")).first()
    if low is None:
        return df.withColumn("rn", F.lit(0).cast("long"))
    buckets = max(buckets, -(-rows // bucket_rows))
    bucket = F.floor((F.col(order) - low) / F.lit((high - low) // buckets + 1)).cast("long")
    placed = df.withColumn("_b", bucket)
    before = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    start = before.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # `buckets` rows
    return placed.join(F.broadcast(start), "_b").withColumn("rn", F.row_number().over(Window.partitionBy("_b").orderBy(order)) + F.col("_s")).drop("_b", "_s")
