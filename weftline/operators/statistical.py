"""Packet-rate profiles: inter-arrival split points, 3-sigma bands of window counts, 2-of-3 outliers.

The sequential window counter moves on by one window a packet at most. With b = floor(t / w) + 1 and i the packet's rank
in its direction, its window is i + min(1, least (b - rank) so far), a running minimum; no loop is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 0.34  # fixed value: the least mean of a band
SERIES = ("total", "range1", "range2")
#: Numbers of packets that are ordered at a time.
SLICE = 1_000_000
#: Sums of counts and of their squares are whole and exact.
_WHOLE = "decimal(18,0)"


def _slice(order: str, rows: int) -> Column:
    return F.floor(F.col(order) / F.lit(rows)).cast("long").alias("_slice")


def pairs(packets: DataFrame) -> DataFrame:
    """Packets with their unordered pair and the pair's orientation, that of its first packet."""
    placed = packets.withColumn("pair", F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst")))
    first = placed.groupBy("pair").agg(F.min_by("src", "seq").alias("_first"))
    return placed.join(first, "pair").select(*packets.columns, "pair", (F.col("_first") == F.col("src")).alias("canonical"))


def inter_arrivals(packets: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """delta to the pair's previous packet of either direction (the first one's is its own time), the direction's key and rank.

    Packets are ordered in slices of slice_rows numbers; what a pair had before a slice comes from one row for each slice,
    so no task orders all packets of a busy pair."""
    placed = packets.select("*", F.concat_ws(":", "src", "dst").alias("direction"), _slice("seq", slice_rows))
    each = placed.groupBy("pair", "direction", "_slice").agg(F.count("*").alias("_n"), F.max(F.struct("seq", "t")).alias("_last"))
    earlier = Window.partitionBy("pair").orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    ranked = Window.partitionBy("pair", "direction").orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    before = each.select("pair", "direction", "_slice", F.max("_last").over(earlier).getField("t").alias("_t"), F.coalesce(F.sum("_n").over(ranked), F.lit(0)).alias("_before"))
    w, d = Window.partitionBy("pair", "_slice").orderBy("seq"), Window.partitionBy("pair", "direction", "_slice").orderBy("seq")
    inside = placed.withColumns({"_at": F.row_number().over(w), "_lag": F.lag("t").over(w), "_rank": F.row_number().over(d)})
    previous = F.coalesce(F.when(F.col("_at") == 1, F.col("_t")).otherwise(F.col("_lag")), F.lit(0.0))
    joined = inside.join(before, ["pair", "direction", "_slice"])
    return joined.select(*packets.columns, (F.col("t") - previous).alias("delta"), "direction", (F.col("_rank") + F.col("_before")).cast("long").alias("rank"))


def candidates(deltas: DataFrame) -> DataFrame:
    """(direction, q25, q50, mean, q75) of the deltas after the direction's first."""
    q = lambda p: F.percentile("delta", F.lit(p))
    return deltas.where("rank > 1").groupBy("direction").agg(q(0.25).alias("q25"), q(0.5).alias("q50"), F.avg("delta").alias("mean"), q(0.75).alias("q75"))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, std (of a sample), min, quartiles with linear interpolation and max of a column, by group; nulls aren't counted."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(value).alias("max"),
    )


def exploded(cands: DataFrame) -> DataFrame:
    """(direction, ord, candidate): the positive candidates in scan order."""
    return cands.select("direction", F.posexplode(F.array("q25", "q50", "mean", "q75")).alias("ord", "candidate")).where("candidate > 0")


def windows(deltas: DataFrame, width: float, windowing: str = "sequential", slice_rows: int = SLICE) -> DataFrame:
    """n: the window of each packet, from 1 on. The running minimum is taken in slices of ranks and carried from slice to slice."""
    b = F.floor(F.col("t") / F.lit(width)).cast("long") + 1
    if windowing == "event_time":
        return deltas.withColumn("n", b)
    placed = deltas.select("*", (b - F.col("rank")).alias("_lead"), _slice("rank", slice_rows))
    earlier = Window.partitionBy("direction").orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("direction", "_slice").agg(F.min("_lead").alias("_least")).select("direction", "_slice", F.min("_least").over(earlier).alias("_before"))
    inside = placed.withColumn("_so_far", F.min("_lead").over(Window.partitionBy("direction", "_slice").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    n = F.col("rank") + F.least(F.lit(1).cast("long"), "_so_far", "_before")
    return inside.join(carried, ["direction", "_slice"]).select(*deltas.columns, n.alias("n"))


def counts(placed: DataFrame, split: Column, by: tuple[str, ...] = ("direction",)) -> DataFrame:
    """Packets of each window: all, below the split, from it on. The last window isn't emitted; windows without packets count 0."""
    found = placed.groupBy(*by, "n").agg(F.count("*").alias("total"), F.count_if(F.col("delta") < split).alias("range1"), F.count_if(F.col("delta") >= split).alias("range2"))
    spine = found.groupBy(*by).agg(F.max("n").alias("top")).where("top > 1").select(*by, F.explode(F.sequence(F.lit(1).cast("long"), F.col("top") - 1)).alias("n"))
    return spine.join(found, [*by, "n"], "left").select(*by, "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in SERIES))


def _spread(n: Column, total: Column, squares: Column) -> Column:
    """Deviation of a sample of n whole numbers from their sum and sum of squares, both exact: the same in any order of rows; null for one."""
    n = n.cast(_WHOLE)
    return F.when(n > 1, F.sqrt((n * squares - total * total).cast("double") / (n * (n - 1)).cast("double")))


def _moments(c: str) -> tuple[Column, Column]:
    """Mean and deviation of a column of whole numbers."""
    x = F.col(c).cast(_WHOLE)
    return F.avg(c), _spread(F.count(c), F.sum(x).cast(_WHOLE), F.sum(x * x))


def _edge(middle: Column, spread: Column, times: float) -> Column:
    """middle + times * spread; where that is a whole number but for rounding, the number itself, so that a count on the edge is inside."""
    e = middle + F.lit(times) * spread
    return F.when(F.abs(e - F.round(e)) <= 1e-14 * (middle + abs(times) * spread + 1), F.round(e)).otherwise(e)


def candidate_stats(deltas: DataFrame, cands: DataFrame, width: float, windowing: str = "sequential") -> DataFrame:
    """Mean and deviation of both ranges' counts for every candidate, over its windows but the last one; those without packets count 0.

    A candidate is known by direction and ord: its value, a mean of doubles, may differ in its last bit each time it is computed, so it is no key."""
    each = windows(deltas, width, windowing).where("n >= 1").join(exploded(cands), "direction")
    ranges = F.count_if(F.col("delta") < F.col("candidate")).alias("range1"), F.count_if(F.col("delta") >= F.col("candidate")).alias("range2")
    found = each.groupBy("direction", "ord", "n").agg(F.first("candidate").alias("candidate"), *ranges)
    x = {s: F.col(s).cast(_WHOLE) for s in SERIES[1:]}
    sums = found.groupBy("direction", "ord").agg(
        F.first("candidate").alias("candidate"), F.max("n").alias("top"), F.max_by(F.struct(*(v.alias(s) for s, v in x.items())), "n").alias("last"),
        *(F.sum(v).cast(_WHOLE).alias(f"sum_{s}") for s, v in x.items()), *(F.sum(v * v).alias(f"squares_{s}") for s, v in x.items()),
    ).where("top > 1")
    n, last = F.col("top") - 1, lambda s: F.col(f"last.{s}")
    total = {s: F.col(f"sum_{s}") - last(s) for s in x}
    return sums.select("direction", "ord", "candidate", *(c for s in x for c in (
        (total[s].cast("double") / n).alias(f"mean_{s}"), _spread(n, total[s], F.col(f"squares_{s}") - last(s) * last(s)).alias(f"std_{s}")
    )))


def split_points(stats: DataFrame) -> DataFrame:
    """The candidate of least deviation with mean - 3 std > 0, the earlier of equals; 0 if there is none."""
    each = stats.select("direction", "ord", "candidate", F.explode(F.array(*(F.struct(F.lit(i).alias("r"), F.col(f"mean_{s}").alias("m"), F.col(f"std_{s}").alias("s")) for i, s in enumerate(SERIES[1:])))).alias("x"))
    fit = each.where("x.m - 3 * x.s > 0").groupBy("direction").agg(F.min_by("candidate", F.struct("x.s", "ord", "x.r")).alias("split"))
    return stats.select("direction").distinct().join(fit, "direction", "left").select("direction", F.coalesce("split", F.lit(0.0)).alias("split"))


def profile(window_counts: DataFrame, sigma: float = 3.0, floor: float = FLOOR) -> DataFrame:
    """Bands of the three series; windows whose total is out of its own band don't count if the mean exceeds the floor."""
    mean, std = _moments("total")
    both = window_counts.join(window_counts.groupBy("direction").agg(mean.alias("m"), std.alias("s")), "direction")
    own = [_edge(F.col("m"), F.col("s"), sign * sigma) for sign in (-1, 1)]
    kept = both.where((F.col("m") <= floor) | F.col("s").isNull() | F.col("total").between(*own))
    stats = kept.groupBy("direction").agg(*(f.alias(f"{k}_{c}") for c in SERIES for k, f in zip("ms", _moments(c), strict=True)))
    band = lambda c, sign: _edge(F.greatest(F.col(f"m_{c}"), F.lit(floor)), F.col(f"s_{c}"), sign * sigma)
    return stats.select("direction", *(band(c, s).alias(f"{c}_{e}") for c in SERIES for s, e in ((-1, "lo"), (1, "hi"))), F.when(F.col("s_total").isNull(), "insufficient").otherwise("ok").alias("status"))


def outliers(window_counts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(direction, series, n): the first window of each three in a row of which two or more are out of the band."""
    j = window_counts.join(profiles, "direction")
    long = j.select("direction", "n", F.explode(F.array(*(F.struct(F.lit(c).alias("series"), (~F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi"))).cast("int").alias("out")) for c in SERIES))).alias("x")).select("direction", "n", "x.*")
    w = Window.partitionBy("direction", "series").orderBy("n")
    return long.withColumns({"a": F.lead("out", 1).over(w), "b": F.lead("out", 2).over(w)}).where("b is not null and out + a + b >= 2").select("direction", "series", "n")


def unprofiled(directions: DataFrame, profiles: DataFrame) -> DataFrame:
    return directions.select("direction").distinct().join(profiles.select("direction"), "direction", "left_anti")
