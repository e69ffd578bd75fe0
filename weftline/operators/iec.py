"""Operation tags and tag vectors of message flows, and the documented aggregation of multicast messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tag of whatever the dictionary doesn't know.
UNKNOWN = "*"


def tags(messages: DataFrame, tag: str = "tag", order: str = "seq") -> DataFrame:
    """(tag, idx): the distinct tags in first-seen order from 1 on; 0 is the unknown one."""
    seen = messages.where(F.col(tag).isNotNull()).groupBy(F.col(tag).alias("tag")).agg(F.min(order).alias("first"))
    ordered = seen.agg(F.array_sort(F.collect_list(F.struct("first", "tag"))).alias("t"))  # distinct tags only
    return ordered.select(F.posexplode(F.concat(F.array(F.lit(UNKNOWN)), F.transform("t", lambda x: x["tag"]))).alias("idx", "tag")).select("tag", "idx")


def indexed(messages: DataFrame, dictionary: DataFrame, tag: str = "tag") -> DataFrame:
    """idx of each message's tag; 0 where the dictionary lacks it."""
    return messages.join(dictionary.withColumnRenamed("tag", "_t"), F.col(tag) == F.col("_t"), "left").drop("_t").withColumn("idx", F.coalesce("idx", F.lit(0)))


def vector(idx: Column, n: int, value: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == idx, value.cast("double")).otherwise(F.lit(0.0)))


def window_aggregate(messages: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Flows, bytes, packets, lengths and items by key and window, with a slot for each tag; slots are summed as columns of one aggregate."""
    slots = lambda c: [F.sum(F.when(F.col("idx") == i, F.col(c)).otherwise(0)).cast("double") for i in range(n)]
    return messages.groupBy(*by).agg(
        F.min("label").alias("label"), F.count("*").alias("n_flows"), F.sum("octets").alias("bytes"), F.sum("packets").alias("packets"),
        F.sum("iec_len").alias("length"), F.sum("items").alias("items"), F.min("us").alias("start_us"),
        F.array(*slots("iec_len")).alias("length_vector"), F.array(*slots("items")).alias("items_vector"),
    )


def tag_pivot(messages: DataFrame, by: list[str], tag: str = "tag") -> DataFrame:
    """Bytes and packets of each key and tag as maps, and the number of distinct states."""
    part = messages.groupBy(*by, tag).agg(F.sum("octets").alias("b"), F.count("*").alias("p"))
    states = messages.groupBy(*by).agg(F.count_distinct("state").alias("n_states"))
    return part.groupBy(*by).agg(F.sum("b").alias("bytes"), F.sum("p").alias("packets"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(tag, "b")))).alias("bytes_by_tag")).join(states, by)
