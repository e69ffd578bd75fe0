"""The driver's tables as traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import functions as X

#: 2024-01-01 00:00 UTC, the start of the events, and the end of the part that counts as normal traffic.
ORIGIN_US, TRAIN_END_US = 1_704_067_200_000_000, 1_705_363_200_000_000
DAY_US = 86_400_000_000
FUNCTION_CODES = (1, 2, 3, 4, 5, 6, 7, 8, 15, 16, 20, 21, 22, 23, 24, 43, 99)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets between client and server endpoints."""
    return as_packets(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_packets(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select(
        F.col("event_id").alias("seq"), X.epoch_micros("ts").alias("us"), k.alias("k"), "user_id", "event_type",
        F.round(F.col("value") * 10).cast("long").alias("octets"), F.floor("value").cast("int").alias("iec_len"), "value", (F.col("event_id") % 2 == 0).alias("up"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("server"),
        (F.lit(40000) + F.col("user_id")).cast("int").alias("client_port"),
    )
    side = lambda a, b: F.when(F.col("up"), a).otherwise(b)
    return base.select(
        "*", F.lit("TCP").alias("proto"), side(F.col("client"), F.col("server")).alias("src_ip"), side(F.col("server"), F.col("client")).alias("dst_ip"),
        side(F.col("client_port"), F.lit(502)).alias("src_port"), side(F.lit(502), F.col("client_port")).alias("dst_port"),
        ((F.col("us") - ORIGIN_US) / F.lit(1e6)).alias("rel_time"), (F.col("k") % 8).alias("cot"), F.col("event_type").alias("asdu_name"),
        F.when(F.col("k") % 10 == 9, "0x00000001").otherwise("0x00000000").alias("fmt"),
        F.get(F.array(*map(F.lit, FUNCTION_CODES)), F.col("k") % 17).alias("fc"), (F.col("event_type") == "error").alias("error"),
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("model"), F.col("us").between(0, TRAIN_END_US - 1).alias("train"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets as the statistical profiler reads them: seq, t, src, dst."""
    return packets(spark, sf_dir).select("seq", F.col("rel_time").alias("t"), F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "train")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events of a user in a row as one word; model p0 .. p9, win the day, ord the first event's number."""
    from pyspark.sql import Window

    p = packets(spark, sf_dir).withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("seq")) - 1) / 3))
    g = p.groupBy("model", "user_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "event_type", "us"))).alias("x"))  # three each
    day = F.floor((F.get("x", F.lit(0))["us"] - ORIGIN_US) / DAY_US).cast("long")
    return g.select("model", F.get("x", F.lit(0))["seq"].alias("ord"), F.transform("x", lambda e: e["event_type"]).alias("word"), day.alias("win"), (F.get("x", F.lit(0))["us"] < TRAIN_END_US).alias("train"))


def iec_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    return p.withColumns({"tag": X.operation_tag(), "label": F.col("seq"), "packets": F.lit(1), "items": F.col("k") % 5, "key": X.directional_key("src_ip", "src_port", "dst_ip", "dst_port"), "window_start": X.tumbling_start(F.col("us"), DAY_US)})


def vectors(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """embeddings as feature vectors of their first n numbers, with given clusters."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double")).alias("features"), "label")
