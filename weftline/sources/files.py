"""File sources. Schemas are declared; numbers that can't be read are 0, as the formats ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import functions as X

# Column names of the file formats.
MESSAGE_COLUMNS = ["TimeStamp", "Relative Time", "srcIP", "dstIP", "srcPort", "dstPort", "ipLen", "len", "fmt", "uType", "asduType", "numix", "cot", "oa", "addr", "ioa"]
PROBE_COLUMNS = ["EXPORT_COUNTER", "BYTES", "PACKETS", "START_SEC", "END_SEC", "L3_IPV4_SRC", "L3_IPV4_DST", "L4_PORT_SRC", "L4_PORT_DST", "IEC104_PKT_LENGTH", "IEC104_FRAME_FMT", "IEC104_ASDU_TYPE_IDENT", "IEC104_ASDU_NUM_ITEMS", "IEC104_ASDU_COT", "IEC104_ASDU_ORG", "IEC104_ASDU_ADDRESS"]
FLOW_TEXT = ["WindowLabel", "WindowStart", "WindowDuration", "FlowLabel", "FlowKey"]
FLOW_NUMBERS = [f"{s}Metrics{k}" for s in ("Forward", "Reverse") for k in ("Duration", "Octets", "Packets", "FirstSeen", "LastSeen")] + ["DataUnitId", "DataReadRequests", "DataWriteRequests", "DataDiagnosticRequests", "DataOtherRequests", "DataUndefinedRequests", "DataResponsesSuccess", "DataResponsesError", "DataMalformedRequests", "DataMalformedResponses"]


def _strings(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, value): rows count lines of a file from 0 on. A large file is read in several splits: numbers rise within
    a split, and the lines of the splits before it, one row for each split, make its first line's number."""
    at = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("value"))
    splits = raw.groupBy("file", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(splits.withColumn("_before", before), ["file", "_split"])
    return placed.where(F.col("value") != "").select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("row"), "value")


def read_messages_positional(spark: SparkSession, path: str) -> DataFrame:
    """seq, t, src, dst: the first four fields; rows that begin with TimeStamp or nothing are headers."""
    f = F.split("value", ";")
    rows = lines(spark, path).where(~F.get(f, F.lit(0)).isin("TimeStamp", ""))
    return rows.select(F.col("row").cast("long").alias("seq"), F.get(f, F.lit(1)).try_cast("double").alias("t"), F.get(f, F.lit(2)).alias("src"), F.get(f, F.lit(3)).alias("dst"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, by header."""
    return spark.read.option("sep", ";").option("header", True).schema(_strings(MESSAGE_COLUMNS)).csv(path)


def read_conversations(spark: SparkSession, path: str, slice_rows: int = 1_000_000) -> DataFrame:
    """(pair, row, duration, length, word): `Key` rows name the pair of the rows that follow; rows without data are dropped."""
    f = F.split("value", ";")
    g = lambda i: F.get(f, F.lit(i))
    rows = lines(spark, path).select("file", "row", g(0).alias("stamp"), g(1).alias("second"), g(2).alias("duration"), g(3).alias("length"), g(4).alias("data")).where("stamp <> 'Timestamp'")
    # The last key before a row: in its own slice of rows, else in an earlier slice of the file.
    key, sliced = F.when(F.col("stamp") == "Key", F.col("second")), rows.withColumn("_slice", F.floor(F.col("row") / F.lit(slice_rows)).cast("long"))
    last = sliced.groupBy("file", "_slice").agg(F.max(F.when(key.isNotNull(), F.struct("row", "second"))).alias("_last"))
    earlier = Window.partitionBy("file").orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy("file", "_slice").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    found = sliced.withColumn("_own", F.last(key, ignorenulls=True).over(w)).join(last.select("file", "_slice", F.max("_last").over(earlier).getField("second").alias("_before")), ["file", "_slice"])
    keyed = found.withColumn("pair", F.coalesce("_own", "_before")).where("stamp <> 'Key' and length(data) > 0")
    return keyed.select(X.parse_pair("pair").alias("pair"), "row", F.col("duration").try_cast("double").alias("duration"), X.int_or_zero("length").alias("length"), X.parse_conversation("data").alias("word"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """direction; split; three bands, without header."""
    names = ["split", *(f"{c}_{e}" for c in ("total", "range1", "range2") for e in ("lo", "hi"))]
    shape = "direction string, " + ", ".join(f"{c} double" for c in names) + ", rest string"
    return spark.read.option("sep", ";").schema(shape).csv(path).drop("rest")


def sniff(first_line: str) -> tuple[str, str]:
    """(dialect, delimiter) from a file's first line: the more frequent of comma and semicolon, which wins a tie."""
    sep = "," if first_line.count(",") > first_line.count(";") else ";"
    if "L3_IPV4_SRC" in first_line:
        return "probe", sep
    if "srcIP" in first_line:
        return "dissector", sep
    raise ValueError("neither a probe's nor a dissector's header")


def read_iec(spark: SparkSession, path: str, origin: str | None = None) -> DataFrame:
    """Either dialect as label, start, endpoints, bytes, packets, length, items, fmt, asdu, cot. A dissector's times have no date: `origin` gives it."""
    head = spark.read.text(path).first()
    dialect, sep = sniff(head[0] if head else "")
    if dialect == "probe":
        names = [c.strip() for c in head[0].split(sep)]
        raw = spark.read.option("sep", sep).option("header", True).option("ignoreLeadingWhiteSpace", True).schema(_strings(names)).csv(path)
        get = lambda c: F.col(f"`{c}`") if c in names else F.lit(None).cast("string")
        n = lambda c: X.int_or_zero(get(c))
        return raw.select(
            n("EXPORT_COUNTER").cast("long").alias("label"), get("START_SEC").try_cast("timestamp").alias("start"), get("L3_IPV4_SRC").alias("src_ip"), get("L3_IPV4_DST").alias("dst_ip"), n("L4_PORT_SRC").alias("src_port"), n("L4_PORT_DST").alias("dst_port"),
            n("BYTES").alias("octets"), n("PACKETS").alias("packets"), n("IEC104_PKT_LENGTH").alias("iec_len"), n("IEC104_ASDU_NUM_ITEMS").alias("items"), get("IEC104_FRAME_FMT").alias("fmt"), get("IEC104_ASDU_TYPE_IDENT").alias("asdu"), get("IEC104_ASDU_COT").alias("cot"),
        )
    if origin is None:
        raise ValueError("a dissector's file needs the capture's origin")
    names = [c.strip() for c in head[0].split(sep)]
    f = F.split("value", sep)
    get = lambda c: F.get(f, F.lit(names.index(c))) if c in names else F.lit(None).cast("string")
    n = lambda c: X.int_or_zero(get(c))
    rel = F.coalesce(get("Relative Time").try_cast("double"), F.lit(0.0))
    return lines(spark, path).where("row > 0").select(
        (F.col("row") - 1).cast("long").alias("label"), F.timestamp_micros(X.epoch_micros(F.lit(origin)) + F.round(rel * 1e6).cast("long")).alias("start"), get("srcIP").alias("src_ip"), get("dstIP").alias("dst_ip"), n("srcPort").alias("src_port"), n("dstPort").alias("dst_port"),
        n("ipLen").alias("octets"), F.lit(1).alias("packets"), n("len").alias("iec_len"), n("numix").alias("items"), get("fmt").alias("fmt"), get("asduType").alias("asdu"), get("cot").alias("cot"),
    )


def _json_cell(c: str) -> Column:
    """A cell that is a JSON literal: quoted text loses its quotes."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), F.col(f"`{c}`"), F.lit("}")), "$.v"), F.col(f"`{c}`"))


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Windowed flows whose cells are JSON literals."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(_strings(FLOW_TEXT + FLOW_NUMBERS)).csv(path)
    return raw.select(*(_json_cell(c).alias(c) for c in FLOW_TEXT), *(F.coalesce(_json_cell(c).try_cast("double"), F.lit(0.0)).alias(c) for c in FLOW_NUMBERS))


def read_packet_labels(spark: SparkSession, path: str) -> DataFrame:
    """(row, label) in file order; the packet number in the file is ignored."""
    return lines(spark, path).select(F.col("row").cast("long").alias("row"), X.int_or_zero(F.get(F.split("value", ";"), F.lit(1))).alias("label"))


def read_register_map(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).schema("Name string, Type string, `Data Type` string, Address string").csv(path)
    return raw.select(F.col("Name").alias("name"), "Type", F.regexp_extract("Address", r"^\s*(.*?)\s*(\d+)\s*$", 1).alias("register"), F.regexp_extract("Address", r"(\d+)\s*$", 1).try_cast("int").alias("index"))


def flatten(df: DataFrame, records: str) -> DataFrame:
    """A row for each record of lists of records; null and empty lists give none."""
    return df.select(F.explode(records).alias("_record")).select("_record.*")


def choose_input(capture: str | None = None, speed: float = 0.0, device: str | None = None, index: int | None = None) -> tuple[str, str | int | None]:
    """Which of the given inputs is read: a capture with a speed above 0 is replayed, one without is read, then a device by name, then by index."""
    if capture:
        return ("replay" if speed > 0 else "read", capture)
    if device:
        return ("device", device)
    return ("none", None) if index is None else ("device", index)


PROTOCOLS = {"modbus": read_flows, "iec": read_iec}


def source(protocol: str):
    """The flow reader of a protocol; others aren't supported."""
    if protocol.lower() not in PROTOCOLS:
        raise NotImplementedError(f"no flow source for {protocol}")
    return PROTOCOLS[protocol.lower()]
