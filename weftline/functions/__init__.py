"""Column expressions of the traffic domain, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the smallest positive 32-bit float, the floor of a cluster's variance.
FLOAT_EPSILON = 1.401298464324817e-45


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_information_frame(fmt: Column | str) -> Column:
    """The hexadecimal frame format is zero; empty or null formats aren't I-frames."""
    return F.coalesce(F.regexp_replace(col(fmt), "^0[xX]", "").rlike("^0+$"), F.lit(False))


def int_or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c).try_cast("int"), F.lit(0))


def from_client(src_port: Column | str, dst_port: Column | str) -> Column:
    """The side with the higher port is the client; equal ports count as the server's."""
    return col(src_port) > col(dst_port)


def biflow_key(src: str = "src_ip", dst: str = "dst_ip", sport: str = "src_port", dport: str = "dst_port", proto: str = "proto") -> Column:
    up = from_client(sport, dport)
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return F.struct(F.col(proto).alias("proto"), pick(src, dst).alias("client"), pick(sport, dport).alias("client_port"), pick(dst, src).alias("server"), pick(dport, sport).alias("server_port"))


def multiflow_key(src: str = "src_ip", dst: str = "dst_ip", sport: str = "src_port", dport: str = "dst_port", proto: str = "proto") -> Column:
    """The biflow key without the client's port."""
    key = biflow_key(src, dst, sport, dport, proto)
    return F.struct(*(key[k].alias(k) for k in ("proto", "client", "server", "server_port")))


def directional_key(src: str, sport: str, dst: str, dport: str) -> Column:
    return F.concat(F.col(src), F.lit(":"), F.col(sport).cast("string"), F.lit("-"), F.col(dst), F.lit(":"), F.col(dport).cast("string"))


def pair_key(a: Column, b: Column) -> Column:
    """Unordered pair of endpoints."""
    return F.concat_ws("|", F.array_sort(F.array(a, b)))


def same_pair(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return pair_key(a1, b1) == pair_key(a2, b2)


def operation_tag(fmt: str = "fmt", cot: str = "cot") -> Column:
    return F.concat_ws(".", F.col(fmt), F.col(cot).cast("string"))


def epoch_micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def micros_to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def ticks_to_micros(ticks: Column | str) -> Column:
    """100-ns ticks since 0001-01-01 to microseconds since 1970-01-01."""
    return F.floor((col(ticks) - F.lit(621355968000000000)) / 10).cast("long")


def tumbling_start(us: Column, width_us: int, anchor_us: Column | int = 0) -> Column:
    """Start of the window of width_us microseconds, counted from the anchor."""
    anchor = F.lit(anchor_us) if isinstance(anchor_us, int) else anchor_us
    return F.floor((us - anchor) / F.lit(width_us)).cast("long") * F.lit(width_us) + anchor


def window_label(index: Column) -> Column:
    return F.lpad(index.cast("string"), 4, "0")


def initial_type(asdu: Column | str, cot: Column | str) -> Column:
    """The class that a conversation's first message opens."""
    a, c = col(asdu).cast("int"), col(cot).cast("int")
    return F.when(a == 122, "FILETRANSFER").when(c == 6, "GENERAL_ACT").when(c == 3, "SPONTANEOUS").when(c == 7, "GENERAL").otherwise("UNKNOWN")


def is_spontaneous(cot: Column | str) -> Column:
    return col(cot).cast("int") == 3


def is_final(kind: Column | str, cot: Column | str) -> Column:
    """Whether the message ends a conversation of that kind; file transfers end only at what follows them."""
    return col(kind).isin("GENERAL", "GENERAL_ACT", "UNKNOWN") & col(cot).cast("int").isin(10, 44, 45, 46, 47)


def is_complete(last_asdu: Column | str, last_cot: Column | str) -> Column:
    return col(last_asdu).cast("int").isin(123, 124, 70, 36) | col(last_cot).cast("int").isin(3, 10, 44, 45, 46, 47)


def array_sum(a: Column | str, b: Column | str) -> Column:
    """Elementwise sum over the length of a."""
    n = F.size(col(a))
    return F.zip_with(col(a), F.slice(col(b), 1, n), lambda x, y: x + F.coalesce(y, F.lit(0)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def vector_stats(xs: Column) -> Column:
    """min, max, mean and population deviation of one vector."""
    n = F.size(xs).cast("double")
    mean = total(xs) / n
    return F.array(F.array_min(xs).cast("double"), F.array_max(xs).cast("double"), mean, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x.cast("double") - total(xs) / n) * (x.cast("double") - total(xs) / n)) / n))


def squared_distance(xs: Column, centroid: list[float] | Column) -> Column:
    c = F.array(*(F.lit(float(v)) for v in centroid)) if isinstance(centroid, list) else centroid
    return F.aggregate(F.zip_with(xs, c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, d: a + d)


def anomaly_score(distance: Column, variance: Column, factor: float = 6.0) -> Column:
    """1 - min(d / (factor * sqrt(variance)), 1); a zero distance scores 1."""
    return 1 - F.least(distance / (F.lit(factor) * F.sqrt(F.greatest(variance, F.lit(FLOAT_EPSILON)))), F.lit(1.0))


def acceptance_radius(variance: Column | str, k: float = 3.0) -> Column:
    return F.lit(k) * F.sqrt(col(variance))


def score_summary(scores: Column) -> dict[str, Column]:
    best = F.array_max(scores)
    return {"max_score": best, "min_score": F.array_min(scores), "average_score": total(scores) / F.size(scores), "best_model": (F.array_position(scores, best) - 1).cast("int")}


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the array needle is a subsequence of the array hay: a fold that moves a pointer through needle."""
    at = F.aggregate(hay, F.lit(1), lambda i, x: i + F.when(F.get(needle, i - 1) == x, 1).otherwise(0))
    return at > F.size(needle)


def parse_ranges(text: Column | str) -> Column:
    """'1,2,30..40' -> all numbers, ranges with both ends."""
    ends = lambda p: F.split(F.trim(p), "\\.\\.")
    return F.flatten(F.transform(F.split(col(text), ","), lambda p: F.sequence(F.element_at(ends(p), 1).cast("int"), F.element_at(ends(p), -1).cast("int"))))


def parse_conversation(data: Column | str) -> Column:
    """'<100.6>,<1.n>' -> ['100.6', '1.n']; a token that doesn't start so is dropped."""
    pattern = "^<([0-9]+\\.([0-9]+|n))>"
    return F.filter(F.transform(F.split(col(data), ","), lambda t: F.regexp_extract(t, pattern, 1)), lambda t: t != "")


def parse_pair(text: Column | str) -> Column:
    """'a-b-pa-pb' or 'host:port-host:port' -> unordered pair; another number of parts is an error."""
    p = F.split(col(text), "-")
    return F.when(F.size(p) == 4, pair_key(F.concat_ws(":", p[0], p[2]), F.concat_ws(":", p[1], p[3]))).when(F.size(p) == 2, pair_key(p[0], p[1])).otherwise(F.raise_error(F.concat(F.lit("bad pair key: "), col(text))))


def ascii_label(c: Column | str) -> Column:
    """Backslashes, quotes and line ends escaped for labels."""
    out = col(c)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
