"""Capture files: format("pcap"), a Python data source. A frame that can't be decoded stays, with null endpoints."""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "seq long, us long, proto string, src_ip string, src_port int, dst_ip string, dst_port int, octets int, payload binary"


def decode(frame: bytes) -> tuple:
    """(proto, src_ip, src_port, dst_ip, dst_port, payload) of an Ethernet frame with IPv4 and TCP or UDP."""
    try:
        kind, at = struct.unpack_from("!H", frame, 12)[0], 14
        while kind == 0x8100:
            kind, at = struct.unpack_from("!H", frame, at + 2)[0], at + 4
        if kind != 0x0800:
            return None, None, None, None, None, None
        size, length, proto = (frame[at] & 15) * 4, struct.unpack_from("!H", frame, at + 2)[0], frame[at + 9]
        src, dst = socket.inet_ntoa(frame[at + 12 : at + 16]), socket.inet_ntoa(frame[at + 16 : at + 20])
        name = {6: "TCP", 17: "UDP"}.get(proto)
        if not name:
            return str(proto), src, 0, dst, 0, None
        sport, dport = struct.unpack_from("!HH", frame, at + size)
        head = (frame[at + size + 12] >> 4) * 4 if proto == 6 else 8
        return name, src, sport, dst, dport, frame[at + size + head : at + length]
    except (IndexError, struct.error, OSError):
        return None, None, None, None, None, None


def records(data: bytes) -> Iterator[tuple]:
    magic = data[:4]
    order, nano = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}.get(magic, (None, 1))
    if order is None:
        raise ValueError("not a capture file")
    at, seq = 24, 0
    while at + 16 <= len(data):
        s, f, n, full = struct.unpack_from(order + "IIII", data, at)
        proto, src, sport, dst, dport, payload = decode(data[at + 16 : at + 16 + n])
        yield seq, s * 1_000_000 + f // nano, proto, src, sport, dst, dport, full, payload
        at, seq = at + 16 + n, seq + 1


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all capture files under the path, which may be in any store that Spark reads; a file is a task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def over(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                rows = list(records(data))
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"src_port": "Int32", "dst_port": "Int32"})

    return files.mapInPandas(over, SCHEMA)
