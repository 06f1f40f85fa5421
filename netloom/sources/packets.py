"""Frames to packets and DNS answers: pcap files, Ethernet/VLAN, IPv4/IPv6, TCP, DNS responses."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PACKET = "src string, dst string, sport int, dport int, ack bigint, flags int, payload_len int"


def records(data: bytes) -> Iterator[tuple[float, bytes]]:
    """Time and frame of each record of a pcap file; a cut-off tail is left out."""
    order = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}.get(data[:4])
    if not order:
        return
    at = 24
    while at + 16 <= len(data):
        sec, frac, size, _ = struct.unpack(order[0] + "IIII", data[at : at + 16])
        if at + 16 + size > len(data):
            return
        yield sec + frac / order[1], data[at + 16 : at + 16 + size]
        at += 16 + size


def network_layer(frame: bytes) -> tuple[int, bytes]:
    kind, at = int.from_bytes(frame[12:14], "big"), 14
    while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
        kind, at = int.from_bytes(frame[at + 2 : at + 4], "big"), at + 4
    return kind, frame[at:]


def _ip(frame: bytes):
    """Source, destination, protocol and payload as far as it was captured; None if it is no IP packet."""
    kind, b = network_layer(frame)
    if kind == 0x0800 and len(b) >= 20 and b[0] >> 4 == 4:
        head, total = (b[0] & 15) * 4, int.from_bytes(b[2:4], "big")
        if 20 <= head <= min(total, len(b)):
            return str(ipaddress.ip_address(b[12:16])), str(ipaddress.ip_address(b[16:20])), b[9], b[head:total]
    if kind == 0x86DD and len(b) >= 40 and b[0] >> 4 == 6:
        return str(ipaddress.ip_address(b[8:24])), str(ipaddress.ip_address(b[24:40])), b[6], b[40 : 40 + int.from_bytes(b[4:6], "big")]
    return None


def address_pair(frame: bytes | None) -> list[str]:
    """Source and destination of any IP packet whose addresses were captured, whatever it carries."""
    kind, b = network_layer(frame or b"")
    cut = (b[12:16], b[16:20]) if kind == 0x0800 and len(b) >= 20 else (b[8:24], b[24:40]) if kind == 0x86DD and len(b) >= 40 else ()
    return [str(ipaddress.ip_address(x)) for x in cut]


def tcp_packet(frame: bytes | None) -> dict | None:
    """What was captured counts as the packet; a header beyond it leaves no payload."""
    ip = _ip(frame or b"")
    if not ip or ip[2] != 6 or len(ip[3]) < 20:
        return None
    src, dst, _, t = ip
    sport, dport, _, ack, off, flags = struct.unpack(">HHIIBB", t[:14])
    head = (off >> 4) * 4
    if head < 20:
        return None
    return {"src": src, "dst": dst, "sport": sport, "dport": dport, "ack": ack, "flags": flags, "payload_len": max(0, len(t) - head)}


def _name(msg: bytes, at: int) -> tuple[str | None, int]:
    labels, end, hops = [], None, 0
    while at < len(msg):
        n = msg[at]
        if n & 0xC0 == 0xC0:
            if at + 1 >= len(msg) or (hops := hops + 1) > 64:
                return None, at
            end = end or at + 2
            at = (n & 0x3F) << 8 | msg[at + 1]
        elif n == 0:
            return ".".join(labels).lower(), end or at + 1
        else:
            labels.append(msg[at + 1 : at + 1 + n].decode("ascii", "replace"))
            at += n + 1
    return None, at


def dns_answers(msg: bytes) -> list[tuple[str, str, int]]:
    """(ip, domain, ttl) of each address, for its own name and all aliases that lead to it."""
    if len(msg) < 12 or not msg[2] & 0x80 or msg[3] & 15:
        return []
    questions, answers = struct.unpack(">HH", msg[4:8])
    at, found, alias = 12, [], {}
    for _ in range(questions):
        name, at = _name(msg, at)
        if name is None:
            return []
        at += 4
    for _ in range(answers):
        name, at = _name(msg, at)
        if name is None or at + 10 > len(msg):
            break
        kind, _, ttl, size = struct.unpack(">HHIH", msg[at : at + 10])
        data, start = msg[at + 10 : at + 10 + size], at + 10
        at += 10 + size
        if (kind, size) in ((1, 4), (28, 16)) and len(data) == size:
            found.append((str(ipaddress.ip_address(data)), name, ttl))
        elif kind == 5 and (target := _name(msg, start)[0]):
            alias.setdefault(target, []).append(name)
    out = []
    for ip, name, ttl in found:
        todo, seen = [name], []
        while todo:
            n = todo.pop(0)
            if n not in seen:
                seen.append(n)
                todo += alias.get(n, [])
        out += [(ip, n, ttl) for n in seen]
    return out


def dns_of_frame(frame: bytes | None) -> list[tuple[str, str, int]]:
    """Answers in a UDP datagram from or to port 53."""
    ip = _ip(frame or b"")
    if not ip or ip[2] != 17 or len(ip[3]) < 8 or 53 not in struct.unpack(">HH", ip[3][:4]):
        return []
    return dns_answers(ip[3][8:])


def _frames(batches, rows: int = 4096):
    for b in batches:
        for data in b["content"]:
            part = []
            for r in records(data):
                part.append(r)
                if len(part) == rows:
                    yield pd.DataFrame(part, columns=["ts", "frame"])
                    part = []
            yield pd.DataFrame(part, columns=["ts", "frame"])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``ts double, frame binary`` of pcap files, some thousand records at a time. A file is read as
    one value, so it must be under 2 GB: long captures are rotated into several files."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_frames, "ts double, frame binary")


def stream_frames(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """The same as a stream: capture files are taken as they appear in the folder, ``files`` a trigger."""
    schema = spark.read.format("binaryFile").load(path).schema
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files).load(path)
    return stream.select("content").mapInPandas(_frames, "ts double, frame binary")


def decode_addresses(frame: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(frames: pd.Series) -> pd.Series:
        return frames.map(address_pair)

    return run(frame)


def decode_tcp(frame: Column) -> Column:
    """A struct of PACKET, its fields null where the frame holds no TCP packet."""
    names = [c.split()[0] for c in PACKET.split(", ")]

    @F.pandas_udf(PACKET)
    def run(frames: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tcp_packet(f) or dict.fromkeys(names) for f in frames], columns=names)

    return run(frame)


def decode_dns(frame: Column) -> Column:
    @F.pandas_udf("array<struct<ip: string, domain: string, ttl: bigint>>")
    def run(frames: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("ip", "domain", "ttl"), a)) for a in dns_of_frame(f)] for f in frames])

    return run(frame)
