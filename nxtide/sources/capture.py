"""A data source for packet captures: spark.read.format("dns_capture").load(path), one row for each DNS message.

Each file is a partition. Datagrams come out of Ethernet (with VLAN and MPLS tags), raw IP
or Linux cooked frames; IP fragments are joined within a file; TCP segments are put in
order by sequence number for each flow until it falls silent for half a second. Register
the source with register(spark).
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "time double, size int, protocol string, src string, dst string, qr string, AA string, rcode int, qdcount int, ancount int, nscount int, arcount int, qcode int, dn string, answer string, file string"
PORT, LULL = 53, 0.5
#: Link types: Ethernet, raw IP (three numbers), Linux cooked.
ETHERNET, RAW, COOKED = 1, (12, 14, 101), 113
#: Record types by their names in answers.
TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TEXT", 28: "AAAA", 33: "SRV", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 10: "NULL", 255: "ANY"}


def packets(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    """(time, link type, frame) of a capture file in either byte order, with microseconds or nanoseconds. A cut record ends it."""
    order, unit = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}.get(data[:4], (None, 0))
    if order is None or len(data) < 24:
        raise ValueError("not a capture file")
    link, at = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF, 24
    while at + 16 <= len(data):
        seconds, part, size, _ = struct.unpack_from(order + "IIII", data, at)
        if at + 16 + size > len(data):
            return
        yield seconds + part / unit, link, data[at + 16 : at + 16 + size]
        at += 16 + size


def network_layer(link: int, frame: bytes) -> bytes | None:
    """The IP packet in a frame."""
    if link in RAW:
        return frame
    if link not in (ETHERNET, COOKED):
        return None
    at = 12 if link == ETHERNET else 14
    while at + 2 <= len(frame):
        kind = int.from_bytes(frame[at : at + 2], "big")
        at += 2
        if kind in (0x0800, 0x86DD):
            return frame[at:]
        if kind in (0x8100, 0x88A8, 0x9100):
            at += 2
        elif kind == 0x8847:
            while at + 4 <= len(frame) and not frame[at + 2] & 1:
                at += 4
            return frame[at + 4 :]
        else:
            return None
    return None


class Fragments:
    """Joins the fragments of IP packets."""

    def __init__(self) -> None:
        self.parts: dict[tuple, dict[int, bytes]] = {}
        self.ends: dict[tuple, int] = {}

    def add(self, key: tuple, offset: int, last: bool, data: bytes) -> bytes | None:
        parts = self.parts.setdefault(key, {})
        parts[offset] = data
        if last:
            self.ends[key] = offset + len(data)
        joined = b""
        for at in sorted(parts):
            if at > len(joined):
                return None
            joined = joined[:at] + parts[at]
        if len(joined) < self.ends.get(key, 1 << 62):
            return None
        del self.parts[key], self.ends[key]
        return joined


def transport(packet: bytes, fragments: Fragments) -> tuple[str, str, int, bytes] | None:
    """(source, destination, protocol, payload) of a whole IP packet."""
    if len(packet) >= 20 and packet[0] >> 4 == 4:
        head, total = (packet[0] & 15) * 4, int.from_bytes(packet[2:4], "big")
        flags = int.from_bytes(packet[6:8], "big")
        src, dst, kind, body = packet[12:16], packet[16:20], packet[9], packet[head : total or None]
        offset, more = (flags & 0x1FFF) * 8, flags & 0x2000
        if offset or more:
            body = fragments.add((src, dst, kind, packet[4:6]), offset, not more, body)
    elif len(packet) >= 40 and packet[0] >> 4 == 6:
        src, dst, kind, body = packet[8:24], packet[24:40], packet[6], packet[40 : 40 + int.from_bytes(packet[4:6], "big")]
        while body is not None and kind in (0, 43, 44, 60) and len(body) >= 8:
            after, size = body[0], 8 if kind == 44 else 8 + body[1] * 8
            if kind == 44:
                word, rest = int.from_bytes(body[2:4], "big"), body[8:]
                body = rest if not word & 0xFFF9 else fragments.add((src, dst, after, body[4:8]), word & 0xFFF8, not word & 1, rest)
            else:
                body = body[size:]
            kind = after
    else:
        return None
    if body is None:
        return None
    return str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst)), kind, body


class Flow:
    """One direction of a TCP connection: its segments by sequence number."""

    def __init__(self) -> None:
        self.segments: dict[int, bytes] = {}
        self.time = 0.0

    def messages(self) -> Iterator[bytes]:
        """The DNS messages, each after its length, of the run of segments from the first one on."""
        stream, at = b"", None
        for seq in sorted(self.segments):
            data = self.segments[seq]
            if at is None:
                at = seq
            if seq > at + len(stream):
                break
            stream = stream[: seq - at] + data if seq - at + len(data) >= len(stream) else stream
        i = 0
        while i + 2 <= len(stream):
            size = int.from_bytes(stream[i : i + 2], "big")
            if i + 2 + size > len(stream):
                return
            yield stream[i + 2 : i + 2 + size]
            i += 2 + size


def name_at(data: bytes, at: int) -> tuple[str, int]:
    """A name, with pointers followed (none twice), and the place after it."""
    labels, after, seen = [], None, set()
    while True:
        size = data[at]
        if size >= 0xC0:
            after = at + 2 if after is None else after
            at = int.from_bytes(data[at : at + 2], "big") & 0x3FFF
            if at in seen:
                raise ValueError("a loop of pointers")
            seen.add(at)
        elif size == 0:
            return ".".join(labels), at + 1 if after is None else after
        else:
            labels.append("".join(chr(b) if 33 <= b < 127 else f"\\{b:03d}" for b in data[at + 1 : at + 1 + size]))
            at += 1 + size


def value_of(kind: int, data: bytes, at: int, size: int) -> str:
    """A record's data as text."""
    raw, num = data[at : at + size], lambda i, n: int.from_bytes(data[at + i : at + i + n], "big")
    if kind in (1, 28) and size in (4, 16):
        return str(ipaddress.ip_address(raw))
    if kind in (2, 5, 12):
        return name_at(data, at)[0]
    if kind == 15:
        return f"{num(0, 2)},{name_at(data, at + 2)[0]}"
    if kind == 33:
        return f"{num(0, 2)},{num(2, 2)},{num(4, 2)},{name_at(data, at + 6)[0]}"
    if kind == 6:
        first, after = name_at(data, at)
        second, after = name_at(data, after)
        return ",".join([first, second, *(str(int.from_bytes(data[after + 4 * i : after + 4 * i + 4], "big")) for i in range(5))])
    if kind == 16:
        parts, i = [], 0
        while i < size:
            parts.append(raw[i + 1 : i + 1 + raw[i]].decode("latin-1"))
            i += 1 + raw[i]
        return " ".join(parts)
    if kind == 43:
        return f"{num(0, 2)},{num(2, 1)},{num(3, 1)},{raw[4:].hex()}"
    if kind == 46:
        return f"{TYPES.get(num(0, 2), num(0, 2))},{num(2, 1)},{num(3, 1)},{num(4, 4)},{num(8, 4)},{num(12, 4)},{num(16, 2)},{name_at(data, at + 18)[0]}"
    if kind == 47:
        return name_at(data, at)[0]
    if kind == 48:
        return f"{num(0, 2)},{num(2, 1)},{num(3, 1)},{raw[4:].hex()}"
    return raw.hex()


def dns_row(data: bytes) -> tuple | None:
    """(qr, AA, rcode, qdcount, ancount, nscount, arcount, qcode, dn, answer); None for what isn't a DNS message."""
    try:
        flags, qd, an, ns, ar = struct.unpack_from(">HHHHH", data, 2)
        at, dn, qcode = 12, None, None
        for i in range(qd):
            name, at = name_at(data, at)
            if i == 0:
                dn, qcode = name.lower(), int.from_bytes(data[at : at + 2], "big")
            at += 4
        answers = []
        for _ in range(an):
            _, at = name_at(data, at)
            kind, _, _, size = struct.unpack_from(">HHIH", data, at)
            if kind == qcode or qcode == 255:
                answers.append(value_of(kind, data, at + 10, size))
            at += 10 + size
    except (struct.error, IndexError, ValueError):
        return None
    return "r" if flags & 0x8000 else "q", "1" if flags & 0x0400 else None, flags & 15, qd, an, ns, ar, qcode, dn, ";".join(answers) or None


def messages(data: bytes) -> Iterator[tuple]:
    """Rows of a capture, without the file's name."""
    fragments, flows = Fragments(), {}

    def ended(now: float) -> Iterator[tuple]:
        for key in [k for k, f in flows.items() if now - f.time > LULL]:
            flow = flows.pop(key)
            for m in flow.messages():
                if row := dns_row(m):
                    yield flow.time, len(m), "t", key[0], key[2], *row

    for time, link, frame in packets(data):
        yield from ended(time)
        packet = network_layer(link, frame)
        found = transport(packet, fragments) if packet else None
        if not found or len(found[3]) < 8:
            continue
        src, dst, kind, body = found
        ports = int.from_bytes(body[0:2], "big"), int.from_bytes(body[2:4], "big")
        if PORT not in ports:
            continue
        if kind == 17 and (row := dns_row(body[8:])):
            yield time, len(body) - 8, "u", src, dst, *row
        elif kind == 6 and len(body) >= 20:
            payload = body[(body[12] >> 4) * 4 :]
            if payload:
                flow = flows.setdefault((src, ports[0], dst, ports[1]), Flow())
                flow.segments[int.from_bytes(body[4:8], "big")] = payload
                flow.time = time
    yield from ended(float("inf"))


class File(InputPartition):
    def __init__(self, path: str, data: bytes | None = None):
        super().__init__(path)
        self.path, self.data = path, data


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.options["path"].removeprefix("file:")
        files = sorted(glob.glob(os.path.join(path, "*.pcap"))) if os.path.isdir(path) else sorted(glob.glob(path))
        return [File(f) for f in files] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.path:
            with open(partition.path, "rb") as f:
                for row in messages(f.read()):
                    yield *row, partition.path


class CaptureSource(DataSource):
    """For captures in a folder that all executors mount; see read_captures() for any other store."""

    @classmethod
    def name(cls) -> str:
        return "dns_capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def read_captures(spark: SparkSession, path: str):
    """The same rows from any store that Spark reads, by its reader of binary files."""
    import pandas as pd

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        for f in frames:
            for file, content in zip(f["path"], f["content"]):
                yield pd.DataFrame([(*row, file) for row in messages(content)], columns=names).astype({"qcode": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, SCHEMA)
