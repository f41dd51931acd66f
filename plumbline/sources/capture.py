"""Packet captures, read in byte ranges: classic captures split anywhere, newer ones a file at a time.

A range's reader doesn't know where a record begins. It looks for the first
place from which headers follow one another plausibly, and goes on from there
to the first record at or beyond the range's end. What it began and ended with
is compared between neighbours: a range is right if the one before, which
is, ended where it began. A range that began elsewhere (payloads may hold
captures themselves) is walked again from where it has to begin. So the rows
are those of one pass over the file, whatever the ranges' size.

Files are opened by tasks, so the storage must be one that pyarrow opens: local
or mounted folders, HDFS, S3, GCS. Truncated last records are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import flows

CAPTURE_SUFFIXES = (".pcap", ".pcapng", ".cap")
#: Bytes in a range, and bytes that a task reads at a time.
RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Headers in a row that make a place plausible; a record beyond this length makes it not.
CHAIN, LONGEST = 12, 1 << 18
# First bytes of a file: byte order, and whether fractions are of a billion.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
SECTION = b"\x0a\x0d\x0d\x0a"
# Bytes before the network header, by link type.
LINKS = {0: 4, 1: 14, 12: 0, 14: 0, 101: 0, 108: 4, 113: 16, 228: 0, 229: 0, 276: 20}
PACKET = (
    "file string, number long, time long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length long, "
    "captured long, ttl int, flags int, window int"
)
_ARROW = pa.schema(
    [("file", pa.string()), ("number", pa.int64()), ("time", pa.int64()), ("src_ip", pa.string()), ("dst_ip", pa.string())]
    + [(c, pa.int32()) for c in ("src_port", "dst_port", "protocol")]
    + [("length", pa.int64()), ("captured", pa.int64())]
    + [(c, pa.int32()) for c in ("ttl", "flags", "window")]
)


class CaptureError(ValueError):
    """The file is no capture, or of a link type that isn't read."""


def opened(path: str):
    """A seekable file of any storage that pyarrow opens."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def head_of(path: str) -> tuple[str, str, int, int]:
    """(kind, byte order, nanoseconds of a fraction's unit, link type) from a file's first bytes."""
    with opened(path) as f:
        head = f.read(24)
    if head[:4] == SECTION:
        return "blocks", "", 0, 0
    if head[:4] not in MAGIC or len(head) < 24:
        raise CaptureError(f"{path}: no capture begins like this")
    order, unit = MAGIC[head[:4]]
    link = struct.unpack(order + "I", head[20:24])[0] & 0x0FFFFFFF
    if link not in LINKS:
        raise CaptureError(f"{path}: packets of link type {link} aren't read")
    return "records", order, unit, link


class Window:
    """Bytes of a file around a moving place; what lies behind it is let go."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """``n`` bytes from ``place``, or fewer at the file's end."""
        if place < self.start or place + n > self.start + len(self.data):
            self.file.seek(place)
            self.start, self.data = place, self.file.read(max(n, READ_BYTES))
        return self.data[place - self.start : place - self.start + n]


def _header(window: Window, place: int, order: str) -> tuple[int, int, int, int] | None:
    raw = window.at(place, 16)
    return struct.unpack(order + "IIII", raw) if len(raw) == 16 else None


def plausible(window: Window, place: int, order: str, unit: int) -> bool:
    """Whether headers follow one another from ``place`` on, ``CHAIN`` of them or to the file's end."""
    seconds = None
    for _ in range(CHAIN):
        if place == window.size:
            return seconds is not None
        got = _header(window, place, order)
        if got is None:
            return False
        second, fraction, captured, whole = got
        if fraction >= 1_000_000_000 // unit or captured > LONGEST or captured > whole or whole > LONGEST or not captured:
            return False
        if seconds is not None and abs(second - seconds) > 86_400:
            return False
        seconds, place = second, place + 16 + captured
        if place > window.size:
            return False
    return True


def first_record(window: Window, start: int, end: int, order: str, unit: int) -> int:
    """The first place from ``start`` on where a record may begin; the end of the range if none does."""
    for place in range(start, min(end, window.size)):
        if plausible(window, place, order, unit):
            return place
    return min(end, window.size)


def walk(window: Window, place: int, end: int, order: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(place, seconds, fraction, captured, whole length) of the records that begin before ``end``."""
    while place < end:
        got = _header(window, place, order)
        if got is None or place + 16 + got[2] > window.size:
            return
        yield (place, *got)
        place += 16 + got[2]


def _walked_to(window: Window, place: int, end: int, order: str) -> tuple[int, int]:
    """(first place at or beyond the range's end, number of records)."""
    n = 0
    for at, _, _, captured, _ in walk(window, place, end, order):
        place, n = at + 16 + captured, n + 1
    return place, n


def ranges_of(spark: SparkSession, paths: list[str], range_bytes: int) -> list[tuple]:
    """(file, kind, order, unit, link, begin, end, number of the first record) of ranges that follow one another exactly.

    Tasks walk the headers; the driver gets one row for each range.
    """
    plan = []
    for path in paths:
        kind, order, unit, link = head_of(path)
        with opened(path) as f:
            size = f.size()
        if kind == "blocks":
            plan.append((path, kind, order, unit, link, 0, size, 0, size, None))
            continue
        for k, start in enumerate(range(24, max(size, 25), range_bytes)):
            plan.append((path, kind, order, unit, link, k, min(size, start + range_bytes), start, size, 24 if k == 0 else None))
    schema = "file string, kind string, order string, unit int, link int, nth long, upto long, start long, size long, begin long"

    def look(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                with opened(r.file) as f:
                    window = Window(f, r.size)
                    begin = first_record(window, r.start, r.upto, r.order, r.unit) if pd.isna(r.begin) else int(r.begin)
                    after, n = _walked_to(window, begin, r.upto, r.order)
                out.append((r.file, r.nth, begin, after, n))
            yield pd.DataFrame(out, columns=["file", "nth", "begin", "after", "n"])

    split = [p for p in plan if p[1] == "records"]
    known: dict[tuple[str, int], tuple[int, int, int]] = {}
    todo = split
    while todo:  # once, but for ranges that began at a wrong place
        frame = spark.createDataFrame(todo, schema).repartition(min(len(todo), 10_000), "file", "nth")
        for r in frame.mapInPandas(look, "file string, nth long, begin long, after long, n long").collect():
            known[r.file, r.nth] = (r.begin, r.after, r.n)
        todo, reached = [], {}
        for p in split:
            begin, after, _ = known[p[0], p[5]]
            want = reached.get(p[0], 24)
            if want is None:  # what a wrong range ended with says nothing: this one is judged in the next round
                reached[p[0]] = after
            elif want >= p[6]:
                known[p[0], p[5]] = (want, want, 0)  # an earlier record covers the range
            elif begin != want:
                todo.append((*p[:9], want))
                reached[p[0]] = None
            else:
                reached[p[0]] = after
    out, count = [(*p[:5], 0, p[8], 0) for p in plan if p[1] == "blocks"], {}
    for p in split:
        begin, after, n = known[p[0], p[5]]
        out.append((*p[:5], begin, p[6], count.get(p[0], 0)))
        count[p[0]] = count.get(p[0], 0) + n
    return out


def _addresses(raw: np.ndarray) -> np.ndarray:
    """Rows of 4 or 16 bytes as addresses; each distinct one is written once."""
    import ipaddress

    rows, at = np.unique(raw, axis=0, return_inverse=True)
    return np.array([str(ipaddress.ip_address(r.tobytes())) for r in rows], object)[at.ravel()]


def decode(data: np.ndarray, starts: np.ndarray, captured: np.ndarray, link: int) -> dict[str, np.ndarray]:
    """Network and transport fields of packets in one buffer; ``ok`` tells which are IP packets.

    ``data`` is padded with zeroes, so that fields which a packet is too short for can be looked at and thrown away.
    """
    n = len(starts)
    u8 = lambda at: data[at].astype(np.int64)
    u16 = lambda at: (u8(at) << 8) | u8(at + 1)
    net = starts + LINKS[link]
    ok = captured >= LINKS[link] + 20
    if link == 1:
        kind = u16(starts + 12)
        for _ in range(2):  # tags of virtual networks
            tagged = np.isin(kind, (0x8100, 0x88A8))
            kind = np.where(tagged, u16(net + 2), kind)
            net = np.where(tagged, net + 4, net)
        ok &= np.isin(kind, (0x0800, 0x86DD))
    version = u8(net) >> 4
    v4, v6 = ok & (version == 4), ok & (version == 6) & (captured >= net - starts + 40)
    v4 &= captured >= net - starts + 20
    ok = v4 | v6
    protocol = np.where(v6, u8(net + 6), u8(net + 9))
    transport = net + np.where(v6, 40, (u8(net) & 15) * 4)
    for _ in range(4):  # extension headers
        more = v6 & np.isin(protocol, (0, 43, 60)) & (transport + 8 <= starts + captured)
        protocol, transport = np.where(more, u8(transport), protocol), np.where(more, transport + 8 * (u8(transport + 1) + 1), transport)
        transport = np.minimum(transport, len(data) - 64)
    whole = np.where(v6, u16(net + 4) + 40, u16(net + 2))
    later = v4 & ((u16(net + 6) & 0x1FFF) != 0)  # further fragments have no ports
    ports = ok & np.isin(protocol, (6, 17, 132)) & (transport + 4 <= starts + captured) & ~later
    tcp = ports & (protocol == 6) & (transport + 16 <= starts + captured)
    src, dst = np.empty(n, object), np.empty(n, object)
    for some, a, b, size in ((v4, 12, 16, 4), (v6, 8, 24, 16)):
        if some.any():
            for out, off in ((src, a), (dst, b)):
                out[some] = _addresses(data[(net[some] + off)[:, None] + np.arange(size)])
    return {
        "ok": ok, "src_ip": src, "dst_ip": dst, "src_port": np.where(ports, u16(transport), -1), "dst_port": np.where(ports, u16(transport + 2), -1),
        "protocol": protocol, "length": whole, "ttl": np.where(v6, u8(net + 7), u8(net + 8)),
        "flags": np.where(tcp, u8(transport + 13), 0), "window": np.where(tcp, u16(transport + 14), -1),
    }


#: Packets that are decoded at a time.
BATCH = 20_000


def _batch(file: str, link: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Arrow columns of (number, time in nanoseconds, bytes) rows."""
    captured = np.array([len(r[2]) for r in rows], np.int64)
    starts = np.cumsum(captured) - captured
    data = np.frombuffer(b"".join([*(r[2] for r in rows), bytes(256)]), np.uint8)
    got = decode(data, starts, captured, link)
    ok = np.flatnonzero(got["ok"])
    number, time = (np.array([r[k] for r in rows], np.int64)[ok] for k in (0, 1))
    few = lambda c: pa.array(got[c][ok].astype(np.int32), pa.int32(), mask=got[c][ok] < 0)
    columns = [pa.array([file] * len(ok), pa.string()), pa.array(number), pa.array(time // 1000)]
    columns += [pa.array(got[c][ok].tolist(), pa.string()) for c in ("src_ip", "dst_ip")] + [few(c) for c in ("src_port", "dst_port", "protocol")]
    columns += [pa.array(got["length"][ok], pa.int64()), pa.array(captured[ok])] + [few(c) for c in ("ttl", "flags", "window")]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _blocks(f, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, time in nanoseconds, link type, bytes) of a block file's packets, section by section."""
    window, place, order, links, number = Window(f, size), 0, "<", [], 0
    while place + 12 <= size:
        kind = window.at(place, 4)
        if kind == SECTION:
            order, links = ("<" if window.at(place + 8, 4) == b"\x4d\x3c\x2b\x1a" else ">"), []
        length = struct.unpack(order + "I", window.at(place + 4, 4))[0]
        if length < 12 or place + length > size:
            return
        code = struct.unpack(order + "I", kind)[0]
        body = window.at(place + 8, length - 12)
        if code == 1:
            unit, at = 1000, 8
            while at + 4 <= len(body):
                option, n = struct.unpack(order + "HH", body[at : at + 4])
                if option == 9 and n == 1:
                    exponent = body[at + 4]
                    unit = 10**9 / 2 ** (exponent & 127) if exponent & 128 else 10 ** (9 - exponent)
                at += 4 + n + -n % 4
                if option == 0:
                    break
            links.append((struct.unpack(order + "H", body[:2])[0], unit))
        elif code == 6 and len(body) >= 20:
            interface, high, low, captured, _ = struct.unpack(order + "IIIII", body[:20])
            if interface < len(links):
                yield number, int(((high << 32) | low) * links[interface][1]), links[interface][0], body[20 : 20 + captured]
            number += 1
        place += length


def read_packets(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each IP packet of the captures, with its number in its file and its time in microseconds."""
    plan = ranges_of(spark, paths, range_bytes)
    schema = "file string, kind string, order string, unit int, link int, begin long, upto long, number long"

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as f:
                    window, name = Window(f, f.size()), r["file"].rsplit("/", 1)[-1]
                    if r["kind"] == "records":
                        found = (
                            (r["number"] + k, (s * 1_000_000_000 + x * r["unit"]), r["link"], window.at(at + 16, n))
                            for k, (at, s, x, n, _) in enumerate(walk(window, r["begin"], r["upto"], r["order"]))
                        )
                    else:
                        found = _blocks(f, window.size)
                    held: dict[int, list] = {}
                    for number, time, link, data in found:
                        if link not in LINKS:
                            raise CaptureError(f"{name}: packets of link type {link} aren't read")
                        rows = held.setdefault(link, [])
                        rows.append((number, time, data))
                        if len(rows) >= BATCH:
                            yield _batch(name, link, rows)
                            held[link] = []
                    for link, rows in held.items():
                        if rows:
                            yield _batch(name, link, rows)

    dealt = spark.createDataFrame(plan, schema).repartition(max(1, min(len(plan), 100_000)), "file", "begin")
    return dealt.mapInArrow(run, PACKET)


def read_capture(spark: SparkSession, path: str | list[str], idle: float = flows.IDLE, active: float = flows.ACTIVE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Flows of one or more captures, by five-tuple with idle and active time-outs; packets of all files are one stream."""
    paths = [path] if isinstance(path, str) else path
    packets = read_packets(spark, paths, range_bytes)
    # a packet's place in its capture orders packets of one microsecond
    packets = packets.withColumn("number", F.struct("file", "number"))
    flows_ = flows.assemble(packets, idle, active)
    if flows_.isEmpty():
        raise CaptureError(f"{', '.join(paths)}: no flow was found; the capture may be empty, cut off or encrypted below IP")
    return flows_
