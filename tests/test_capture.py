"""Captures against a plain reader and a plain assembly, whatever the ranges; records that a timeout cut."""

import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.operators import flows
from plumbline.sources import capture

PACKETS = 700


def packet(rng, src, dst, sport, dport, proto, payload=b"", flags=0, tag=False):
    body = struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 512, 0, 0) + payload if proto == 6 else struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload
    if ":" in src:
        import ipaddress

        ip = struct.pack("!IHBB", 6 << 28, len(body), proto, 60) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed
        kind = b"\x86\xdd"
    else:
        address = lambda a: bytes(map(int, a.split(".")))
        ip = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0) + address(src) + address(dst)
        kind = b"\x08\x00"
    return bytes(12) + (b"\x81\x00\x00\x05" if tag else b"") + kind + ip + body


def made(seed):
    """(time in microseconds, packet, fields) with idle and active time-outs, two directions, and captures inside payloads."""
    rng = random.Random(seed)
    out, now = [], 1_700_000_000_000_000
    inner = b"".join(struct.pack("<IIII", 1_700_000_000 + k, 5, 40, 40) + bytes(40) for k in range(30))
    ends = [("10.0.0.1", "10.0.0.2", 1000, 80, 6), ("10.0.0.1", "10.0.0.2", 1001, 80, 6), ("fe80::1", "fe80::2", 53, 53, 17), ("10.0.0.9", "10.0.0.1", 7, 7, 17)]
    for k in range(PACKETS):
        now += rng.choice([0, 1, 50_000, 20_000_000, 40_000_000, 125_000_000 if rng.random() < 0.1 else 3_000_000])
        src, dst, sport, dport, proto = rng.choice(ends[:2] if rng.random() < 0.7 else ends)
        if rng.random() < 0.4:
            src, dst, sport, dport = dst, src, dport, sport
        payload = inner if k % 40 == 7 and proto == 6 else bytes(rng.randrange(0, 60))
        flags = rng.choice([2, 16, 24, 1])
        raw = packet(rng, src, dst, sport, dport, proto, payload, flags, tag=k % 5 == 0)
        length = len(raw) - 14 - (4 if k % 5 == 0 else 0)
        out.append((now, raw, (src, dst, sport, dport, proto, length, flags if proto == 6 else 0)))
        if k % 50 == 3:
            out.append((now, bytes(12) + b"\x08\x06" + bytes(40), None))  # no IP packet
    return out


def written(path, rows, order="<", nano=False, tail=b""):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for t, raw, _ in rows:
        data += struct.pack(order + "IIII", t // 1_000_000, t % 1_000_000 * (1000 if nano else 1), len(raw), len(raw)) + raw
    path.write_bytes(data + tail)


def blocks(path, rows):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    data += block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for t, raw, _ in rows:
        t *= 1000
        data += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(raw), len(raw)) + raw + bytes(-len(raw) % 4))
    path.write_bytes(data)


def plain_flows(rows, idle=120_000_000, active=1_800_000_000):
    open_, done = {}, []
    for t, _, f in rows:
        if f is None:
            continue
        src, dst, sport, dport, proto, length, flags = f
        key = (proto, *sorted([(src, sport), (dst, dport)]))
        flow = open_.get(key)
        if flow is None or t - flow["last"] > idle or t - flow["first"] >= active:
            if flow:
                done.append(flow)
            flow = open_[key] = {"src": (src, sport), "dst": (dst, dport), "proto": proto, "first": t, "n": [0, 0], "bytes": [0, 0], "sizes": [], "flags": defaultdict(int)}
        flow["last"] = t
        side = 0 if (src, sport) == flow["src"] else 1
        flow["n"][side] += 1
        flow["bytes"][side] += length
        flow["sizes"].append(length)
        for k, name in enumerate(flows.FLAGS):
            flow["flags"][name] += flags >> k & 1
    return sorted((*f["src"], *f["dst"], f["proto"], f["first"] // 1000, f["last"] // 1000, *f["n"], *f["bytes"], min(f["sizes"]), max(f["sizes"]), f["flags"]["syn"], f["flags"]["ack"]) for f in done + list(open_.values()))


COLUMNS = "src_ip src_port dst_ip dst_port protocol bidirectional_first_seen_ms bidirectional_last_seen_ms src2dst_packets dst2src_packets src2dst_bytes dst2src_bytes bidirectional_min_ps bidirectional_max_ps bidirectional_syn_packets bidirectional_ack_packets".split()


def got_flows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_ranges_of_any_size_give_the_flows_of_one_pass(spark, tmp_path):
    rows = made(1)
    written(tmp_path / "a.pcap", rows, tail=struct.pack("<IIII", 1_700_000_000, 0, 500, 500) + b"cut off")
    want = plain_flows(rows)
    assert len(want) > 20 and any(w[6] - w[5] > 1_000_000 for w in want)
    for size in (1 << 30, 40_000, 1_111):
        packets = capture.read_packets(spark, [str(tmp_path / "a.pcap")], size)
        told = sorted((r.number, r.time, r.src_ip, r.dst_port, r.length, r.flags) for r in packets.collect())
        assert told == [(k, t, f[0], f[3], f[5], f[6]) for k, (t, _, f) in enumerate(rows) if f]
    assert got_flows(capture.read_capture(spark, str(tmp_path / "a.pcap"), range_bytes=40_000)) == want


def test_byte_orders_and_block_files(spark, tmp_path):
    rows = made(2)[:300]
    written(tmp_path / "big.pcap", rows, order=">", nano=True)
    blocks(tmp_path / "new.pcapng", rows)
    want = plain_flows(rows)
    for name in ("big.pcap", "new.pcapng"):
        assert got_flows(capture.read_capture(spark, str(tmp_path / name), range_bytes=5_000)) == want


def test_no_capture_and_no_flow(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"nothing of the kind, but long enough")
    with pytest.raises(capture.CaptureError, match="no capture"):
        capture.read_capture(spark, str(tmp_path / "x.pcap"))
    written(tmp_path / "empty.pcap", [])
    with pytest.raises(capture.CaptureError, match="no flow"):
        capture.read_capture(spark, str(tmp_path / "empty.pcap"))


def plain_islands(rows, gap):
    """First id of each row's island, by a loop over sorted rows."""
    out, last = {}, None
    for key, start, end, row in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3])):
        end = max(start, end)
        if last is None or last[0] != key or start - last[1] > gap:
            last = [key, end, row]
        last[1] = max(last[1], end)
        out[row] = last[2]
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_islands_are_glued_across_ranges(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([None, 1, 2]) if rng.random() < 0.3 else 7, rng.randrange(0, 3000), 0, k) for k in range(600)]  # one hot key
    rows = [(k, s, s + rng.choice([0, 1, 5, 400 if rng.random() < 0.05 else 2]), i) for k, s, _, i in rows]
    df = spark.createDataFrame(rows, "k long, s long, e long, id long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = flows.islands(df, ["k"], F.col("s"), F.col("e"), 3, ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    least = {}
    for r in sorted(found, key=lambda r: (r.s, r.id)):
        least.setdefault(r.island, r.id)
    assert {r.id: least[r.island] for r in found} == plain_islands(rows, 3)
