"""Flows: records that a timeout cut from one event, and packets put together to flows.

Records of a key, in the order of time, are one island as long as the next
begins no later than a gap after all before it ended. Rows are dealt into
ranges of (key, time), as many as a shuffle has partitions, so a key with any
share of the rows is no one task's; each range finds its own islands, and what
is still open at a range's end is carried on, range by range, from a table
with one row for each range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import q
from plumbline.operators import ranks
from plumbline.operators.groups import bound_batches
from plumbline.session import cut

_PART = "__range"


def islands(df: DataFrame, keys: list[str], start: Column, end: Column, gap: float, tie: list[str]) -> DataFrame:
    """``df`` with ``island``, a number that the records of one island share.

    A record belongs to the island before it if it has the same keys (null with
    null) and ``start`` is at most ``gap`` after the greatest ``end`` of that
    island. ``tie`` orders records of equal starts; times are numbers, and
    records without a start are left out. An end before its start counts as
    the start.
    """
    named = df.withColumns({"__start": start, "__end": F.greatest(start, F.coalesce(end, start))}).where("__start IS NOT NULL")
    named = named.withColumn("__key", F.struct(*[q(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    order = [F.col("__key"), F.col("__start"), *[q(t) for t in tie]]
    dealt = ranks.ranged(named, order)
    spans = dealt.groupBy(_PART, "__key").agg(F.max("__end").alias("end"), F.min("__start").alias("start"))
    edges = spans.groupBy(_PART).agg(F.min("__key").alias("first"), F.max("__key").alias("last"))
    tails = spans.join(edges, [_PART]).where(F.col("__key").eqNullSafe(F.col("last"))).select(_PART, "first", "last", "end")
    carried, held = [], None
    for r in sorted(tails.collect(), key=lambda r: r[_PART]):  # a row for each range
        if held is not None and held[0] == r["first"]:
            carried.append((r[_PART], held[0], held[1]))
        reached = r["end"]
        if held is not None and held[0] == r["last"] and r["first"] == r["last"]:
            reached = max(reached, held[1])
        held = (r["last"], reached)
    schema = f"{_PART} int, __key {dealt.schema['__key'].dataType.simpleString()}, __carried {dealt.schema['__end'].dataType.simpleString()}"
    table = df.sparkSession.createDataFrame(carried, schema).withColumnRenamed("__key", "__of")
    told = dealt.join(F.broadcast(table), _PART, "left")
    own = Window.partitionBy(_PART, "__key").orderBy(F.col("__start"), *[q(t) for t in tie]).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.when(F.col("__key").eqNullSafe(F.col("__of")), F.col("__carried"))
    before = F.greatest(F.max("__end").over(own), carry)  # greatest passes over nulls
    told = cut(told.withColumn("__new", (before.isNull() | (F.col("__start") - before > gap)).cast("long")).drop("__of", "__carried"))
    opened = told.groupBy(_PART).agg(F.sum("__new").alias("n"))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    opened = opened.select(F.col(_PART).alias("__at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__islands"))
    within = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.withColumn("island", F.sum("__new").over(within)).join(F.broadcast(opened), F.col(_PART) == F.col("__at"))
    return told.select(*[q(c) for c in df.columns], (F.col("island") + F.col("__islands")).alias("island"))


def cut_by_timeout(df: DataFrame, keys: list[str], start: Column, end: Column, gap: float, row_id: str) -> DataFrame:
    """(first_id, n_records, start, end) of each event that was recorded as several flows."""
    named = df.withColumns({"__s": start, "__e": F.greatest(start, F.coalesce(end, start))})
    found = islands(named, keys, F.col("__s"), F.col("__e"), gap, [row_id])
    parts = found.groupBy("island").agg(
        F.min_by(q(row_id), F.struct("__s", q(row_id))).alias("first_id"), F.count(F.lit(1)).alias("n_records"),
        F.min("__s").alias("start"), F.max("__e").alias("end"),
    )
    return parts.where("n_records > 1").drop("island")


def timeout_summary(events: DataFrame, n_rows: int) -> DataFrame:
    """(n_events, n_affected, ratio, longest): of the result of ``cut_by_timeout``."""
    return events.agg(
        F.count(F.lit(1)).alias("n_events"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_affected"), F.max("n_records").alias("longest")
    ).withColumn("ratio", F.col("n_affected") / F.lit(float(max(1, n_rows))))


#: Seconds without a packet that end a flow, and seconds after which a flow is cut though packets go on.
IDLE, ACTIVE = 120.0, 1800.0
_SECOND = 1_000_000


def _cut_points(islands_: DataFrame, active: int) -> DataFrame:
    """(island, cuts): the times at which an island's flows begin, of those that last ``active`` or longer.

    Each next flow begins with the first packet that comes ``active`` or more
    after the one before began, so times are followed in order: a task streams
    an island's times (eight bytes each, however wide packets are), sorted by
    the shuffle, and holds the last beginning alone.
    """
    spans = islands_.groupBy("island").agg((F.max("time") - F.min("time")).alias("lasts")).where(F.col("lasts") >= active)
    times = islands_.join(spans.select("island"), "island").select("island", "time").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, began, cuts = None, None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([cuts], pa.list_(pa.int64()))], ["island", "cuts"])
        for batch in batches:
            own, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]), strict=True):
                if a == b:
                    continue
                if own[a] != last:
                    if last is not None:
                        yield out()
                    last, began = int(own[a]), int(at[a])
                    cuts = [began]
                while (k := a + int(np.searchsorted(at[a:b], began + active))) < b:
                    began = int(at[k])
                    cuts.append(began)
        if last is not None:
            yield out()

    bound_batches(times.sparkSession)
    return times.repartition("island").sortWithinPartitions("island", "time").mapInArrow(run, "island long, cuts array<long>")


def assemble(packets: DataFrame, idle: float = IDLE, active: float = ACTIVE, number: str = "number") -> DataFrame:
    """Flows in both directions from packets (time, src_ip, dst_ip, src_port, dst_port, protocol, length, flags, ``number``).

    ``time`` is in whole microseconds. Packets of one five-tuple, whichever end
    sent them, are one flow until no packet comes for more than ``idle``
    seconds, or until ``active`` seconds after its first packet. A flow's
    source is the sender of its first packet, by time and then ``number``.
    Ports that a protocol lacks are null. Packets without time or address are
    left out.

    One row for each flow: its ends, times in milliseconds, packets and bytes
    in both directions and in each, packet sizes (least, mean, deviation,
    greatest) and counts of TCP flags.
    """
    ends = lambda ip, port: F.struct(F.col(ip).alias("ip"), F.col(port).alias("port"))
    known = packets.where("time IS NOT NULL AND src_ip IS NOT NULL AND dst_ip IS NOT NULL")
    one, two = ends("src_ip", "src_port"), ends("dst_ip", "dst_port")
    known = known.withColumns({"__low": F.least(one, two), "__high": F.greatest(one, two)})
    found = islands(known, ["protocol", "__low", "__high"], F.col("time"), F.col("time"), int(idle * _SECOND), [number])
    found = cut(found.drop("__low", "__high"))
    cuts = _cut_points(found, int(active * _SECOND))
    told = found.join(cuts, "island", "left")
    nth = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("time"))), F.lit(1))
    told = told.withColumn("flow", F.struct("island", nth.alias("nth"))).drop("cuts")

    first = F.min(F.struct("time", number, "src_ip", "src_port", "dst_ip", "dst_port", "protocol"))
    ended = told.groupBy("flow").agg(first.alias("f"))
    # the sender of a flow's first packet is known after one aggregate; the two directions are summed up by sender before
    by_end = told.groupBy("flow", "src_ip", "src_port").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.min("length").alias("least"), F.max("length").alias("most"),
        F.sum(F.col("length").cast("decimal(38,0)") * F.col("length")).alias("squares"), F.min("time").alias("t0"), F.max("time").alias("t1"),
        *[F.count_if(F.col("flags").bitwiseAND(1 << k) != 0).alias(name) for k, name in enumerate(FLAGS)],
    )
    met = by_end.join(ended, "flow")
    ahead = F.col("src_ip").eqNullSafe(F.col("f.src_ip")) & F.col("src_port").eqNullSafe(F.col("f.src_port"))
    part = lambda c, own: F.coalesce(F.sum(F.when(ahead if own else ~ahead, F.col(c))), F.lit(0)).cast("long")
    n, total = F.sum("packets"), F.sum("bytes")
    spread = F.sum("squares").cast("double") / n - F.pow(total / n, 2)
    out = met.groupBy("flow").agg(
        F.first("f").alias("f"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        n.cast("long").alias("bidirectional_packets"), total.cast("long").alias("bidirectional_bytes"),
        part("packets", True).alias("src2dst_packets"), part("bytes", True).alias("src2dst_bytes"),
        part("packets", False).alias("dst2src_packets"), part("bytes", False).alias("dst2src_bytes"),
        F.min("least").cast("long").alias("bidirectional_min_ps"), (total / n).alias("bidirectional_mean_ps"),
        F.sqrt(F.greatest(spread, F.lit(0.0)) * n / F.greatest(n - 1, F.lit(1))).alias("bidirectional_stddev_ps"), F.max("most").cast("long").alias("bidirectional_max_ps"),
        *[F.sum(name).cast("long").alias(f"bidirectional_{name}_packets") for name in FLAGS],
    )
    named = [F.col(f"f.{c}").alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")]
    ms = lambda c: F.expr(f"{c} div 1000")
    times = [ms("t0").alias("bidirectional_first_seen_ms"), ms("t1").alias("bidirectional_last_seen_ms"), ms("(t1 - t0)").alias("bidirectional_duration_ms")]
    return out.select(*named, *times, *[c for c in out.columns if "_" in c])


# TCP flags from the lowest bit on.
FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")
