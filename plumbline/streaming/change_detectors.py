"""Change detectors on streams of numbers by key: adaptive windows and Page-Hinkley, with alerts that stay open until it is calm.

Adaptive windows (Bifet & Gavaldà, 2007) keep an exponential histogram: buckets
of counts, means and spreads, whose sizes double, so a key's state grows with
the logarithm of its values. Where the means of an older and a newer part
differ by more than chance allows, the older part is dropped: a change. Page
and Hinkley's test adds up how far values lie above their running mean, and
tells a rise of the sum above its least value.

A change opens an alert, or keeps an open one open; once no change came for
``calm`` seconds the alert closes. On a stream the close is a timer on the
watermark; state and timers live in the checkpoint, so a restart changes
nothing. A key's values are followed in the order of time (and ``tie``) inside
a micro-batch; rows later than the watermark are left out, as everywhere. The
same code follows a table's sorted rows with one state at a time.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import q
from plumbline.operators.groups import bound_batches

#: Chance of a false change at a look, buckets of one size, values between two looks, and fewest values in a part.
DELTA, PER_SIZE, CLOCK, LEAST = 0.002, 5, 32, 16
#: Page-Hinkley: tolerated rise, limit of the sum, both in the unit of values, and fewest values.
RISE, LIMIT, WARM_UP = 0.25, 50.0, 30


class AdaptiveWindow:
    """Buckets (n, mean, sum of squared deviations), newest first within each size; ``state`` is what is kept."""

    def __init__(self, state: list | None = None, delta: float = DELTA):
        self.sizes, self.seen = (state[0], state[1]) if state else ([[]], 0)
        self.delta = delta

    @property
    def state(self) -> list:
        return [self.sizes, self.seen]

    @staticmethod
    def joined(a: list[float], b: list[float]) -> list[float]:
        n = a[0] + b[0]
        return [n, (a[0] * a[1] + b[0] * b[1]) / n, a[2] + b[2] + a[0] * b[0] / n * (a[1] - b[1]) ** 2]

    def add(self, x: float) -> tuple[float, float, int] | None:
        """(mean before, mean after, values kept) if this value shows a change."""
        self.seen += 1
        self.sizes[0].insert(0, [1, x, 0.0])
        for k in range(len(self.sizes)):
            if len(self.sizes[k]) <= PER_SIZE:
                break
            if k + 1 == len(self.sizes):
                self.sizes.append([])
            two, one = self.sizes[k].pop(), self.sizes[k].pop()
            self.sizes[k + 1].insert(0, self.joined(one, two))
        return self._looked() if self.seen % CLOCK == 0 else None

    def _looked(self) -> tuple[float, float, int] | None:
        found = None
        while (cut := self._cut()) is not None:
            found = (found[0] if found else cut[0], cut[1])
            for row in reversed(self.sizes):
                if row:
                    row.pop()  # the oldest bucket
                    break
        if found is None:
            return None
        kept = [b for row in self.sizes for b in row]
        return found[0], found[1], int(sum(b[0] for b in kept))

    def _cut(self) -> tuple[float, float] | None:
        """(older mean, newer mean) of the first split that chance doesn't explain."""
        buckets = [b for row in reversed(self.sizes) for b in reversed(row)]  # oldest first
        if len(buckets) < 2:
            return None
        whole = buckets[0]
        for b in buckets[1:]:
            whole = self.joined(whole, b)
        n, spread = whole[0], whole[2] / whole[0]
        log = math.log(2 * math.log(max(n, 3)) / self.delta)
        old_n, old_sum, total = 0, 0.0, whole[0] * whole[1]
        for b in buckets[:-1]:
            old_n, old_sum = old_n + b[0], old_sum + b[0] * b[1]
            new_n = n - old_n
            if old_n < LEAST or new_n < LEAST:
                continue
            m = 1 / (1 / old_n + 1 / new_n)
            limit = math.sqrt(2 / m * spread * log) + 2 / (3 * m) * log
            if abs(old_sum / old_n - (total - old_sum) / new_n) > limit:
                return old_sum / old_n, (total - old_sum) / new_n
        return None


class PageHinkley:
    """Running mean, the sum of rises above it, and the least sum."""

    def __init__(self, state: list | None = None, limit: float = LIMIT):
        self.n, self.mean, self.total, self.least = state or [0, 0.0, 0.0, 0.0]
        self.limit = limit

    @property
    def state(self) -> list:
        return [self.n, self.mean, self.total, self.least]

    def add(self, x: float) -> tuple[float, float, int] | None:
        self.n += 1
        before = self.mean
        self.mean += (x - self.mean) / self.n
        self.total += x - self.mean - RISE
        self.least = min(self.least, self.total)
        if self.n < WARM_UP or self.total - self.least <= self.limit:
            return None
        found = (before, x, self.n)
        self.n, self.mean, self.total, self.least = 0, 0.0, 0.0, 0.0
        return found


DETECTORS = {"window": AdaptiveWindow, "page_hinkley": PageHinkley}
ALERTS = "key string, time double, event string, before double, after double, n long"


class Follower:
    """A detector and its alert; ``opened`` is when the last change of an open alert came."""

    def __init__(self, detector: str, calm: float, state: str | None = None):
        held, self.opened = json.loads(state) if state else (None, None)
        self.detector, self.calm = DETECTORS[detector](held), calm

    @property
    def state(self) -> str:
        return json.dumps([self.detector.state, self.opened])

    def closed(self, now: float) -> list[tuple]:
        """The close of an alert that has been calm long enough by ``now``."""
        if self.opened is None or now < self.opened + self.calm:
            return []
        at, self.opened = self.opened + self.calm, None
        return [(at, "closed", None, None, None)]

    def add(self, time: float, x: float) -> list[tuple]:
        out = self.closed(time)
        if x is None or math.isnan(x) or math.isinf(x):
            return out
        if (found := self.detector.add(x)) is not None:
            out.append((time, "changed" if self.opened is not None else "opened", *found))
            self.opened = time
        return out


def changes(df: DataFrame, key: str, time: str, value: str, tie: list[str], detector: str = "window", calm: float = 3600.0) -> DataFrame:
    """(key, time, event, before, after, n) of a table: each key's rows are followed in order, one state at a time.

    ``time`` is in seconds. What follows values in order can't be split within
    a key; a task streams its keys' rows, sorted by the shuffle, and holds one
    state of logarithmic size. Alerts still open at a key's end stay open. Null
    times are left out; null, nan and infinite values change nothing.
    """
    named = df.where(q(time).isNotNull()).select(q(key).cast("string").alias("key"), q(time).cast("double").alias("time"), q(value).cast("double").alias("x"), *[q(t).alias(f"__o{i}") for i, t in enumerate(tie)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, follower = (), None
        for batch in batches:
            out = []
            for own, at, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (own,) != last:
                    last, follower = (own,), Follower(detector, calm)
                out += [(own, *r) for r in follower.add(at, x)]
            if out:
                kinds = [pa.string(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "time", "event", "before", "after", "n"])

    bound_batches(df.sparkSession)
    order = ["key", "time", *[f"__o{i}" for i in range(len(tie))]]
    return named.repartition("key").sortWithinPartitions(*order).mapInArrow(run, ALERTS)


def watch(stream: DataFrame, key: str, time: str, value: str, late: str = "10 minutes", detector: str = "window", calm: float = 3600.0, tie: str | None = None) -> DataFrame:
    """(key, time, event, before, after, n) of a stream, as changes come; an alert closes by a timer on the watermark."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    named = stream.where(q(time).isNotNull()).select(q(key).cast("string").alias("key"), q(time).alias("time"), q(value).cast("double").alias("x"), (q(tie) if tie else F.lit(0)).cast("long").alias("tie"))

    def run(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        follower = Follower(detector, calm, state.get[0] if state.exists else None)
        out = []
        if state.hasTimedOut:
            out += follower.closed(float("inf"))
        else:
            rows = pd.concat(list(frames)).sort_values(["time", "tie"], kind="stable")
            seconds = rows["time"].astype("datetime64[us]").astype("int64") / 1e6
            for at, x in zip(seconds.tolist(), rows["x"].tolist(), strict=True):
                out += follower.add(at, x)
        state.update((follower.state,))
        if follower.opened is not None:
            state.setTimeoutTimestamp(max(int((follower.opened + calm) * 1000), state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame([(names[0], *r) for r in out], columns=["key", "time", "event", "before", "after", "n"])
        yield frame.astype({"before": "float64", "after": "float64", "n": "Int64"})

    watched = named.withWatermark("time", late).groupBy("key")
    return watched.applyInPandasWithState(run, ALERTS, "state string", "append", GroupStateTimeout.EventTimeTimeout)
