"""Drift over a stream: histograms on the reference's bins by event-time window, and their PSI."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.drift import FLOOR, bin_of, quantile_edges


def window_counts(stream: DataFrame, time: str, column: str, cuts: list[float], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, bins): a count for each bin, as one mergeable row of state for each open window."""
    b = bin_of(column, cuts)
    counts = [F.count_if(b == k).alias(f"b{k}") for k in range(len(cuts) + 1)]
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window")).agg(*counts)
    return grouped.select("window", F.array(*[F.col(f"b{k}") for k in range(len(cuts) + 1)]).alias("bins"))


def reference_shares(reference: DataFrame, column: str, cuts: list[float]) -> list[float]:
    row = {r.b: r["count"] for r in reference.groupBy(bin_of(column, cuts).alias("b")).count().where("b IS NOT NULL").collect()}
    total = sum(row.values()) or 1
    return [max(row.get(k, 0) / total, FLOOR) for k in range(len(cuts) + 1)]


def monitor(stream: DataFrame, reference: DataFrame, time: str, column: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, n, psi) of a streaming or static table against a reference; late rows follow the watermark."""
    cuts = quantile_edges(reference, [column])[column]
    shares = F.array(*map(F.lit, reference_shares(reference, column, cuts)))
    counted = window_counts(stream, time, column, cuts, window, late)
    n = F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x)
    part = F.transform("bins", lambda x: F.greatest(x / F.col("n"), F.lit(FLOOR)))
    terms = F.zip_with("c", shares, lambda c, r: (c - r) * F.log(c / r))
    out = counted.withColumn("n", n).withColumn("c", part)
    return out.select("window", "n", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("psi"))
