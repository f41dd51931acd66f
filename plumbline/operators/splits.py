"""Splits that don't leak: by time, and by whole groups."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import q
from plumbline.operators import ranks


def checked(ratio: float) -> float:
    """A share of rows or groups that train; ValueError outside of (0, 1)."""
    if not 0 < ratio < 1:
        raise ValueError(f"train_ratio is {ratio}; it must lie between 0 and 1")
    return ratio


def share_of(n: int, ratio: float) -> Fraction:
    """``ratio`` as it is written times ``n``, exactly: 0.7 of 90,000 is 63,000, as doubles it is less."""
    return Fraction(str(ratio)) * n


def cutoff(df: DataFrame, time: Column, ratio: float = 0.7):
    """The time at index round(ratio * (n - 1)) of the ordered non-null times (halves up); None without times."""
    counted = ranks.counted_values(df, {"t": time})
    found = ranks.values_at(counted, {"t": lambda n: [math.floor(share_of(n - 1, ratio) + Fraction(1, 2))]})
    return next(iter(found["t"].values()), None)


def temporal(df: DataFrame, time: Column, split: str, ratio: float = 0.7) -> DataFrame:
    """The table with ``split`` set: train up to the cutoff, test after it, null without a time."""
    at = cutoff(df, time, checked(ratio))
    if at is None:
        return df.withColumn(split, F.lit(None).cast("string"))
    return df.withColumn(split, F.when(time <= F.lit(at), "train").when(time > F.lit(at), "test"))


def group_text(columns: list[str]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(q(c).cast("string"), F.lit("\x00")) for c in columns])


def grouped(df: DataFrame, columns: list[str], split: str, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """The table with ``split`` set so that whole groups go to one side: the first share of groups in a hash order trains."""
    group = group_text(columns)
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("__g")).cast("binary"))
    groups = df.select(group.alias("__g")).distinct().withColumn("__h", order)
    train = max(1, math.floor(share_of(groups.count(), checked(ratio))))
    first = ranks.first_rows(groups, [F.col("__h"), F.col("__g")], train).select("__g")
    met = df.withColumn("__own", group).join(first, F.col("__own") == F.col("__g"), "left")
    return met.withColumn(split, F.when(F.col("__g").isNotNull(), "train").otherwise("test")).drop("__own", "__g")
