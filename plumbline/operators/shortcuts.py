"""Columns that give the label away: one-column balanced accuracy, and identifiers by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import edges_below, finite
from plumbline.model import q
from plumbline.operators import ranks
from plumbline.session import cut

# Whole words, and parts of words, that an identifier's name has once all but letters and digits are spaces.
IDENTIFIER = re.compile(r"\b(?:ip|id|flow.?id|uid|ts|mac)\b|ipaddr|address|timestamp|datetime|source.?file")


def names_identifier(name: str) -> bool:
    """Whether a column's name tells that it identifies rows, hosts or times."""
    letters = "".join(c if c.isascii() and c.isalnum() else " " for c in name.lower())
    return IDENTIFIER.search(letters) is not None


def edges(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Inner quantile edges of each column, exact and without repeats."""
    found = ranks.quantiles(df, {c: finite(q(c)) for c in columns}, [k / bins for k in range(1, bins)])
    return {c: sorted(set(v)) for c, v in found.items()}


def binned(column: str, cuts: list[float]) -> Column:
    """The number of edges strictly below a value; null for null, nan and infinities."""
    v = finite(q(column))
    return F.when(v.isNotNull(), edges_below(v, cuts))


def value_counts(df: DataFrame, values: dict[str, Column], label: str) -> DataFrame:
    """(column, v, y, n): every column's values by label, in one shuffle; null is a value, and a null label a label."""
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(v.cast("string"), F.lit("\x00")).alias("v")) for c, v in values.items()]
    long = df.select(q(label).cast("string").alias("y"), F.explode(F.array(*cells)).alias("c"))
    return long.groupBy("c.column", "c.v", "y").agg(F.count(F.lit(1)).alias("n"))


def accuracy_of(counted: DataFrame) -> DataFrame:
    """(column, balanced_accuracy) from ``value_counts``: each value is read as its majority label.

    Rows without a label aren't counted. The largest label wins a majority's ties.
    """
    known = counted.where("y IS NOT NULL")
    majority = known.groupBy("column", "v").agg(F.max_by("y", F.struct("n", "y")).alias("y"), F.max("n").alias("hits"))
    hits = majority.groupBy("column", "y").agg(F.sum("hits").alias("hits"))
    totals = known.groupBy("column", "y").agg(F.sum("n").alias("n"))
    recall = totals.join(hits, ["column", "y"], "left").withColumn("recall", F.coalesce("hits", F.lit(0)) / F.col("n"))
    return recall.groupBy("column").agg(F.avg("recall").alias("balanced_accuracy"))


def balanced_accuracy(df: DataFrame, values: dict[str, Column], label: str) -> DataFrame:
    """(column, balanced_accuracy) of predicting the label by each value's majority label."""
    return accuracy_of(cut(value_counts(df.where(q(label).isNotNull()), values, label)))


def single_feature(df: DataFrame, features: list[str], numeric: list[str], label: str) -> DataFrame:
    """``balanced_accuracy`` of every feature that can be judged; near-unique numeric ones by quantile bins.

    One aggregate says of which columns nearly every value is another (a
    sketch, trusted where it is fifteen standard deviations beyond the limit):
    those aren't counted by value. Counts of (column, value, label) of the rest
    come from one shuffle and say exactly how many values a column has, and
    what each tells; only near-unique numbers are read again.
    """
    if not features:
        return df.sparkSession.createDataFrame([], "column string, balanced_accuracy double")
    kinds = [F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(features)]
    seen = df.agg(F.count(F.lit(1)).alias("n"), *kinds).first()
    sure = [c for i, c in enumerate(features) if seen[f"d{i}"] > 1.8 * max(2, 0.3 * seen.n)]
    rest = [c for c in features if c not in sure]
    counted = cut(value_counts(df, {c: q(c) for c in rest}, label)) if rest else df.sparkSession.createDataFrame([], "column string, v string, y string, n long")
    by_value = counted.groupBy("column", "v").agg(F.sum("n").alias("n"))
    sizes = {r["column"]: (r.values, r.n) for r in by_value.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n")).collect()}
    unique = [c for c, (values, n) in sizes.items() if values > max(2, 0.3 * n) or n / max(1, values) < 3]
    numbers = [c for c in features if c in numeric and (c in unique or c in sure)]
    out = accuracy_of(counted.where(~F.col("column").isin(unique)) if unique else counted)
    if numbers:
        bins = max(2, min(50, seen.n // 20))
        cuts = edges(df, numbers, bins)
        out = out.unionByName(balanced_accuracy(df, {c: binned(c, cuts[c]) for c in numbers}, label))
    return out
