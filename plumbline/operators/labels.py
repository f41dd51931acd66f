"""Label conflicts, spellings, imbalance; every plan is one grouping or two."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import normal_form
from plumbline.model import q
from plumbline.operators.census import differs


def conflict_groups(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys..., n_rows, labels): equal rows that carry two or more labels."""
    counted = df.where(q(label).isNotNull()).groupBy(*[q(k) for k in keys], q(label).cast("string").alias("__label"))
    counted = counted.agg(F.count(F.lit(1)).alias("n"))
    groups = counted.groupBy(*[q(k) for k in keys]).agg(
        F.sum("n").alias("n_rows"), F.array_sort(F.collect_set("__label")).alias("labels")
    )
    return groups.where(F.size("labels") > 1)


def conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(n_total, n_groups, n_affected, ratio); the ratio is of all rows, with or without a label.

    Labels clash where the least hash of a group's labels isn't the greatest,
    by either of two seeds (128 bits in all), so one grouping of the rows, with
    numbers that are added up in place, says all.
    """
    own = q(label).cast("string")
    groups = df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows"), F.count(own).alias("n_known"), differs(own).alias("clash"))
    found = groups.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_total"),
        F.count_if("clash").alias("n_groups"),
        F.coalesce(F.sum(F.when(F.col("clash"), F.col("n_known"))), F.lit(0)).alias("n_affected"),
    )
    return found.withColumn("ratio", F.try_divide("n_affected", "n_total"))


def conflict_pairs(df: DataFrame, keys: list[str], label: str, pairs: int = 10) -> DataFrame:
    """(pair, n_groups, n_rows): which labels clash most, over all groups; a top-k report."""
    all_ = conflict_groups(df, keys, label).select(F.array_join("labels", " / ").alias("pair"), "n_rows")
    out = all_.groupBy("pair").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"))
    return out.orderBy(F.desc("n_rows"), "pair").limit(pairs)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n) of the labels that aren't null."""
    return df.where(q(label).isNotNull()).groupBy(q(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def taxonomy(df: DataFrame, label: str) -> DataFrame:
    """(normal_form, n_spellings, spellings, n_rows) of labels spelt in several ways."""
    return taxonomy_of(label_counts(df, label))


def taxonomy_of(counted: DataFrame) -> DataFrame:
    """``taxonomy`` from ``label_counts``."""
    out = counted.groupBy(normal_form(F.col("label")).alias("normal_form")).agg(
        F.count(F.lit(1)).alias("n_spellings"),
        F.array_join(F.array_sort(F.collect_list("label")), "|").alias("spellings"),
        F.sum("n").alias("n_rows"),
    )
    return out.where("n_spellings > 1")


def normalize(df: DataFrame, label: str) -> DataFrame:
    """The table with each label in the most frequent spelling of its normal form; ties go to the least label."""
    counted = df.where(q(label).isNotNull()).groupBy(q(label).cast("string").alias("__from")).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("__form").orderBy(F.desc("n"), "__from")
    names = counted.withColumn("__form", normal_form(F.col("__from"))).withColumn("__to", F.first("__from").over(best))
    names = names.where(F.col("__from") != F.col("__to")).select("__from", "__to")
    out = df.join(names, q(label).cast("string") == F.col("__from"), "left")
    return out.withColumn(label, F.coalesce("__to", q(label).cast("string"))).select(*[q(c) for c in df.columns])


def imbalance(df: DataFrame, label: str, least: int = 100) -> DataFrame:
    """(label, n_rows, threshold, ratio) of classes below min(least, a tenth of all rows); ratio: largest to smallest class."""
    return imbalance_of(label_counts(df, label), least)


def imbalance_of(counted: DataFrame, least: int = 100) -> DataFrame:
    """``imbalance`` from ``label_counts``."""
    counted = counted.withColumnRenamed("n", "n_rows")
    every = counted.agg(  # one row
        F.least(F.lit(least), F.floor(F.sum("n_rows") * 0.1)).cast("long").alias("threshold"),
        (F.max("n_rows") / F.min("n_rows")).alias("ratio"), F.count(F.lit(1)).alias("classes"),
    )
    out = counted.join(F.broadcast(every))
    small = (F.col("n_rows") < F.col("threshold")) & (F.col("threshold") >= 2) & (F.col("classes") > 1)
    return out.where(small).select("label", "n_rows", "threshold", "ratio")
