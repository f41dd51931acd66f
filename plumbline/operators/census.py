"""One census of a table's distinct rows, from which copies, clashing labels and shared splits are all told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import q

#: Labels that one identity may bring together in an array, some 50 bytes each.
MOST_LABELS = 10_000


def differs(value: Column) -> Column:
    """An aggregate: whether a group holds two values that aren't null, by the least and greatest of two 64-bit hashes.

    Numbers are added up in place, which text isn't.
    """
    hashes = [F.when(value.isNotNull(), F.xxhash64(F.lit(seed), value)) for seed in (1, 2)]
    return F.coalesce((F.min(hashes[0]) < F.max(hashes[0])) | (F.min(hashes[1]) < F.max(hashes[1])), F.lit(False))


def row_census(df: DataFrame, keys: list[str], label: str | None, split: str | None) -> DataFrame:
    """(labels), a row for each distinct row by ``keys``: array of (label, n, assigned, crossed).

    ``n`` rows have that label (null is one), ``assigned`` of them a split, and
    ``crossed`` says whether these are in several splits. Keys are left out:
    what is told of distinct rows needs no more, so a census is thin, and all
    that follows is narrow or groups by label. Rows are counted before a
    shuffle, so a row that is repeated without end is one for each task. The
    labels must be few (MOST_LABELS, for the caller to check).
    """
    side = q(split).cast("string") if split else F.lit(None).cast("string")
    told = [F.count(F.lit(1)).alias("__n"), F.count(side).alias("__assigned"), differs(side).alias("__crossed")]
    own = q(label).cast("string") if label else F.lit(None).cast("string")
    counted = df.groupBy(*[q(k) for k in [*keys, *([label] if label else [])]]).agg(*told)
    one = F.struct(own.alias("label"), F.col("__n").alias("n"), F.col("__assigned").alias("assigned"), F.col("__crossed").alias("crossed"))
    if label is None:
        return counted.select(F.array(one).alias("labels"))
    return counted.groupBy(*[q(k) for k in keys]).agg(F.collect_list(one).alias("labels")).select("labels")


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x.n)


def _by_label(census: DataFrame) -> DataFrame:
    return census.select(F.explode("labels").alias("l")).select("l.*")


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _known() -> Column:
    return F.filter("labels", lambda x: x.label.isNotNull())


def exact(census: DataFrame) -> DataFrame:
    """``duplicates.exact`` over the keys and the label."""
    one = census.agg(_sum(_total(F.col("labels"))).alias("n_rows"), _sum(F.size("labels").cast("long")).alias("n_unique"))
    dupes = F.col("n_rows") - F.col("n_unique")
    return one.select("n_rows", "n_unique", dupes.alias("n_dupes"), F.try_divide(dupes, F.col("n_rows")).alias("ratio"))


def class_ratio(census: DataFrame, least_ratio: float = 0.5, least_rows: int = 10) -> DataFrame:
    """``duplicates.class_ratio``."""
    out = _by_label(census).groupBy("label").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"))
    out = out.withColumn("dup_ratio", (F.col("n_rows") - F.col("n_unique")) / F.col("n_rows"))
    return out.where((F.col("dup_ratio") >= least_ratio) & (F.col("n_rows") >= least_rows))


def cross_split(census: DataFrame) -> DataFrame:
    """``duplicates.cross_split`` over the keys and the label."""
    out = _by_label(census).agg(
        _sum(F.col("assigned")).alias("n_assigned"),
        F.count_if("crossed").alias("n_groups"),
        _sum(F.when(F.col("crossed"), F.col("assigned"))).alias("n_affected"),
        _sum(F.col("n") - F.col("assigned")).alias("n_unassigned"),
    )
    return out.withColumn("ratio", F.try_divide("n_affected", "n_assigned"))


def conflicts(census: DataFrame) -> DataFrame:
    """``labels.conflicts``."""
    clash = F.size(_known()) > 1
    out = census.agg(
        _sum(_total(F.col("labels"))).alias("n_total"), F.count_if(clash).alias("n_groups"), _sum(F.when(clash, _total(_known()))).alias("n_affected")
    )
    return out.withColumn("ratio", F.try_divide("n_affected", "n_total"))


def conflict_pairs(census: DataFrame, pairs: int = 10) -> DataFrame:
    """``labels.conflict_pairs``; a top-k report."""
    names = F.array_join(F.array_sort(F.transform(_known(), lambda x: x.label)), " / ")
    clashing = census.where(F.size(_known()) > 1).select(names.alias("pair"), _total(_known()).alias("n_rows"))
    out = clashing.groupBy("pair").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"))
    return out.orderBy(F.desc("n_rows"), "pair").limit(pairs)


def label_counts(census: DataFrame) -> DataFrame:
    """``labels.label_counts``."""
    return _by_label(census).where("label IS NOT NULL").groupBy("label").agg(F.sum("n").alias("n"))
