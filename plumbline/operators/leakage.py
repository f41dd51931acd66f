"""Leaks from train into test: time, sessions, hosts. Shared keys come from one grouping, not from set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from plumbline.model import CheckSkipped, q
from plumbline.operators import ranks

# Names of splits, compared trimmed and in lower case.
TEST_NAMES = ("test", "testing", "prueba", "eval", "evaluation", "holdout")
TRAIN_NAMES = (
    "train", "training", "entrenamiento", "fit", "val", "valid", "validation", "validacion", "validación", "dev",
)
ISO = "ISO 8601"
# Time formats that are tried; the first reads ISO 8601 in its variants.
TIME_FORMATS = (
    ISO,
    "yyyy-MM-dd HH:mm:ss",
    "d/M/yyyy H:mm:ss",
    "M/d/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "M/d/yyyy H:mm",
    "d/M/yyyy",
    "M/d/yyyy",
)
#: A larger share of unreadable times than this, and nothing is concluded from time.
UNREADABLE = 0.001


def is_train(split: Column) -> Column:
    return F.lower(F.trim(split.cast("string"))).isin(*TRAIN_NAMES)


def is_test(split: Column) -> Column:
    return F.lower(F.trim(split.cast("string"))).isin(*TEST_NAMES)


def unclassified(df: DataFrame, split: str) -> list[str]:
    """Split values that are neither train nor test, as many as there are splits."""
    names = df.select(q(split).cast("string").alias("s")).where("s IS NOT NULL").distinct()
    return sorted(r.s for r in names.where(~is_train(F.col("s")) & ~is_test(F.col("s"))).collect())


def read_time(value: Column, time_format: str) -> Column:
    """The text as a timestamp, or null."""
    return value.try_cast("timestamp") if time_format == ISO else F.try_to_timestamp(value, F.lit(time_format))


def parse_counts(df: DataFrame, column: str, formats=TIME_FORMATS) -> DataFrame:
    """(format, n_parsed, n_values): how many values each format reads, in one pass."""
    value = q(column).cast("string")
    aggs = [F.count(read_time(value, f)).alias(f"f{i}") for i, f in enumerate(formats)]
    one = df.agg(F.count(value).alias("n_values"), *aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"f{i}").alias("n_parsed")) for i, f in enumerate(formats)])
    return one.select("n_values", F.explode(rows).alias("r")).select("r.format", "r.n_parsed", "n_values")


def orders_differ(df: DataFrame, column: str, one: str, two: str) -> bool:
    """Whether two formats, both of which read every value, put values in different orders."""
    value = q(column).cast("string")
    pairs = df.select(
        read_time(value, one).alias("a"), read_time(value, two).alias("b")
    ).distinct()
    by_a = pairs.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    dealt = ranks.ranged(by_a, [F.col("a")])
    within = Window.partitionBy("__range").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("before", F.max("high").over(within)).where("before > low")
    spans = dealt.groupBy("__range").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    reached = None
    for r in sorted(spans.collect()):  # a row for each range
        if reached is not None and reached > r.low:
            return True
        reached = r.high if reached is None else max(reached, r.high)
    return not inside.isEmpty()


def time_column(df: DataFrame, column: str, time_format: str | None = None) -> Column:
    """The column as something that orders in time, or CheckSkipped with the reason."""
    kind = df.schema[column].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType, NumericType)):
        return q(column)
    formats = (time_format,) if time_format else TIME_FORMATS
    rows = parse_counts(df, column, formats).collect()
    best = max(rows, key=lambda r: r.n_parsed)
    if not best.n_values or best.n_parsed < best.n_values * (1 - UNREADABLE):
        raise CheckSkipped(f"{column}: {best.n_values - best.n_parsed} of {best.n_values} times can't be read")
    full = [r.format for r in rows if r.n_parsed == best.n_parsed]
    for other in full[1:]:
        if orders_differ(df, column, full[0], other):
            raise CheckSkipped(f"{column} is ambiguous: {full[0]} and {other} both read it, in different orders")
    return read_time(q(column).cast("string"), full[0])


def temporal(df: DataFrame, time: Column, split: str) -> DataFrame:
    """(n_train, n_test, train_min, train_max, test_min, test_max, n_before, overlap, n_untimed).

    n_before counts test rows at or before the latest train row. Test times
    are first counted by value, so the table is read once.
    """
    role = F.when(is_train(q(split)), 0).when(is_test(q(split)), 1)
    counted = df.select(time.alias("t"), role.alias("role")).where("role IS NOT NULL").groupBy("t", "role")
    counted = counted.agg(F.count(F.lit(1)).alias("n"))
    one = counted.agg(
        F.coalesce(F.sum(F.when((F.col("role") == 0) & F.col("t").isNotNull(), F.col("n"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when((F.col("role") == 1) & F.col("t").isNotNull(), F.col("n"))), F.lit(0)).alias("n_test"),
        F.min(F.when(F.col("role") == 0, F.col("t"))).alias("train_min"),
        F.max(F.when(F.col("role") == 0, F.col("t"))).alias("train_max"),
        F.min(F.when(F.col("role") == 1, F.col("t"))).alias("test_min"),
        F.max(F.when(F.col("role") == 1, F.col("t"))).alias("test_max"),
        F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("n"))), F.lit(0)).alias("n_untimed"),
    )
    late = counted.where("role = 1").join(F.broadcast(one.select("train_max")), F.col("t") <= F.col("train_max"))
    before = late.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"))
    return one.join(before).withColumn("overlap", F.try_divide("n_before", "n_test"))


def _shared(df: DataFrame, keys: list[Column], split: str) -> DataFrame:
    aggs = {"train": F.count_if(is_train(q(split))), "test": F.count_if(is_test(q(split)))}
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])


def sessions(df: DataFrame, columns: list[str], split: str) -> DataFrame:
    """(n_shared, n_test_rows, n_affected, ratio): sessions (null is a value) with rows in train and in test."""
    both = (F.col("train") > 0) & (F.col("test") > 0)
    out = _shared(df, [q(c) for c in columns], split).agg(
        F.count_if(both).alias("n_shared"),
        F.coalesce(F.sum("test"), F.lit(0)).alias("n_test_rows"),
        F.coalesce(F.sum(F.when(both, F.col("test"))), F.lit(0)).alias("n_affected"),
    )
    return out.withColumn("ratio", F.try_divide("n_affected", "n_test_rows"))


def hosts(df: DataFrame, column: str, split: str) -> DataFrame:
    """(n_shared, n_test_hosts, n_affected, n_test_rows, test_rows_ratio, shared_host_ratio); null hosts don't count."""
    both = (F.col("train") > 0) & (F.col("test") > 0)
    known = df.where(q(column).isNotNull() & q(split).isNotNull())
    out = _shared(known, [q(column)], split).agg(
        F.count_if(both).alias("n_shared"),
        F.count_if(F.col("test") > 0).alias("n_test_hosts"),
        F.coalesce(F.sum(F.when(both, F.col("test"))), F.lit(0)).alias("n_affected"),
        F.coalesce(F.sum("test"), F.lit(0)).alias("n_test_rows"),
    )
    return out.withColumn("test_rows_ratio", F.try_divide("n_affected", "n_test_rows")).withColumn(
        "shared_host_ratio", F.try_divide("n_shared", "n_test_hosts")
    )


def runs(df: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """(n, n_values, n_runs, expected, z): runs of equal values along ``order`` (without ties), and how far chance is from that.

    Wald and Wolfowitz's test for any number of values: z is near 0 where
    values come in a random order, far below where they come in blocks. Rows
    without a value are left out. Rows are dealt into ranges of the order, so
    no task has them all.
    """
    known = df.withColumn("__value", value).where("__value IS NOT NULL")
    told = ranks.with_previous(known, order, {"__last": F.col("__value")})
    changes = told.agg(F.count_if(F.col("__last").isNull() | (F.col("__last") != F.col("__value"))).alias("n_runs"))
    sizes = known.groupBy("__value").agg(F.count(F.lit(1)).alias("m"))
    of = lambda power: F.coalesce(F.sum(F.pow(F.col("m").cast("double"), power)), F.lit(0.0))
    sums = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_values"), of(2.0).alias("s2"), of(3.0).alias("s3"))
    n = F.col("n").cast("double")
    expected = F.try_divide(n * (n + 1) - F.col("s2"), n)
    spread = F.try_divide(F.col("s2") * (F.col("s2") + n * (n + 1)) - 2 * n * F.col("s3") - F.pow(n, 3.0), n * n * (n - 1))
    one = sums.join(changes)  # one row each
    z = F.try_divide(F.col("n_runs") - expected, F.sqrt(F.when(spread > 0, spread)))
    return one.select("n", "n_values", "n_runs", expected.alias("expected"), z.alias("z"))


#: Deviations within which a split looks drawn by lot, and below which labels hang together in time.
BY_LOT, TOGETHER = 3.0, -3.0


def random_split(df: DataFrame, time: Column, split: str, label: str, row_id: str) -> DataFrame:
    """(n, split_runs, split_z, label_runs, label_z, by_lot): whether a split was drawn by lot though labels hang together in time."""
    told = df.withColumn("__t", time).where("__t IS NOT NULL")
    side = F.when(is_train(q(split)), 0).when(is_test(q(split)), 1)
    told = told.where(side.isNotNull())
    order = [F.col("__t"), q(row_id)]
    one = runs(told, order, side).select("n", F.col("n_values"), F.col("n_runs").alias("split_runs"), F.col("z").alias("split_z"))
    two = runs(told, order, q(label).cast("string")).select(F.col("n_runs").alias("label_runs"), F.col("z").alias("label_z"))
    by_lot = (F.abs("split_z") <= BY_LOT) & (F.col("label_z") <= TOGETHER) & (F.col("n_values") == 2)
    return one.join(two).withColumn("by_lot", F.coalesce(by_lot, F.lit(False))).drop("n_values")  # one row each
