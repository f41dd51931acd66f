"""Signs of poisoned training data, their combination into a ranking, and injections to measure the detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import CheckSkipped, q
from plumbline.operators import density, ranks
from plumbline.operators.density import MAX_CLASSES, directions
from plumbline.operators.ml import clean, hash_sample
from plumbline.session import cut

# Fixed values of the trigger detector.
MIN_SUPPORT, MAX_CLASS_SHARE, MAX_GLOBAL_SHARE, SHARE_TOLERANCE = 20, 0.10, 0.02, 1.1
MIN_LIFT, MAX_VALUES, MAX_UNIQUE_RATIO = 10.0, 3, 0.5
# What a detector's score weighs in the ranking.
WEIGHTS = {"poison.loss": 0.7, "poison.knn": 1.0, "poison.cluster": 0.0, "poison.trigger": 1.2}


def loss(scored: DataFrame, share: float = 0.01) -> DataFrame:
    """(row_id, loss): the rows of largest log-loss of their own label, a hundredth of all, at least one."""
    own = F.element_at("probs", (F.col("y") + 1).cast("int"))
    lost = scored.select("row_id", (-F.log(F.greatest(own, F.lit(1e-12)))).alias("loss"))
    return ranks.first_rows(lost, [F.desc("loss"), F.col("row_id")], max(1, int(share * scored.count())))


def trigger_values(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, value, label, n, n_class, n_value, lift): values that are rare, yet belong to one class.

    All columns are counted in one shuffle of (column, value, label). A column
    with more than ``MAX_VALUES`` such values shows its distribution, no
    trigger, and is left out whole.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("v")) for c in columns])
    long = df.select(q(label).cast("string").alias("y"), F.explode(cells).alias("c"))
    counted = cut(long.groupBy("c.column", "c.v", "y").agg(F.count(F.lit(1)).alias("n")))
    classes = counted.where(F.col("column") == columns[0]).groupBy("y").agg(F.sum("n").alias("n_class"))
    every = counted.groupBy("column", "v").agg(F.sum("n").alias("n_value"))
    totals = every.groupBy("column").agg(F.sum("n_value").alias("n_total"), F.count(F.lit(1)).alias("n_unique"))
    met = counted.where("v IS NOT NULL AND y IS NOT NULL").join(every, ["column", "v"])
    met = met.join(F.broadcast(totals), "column").join(classes, "y")  # a row for each column and each class
    others = F.col("n_total") - F.col("n_class")
    lift = (F.col("n") / F.col("n_class")) / F.greatest((F.col("n_value") - F.col("n")) / others, 1.0 / others)
    found = met.withColumn("lift", F.when(others > 0, lift)).where(
        (F.col("n_unique") / F.col("n_total") <= MAX_UNIQUE_RATIO)
        & (F.col("n") >= MIN_SUPPORT)
        & (F.col("n") / F.col("n_class") <= MAX_CLASS_SHARE)
        & (F.col("n_value") / F.col("n_total") <= MAX_GLOBAL_SHARE * SHARE_TOLERANCE)
        & (F.col("lift") >= MIN_LIFT)
    )
    values = found.groupBy("column").agg(F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") <= MAX_VALUES)
    return found.join(values, "column", "left_semi").select(
        "column", F.col("v").alias("value"), F.col("y").alias("label"), "n", "n_class", "n_value", "lift"
    )


def trigger_rows(df: DataFrame, columns: list[str], label: str, row_id: str) -> DataFrame:
    """(row_id, score): rows that hold a trigger value under its class; the best score of each row."""
    found = trigger_values(df, columns, label).select(
        F.col("column").alias("__c"), F.col("value").alias("__v"), F.col("label").alias("__y"), F.least(F.lit(1.0), F.col("lift") / 100).alias("score")
    )
    cells = F.array(*[F.struct(F.lit(c).alias("c"), q(c).cast("double").alias("v")) for c in columns])
    long = df.select(q(row_id).alias("row_id"), q(label).cast("string").alias("y"), F.explode(cells).alias("c"))
    met = long.join(found, (F.col("c.c") == F.col("__c")) & (F.col("c.v") == F.col("__v")) & (F.col("y") == F.col("__y")))
    return met.groupBy("row_id").agg(F.max("score").alias("score"))


def matrix(df: DataFrame, columns: list[str], label: str, row_id: str) -> DataFrame:
    """(row_id, y, x): labelled rows with their cleaned, standardised columns as an array."""
    rows = df.where(q(label).isNotNull()).select(
        q(row_id).alias("row_id"), q(label).cast("string").alias("y"), *[clean(c).alias(f"x{i}") for i, c in enumerate(columns)]
    )
    stats = rows.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [
        F.when(F.col(f"s{i}") > 0, (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).otherwise(0.0) for i in range(len(columns))
    ]
    return rows.join(F.broadcast(stats)).select("row_id", "y", F.array(*scaled).alias("x"))  # one row of statistics


def knn(rows: DataFrame, k: int = 10, least: float = 0.8, cap: int = 50_000, seed: int = 42) -> DataFrame:
    """(row_id, score): rows of whose k nearest neighbours at least a share ``least`` has another label.

    It is a nearest-neighbour classifier: what it learns from is a bounded hash
    sample of about ``cap`` rows (all, of fewer), and every row of the table is
    judged by it. The sample goes to every task, so one narrow pass does.
    """
    rows = cut(rows)
    return density.neighbour_labels(rows, hash_sample(rows, "row_id", cap, seed), k).where(F.col("score") >= least)


def clusters(all_rows: DataFrame, min_samples: int = 10, least_rows: int = 40, probes: int = 1_000, seed: int = 42) -> DataFrame:
    """(row_id, y, cluster, score): rows in small, compact clusters inside a class, by exact DBSCAN over all rows.

    eps of a class is the tenth percentile of its rows' distances to their
    fifth neighbour among all rows of the class, estimated from at most
    ``probes`` rows of it. A row with ``min_samples`` rows within eps, itself
    included, is a core; cores within eps are one cluster; a row within eps of
    cores joins the cluster of the least of them. A cluster is named after its
    least core, whatever the table's size or partitioning. Experimental: its
    weight in the ranking is 0.
    """
    rows = cut(all_rows)
    sizes = cut(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n_class")).where(F.col("n_class") >= least_rows))
    eps = density.fifth_neighbours(rows, sizes, probes, seed)
    members = cut(density.dbscan(rows, eps, min_samples).where("cluster IS NOT NULL"))
    x = rows.drop("y").join(members, "row_id")
    spread = lambda df, keys: df.select(*keys, F.posexplode("x").alias("d", "v")).groupBy(*keys, "d").agg(
        F.var_pop("v").alias("var")).groupBy(*keys).agg(F.sqrt(F.sum("var")).alias("disp"))
    own = x.groupBy("y", "cluster").agg(F.count(F.lit(1)).alias("n")).join(sizes, "y").where((F.col("n") >= 10) & (F.col("n") <= 0.05 * F.col("n_class")))
    own = cut(own)  # only small clusters go on
    own = own.join(spread(x.join(own.select("cluster"), "cluster", "left_semi"), ["y", "cluster"]), ["y", "cluster"])
    own = own.join(spread(rows, ["y"]).withColumnRenamed("disp", "all"), "y")
    score = 1 - F.least(F.lit(1.0), F.coalesce(F.try_divide("disp", "all"), F.lit(1.0)))
    small = own.withColumn("score", score).where(F.col("score") >= 0.75)
    return members.join(small.select("cluster", "score"), "cluster").select("row_id", "y", "cluster", "score")


def combine_scores(flagged: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(row_id, score, n_detectors, detectors) from (row_id, check_id, score).

    Each detector's scores are stretched to 0..1 (flat ones count 1); a row
    has its best weighted score, half as much again for each further detector.
    Detectors of weight 0 don't count; unknown ones weigh 1. A detector's
    bounds come from a grouping, so none is gathered in one task.
    """
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("check_id") == name, w).otherwise(weight)
    used = flagged.withColumn("w", weight).where("w > 0")
    bounds = used.groupBy("check_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))  # a row for each detector
    scaled = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    used = used.join(F.broadcast(bounds), "check_id").withColumn("s", scaled * F.col("w"))
    out = used.groupBy("row_id").agg(
        F.max("s").alias("base"), F.array_join(F.array_sort(F.collect_set("check_id")), ",").alias("detectors"),
        F.countDistinct("check_id").alias("n_detectors"),
    )
    return out.select("row_id", (F.col("base") * (1 + 0.5 * (F.col("n_detectors") - 1))).alias("score"), "n_detectors", "detectors")


def rank_suspects(combined: DataFrame, top: int = 100, least: int = 1) -> DataFrame:
    """The ``top`` rows by score, then detectors, then row; a top-k report."""
    found = combined.where(F.col("n_detectors") >= least)
    return found.orderBy(F.desc("score"), F.desc("n_detectors"), "row_id").limit(top)


def _order(row_id: str, seed: int) -> Column:
    """A hash order that SQL engines share."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), q(row_id).cast("string")).cast("binary"))


def chosen(df: DataFrame, row_id: str, rows: int, seed: int = 42) -> DataFrame:
    """(row_id): the first ``rows`` rows in the hash order; a sampling operator."""
    return ranks.first_rows(df.select(q(row_id).alias("row_id"), _order(row_id, seed).alias("h")), [F.col("h"), F.col("row_id")], rows).select("row_id")


def _mark(df: DataFrame, row_id: str, hit: DataFrame) -> DataFrame:
    ids = hit.select(F.col("row_id").alias("__hit"))
    return df.join(ids, q(row_id) == F.col("__hit"), "left").withColumn("__poisoned", F.col("__hit").isNotNull()).drop("__hit")


def how_many(n: int, ratio: float) -> int:
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    return max(1, int(n * ratio))


def inject_label_flip(
    df: DataFrame, label: str, row_id: str, ratio: float, to_label: str | None = None, from_label: str | None = None, seed: int = 42
) -> DataFrame:
    """The table with a share of labels changed to another class, and ``__poisoned``."""
    own = q(label).cast("string")
    pool = df.where(q(label).isNotNull())
    if from_label is not None:
        pool = pool.where(own == from_label)
    if to_label is not None:
        pool = pool.where(own != to_label)
    out = _mark(df, row_id, chosen(pool, row_id, how_many(df.count(), ratio), seed))
    if to_label is not None:
        new = F.lit(to_label)
    else:
        classes = sorted(r[0] for r in df.where(q(label).isNotNull()).select(own).distinct().collect())
        others = F.array_remove(F.array(*map(F.lit, classes)), own)
        pick = F.conv(F.substring(_order(row_id, seed + 1), 1, 8), 16, 10).cast("long")
        new = F.element_at(others, (F.pmod(pick, F.size(others)) + 1).cast("int"))
    return out.withColumn(label, F.when(F.col("__poisoned"), new).otherwise(own))


def inject_backdoor(
    df: DataFrame, column: str, value: float, label: str, target: str, row_id: str, ratio: float, seed: int = 42
) -> DataFrame:
    """The table with a trigger value and the target label set on a share of rows, and ``__poisoned``."""
    out = _mark(df, row_id, chosen(df, row_id, how_many(df.count(), ratio), seed))
    kind = df.schema[column].dataType
    return out.withColumn(column, F.when(F.col("__poisoned"), F.lit(value).cast(kind)).otherwise(q(column))).withColumn(
        label, F.when(F.col("__poisoned"), F.lit(target)).otherwise(q(label).cast("string"))
    )


def inject_synthetic(
    df: DataFrame, numeric: list[str], label: str, target: str, row_id: str, rows: int, jitter: float = 0.05, seed: int = 42
) -> DataFrame:
    """The table and ``rows`` jittered copies of its rows under the target label, and ``__poisoned``.

    Copies have negative ids: -1 - the id of the row that they copy.
    """
    hit = chosen(df, row_id, rows, seed)
    copies = df.join(hit.select(F.col("row_id").alias("__hit")), q(row_id) == F.col("__hit"), "left_semi")
    step = lambda i: F.conv(F.substring(_order(row_id, seed + 1 + i), 1, 8), 16, 10).cast("double") / float(2**32 - 1)
    for i, c in enumerate(numeric):
        copies = copies.withColumn(c, q(c) * (1 + jitter * (2 * step(i) - 1)))
    copies = copies.withColumn(label, F.lit(target)).withColumn(row_id, -1 - q(row_id))
    kept = df.withColumn(label, q(label).cast("string"))
    for c in numeric:
        kept = kept.withColumn(c, q(c).cast("double"))
    return kept.withColumn("__poisoned", F.lit(False)).unionByName(copies.withColumn("__poisoned", F.lit(True)))


def evaluate(flagged: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_flagged, n_true, n_hit, precision, recall, f1) of flagged row_ids against the injected ones."""
    a = flagged.select("row_id").distinct().withColumn("f", F.lit(1))
    b = truth.select("row_id").distinct().withColumn("t", F.lit(1))
    out = a.join(b, "row_id", "full").agg(
        F.count("f").alias("n_flagged"), F.count("t").alias("n_true"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("n_hit")
    )
    p, r = F.coalesce(F.try_divide("n_hit", "n_flagged"), F.lit(0.0)), F.coalesce(F.try_divide("n_hit", "n_true"), F.lit(0.0))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def spectral(rows: DataFrame, share: float = 0.015, least_rows: int = 40) -> DataFrame:
    """(row_id, y, score): of each class the share of rows that lie furthest along its top direction (Tran et al., 2018).

    ``rows`` is (row_id, y, x) with x standardised. The score is the squared
    projection of a centred row on the direction; ties go to the lesser id. At
    least one row of a class is told, none of a class under ``least_rows``.
    """
    rows = cut(rows)
    found = directions(rows, least_rows)
    sizes = found.select("y", "n").limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES:
        raise CheckSkipped(f"more than {MAX_CLASSES} classes")
    met = rows.join(F.broadcast(found.withColumnRenamed("y", "__y")), F.col("y") == F.col("__y"))  # MAX_CLASSES rows at most
    away = F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "direction", lambda a, b: a * b)
    scored = met.select("row_id", "y", F.pow(F.aggregate(away, F.lit(0.0), lambda s, v: s + v), 2.0).alias("score"))
    wanted = {r.y: max(1, int(share * r.n)) for r in sizes}
    return ranks.first_rows(scored, [F.desc("score"), F.col("row_id")], wanted, F.col("y"))
