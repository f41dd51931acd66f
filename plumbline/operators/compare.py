"""A baseline model before and after fixes, and the metrics that it is compared by."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import Dataset, q
from plumbline.operators.leakage import is_test, is_train
from plumbline.session import cut


def confusion(scored: DataFrame, label: str, predicted: str, n: str | None = None) -> DataFrame:
    """(label, predicted, n): rows, or what they add up to in column ``n``."""
    return scored.groupBy(q(label).cast("string").alias("label"), q(predicted).cast("string").alias("predicted")).agg(
        (F.sum(q(n)) if n else F.count(F.lit(1))).alias("n")
    )


def class_metrics(counted: DataFrame) -> DataFrame:
    """(label, n, recall, precision, f1) from (label, predicted, n)."""
    long = counted.select(F.col("label").alias("c"), "n", F.lit(0).alias("p"), (F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    long = long.unionByName(counted.select(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("n"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))
    out = long.groupBy(F.col("c").alias("label")).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    out = out.withColumn("recall", F.coalesce(F.try_divide("hit", "n"), zero)).withColumn("precision", F.coalesce(F.try_divide("hit", "p"), zero))
    return out.select("label", "n", "recall", "precision", F.coalesce(F.try_divide(2 * F.col("hit"), F.col("n") + F.col("p")), zero).alias("f1"))


def summary(counted: DataFrame, benign: str) -> DataFrame:
    """(n, accuracy, f1_macro, fp_per_10k_benign) from (label, predicted, n)."""
    known = class_metrics(counted).where("n > 0").agg(F.avg("f1").alias("f1_macro"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    false = F.when((F.col("label") == benign) & (F.col("predicted") != benign), F.col("n")).otherwise(0)
    safe = F.when(F.col("label") == benign, F.col("n")).otherwise(0)
    one = counted.agg(F.sum("n").alias("n"), (F.sum(hit) / F.sum("n")).alias("accuracy"),
                      F.coalesce(F.try_divide(10_000 * F.sum(false), F.sum(safe)), F.lit(0.0)).alias("fp_per_10k_benign"))
    return one.join(known)  # two single rows


#: Shares that equal rows are drawn in for a tree, at most, and rows of a task that trees learn from.
SHARES, LEARNT_ROWS = 32, 200_000


def drawn(counted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows to grow a forest from, weighted by ``__w``, of (columns..., n): equal rows as ``SHARES`` near equal shares, or one by one if they are fewer.

    Each tree draws each share by itself, as it would each row; all rows count.
    Partitions depend on the rows alone, so the forest does.
    """
    shares = F.least(F.col("n"), F.lit(SHARES))
    size = counted.agg(F.sum(shares).alias("n")).first().n or 0
    dealt = counted.repartition(max(32, math.ceil(size / LEARNT_ROWS)), *map(F.col, columns)).sortWithinPartitions(*columns)
    weight = F.floor(F.col("n") / F.col("__of")) + (F.col("__k") < F.col("n") % F.col("__of")).cast("long")
    return dealt.withColumn("__of", shares).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__of") - 1))).withColumn("__w", weight.cast("double"))


def predictions(data: Dataset, seed: int = 42, row_id: str | None = None) -> DataFrame:
    """(label, predicted, n) of the test rows, by a random forest trained on the train rows; text columns are coded by order.

    Rows that are equal to a model are counted in one scan; trees learn from
    them and tell them once, with their number.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    from plumbline.operators.ml import clean

    label, split = data.roles.label, data.roles.split
    numeric = [c for c in data.numeric if c != row_id]
    text = [c for c in data.features if c not in data.numeric and dict(data.df.dtypes)[c] == "string" and c != row_id]
    rows = data.df.where(q(label).isNotNull()).select(
        q(label).cast("string").alias("__label"), is_train(q(split)).alias("__train"), is_test(q(split)).alias("__test"),
        *[clean(c).alias(f"n{i}") for i, c in enumerate(numeric)], *[q(c).alias(f"s{i}") for i, c in enumerate(text)])
    keys = rows.columns
    rows = cut(rows.where("__train OR __test").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    steps = [StringIndexer(inputCol=f"s{i}", outputCol=f"k{i}", handleInvalid="keep", stringOrderType="alphabetAsc") for i in range(len(text))]
    inputs = [f"n{i}" for i in range(len(numeric))] + [f"k{i}" for i in range(len(text))]
    index = StringIndexer(inputCol="__label", outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(featuresCol="features", labelCol="__y", weightCol="__w", numTrees=50, maxDepth=8, maxBins=256, seed=seed)
    pipe = Pipeline(stages=[*steps, index, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"), forest])
    model = pipe.fit(drawn(rows.where("__train"), keys))
    names = F.array(*map(F.lit, [*model.stages[len(steps)].labels, "unknown"]))
    scored = model.transform(rows.where("__test")).withColumn("__p", F.element_at(names, (F.col("prediction") + 1).cast("int")))
    return scored.select(F.col("__label").alias("label"), F.col("__p").alias("predicted"), "n")


def evaluate(data: Dataset, benign: str, seed: int = 42, row_id: str | None = None) -> DataFrame:
    """``summary`` of ``predictions``, and the recall of each class as a map."""
    counted = cut(confusion(predictions(data, seed, row_id), "label", "predicted", "n"))
    recall = class_metrics(counted).where("n > 0").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "recall")))).alias("recall"))
    return summary(counted, benign).join(recall)  # two single rows


def test_rows(data: Dataset) -> DataFrame:
    """(n, digest) of the test rows over all columns but the split: equal tables have equal sums of hashes."""
    own = data.df.where(is_test(q(data.roles.split)))
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[q(c) for c in sorted(own.columns)]).cast("decimal(38,0)")).alias("digest"))


def compare(data: Dataset, fixes: list[str], benign: str, seed: int = 42, row_id: str | None = None) -> DataFrame:
    """(stage, metrics..., test_changed) before and after a chain of fixes.

    Rows are quarantined on the train side only, so that a fix can't pick the
    rows that it is judged by. ``test_changed`` says whether the other fixes
    changed the test rows; then the two stages aren't judged by the same.
    """
    from plumbline.plans.fixes import apply_fix, apply_to_train

    before = evaluate(data, benign, seed, row_id).withColumn("stage", F.lit("before"))
    fixed = data
    for name in fixes:
        apply = apply_to_train if name == "quarantine_noise" else apply_fix
        fixed = apply(fixed, name, row_id=row_id).dataset
    changed = test_rows(data).first() != test_rows(fixed).first()
    out = before.unionByName(evaluate(fixed, benign, seed, row_id).withColumn("stage", F.lit("after")))
    return out.withColumn("test_changed", F.lit(changed))
