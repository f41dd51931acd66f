"""What the model-based checks share: hash samples, feature vectors, out-of-fold probabilities, confident learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import finite
from plumbline.model import CheckSkipped, q
from plumbline.operators import ranks
from plumbline.session import cut

FOLDS = 3


def fold_of(row_id: str, folds: int, seed: int) -> Column:
    """A row's fold, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit(seed), q(row_id).cast("string")), F.lit(folds))


def fitted_rows(row_id: str, wanted: int, rows: int, seed: int) -> Column:
    """Whether a row is in the hash sample that models learn from: all rows, or about ``wanted`` of so many."""
    if rows <= wanted:
        return F.lit(True)
    steps = 1 << 30
    return F.pmod(F.xxhash64(F.lit(seed + 1), q(row_id).cast("string")), F.lit(steps)) < int(steps * wanted / rows)


def hash_sample(df: DataFrame, row_id: str, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows by a hash of their ids (all, of fewer): the same at any partitioning."""
    return df.where(fitted_rows(row_id, rows, df.count(), seed))


def clean(column: str):
    """A number for models: null, nan and infinities are 0."""
    return F.coalesce(finite(q(column)), F.lit(0.0))


def assembled(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., features): the cleaned columns as one vector."""
    from pyspark.ml.feature import VectorAssembler

    inputs = [f"__x{i}" for i in range(len(columns))]
    numbers = df.select(*[q(k) for k in keep], *[clean(c).alias(i) for i, c in zip(inputs, columns, strict=True)])
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(numbers).select(*keep, "features")


def out_of_fold(
    df: DataFrame, columns: list[str], label: str, row_id: str, seed: int = 42, cap: int = 200_000
) -> tuple[DataFrame, list[str]]:
    """((row_id, given, y, probs), classes): each row's class probabilities by a model that hasn't seen its fold.

    Standardised features, multinomial logistic regression; a row's fold is a
    hash of its id. Models learn from a bounded hash sample of about ``cap``
    rows; every row is scored.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer
    from pyspark.ml.functions import vector_to_array

    rows = df.select(q(row_id).alias("row_id"), q(label).cast("string").alias("given"), *[q(c) for c in columns])
    rows = rows.withColumn("fold", fold_of("row_id", FOLDS, seed)).withColumn("fit", fitted_rows("row_id", cap, df.count(), seed))
    data = assembled(rows, columns, ["row_id", "given", "fold", "fit"])
    index = StringIndexer(inputCol="given", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    classes = list(index.labels)
    data = cut(index.transform(data))
    model = Pipeline(
        stages=[
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
            LogisticRegression(featuresCol="scaled", labelCol="y", maxIter=300, family="multinomial", probabilityCol="p"),
        ]
    )
    out = None
    for k in range(FOLDS):
        fitted = model.fit(data.where(F.col("fit") & (F.col("fold") != k)))
        part = fitted.transform(data.where(F.col("fold") == k)).select("row_id", "given", "y", vector_to_array("p").alias("probs"))
        out = part if out is None else out.unionByName(part)
    return cut(out), classes


def skill(scored: DataFrame) -> tuple[float, float]:
    """(accuracy, skill over always guessing the commonest class)."""
    best = F.array_position("probs", F.array_max("probs")) - 1
    row = scored.agg(F.avg((best == F.col("y")).cast("double")).alias("acc")).first()
    most = scored.groupBy("y").count().agg((F.max("count") / F.sum("count")).alias("base")).first()
    accuracy, base = row.acc or 0.0, most.base or 0.0
    return accuracy, (accuracy - base) / (1 - base) if base < 1 else 0.0


def confident_issues(scored: DataFrame, classes: list[str]) -> DataFrame:
    """(row_id, given, suggested, self_confidence): rows whose label is probably wrong (Northcutt et al., 2021).

    The joint of given and confident classes is counted over all rows and
    calibrated to class sizes; of each off-diagonal cell as many rows are
    flagged as it holds, those of the largest margin first.
    """
    k = len(classes)
    p = lambda j: F.element_at("probs", j + 1)
    limits = scored.groupBy("y").agg(F.avg(F.element_at("probs", (F.col("y") + 1).cast("int"))).alias("t")).collect()
    threshold = {int(r.y): r.t for r in limits}
    over = F.array(*[F.when(p(j) >= threshold.get(j, 2.0), p(j)).otherwise(-1.0) for j in range(k)])
    confident = F.when(F.array_max(over) >= 0, F.array_position(over, F.array_max(over)) - 1)
    rows = scored.withColumn("confident", confident.cast("int"))
    counted = rows.where("confident IS NOT NULL").groupBy("y", "confident").count().collect()  # classes squared
    sizes = {int(r.y): r["count"] for r in scored.groupBy("y").count().collect()}
    joint = {(int(r.y), r.confident): r["count"] for r in counted}
    wanted = []
    for i in range(k):
        total = sum(joint.get((i, j), 0) for j in range(k))
        wanted += [
            (i, j, round(joint[i, j] * sizes[i] / total)) for j in range(k) if i != j and total and joint.get((i, j), 0)
        ]
    if not wanted:
        return scored.select("row_id", "given", F.lit("").alias("suggested"), F.lit(0.0).alias("self_confidence")).limit(0)
    best = F.array_position("probs", F.array_max("probs")) - 1
    own = F.element_at("probs", (F.col("y") + 1).cast("int"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(n).alias("n"), (p(j) - p(i)).alias("margin")) for i, j, n in wanted])
    # what is ordered is thin, as each row stands in it once for each other class; rows that aren't flagged in the end still hold a place
    long = scored.select("row_id", "y", best.cast("int").alias("best"), own.alias("self_confidence"), F.explode(F.filter(cells, lambda c: c.i == F.col("y"))).alias("c"))
    long = long.select("row_id", "y", "best", "self_confidence", (F.col("c.i") * k + F.col("c.j")).alias("cell"), F.col("c.margin").alias("margin"))
    first = ranks.first_rows(long, [F.desc("margin"), F.col("row_id")], {i * k + j: n for i, j, n in wanted}, F.col("cell"))
    names = F.array(*map(F.lit, classes))
    name = lambda c: F.element_at(names, (F.col(c) + 1).cast("int"))
    flagged = first.where("best <> y").select("row_id", name("y").alias("given"), name("best").alias("suggested"), "self_confidence")
    return flagged.distinct()


def noise_scores(df: DataFrame, columns: list[str], label: str, row_id: str, seed: int = 42, cap: int = 200_000):
    """(scored, classes, accuracy) for label-noise detection, or CheckSkipped with the reason."""
    if len(columns) < 2:
        raise CheckSkipped("fewer than two numeric columns that aren't identifiers")
    known = df.where(q(label).isNotNull())
    large = [r[0] for r in known.groupBy(q(label).cast("string")).count().where("count >= 20").collect()]
    if len(large) < 2:
        raise CheckSkipped("fewer than two classes with 20 rows")
    scored, classes = out_of_fold(known.where(q(label).cast("string").isin(large)), columns, label, row_id, seed, cap)
    accuracy, gain = skill(scored)
    if gain < 0.25:
        raise CheckSkipped(f"a simple model tells the classes too badly (skill {gain:.2f})")
    return scored, classes, accuracy


def overestimate(accuracy: float) -> float:
    """How far label noise may be overestimated, by the accuracy of the model that judged it (fixed values)."""
    return next(v for least, v in ((0.97, 0.01), (0.90, 0.035), (0.80, 0.085), (0.0, 0.15)) if accuracy >= least)
