"""What a baseline forest decides by: Shapley values over its paths, one vectorised pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import CheckSkipped, q
from plumbline.operators import ml
from plumbline.session import cut, remove_folder, shared_folder

TREES = 20
#: A path of so many levels has at most so many columns, hence 2 ** DEPTH patterns of "goes this way" for a leaf.
DEPTH = 5
#: Rows that a task weighs at a time: times leaves times depth, some 13 MB.
CHUNK = 512


@dataclass(frozen=True)
class Paths:
    """Every leaf of a forest with the intervals of the columns on its path.

    ``column``, ``low``, ``high``: (leaves, depth), an interval is open below
    and closed above, column -1 fills up; ``weights``: (leaves, patterns,
    depth), what a column that is inside or not adds of the leaf's value;
    ``values``: (leaves, classes), shares of the forest's probabilities.
    """

    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weights: np.ndarray
    values: np.ndarray
    base: np.ndarray

    def explain(self, x: np.ndarray) -> np.ndarray:
        """(rows, columns, classes) of a block of rows; with ``base`` they add up to the probabilities."""
        inside = (x[:, self.column] > self.low) & (x[:, self.column] <= self.high)
        inside &= self.column >= 0
        pattern = inside @ (1 << np.arange(self.column.shape[1]))
        part = self.weights[np.arange(len(self.values)), pattern]
        out = np.zeros((*x.shape, self.values.shape[1]))
        for c in np.unique(self.column[self.column >= 0]):
            leaf, slot = np.nonzero(self.column == c)
            out[:, c] = part[:, leaf, slot] @ self.values[leaf]
        return out


def pattern_weights(shares: list[float]) -> np.ndarray:
    """(patterns, columns): Shapley weights of a path whose columns pass ``shares`` of the training rows.

    In a game of the path's columns, a coalition is worth the product of its
    own indicators and of the others' shares. The sum over coalitions goes by
    their sizes: coefficients of a product of linear terms.
    """
    d = len(shares)
    sizes = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
    out = np.zeros((1 << d, d))
    for pattern in range(1 << d):
        own = [pattern >> k & 1 for k in range(d)]
        for j in range(d):
            terms = np.ones(1)
            for k in range(d):
                if k != j:
                    terms = np.convolve(terms, [shares[k], own[k]])
            out[pattern, j] = (own[j] - shares[j]) * (terms @ sizes)
    return out


def paths_of(nodes: dict[int, dict[int, tuple]], depth: int) -> Paths:
    """Paths of trees: {tree: {node: (column, threshold, left, right, rows, class shares)}}, column None at a leaf.

    A column that a path asks several times is one column with the
    intersection of its intervals and the product of its shares.
    """
    found = []

    def descend(tree: dict[int, tuple], at: int, seen: dict[int, tuple[float, float, float]]) -> None:
        column, threshold, left, right, rows, values = tree[at]
        if column is None:
            found.append((seen, np.asarray(values, float) / len(nodes)))
            return
        low, high, share = seen.get(column, (-np.inf, np.inf, 1.0))
        for child, bounds in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            descend(tree, child, seen | {column: (*bounds, share * tree[child][4] / rows)})

    for tree in nodes.values():
        descend(tree, 0, {})
    shape = (len(found), depth)
    column, low, high = np.full(shape, -1), np.full(shape, -np.inf), np.full(shape, np.inf)
    weights = np.zeros((len(found), 1 << depth, depth))
    base = np.zeros(len(found[0][1]))
    for i, (seen, value) in enumerate(found):
        d = len(seen)
        column[i, :d] = list(seen)
        low[i, :d], high[i, :d] = [b[0] for b in seen.values()], [b[1] for b in seen.values()]
        shares = [b[2] for b in seen.values()]
        if d:
            weights[i, : 1 << d, :d] = pattern_weights(shares)
        base += value * np.prod(shares)
    return Paths(column, low, high, weights, np.array([v for _, v in found]), base)


def forest_nodes(model) -> dict[int, dict[int, tuple]]:
    """The nodes of a fitted forest, as ``paths_of`` takes them: at most TREES * 2 ** (DEPTH + 1) rows.

    They are those of the saved model, whose nodes are a table.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    folder = shared_folder(spark, "forest")
    model.write().save(folder)
    n = "nodeData."
    rows = spark.read.parquet(f"{folder}/data").select(
        "treeID", n + "id", n + "leftChild", n + "rightChild", n + "rawCount", n + "impurityStats",
        n + "split.featureIndex", F.try_element_at(n + "split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")).collect()
    remove_folder(spark, folder)
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        stats = np.array(r.impurityStats)
        inner = r.leftChild >= 0
        trees.setdefault(r.treeID, {})[r.id] = (r.featureIndex if inner else None, r.threshold, r.leftChild, r.rightChild, r.rawCount, stats / stats.sum())
    return trees


def baseline(df: DataFrame, columns: list[str], label: str, row_id: str, seed: int = 42, cap: int = 50_000):
    """(fitted forest, classes, skill): learnt from a hash sample of about ``cap`` rows but for one fold, judged by all of that fold.

    The skill is over always guessing the commonest class. A label that is
    null takes no part; cells that aren't finite are 0.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import vector_to_array

    rows = df.where(q(label).isNotNull()).select(q(row_id).alias("row_id"), q(label).cast("string").alias("given"), *[q(c) for c in columns])
    fold = ml.fold_of("row_id", ml.FOLDS, seed) == 0
    rows = rows.withColumn("held", fold).withColumn("fit", ~fold & ml.fitted_rows("row_id", cap, rows.count(), seed))
    data = ml.assembled(rows, columns, ["row_id", "given", "held", "fit"])
    index = StringIndexer(inputCol="given", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    if len(index.labels) < 2:
        raise CheckSkipped("fewer than two classes")
    forest = RandomForestClassifier(featuresCol="features", labelCol="y", probabilityCol="p", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="all", seed=seed)
    data = index.transform(data)
    model = forest.fit(cut(data.where("fit").select("features", "y")))  # a forest reads them level by level
    _, gain = ml.skill(model.transform(data.where("held")).select("y", vector_to_array("p").alias("probs")))
    return model, list(index.labels), gain


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            yield part, np.array(part["x"].tolist(), float)


def shapley(df: DataFrame, columns: list[str], row_id: str, paths: Paths, classes: list[str]) -> DataFrame:
    """(row_id, column, class, value): what each column adds to each class's probability in each row."""
    n = len(columns) * len(classes)

    def run(batches):
        for part, x in _blocks(batches):
            yield pd.DataFrame({"row_id": part["row_id"].to_numpy(), "v": list(paths.explain(x).reshape(len(x), n))})

    kind = df.schema[row_id].dataType.simpleString()
    cells = df.select(q(row_id).alias("row_id"), F.array(*[ml.clean(c) for c in columns]).alias("x"))
    found = cells.mapInPandas(run, f"row_id {kind}, v array<double>").select("row_id", F.posexplode("v").alias("at", "value"))
    name = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    k = len(classes)
    return found.select("row_id", name(columns, F.floor(F.col("at") / k)).alias("column"), name(classes, F.col("at") % k).alias("class"), "value")


def importance(df: DataFrame, columns: list[str], paths: Paths) -> DataFrame:
    """(column, importance, share): the mean over all rows of what a column adds or takes, summed over classes.

    A task sends one row for each column and batch, so what is shuffled
    doesn't grow with the rows' width or the classes.
    """

    def run(batches):
        for _, x in _blocks(batches):
            yield pd.DataFrame({"at": range(len(columns)), "total": np.abs(paths.explain(x)).sum(axis=(0, 2)), "n": len(x)})

    cells = df.select(F.array(*[ml.clean(c) for c in columns]).alias("x"))
    sums = cells.mapInPandas(run, "at int, total double, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    sums = cut(sums)  # a row for each column
    every = sums.agg(F.sum("total").alias("every"))  # one row
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("at") + 1)
    share = F.coalesce(F.try_divide("total", "every"), F.lit(0.0))
    return sums.join(F.broadcast(every)).select(name.alias("column"), (F.col("total") / F.col("n")).alias("importance"), share.alias("share"))
