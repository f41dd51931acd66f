"""Drift against a reference table: schema, quantile histograms, PSI, KS, Jensen-Shannon, and two model checks."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import edges_below
from plumbline.model import CheckSkipped, q
from plumbline.operators import ranks
from plumbline.operators.groups import added_up
from plumbline.operators.ml import clean
from plumbline.operators.shortcuts import names_identifier
from plumbline.session import cut

#: Proportions are floored at this before a logarithm.
FLOOR = 1e-6
#: Population stability: moderate and severe.
PSI_MODERATE, PSI_SEVERE = 0.2, 0.25
DECILES = tuple(k / 10 for k in range(1, 10))


def schema(reference: DataFrame, batch: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """(change, column, reference type, batch type) of columns missing, new or of another type."""
    old, new = dict(reference.dtypes), dict(batch.dtypes)
    out = [("missing", c, t, None) for c, t in old.items() if c not in new]
    out += [("new", c, None, t) for c, t in new.items() if c not in old]
    return out + [("retyped", c, t, new[c]) for c, t in old.items() if c in new and new[c] != t]


def both_sides(reference: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """(side, columns...): 0 for the reference, 1 for the batch."""
    pick = lambda df, side: df.select(F.lit(side).alias("side"), *[q(c) for c in columns])
    return pick(reference, 0).unionByName(pick(batch, 1))


def quantile_edges(reference: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """The reference's inner deciles, without repeats; nan counts as nothing here."""
    value = lambda c: F.when(~F.isnan(q(c).cast("double")), q(c).cast("double"))
    found = ranks.quantiles(reference, {c: value(c) for c in columns}, list(DECILES))
    return {c: sorted(set(v)) for c, v in found.items()}


def bin_of(column: str, cuts: list[float]) -> Column:
    """How many edges lie strictly below the value; nan is above none; null stays null."""
    v = q(column).cast("double")
    return F.when(v.isNotNull(), F.when(F.isnan(v), 0).otherwise(edges_below(v, cuts)))


def histograms(reference: DataFrame, batch: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(column, bin, n_reference, n_batch): both tables' counts over the reference's bins, in one shuffle."""
    columns = list(cuts)
    both = both_sides(reference, batch, columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), bin_of(c, cuts[c]).alias("bin")) for c in columns])
    long = both.select("side", F.explode(cells).alias("c")).where("c.bin IS NOT NULL")
    return long.groupBy("c.column", "c.bin").agg(
        F.count_if(F.col("side") == 0).alias("n_reference"), F.count_if(F.col("side") == 1).alias("n_batch")
    )


def psi(reference: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """(column, psi): sum of (c - r) ln(c / r) over the reference's decile bins; 0 where the reference has no value."""
    cuts = quantile_edges(reference, columns)
    empty = [c for c in columns if not cuts[c]]
    counted = histograms(reference, batch, {c: cuts[c] for c in columns})
    bins = reference.sparkSession.createDataFrame(
        [(c, b) for c in columns for b in range(len(cuts[c]) + 1)], "column string, bin int"
    )
    filled = bins.join(counted, ["column", "bin"], "left").na.fill(0, ["n_reference", "n_batch"])
    own = Window.partitionBy("column")
    share = lambda n: F.greatest(F.coalesce(F.try_divide(F.col(n), F.sum(n).over(own)), F.lit(0.0)), F.lit(FLOOR))
    parts = filled.select("column", share("n_reference").alias("r"), share("n_batch").alias("c"))
    out = parts.groupBy("column").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))
    return out.withColumn("psi", F.when(F.col("column").isin(empty), 0.0).otherwise(F.col("psi")) if empty else F.col("psi"))


def ks(reference: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """(column, ks): the largest gap between the two cumulative distributions; null and nan don't count.

    Values are counted first; sums run within ranges of values, as many as a
    shuffle has partitions, and shift by what lies in the ranges before.
    """
    v = q(column).cast("double")
    both = both_sides(reference, batch, [column]).select("side", v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    counted = both.groupBy("v").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    counted = cut(counted)
    totals = counted.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))  # one row
    run = ranks.running(counted, [F.col("v")], {"cr": F.col("r"), "cc": F.col("c")}).join(F.broadcast(totals))
    gap = F.abs(F.try_divide("cr", "nr") - F.try_divide("cc", "nc"))
    return run.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks")).select(F.lit(column).alias("column"), "ks")


def js(reference: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """(column, js, n_new, n_vanished): Jensen-Shannon divergence in bits of two categorical distributions; null doesn't count."""
    both = both_sides(reference, batch, [column]).where(q(column).isNotNull())
    counted = both.groupBy(q(column).cast("string").alias("v")).agg(
        F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c")
    )
    totals = counted.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    p, o = F.try_divide("r", "nr"), F.try_divide("c", "nc")
    shares = counted.join(F.broadcast(totals)).select("r", "c", p.alias("p"), o.alias("o"))
    m = (F.col("p") + F.col("o")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    out = shares.agg(
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum((part("p") + part("o")) / 2))), F.lit(0.0)).alias("js"),
        F.count_if((F.col("r") == 0) & (F.col("c") > 0)).alias("n_new"),
        F.count_if((F.col("c") == 0) & (F.col("r") > 0)).alias("n_vanished"),
    )
    return out.select(F.lit(column).alias("column"), "js", "n_new", "n_vanished")


def feature_drift(reference: DataFrame, batch: DataFrame, columns: list[str], threshold: float = PSI_MODERATE) -> DataFrame:
    """``psi`` of the columns at or over the threshold."""
    return psi(reference, batch, columns).where(F.col("psi") >= threshold)


def covariate_auc(
    reference: DataFrame, batch: DataFrame, columns: list[str], row_id: str, cap: int = 50_000, seed: int = 42, folds: int = 3
) -> tuple[float, dict[str, float]]:
    """(AUC, importance of each column) of telling batch rows from reference rows out of fold.

    Forests learn from a bounded hash sample of each side, about ``cap`` rows
    and as many of both; all rows of both sides are scored.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from plumbline.operators.ml import assembled, fitted_rows, fold_of

    sizes = reference.count(), batch.count()
    rows = min(cap, *sizes)
    pick = lambda df, side: df.select(
        fold_of(row_id, folds, seed).alias("__fold"), F.lit(float(side)).alias("__y"),
        fitted_rows(row_id, rows, sizes[side], seed).alias("__fit"), *[q(c) for c in columns])
    data = cut(assembled(pick(reference, 0).unionByName(pick(batch, 1)), columns, keep=["__fold", "__y", "__fit"]))
    forest = RandomForestClassifier(featuresCol="features", labelCol="__y", numTrees=50, maxDepth=8, seed=seed)
    evaluate = BinaryClassificationEvaluator(labelCol="__y", metricName="areaUnderROC")
    scores, weights = [], [0.0] * len(columns)
    for fold in range(folds):
        model = forest.fit(data.where(F.col("__fit") & (F.col("__fold") != fold)))
        scores.append(evaluate.evaluate(model.transform(data.where(F.col("__fold") == fold))))
        weights = [w + v / folds for w, v in zip(weights, model.featureImportances.toArray(), strict=True)]
    return sum(scores) / folds, dict(zip(columns, weights, strict=True))


#: Partitions of the rows that forests learn from, whatever the session's.
FIT_PARTS = 16


def concept_scores(
    reference: DataFrame, batch: DataFrame, columns: list[str], label: str, row_id: str, cap: int = 50_000, seed: int = 42
) -> DataFrame:
    """(side, label, hit, n) over all rows: 0 for the reference, judged out of fold, 1 for the batch, judged by all folds' forest.

    Forests learn from a bounded hash sample of the reference, about ``cap``
    rows, kept apart, so that they don't read the table again. Batch rows that
    the reference also has are left out; rows that are equal fall in one fold,
    and are counted and then judged once, with their number.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    from plumbline.operators.ml import assembled, fitted_rows

    same = F.struct(*[q(c) for c in columns])
    own = q(label).cast("string").alias("__label")
    fold = F.pmod(F.xxhash64(F.to_json(same)), F.lit(3)).alias("__fold")
    counted = lambda df: df.groupBy(*[q(c) for c in columns], own).agg(F.count(F.lit(1)).alias("__n"))
    every = cut(counted(reference))
    old = every.where("__label IS NOT NULL").withColumn("__fold", fold)
    seen = every.select(same.alias("__s")).distinct()
    new = counted(batch.where(q(label).isNotNull())).withColumn("__k", same)
    new = new.join(seen, F.col("__k").eqNullSafe(F.col("__s")), "left_anti").drop("__k")
    size = old.agg(F.sum("__n").alias("n")).first().n or 0
    # forests draw rows by their place in a partition
    fit = reference.where(q(label).isNotNull()).where(fitted_rows(row_id, cap, size, seed)).repartition(FIT_PARTS, q(row_id)).sortWithinPartitions(q(row_id))
    fit = fit.select(fold, own, *[q(c) for c in columns])
    index = StringIndexer(inputCol="__label", outputCol="__y", handleInvalid="skip", stringOrderType="alphabetAsc").fit(old)
    fit = cut(index.transform(assembled(fit, columns, ["__fold", "__label"])))
    forest = RandomForestClassifier(featuresCol="features", labelCol="__y", numTrees=50, maxDepth=8, seed=seed)
    told = lambda model, df, side: model.transform(index.transform(assembled(df, columns, ["__label", "__n"]))).select(
        F.lit(side).alias("side"), F.col("__label").alias("label"), (F.col("prediction") == F.col("__y")).alias("hit"), "__n")
    out = told(forest.fit(fit), new, 1)
    for k in range(3):
        out = out.unionByName(told(forest.fit(fit.where(F.col("__fold") != k)), old.where(F.col("__fold") == k), 0))
    return cut(out.groupBy("side", "label", "hit").agg(F.sum("__n").alias("n")))


def recalls(scored: DataFrame, least: int = 30) -> DataFrame:
    """(label, n_reference, n_batch, recall_reference, recall_batch) of classes with ``least`` rows on both sides.

    ``scored`` is (side, label, hit), a row each, or with ``n``, how many rows each stands for.
    """
    n = F.col("n") if "n" in scored.columns else F.lit(1).cast("long")
    rows = lambda k, *hit: F.sum(F.when(reduce(Column.__and__, hit, F.col("side") == k), n).otherwise(0))
    out = scored.groupBy("label").agg(*[f.alias(name) for k, name in ((0, "reference"), (1, "batch")) for f, name in (
        (rows(k), f"n_{name}"), (F.try_divide(rows(k, F.col("hit")), rows(k, F.col("hit").isNotNull())), f"recall_{name}"))])
    out = out.select("label", "n_reference", "n_batch", "recall_reference", "recall_batch")
    return out.where((F.col("n_reference") >= least) & (F.col("n_batch") >= least))


def recall_drop(by_class: DataFrame) -> DataFrame:
    """(classes, before, after, drop, error) over ``recalls``; the error is the binomial standard error of the drop."""
    term = lambda r, n: (lambda p: p * (1 - p) / F.col(n))((F.col(r) * F.col(n) + 0.5) / (F.col(n) + 1))
    spread = F.sum(term("recall_reference", "n_reference") + term("recall_batch", "n_batch"))
    out = by_class.agg(
        F.count(F.lit(1)).alias("classes"), F.avg("recall_reference").alias("before"), F.avg("recall_batch").alias("after"),
        F.try_divide(F.sqrt(spread), F.count(F.lit(1))).alias("error"),
    )
    return out.select("classes", "before", "after", (F.col("before") - F.col("after")).alias("drop"), "error")


def model_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if not names_identifier(c)]


#: Random Fourier features, and draws of weights for the limit.
FEATURES, DRAWS = 256, 100


def _poisson(ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """A Poisson weight of mean one for each row and draw, by hashes of the row's number: the same wherever it stands."""
    x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
    for shift in (30, 27, 31):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0x94D049BB133111EB)
    uniform = (x >> np.uint64(11)).astype(float) / (1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    return np.searchsorted(steps, uniform, side="right").astype(float)


def mmd(reference: DataFrame, batch: DataFrame, columns: list[str], row_id: str, seed: int = 42, features: int = FEATURES, draws: int = DRAWS) -> dict[str, float]:
    """Squared maximum mean discrepancy of two tables: {mmd2, limit, drifted, n_reference, n_batch}.

    Columns are standardised by the reference; the kernel is Gaussian with the
    number of columns as its squared width. Means of ``features`` random
    Fourier features (a cosine and a sine each) stand for kernel sums, with an
    error of about 1 / sqrt(features), so both tables are read once in one
    aggregate and no pair of rows is looked at. The limit is the 99th
    percentile of what the means move by under Poisson weights of the rows
    (a bootstrap, drawn by hashes of ids): beyond it the tables differ.
    """
    stats = reference.agg(*[f(clean(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = F.array(*[(clean(c) - F.lit(stats[f"m{i}"] or 0.0)) / F.lit(stats[f"s{i}"] or 1.0) for i, c in enumerate(columns)])
    side = lambda df, name: df.select(F.lit(name).alias("side"), F.xxhash64(q(row_id)).alias("id"), scaled.alias("x"))
    both = side(reference, "reference").unionByName(side(batch, "batch"))
    rng = np.random.default_rng(seed)
    turn = rng.standard_normal((len(columns), features)) / math.sqrt(len(columns))

    def run(batches):
        from pyspark import TaskContext

        salt, parts = TaskContext.get().partitionId() % 32, {}
        for part in batches:
            names = np.array(part.column(0).to_pylist(), object)
            ids, x = part.column(1).to_numpy(), part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(columns))
            for a in range(0, len(names), 4096):
                angle = x[a : a + 4096] @ turn
                phi = np.concatenate((np.cos(angle), np.sin(angle)), axis=1) / math.sqrt(features)
                weights = _poisson(ids[a : a + 4096], draws, seed)
                for name in set(names[a : a + 4096].tolist()):
                    own = names[a : a + 4096] == name
                    now = (int(own.sum()), phi[own].sum(axis=0), weights[own].sum(axis=0), weights[own].T @ phi[own])
                    held = parts.get(name)
                    parts[name] = now if held is None else tuple(p + n for p, n in zip(held, now, strict=True))
        for name, (n, total, drawn, moved) in parts.items():
            cells = [pa.array([name]), pa.array([salt], pa.int32()), pa.array([n], pa.int64()), *(pa.array([v.tobytes()]) for v in (total, drawn, moved))]
            yield pa.RecordBatch.from_arrays(cells, ["side", "salt", "n", "total", "drawn", "moved"])

    schema = "side string, salt int, n long, total binary, drawn binary, moved binary"
    sums = {r.side: r for r in added_up(both.mapInArrow(run, schema), "side", ["total", "drawn", "moved"]).collect()}  # two rows
    if len(sums) < 2:
        raise CheckSkipped("one of the tables has no row")
    means, moves = {}, {}
    for name, r in sums.items():
        means[name] = np.frombuffer(r.total) / r.n
        drawn = np.maximum(np.frombuffer(r.drawn), 1.0)
        moves[name] = np.frombuffer(r.moved).reshape(draws, -1) / drawn[:, None] - means[name]
    mmd2 = float(((means["reference"] - means["batch"]) ** 2).sum())
    limit = float(np.quantile(((moves["reference"] - moves["batch"]) ** 2).sum(axis=1), 0.99))
    return {"mmd2": mmd2, "limit": limit, "drifted": mmd2 > limit, "n_reference": sums["reference"].n, "n_batch": sums["batch"].n}
