"""Ranks, running sums and quantiles by ranges equal those of a task that orders all rows."""

import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import duplicates, ml, poison, ranks, splits


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(v), float(w) if i % 3 else None) for i, (v, w) in enumerate(zip(rng.integers(0, 60, 2000), rng.normal(size=2000)))]
    return spark.createDataFrame(rows, "id long, v double, w double").repartition(5).cache()


def test_running_sums(numbers):
    got = [(r.id, r.upto) for r in ranks.running(numbers, [F.col("v"), F.col("id")], {"upto": F.col("v")}).collect()]
    rows = sorted((r.v, r.id) for r in numbers.collect())
    want = dict(zip([i for _, i in rows], np.cumsum([v for v, _ in rows])))
    assert dict(got) == pytest.approx(want) and len(got) == 2000


@pytest.mark.parametrize("k", [0, 1, 777, 2000, 5000])
def test_first_rows(numbers, k):
    got = {r.id for r in ranks.first_rows(numbers, [F.desc("v"), F.col("id")], k).collect()}
    assert got == {i for _, i in sorted((-r.v, r.id) for r in numbers.collect())[:k]}


def test_first_rows_of_groups(numbers):
    wanted = {0: 3, 1: 250, 2: 10_000}
    got = sorted(r.id for r in ranks.first_rows(numbers, [F.col("v"), F.col("id")], wanted, (F.col("id") % 4).cast("int")).collect())
    rows = sorted((r.v, r.id) for r in numbers.collect())
    assert got == sorted(i for g, k in wanted.items() for i in [i for _, i in rows if i % 4 == g][:k])


def test_quantiles_are_exact(numbers):
    shares = [0.0, 0.1, 0.25, 0.5, 0.777, 1.0]
    got = ranks.quantiles(numbers, {"v": F.col("v"), "w": F.col("w"), "none": F.lit(None).cast("double")}, shares)
    rows = numbers.collect()
    assert got["v"] == pytest.approx(list(np.quantile([r.v for r in rows], shares)))
    assert got["w"] == pytest.approx(list(np.quantile([r.w for r in rows if r.w is not None], shares)))
    assert got["none"] == []


def test_cutoff_of_few_and_many_times(spark):
    for times in ([], [5], [1, 1, 1, 9], list(range(100)) + [50] * 300):
        df = spark.createDataFrame([(t,) for t in times], "t long").repartition(3)
        want = sorted(times)[int(0.7 * (len(times) - 1) + 0.5)] if times else None
        assert splits.cutoff(df, F.col("t")) == want


def test_shares_of_rows_and_groups_are_whole_where_doubles_fall_short(spark):
    assert int(90 * 0.7) == 62 and int(0.7 * 45 + 0.5) == 31
    assert splits.grouped(spark.range(90), ["id"], "split").where("split = 'train'").count() == 63
    assert splits.cutoff(spark.range(46), F.col("id")) == 32


def test_a_fit_sample_is_bounded_and_every_row_is_scored(spark):
    rows = spark.range(3000).selectExpr("id AS row_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS y", "array((id % 2) * 10.0D + (id * 37 % 101) / 100D, (id * 53 % 97) / 97D) AS x")
    flipped = rows.withColumn("y", F.when(F.col("row_id") % 100 == 1, "a").otherwise(F.col("y")))
    sample = ml.hash_sample(flipped, "row_id", 500).count()
    assert 350 < sample < 650
    found = {r.row_id for r in poison.knn(flipped, cap=500).collect()}
    assert found == set(range(1, 3000, 100))
    far = rows.unionByName(spark.range(60).selectExpr("id + 9000 AS row_id", "'a' AS y", "array(50D + (id % 7) / 5000D, 50D + id / 6000D) AS x"))
    got = poison.clusters(far, probes=500)
    assert {r.row_id for r in got.where("row_id >= 9000").collect()} == set(range(9000, 9060))


@pytest.mark.parametrize("block", [3, 1024])
def test_near_rows_equal_brute_force_in_small_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    rows = [(i, *[float(x) for x in rng.integers(0, 2, 12)]) for i in range(120)]
    columns = [f"c{k}" for k in range(12)]
    df = spark.createDataFrame(rows, ["id", *columns])
    assert duplicates.mismatches_allowed(12, 0.8) == 1
    got = {r.row_id: r.component_id for r in duplicates.near_classes(df, columns, "id", None, 0.8).collect()}
    label = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if sum(x != y for x, y in zip(a[1:], b[1:])) <= 1 and label[b[0]] < label[a[0]]:
                    label[a[0]], changed = label[b[0]], True
    first = {}
    for r in rows:
        first.setdefault(r[1:], r[0])
    sizes = {}
    for i in first.values():
        sizes[label[i]] = sizes.get(label[i], 0) + 1
    assert got == {i: label[i] for i in first.values() if sizes[label[i]] > 1}


def test_drop_duplicates_keeps_one_row_of_each_key(spark):
    rows = [(i % 7, None if i % 2 else "x", i, float("nan")) for i in range(100)] + [(0, "x", 0, float("nan"))]
    got = duplicates.drop_duplicates(spark.createDataFrame(rows, "k long, t string, id long, d double"), ["k", "t", "d"], ["id"]).collect()
    want = {}
    for k, t, i, _ in rows:
        want[k, t] = min(want.get((k, t), i), i)
    assert sorted((r.k, str(r.t), r.id) for r in got) == sorted((k, str(t), i) for (k, t), i in want.items())


@pytest.mark.parametrize("kind", ["few", "many", "copies", "tiny", "zeros"])
def test_bracketed_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(4)
    x = {"few": rng.normal(size=7), "many": rng.normal(size=30_000), "copies": rng.integers(0, 3, 5_000) * 1.0,
         "tiny": rng.integers(-3, 4, 500) * 5e-324, "zeros": np.where(rng.random(4_000) < 0.5, 0.0, rng.normal(size=4_000))}[kind]
    df = spark.createDataFrame([(float(v), None) for v in x], "a double, b double")
    shares = [0.0, 0.02, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = ranks.quantiles(df, {"a": F.col("a"), "b": F.col("b")}, shares)
    assert got["b"] == [] and got["a"] == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12, abs=1e-15)
    if kind in ("many", "copies"):
        sizes, found = ranks._bracketed(df, {"a": F.col("a")}, shares)
        assert sizes == {"a": len(x)} and set(found["a"]) == {f(s * (len(x) - 1)) for s in shares for f in (math.floor, math.ceil)}
