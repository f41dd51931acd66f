"""Shapley values over paths: against enumeration of coalitions, sums against the forest's own probabilities."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.model import CheckSkipped, Dataset, Roles
from plumbline.operators import importance, ml
from plumbline.plans import checks, registry

COLUMNS = ["a", "b", "c", "src_port"]


def worth(tree, at, x, known):
    """The expected class shares when only the columns in ``known`` are told; both ways, by rows, where one isn't."""
    column, threshold, left, right, rows, values = tree[at]
    if column is None:
        return np.asarray(values, float)
    if column in known:
        return worth(tree, left if x[column] <= threshold else right, x, known)
    return sum(tree[c][4] / rows * worth(tree, c, x, known) for c in (left, right))


def enumerated(trees, x):
    d = len(x)
    out = np.zeros((d, next(len(n[5]) for tree in trees.values() for n in tree.values() if n[0] is None)))
    for tree in trees.values():
        for j in range(d):
            others = [k for k in range(d) if k != j]
            for size in range(d):
                for known in combinations(others, size):
                    gain = worth(tree, 0, x, {*known, j}) - worth(tree, 0, x, set(known))
                    out[j] += factorial(size) * factorial(d - size - 1) / factorial(d) * gain / len(trees)
    return out


def table(spark, rows=600):
    return spark.range(rows).selectExpr(
        "id", "CAST(id * 37 % 101 AS DOUBLE) AS a", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 51 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(id * 13 % 17 AS DOUBLE) END AS b",
        "CAST(id * 7 % 29 AS DOUBLE) AS c", "CAST(id * 11 % 97 AS DOUBLE) AS src_port",
        "CASE WHEN id % 40 = 0 THEN NULL WHEN id * 37 % 101 > 60 AND id * 7 % 29 > 9 THEN 'x' WHEN id * 13 % 17 > 11 THEN 'y' ELSE 'z' END AS label")


def test_values_equal_enumeration_and_add_up(spark):
    df = table(spark)
    model, classes, gain = importance.baseline(df, COLUMNS, "label", "id")
    assert classes == ["x", "y", "z"] and gain > 0.25
    trees = importance.forest_nodes(model)
    paths = importance.paths_of(trees, importance.DEPTH)
    cells = {r.id: np.array(r.x) for r in df.select("id", F.array(*[ml.clean(c) for c in COLUMNS]).alias("x")).collect()}
    got = {i: np.zeros((4, 3)) for i in cells}
    for r in importance.shapley(df, COLUMNS, "id", paths, classes).collect():
        got[r.row_id][COLUMNS.index(r.column), classes.index(r["class"])] = r.value
    for i in range(0, 600, 29):
        np.testing.assert_allclose(got[i], enumerated(trees, cells[i]), atol=1e-12)
    scored = model.transform(ml.assembled(df, COLUMNS, ["id"])).select("id", vector_to_array("p").alias("p")).collect()
    for r in scored:
        np.testing.assert_allclose(paths.base + got[r.id].sum(axis=0), r.p, atol=1e-9)
    total = np.mean([np.abs(v).sum(axis=1) for v in got.values()], axis=0)
    mean = {r.column: (r.importance, r.share) for r in importance.importance(df.repartition(7), COLUMNS, paths).collect()}
    for c, t in zip(COLUMNS, total, strict=True):
        np.testing.assert_allclose(mean[c], (t, t / total.sum()), atol=1e-9)


def test_a_column_asked_twice_and_a_tree_of_one_leaf():
    trees = {
        0: {0: (1, 5.0, 1, 2, 10, None), 1: (1, 2.0, 3, 4, 6, None), 2: (None, 0, -1, -1, 4, [0.5, 0.5]), 3: (0, 1.0, 5, 6, 4, None),
            4: (None, 0, -1, -1, 2, [1, 0]), 5: (None, 0, -1, -1, 1, [0.25, 0.75]), 6: (None, 0, -1, -1, 3, [0, 1])},
        1: {0: (None, 0, -1, -1, 10, [0.3, 0.7])},
    }
    paths = importance.paths_of(trees, 3)
    x = np.array([[0.0, 1.0, 9.0], [2.0, 2.0, 9.0], [1.0, 3.0, 9.0], [5.0, 5.5, 9.0], [1.0, 5.0, 0.0]])
    np.testing.assert_allclose(paths.explain(x), [enumerated(trees, r) for r in x], atol=1e-12)
    assert paths.explain(x)[:, 2].any() == False  # noqa: E712  nothing asks for it


def test_check_fires_on_identifiers_and_few_columns(spark):
    run = checks.select("shortcut.importance")[0].run
    roles = Roles(label="label")
    port = table(spark).selectExpr("id", "a", "b", "c", "src_port", "CASE WHEN src_port > 40 THEN 'x' ELSE 'z' END AS label")
    found = run(Dataset(port, roles, config={"row_id": "id"}))
    assert [f.check_id for f in found] == ["shortcut.importance"] and found[0].metric["columns"] == ["src_port"]
    assert found[0].examples[0]["share"] > 0.9
    spread = table(spark).withColumnRenamed("src_port", "d")
    assert run(Dataset(spread, roles, config={"row_id": "id"})) == []
    with pytest.raises(CheckSkipped):  # labels that no column tells
        run(Dataset(table(spark).withColumn("label", F.when(F.xxhash64("id") % 2 == 0, "x").otherwise("z")), roles, config={"row_id": "id"}))
    with pytest.raises(CheckSkipped):
        run(Dataset(table(spark).withColumn("label", F.lit("x")), roles, config={"row_id": "id"}))
    with pytest.raises(CheckSkipped):
        run(Dataset(table(spark).limit(0), roles, config={"row_id": "id"}))


def test_query_finds_what_decides(spark):
    rows = {r.column: r.share for r in registry.queries()["shortcut_importance"](spark, "/root/testdata/sf0.001").collect()}
    assert rows["wait"] > 0.5 and abs(sum(rows.values()) - 1) < 1e-5 and rows["l_tax"] < 0.05
