"""Near duplicates of rows against all pairs: marks in cells, long cells, constant columns, both ways of meeting."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import duplicates


def plain(rows, k):
    """Component (least id) of each row id, from all pairs that differ in at most k cells."""
    label = {r[0]: r[0] for r in rows}
    while True:
        before = dict(label)
        for a in rows:
            for b in rows:
                if sum(x != y for x, y in zip(a[1:], b[1:])) <= k:
                    label[a[0]] = label[b[0]] = min(label[a[0]], label[b[0]])
        if before == label:
            return label


@pytest.mark.parametrize("stars", [64, 0])
@pytest.mark.parametrize("columns, threshold", [(20, 0.9), (12, 0.7)])
def test_near_classes_equal_all_pairs(spark, monkeypatch, stars, columns, threshold):
    monkeypatch.setattr(duplicates, "STAR_KEYS", stars if columns == 20 else 10_000 * stars)
    rng = random.Random(columns + stars)
    cells = ["a", "b\x1fc", "\x00", "", None, "x" * 10_000, "\x1f"]
    rows = []
    for g in range(12):
        base = [rng.choice(cells) for _ in range(columns)]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(columns)] = rng.choice(cells)
            copy[3] = "same"
            rows.append((len(rows), *copy))
    names = [f"c{i}" for i in range(columns)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} string" for n in names))
    k = duplicates.mismatches_allowed(columns, threshold)
    told = [(r[0], *("\x00" if c is None else c for c in r[1:])) for r in rows]
    want = plain(told, k)
    sizes = {c: sum(v == c for v in want.values()) for c in set(want.values())}
    firsts = {}
    for r in rows:
        firsts.setdefault(r[1:], r[0])
    sizes = {c: sum(want[i] == c for i in firsts.values()) for c in set(want.values())}
    expect = {i: (want[i], sizes[want[i]]) for i in firsts.values() if sizes[want[i]] > 1}
    got = {r.row_id: (r.component_id, r.n_rows) for r in duplicates.near_classes(df, names, "id", threshold=threshold).collect()}
    assert got == expect and len(got) > 5


def test_constant_columns_pair_nothing(spark):
    """A hundred thousand rows of 14 constant and 6 varying columns take seconds."""
    n = 100_000
    df = spark.range(n).select("id", *[F.lit("flat").alias(f"k{i}") for i in range(14)], *[(F.xxhash64(F.lit(i), "id") % 100_000).alias(f"v{i}") for i in range(6)])
    twin = spark.range(50).select((F.col("id") + n).alias("id"), *[F.lit("flat").alias(f"k{i}") for i in range(14)],
                                  *[(F.xxhash64(F.lit(i), "id") % 100_000 if i else F.lit(-1)).alias(f"v{i}") for i in range(6)])
    began = time.time()
    got = duplicates.near_classes(df.unionByName(twin), [c for c in df.columns if c != "id"], "id").collect()
    assert {r.row_id for r in got} >= {k for i in range(50) for k in (i, n + i)}
    assert all(r.n_rows == 2 for r in got) and time.time() - began < 90


def test_few_varying_columns_link_all(spark):
    df = spark.range(30).select("id", *[F.lit(1).alias(f"k{i}") for i in range(30)], (F.col("id") % 7).alias("v"))
    got = duplicates.near_classes(df, [c for c in df.columns if c != "id"], "id").collect()
    assert len(got) == 7 and {r.component_id for r in got} == {0} and {r.n_rows for r in got} == {7}


@pytest.mark.parametrize("small", [0, 100_000])
def test_what_is_found_is_joined_both_ways(spark, monkeypatch, small):
    """Three columns allow no difference but that of rounding; rows equal in all are one, the first."""
    monkeypatch.setattr(duplicates, "SMALL_ROWS", small)
    rows = [(0, 1.00001, "a", None), (1, 1.00002, "a", None), (2, 1.00001, "a", None), (3, 1.00001, "b", None), (4, 2.5, "a", "x"), (5, None, "a", "x"), (6, None, "a", "x")]
    df = spark.createDataFrame(rows, "id long, v double, s string, t string")
    found = duplicates.near_classes(df, ["v", "s", "t"], "id")
    assert {(r.row_id, r.component_id, r.n_rows) for r in found.collect()} == {(0, 0, 2), (1, 0, 2)}
    assert duplicates.near_classes(df.limit(0), ["v", "s", "t"], "id").collect() == []
