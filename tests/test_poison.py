"""Injected poison is found; clean data isn't flagged by several detectors; rankings follow their rules."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import poison


def base(spark, n=1500):
    return spark.range(n).selectExpr(
        "id AS rid", "(id * 37 % 499) * 1.0D + CASE WHEN id % 2 = 0 THEN 600 ELSE 0 END AS size_a", "(id * 53 % 101) * 1.0D AS size_b",
        "element_at(array(8192L, 16384L, 65535L), CAST(id % 3 + 1 AS INT)) AS win", "CASE WHEN id % 2 = 0 THEN 'attack' ELSE 'benign' END AS label")


def test_backdoor_is_found_by_its_trigger(spark):
    hit = poison.inject_backdoor(base(spark), "win", 4242, "label", "benign", "rid", 0.015)
    truth = hit.where("__poisoned").select(F.col("rid").alias("row_id"))
    flagged = poison.trigger_rows(hit, ["size_a", "size_b", "win"], "label", "rid")
    r = poison.evaluate(flagged, truth).first()
    assert r.recall == 1.0 and r.precision > 0.9
    assert poison.trigger_rows(base(spark), ["size_a", "size_b", "win"], "label", "rid").count() == 0


def test_flips_are_found_by_neighbours(spark):
    hit = poison.inject_label_flip(base(spark, 600), "label", "rid", 0.03)
    truth = hit.where("__poisoned").select(F.col("rid").alias("row_id"))
    rows = poison.matrix(hit, ["size_a", "size_b"], "label", "rid")
    r = poison.evaluate(poison.knn(rows), truth).first()
    assert r.recall > 0.8 and r.precision > 0.8


def test_injections_are_the_same_at_any_partitioning(spark):
    ids = [sorted(r.rid for r in poison.inject_label_flip(base(spark, 300).repartition(p), "label", "rid", 0.1).where("__poisoned").collect()) for p in (1, 5)]
    assert ids[0] == ids[1] and len(ids[0]) == 30
    with pytest.raises(ValueError):
        poison.how_many(10, 1.0)
    out = poison.inject_synthetic(base(spark, 50), ["size_a"], "label", "benign", "rid", 7)
    assert out.count() == 57 and out.where("__poisoned AND label = 'benign' AND rid < 0").count() == 7


def test_combination_rules(spark):
    rows = [(1, "poison.knn", 0.2), (1, "poison.trigger", 5.0), (2, "poison.knn", 0.8), (3, "poison.cluster", 1.0), (2, "poison.knn", 0.8)]
    got = {r.row_id: r for r in poison.combine_scores(spark.createDataFrame(rows, "row_id long, check_id string, score double")).collect()}
    assert got[1].score == pytest.approx(1.8) and got[1].n_detectors == 2
    assert got[2].score == pytest.approx(1.0) and 3 not in got
    top = poison.rank_suspects(poison.combine_scores(spark.createDataFrame(rows, "row_id long, check_id string, score double")), 1)
    assert top.first().row_id == 1


def test_blocks_of_copies_within_eps_are_one_cluster(spark):
    rows = [(i, "a", [float(i % 25), float(i // 25)]) for i in range(600)]
    rows += [(600 + i, "a", [100.0 + 0.3 * (i % 2), 100.0]) for i in range(24)]  # each copy's ten nearest are its own copies
    rows += [(624, "a", [100.9, 100.0])]  # within eps of cores, in no core's ten nearest
    got = poison.clusters(spark.createDataFrame(rows, "row_id long, y string, x array<double>")).collect()
    assert {r.row_id for r in got} == set(range(600, 625)) and {r.cluster for r in got} == {600}


def plain_dbscan(points, eps, least):
    """{id: (core, least core id of its cluster or None)} of one class."""
    import math

    near = {a: [b for b in points if math.dist(points[a], points[b]) <= eps] for a in points}
    core = {a for a in points if len(near[a]) >= least}
    label = {a: a for a in core}
    while True:
        before = dict(label)
        for a in core:
            for b in near[a]:
                if b in core:
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return {a: (a in core, label[a] if a in core else min((label[b] for b in near[a] if b in core), default=None)) for a in points}


@pytest.mark.parametrize("block", [2048, 16])
@pytest.mark.parametrize("columns", [1, 2, 5])
def test_dbscan_equals_a_plain_one(spark, monkeypatch, block, columns):
    import random

    from plumbline.operators import density

    monkeypatch.setattr(density, "BLOCK_ROWS", block)
    rng = random.Random(columns)
    rows = []
    for y, eps in (("a", 1.0), ("b", 0.5)):
        centres = [[rng.uniform(0, 12) for _ in range(columns)] for _ in range(5)]
        for k in range(150):
            c = rng.choice(centres)
            rows.append((len(rows), y, [v + rng.gauss(0, 0.4 * eps) for v in c]))
        rows += [(len(rows) + k, y, [round(v) * 1.0 for v in rows[-k - 1][2]]) for k in range(60)]  # copies, and distances of exactly one
    df = spark.createDataFrame(rows, "row_id long, y string, x array<double>").repartition(5)
    eps = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "y string, eps double")
    got = {r.row_id: (r.core, r.cluster) for r in density.dbscan(df, eps, 5).collect()}
    want = {}
    for y, e in (("a", 1.0), ("b", 0.5)):
        want |= plain_dbscan({i: x for i, own, x in rows if own == y}, e, 5)
    assert got == want and any(not c and k is not None for c, k in want.values())


@pytest.mark.parametrize("parts", [8, 1])
@pytest.mark.parametrize("columns", [1, 2, 4])
def test_dbscan_of_crowds_equals_a_plain_one(spark, monkeypatch, parts, columns):
    import random

    from plumbline.operators import density

    monkeypatch.setattr(density, "BLOCK_ROWS", 16)
    monkeypatch.setattr(density, "PARTS", parts, raising=False)
    rng = random.Random(columns)
    rows = []
    for k, c in enumerate((0, 1.7, 3.6, 9, 10.9, 12.9)):  # crowds, of which some nearly touch
        for _ in range((80, 60, 40)[k % 3]):
            rows.append((len(rows), "a", [c + rng.uniform(0, 1) / columns**0.5, *(rng.uniform(0, 1) / columns**0.5 for _ in range(columns - 1))]))
    rows += [(len(rows) + k, "a", [rng.uniform(-2, 15), *(rng.uniform(-1, 2) for _ in range(columns - 1))]) for k in range(40)]
    df = spark.createDataFrame(rows, "row_id long, y string, x array<double>").repartition(5)
    for eps in (1.0, 1.25):
        got = {r.row_id: (r.core, r.cluster) for r in density.dbscan(df, spark.createDataFrame([("a", eps)], "y string, eps double"), 8).collect()}
        assert got == plain_dbscan({i: x for i, _, x in rows}, eps, 8)


def test_what_is_compared_grows_no_faster_than_a_crowd(spark, monkeypatch):
    from plumbline.operators import density

    dealt, plain = [], density.map_sorted_groups

    def counting(df, *rest):
        dealt.append(df.count())
        return plain(df, *rest)

    monkeypatch.setattr(density, "BLOCK_ROWS", 16)
    monkeypatch.setattr(density, "map_sorted_groups", counting)
    rows = [(i, "a", [i % 50 / 100, i // 50 / 100]) for i in range(2000)] + [(2000, "a", [1.2, 0.0])]  # all within one eps but the last, which is in reach of some
    got = density.dbscan(spark.createDataFrame(rows, "row_id long, y string, x array<double>"), spark.createDataFrame([("a", 1.0)], "y string, eps double"), 10).collect()
    assert all(r.core and r.cluster == 0 for r in got) and len(got) == 2001
    assert sum(dealt) < 10 * len(rows)


@pytest.mark.parametrize("probes", [1_000, 100])
def test_a_planted_cluster_is_found_at_any_size_of_sample(spark, probes):
    import random

    rng = random.Random(8)
    rows = [(i, "a", [rng.uniform(0, 60), rng.uniform(0, 60)]) for i in range(4000)]
    rows += [(4000 + i, "a", [200 + rng.gauss(0, 0.05), 200 + rng.gauss(0, 0.05)]) for i in range(30)]
    got = poison.clusters(spark.createDataFrame(rows, "row_id long, y string, x array<double>"), probes=probes).collect()
    assert {r.row_id for r in got if r.row_id >= 4000} == set(range(4000, 4030))


def test_neighbours_of_copies_and_ties(spark):
    rows = [(i, "a" if i < 30 else "b", [float(i // 10), 0.0]) for i in range(60)]
    got = {r.row_id: r.score for r in poison.knn(spark.createDataFrame(rows, "row_id long, y string, x array<double>"), k=12, least=0.0).collect()}
    for i, y, x in rows:
        near = sorted((abs(x[0] - o[2][0]), o[0], o[1]) for o in rows if o[0] != i)[:12]
        assert got[i] == pytest.approx(sum(o[2] != y for o in near) / 12)
