"""Windows, time-outs, splits by lot and spectra: against plain versions, and as checks that fire and stay silent."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.model import CheckSkipped, Dataset, Roles
from plumbline.operators import drift, leakage, poison, splits, validity, windows
from plumbline.plans import audit, checks, fixes


def plain_expected(rows, given):
    out = {}
    for i, t, host, peer in rows:
        fits = [w for w in given if w[1] <= w[2] and t is not None and w[1] <= t <= w[2] and w[3] in (None, host) and w[4] in (None, peer)]
        out[i] = min(fits, key=lambda w: (w[5], w[1], w[2], w[0]))[0] if fits else None
    return out


@pytest.mark.parametrize("width", [10.0, 1000.0])
def test_windows_equal_plain_ones_whatever_overlaps(spark, width):
    rng = random.Random(3)
    hosts = ["a", "b", "c", None]
    given = []
    for k in range(60):
        start = rng.uniform(0, 900)
        given.append((f"w{k}", start, start + rng.choice([-1, 0, 5, 50, 300]), rng.choice(hosts), rng.choice([None, None, "x", "y"]), rng.randrange(3)))
    rows = [(i, rng.choice([None, rng.uniform(0, 1000), given[i % 60][1], given[i % 60][2]]), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "z", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t double, host string, peer string")
    table = spark.createDataFrame(given, "label string, start double, end double, host string, peer string, precedence int")
    got = windows.expected(df, F.col("t"), F.col("host"), table, F.col("peer"), width)
    assert got.columns == [*df.columns, "expected"] and got.count() == 500
    assert {r.id: r.expected for r in got.collect()} == plain_expected(rows, given)


def dataset(spark, **config):
    rows = [(i, 1_700_000_000.0 + 60 * i, "evil" if i % 4 == 0 else f"h{i % 5}", "srv", 80, 1000 + i, "tcp", "BENIGN") for i in range(200)]
    rows = [(*r[:7], "Scan" if r[2] == "evil" and 40 <= r[0] <= 80 and r[0] != 60 else "DoS" if r[0] == 150 else r[7]) for r in rows]
    df = spark.createDataFrame(rows, "id long, ts double, src string, dst string, dport int, sport int, proto string, label string")
    roles = Roles(label="label", time="ts", src_ip="src", dst_ip="dst", src_port="sport", dst_port="dport", protocol="proto")
    return Dataset(df, roles, config={"row_id": "id"} | config)


def test_window_check_and_fix(spark):
    given = [{"label": "scan", "start": 1_700_000_000 + 60 * 40, "end": 1_700_000_000 + 60 * 80, "host": "evil"}]
    data = dataset(spark, attack_windows=given)
    found = checks.select("labels.window")[0].run(data)[0]
    assert found.affected_rows == 2 and found.metric["inside"] == 1 and found.metric["outside"] == 1
    assert {r.row_id for r in found.flagged.collect()} == {60, 150}
    fixed = fixes.apply_fix(data, "relabel_window").dataset
    assert {r.id: r.label for r in fixed.df.where("id IN (60, 150)").collect()} == {60: "scan", 150: "BENIGN"}
    assert checks.select("labels.window")[0].run(fixed) == []
    with pytest.raises(fixes.FixNotApplicable):
        fixes.apply_fix(fixed, "relabel_window")
    with pytest.raises(CheckSkipped):
        checks.select("labels.window")[0].run(dataset(spark))


def test_timeout_check(spark):
    data = dataset(spark)
    assert checks.select("flow.timeout")[0].run(data) == []  # every record has a port of its own
    same = data.with_df(data.df.withColumn("sport", F.lit(7)))
    events = checks.select("flow.timeout")[0].run(Dataset(same.df, same.roles, config={"row_id": "id", "timeout_gap": 250.0}))
    assert events[0].affected_rows == 50 and events[0].severity == "high" and events[0].examples


@pytest.mark.parametrize("partitions", [1, 7])
def test_runs_equal_a_loop(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i, rng.randrange(50), rng.choice(["a", "a", "b", "c", None])) for i in range(400)]
    got = leakage.runs(spark.createDataFrame(rows, "id long, t long, v string").repartition(partitions), [F.col("t"), F.col("id")], F.col("v")).first()
    values = [v for _, _, v in sorted(rows, key=lambda r: (r[1], r[0])) if v]
    n, sizes = len(values), [values.count(x) for x in set(values)]
    s2, s3 = sum(m**2 for m in sizes), sum(m**3 for m in sizes)
    assert got.n_runs == 1 + sum(a != b for a, b in zip(values, values[1:])) and got.n == n and got.n_values == 3
    spread = (s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n**3) / (n * n * (n - 1))
    assert got.z == pytest.approx((got.n_runs - (n * (n + 1) - s2) / n) / spread**0.5)
    assert abs(got.z) < 4  # drawn by lot


def test_random_split_check(spark):
    df = spark.range(3000).selectExpr("id", "id AS ts", "CASE WHEN id % 1000 < 300 THEN 'attack' ELSE 'benign' END AS label", "CASE WHEN xxhash64(id) % 10 > 2 THEN 'train' ELSE 'test' END AS split")
    data = Dataset(df, Roles(label="label", split="split", time="ts"), config={"row_id": "id"})
    check = checks.select("leak.random_split")[0]
    assert check.run(data)[0].severity == "high"
    blocks = data.with_df(df.withColumn("split", F.expr("CASE WHEN id < 2000 THEN 'train' ELSE 'test' END")))
    assert check.run(blocks) == []  # by time
    loose = data.with_df(df.withColumn("label", F.expr("CASE WHEN xxhash64(id, 5) % 2 = 0 THEN 'x' ELSE 'y' END")))
    assert check.run(loose) == []  # labels that don't hang together


def test_directions_are_singular_vectors_and_backdoors_stand_out(spark):
    rng = np.random.default_rng(5)
    base = {y: rng.normal(size=(400, 12)) @ np.diag(np.linspace(0.3, 1, 12)) for y in ("a", "b")}
    base["a"][:6] += 9 * np.eye(12)[3] + 9 * np.eye(12)[7]
    base["c"] = rng.normal(size=(20, 12))  # too few
    rows = [(k * 1000 + i, y, x.tolist()) for k, (y, xs) in enumerate(base.items()) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "row_id long, y string, x array<double>").repartition(9)
    found = {r.y: r for r in poison.directions(df).collect()}
    assert set(found) == {"a", "b"}
    for y, r in found.items():
        centred = base[y] - base[y].mean(axis=0)
        want = np.linalg.svd(centred)[2][0]
        assert abs(abs(np.dot(want, r.direction)) - 1) < 1e-8 and np.allclose(r.mean, base[y].mean(axis=0), atol=1e-10)
    top = poison.spectral(df).collect()
    assert {r.row_id for r in top if r.y == "a"} == set(range(6)) and sum(r.y == "b" for r in top) == 6
    centred = base["a"] - base["a"].mean(axis=0)
    scores = (centred @ np.linalg.svd(centred)[2][0]) ** 2
    assert all(r.score == pytest.approx(scores[r.row_id], rel=1e-7) for r in top if r.y == "a")


def test_shares_outside_of_zero_and_one_are_refused(spark):
    df = spark.range(10).withColumn("g", F.col("id"))
    for share in (0, 1, 1.5, -0.1):
        with pytest.raises(ValueError, match="train_ratio"):
            splits.grouped(df, ["g"], "split", share)
        with pytest.raises(ValueError, match="train_ratio"):
            splits.temporal(df, F.col("id"), "split", share)


def test_domain_audit_runs(spark):
    report = audit.run_audit(dataset(spark), "all", "domain")
    assert not report.errors and {"labels.window", "leak.random_split"} <= set(report.skipped)


def test_mmd_is_near_the_kernel_sum_and_silent_on_halves(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 3))
    y = np.concatenate((x[600:, :2], 0.9 * x[600:, :1] + 0.3 * x[600:, 2:]), axis=1)  # the same margins, another joint distribution
    frame = lambda rows, start: spark.createDataFrame([(start + i, *map(float, r)) for i, r in enumerate(rows)], "id long, a double, b double, c double").repartition(5)
    one, two, bent = frame(x[:600], 0), frame(x[600:], 5000), frame(y, 5000)
    same = drift.mmd(one, two, ["a", "b", "c"], "id")
    assert not same["drifted"] and same == drift.mmd(one.repartition(2), two, ["a", "b", "c"], "id") | {k: pytest.approx(same[k]) for k in ("mmd2", "limit")}
    found = drift.mmd(one, bent, ["a", "b", "c"], "id", features=4096)
    scale = lambda v: (v - x[:600].mean(axis=0)) / x[:600].std(axis=0)
    kernel = lambda u, v: np.exp(-((scale(u)[:, None, :] - scale(v)[None, :, :]) ** 2).sum(axis=2) / 6).mean()
    want = kernel(x[:600], x[:600]) + kernel(y, y) - 2 * kernel(x[:600], y)
    assert found["drifted"] and found["mmd2"] == pytest.approx(want, abs=2 / np.sqrt(4096) * np.sqrt(want) + 1e-4)


def test_kinds_of_text_columns(spark):
    rows = [(str(i), f" {i}.5", "yes" if i % 2 else "No", "2024-01-0%d" % (i % 9 + 1), "10.0.0.1", "x" if i == 7 else str(i), None, "") for i in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in "abcdefgh"))
    got = {r.column: (r.kind, r.n_values, r.n_padded, r.n_odd, r.odd_example) for r in validity.kinds_of(df, list("abcdefgh")).collect()}
    assert got == {"a": ("whole", 200, 0, 0, None), "b": ("number", 200, 200, 0, None), "c": ("truth", 200, 0, 0, None), "d": ("time", 200, 0, 0, None),
                   "e": ("address", 200, 0, 0, None), "f": ("whole", 200, 0, 1, "x"), "g": ("text", 0, 0, 0, None), "h": ("text", 0, 0, 0, None)}
    found = checks.select("validity.types")[0].run(Dataset(df))
    assert {f.severity for f in found} == {"low", "medium"} and sum("as text" in f.title for f in found) == 5
