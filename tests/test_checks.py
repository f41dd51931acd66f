"""Checks fire on a planted defect and stay silent on clean flows; fixes make a second audit clean."""

import datetime as dt

import pytest

from plumbline.model import CheckSkipped, Dataset, Finding, Report, Roles
from plumbline.operators import duplicates, graph, leakage, validity
from plumbline.plans import audit, checks, fixes

ROLES = Roles("label", "split", "moment", "host", "peer", "sport", "dport", "proto")


def flows(n=120):
    rows = []
    for i in range(n):
        test = i >= n * 3 // 4
        day = dt.datetime(2024, 3 if test else 1, 1 + i % 27, i % 24, i % 60)
        kind = "attack" if (i * 7) % 10 < 4 else "benign"
        rows.append((i, 0.5 + (i * 37 % 101) / 10 + (3 if kind == "attack" else 0), 100 + i * 13 % 997, 1 + i % 17,
                     f"10.{'2' if test else '1'}.0.{i % 20}", f"10.{'4' if test else '3'}.0.{i % 11}", 40000 + i, [80, 443, 53][i % 3], 6,
                     day.strftime("%Y-%m-%d %H:%M:%S"), kind, "test" if test else "train"))
    return rows


SCHEMA = "rid long, duration double, bytes_fwd long, pkts_fwd long, host string, peer string, sport long, dport long, proto long, moment string, label string, split string"


def data(spark, rows, **config):
    df = spark.createDataFrame(rows, SCHEMA)
    return Dataset(df, ROLES, frozenset({"moment", "host", "peer"}), config={"row_id": "rid"} | config)


def run(spark, rows, check, **config):
    return checks.select(check)[0].run(data(spark, rows, **config))


def test_clean_flows_have_no_serious_finding(spark):
    report = audit.run_audit(data(spark, flows()), ["validity", "dup.exact", "dup.cross_split", "dup.near", "labels.conflict", "labels.taxonomy", "leak", "shortcut"])
    assert not report.errors
    assert not [f for f in report.findings if f.severity in ("critical", "high")]
    assert [f.check_id for f in report.findings] == ["validity.constant"]  # proto


def test_exact_duplicates_and_their_classes(spark):
    rows = flows()
    copies = [(1000 + i, *rows[0][1:]) for i in range(60)]
    found = run(spark, rows + copies, "dup.exact")
    assert found[0].affected_rows == 60 and found[0].severity == "high"
    assert {f.check_id for f in found} == {"dup.exact", "dup.class_ratio"}


def test_cross_split_copies_are_critical(spark):
    rows = flows()
    copy = list(rows[0])
    copy[0], copy[-1] = 999, "test"
    found = run(spark, rows + [tuple(copy)], "dup.cross_split")
    assert found[0].severity == "critical" and found[0].affected_rows == 2


def test_null_and_nan_shift_are_no_duplicates(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 0.0), (float("nan"), -0.0)], "a double, b double")
    assert duplicates.exact(df, ["a", "b"]).first().n_dupes == 1


@pytest.mark.parametrize("m", [5, 9, 19, 20, 40, 60])
@pytest.mark.parametrize("t", [0.5, 0.8, 0.9])
def test_mismatches_allowed_is_the_inequality(m, t):
    k = duplicates.mismatches_allowed(m, t)
    assert (m - k) / (m + k) >= t
    assert (m - k - 1) / (m + k + 1) < t


def test_near_classes_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 4, (12, 40)).astype(float)
    rows = []
    for i in range(60):
        r = base[i % 12].copy()
        for j in rng.integers(0, 40, i // 20):
            r[j] += 9
        rows.append((i, *r.tolist()))
    columns = [f"c{k}" for k in range(40)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns))
    got = {r.row_id: r.component_id for r in duplicates.near_classes(df, columns, "id", None, 0.9).collect()}
    k = duplicates.mismatches_allowed(40, 0.9)
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, r in enumerate(rows):
        first.setdefault(r[1:], i)
    keep = sorted(first.values())
    for a in keep:
        for b in keep:
            if a < b and sum(x != y for x, y in zip(rows[a][1:], rows[b][1:])) <= k:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {a: find(a) for a in keep if sum(find(b) == find(a) for b in keep) > 1}
    assert got == want


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1400)] + [(5, 5), (None, 3)]
    out = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(out[i] == 100 for i in range(100, 161))
    assert all(out[k] == 7 for k in range(1000, 1400))
    assert 5 not in out and 3 not in out


def test_components_without_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_label_conflict_and_spellings(spark):
    rows = flows()
    twin = list(rows[3])
    twin[0], twin[-2] = 500, "other"
    assert run(spark, rows + [tuple(twin)], "labels.conflict")[0].affected_rows == 2
    spelt = [tuple(x if x != "attack" or i % 2 else "At-tack" for x in r) for i, r in enumerate(rows)]
    spelt = [tuple("AT tack" if x == "attack" else x for x in r) for r in spelt]
    assert run(spark, spelt, "labels.taxonomy")[0].auto_fix == "normalize_labels"


def test_temporal_leak_and_its_fix(spark):
    rows = [(*r[:-3], r[9], r[10], "train" if i % 2 else "test") for i, r in enumerate(flows())]
    found = run(spark, rows, "leak.temporal")
    assert found and found[0].severity == "critical"
    fixed = fixes.apply_fix(data(spark, rows), "temporal_split").dataset
    assert checks.select("leak.temporal")[0].run(fixed) == []


def test_ambiguous_dates_are_skipped(spark):
    df = spark.createDataFrame([("01/02/2024",), ("03/01/2024",), ("02/05/2024",)], "t string")
    with pytest.raises(CheckSkipped, match="ambiguous"):
        leakage.time_column(df, "t")
    df = spark.createDataFrame([("13/02/2024",), ("03/01/2024",), ("25/05/2024",)], "t string")
    leakage.time_column(df, "t")
    df = spark.createDataFrame([("13/02/2024",), ("soon",)], "t string")
    with pytest.raises(CheckSkipped, match="can't be read"):
        leakage.time_column(df, "t")


def test_group_split_removes_session_leaks(spark):
    rows = [(*r[:4], "h", "p", i % 30, 80, 6, r[9], r[10], "train" if i % 2 else "test") for i, r in enumerate(flows())]
    rows = [(*r[:6], i % 30 // 2, *r[7:]) for i, r in enumerate(rows)]
    assert run(spark, rows, "leak.session")
    fixed = fixes.apply_fix(data(spark, rows), "group_split").dataset
    assert checks.select("leak.session")[0].run(fixed) == []


def test_shortcut_and_identifier(spark):
    rows = [(*r[:7], 80 if r[10] == "attack" else 443, *r[8:]) for r in flows()]
    found = run(spark, rows, "shortcut.single_feature")
    assert [f.metric["column"] for f in found] == ["dport"]
    d = Dataset(spark.createDataFrame([(1, "a", "x")], "flow_id long, src_ip string, label string"), Roles("label"))
    assert checks.select("shortcut.identifier")[0].run(d)[0].metric["columns"] == ["flow_id", "src_ip"]


def test_validity_findings(spark):
    rows = [(i, float("inf") if i == 0 else None if i < 3 else 1.0, 7, -5 if i == 4 else 3, "a") for i in range(50)]
    d = Dataset(spark.createDataFrame(rows, "id long, rate double, flat long, pkt_len long, label string"), Roles("label"))
    assert checks.select("validity.nan_inf")[0].run(d)[0].severity == "high"
    assert checks.select("validity.constant")[0].run(d)[0].metric["columns"] == ["flat"]
    assert checks.select("validity.impossible")[0].run(d)[0].affected_rows == 1
    assert validity.name_problems([" a", "a", "b"]) == {"spaces": [" a"], "collisions": ["a"]}


def test_drift_fires_and_stays_silent(spark):
    old = spark.range(3000).selectExpr("id", "(id * 37 % 997) / 10 AS v", "(id * 11 % 13) * 1.0 AS w", "CASE WHEN id % 4 = 0 THEN 'x' ELSE 'y' END AS label")
    new = old.selectExpr("id + 5000 AS id", "v * 3 AS v", "w", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'z' END AS label")
    d = Dataset(new, Roles("label"), reference=old, config={"row_id": "id"})
    report = audit.run_audit(d, ["drift.schema", "drift.feature", "drift.prior"], "drift")
    assert {f.check_id: f.severity for f in report.findings} == {"drift.feature": "high", "drift.prior": "high"}
    same = audit.run_audit(Dataset(old, Roles("label"), reference=old, config={"row_id": "id"}), ["drift.schema", "drift.feature", "drift.prior"], "drift")
    assert same.traffic_light == "green"
    none = audit.run_audit(Dataset(old, Roles("label")), "all", "drift")
    assert none.traffic_light == "grey" and len(none.skipped) == 5


def test_a_failing_check_is_an_error_and_others_run(spark, monkeypatch):
    def fails(d):
        raise RuntimeError("no")

    monkeypatch.setitem(checks._CHECKS, "validity.fails", checks.Check("validity.fails", "auditor", fails))
    report = audit.run_audit(data(spark, flows(40)), ["validity"])
    assert report.traffic_light == "red" and "no" in report.errors["validity.fails"]
    assert any(f.check_id == "validity.constant" for f in report.findings)
    assert report.exceeds("critical")


def test_registry_and_report():
    with pytest.raises(KeyError):
        checks.select("nope")
    with pytest.raises(ValueError):
        checks.register("dup.exact")(lambda d: [])
    assert len(checks.all_checks("auditor")) == 16 and len(checks.all_checks("poison")) == 4 and len(checks.all_checks("drift")) == 5
    assert [c.id for c in checks.all_checks("domain")] == ["drift.mmd", "flow.timeout", "labels.window", "leak.random_split", "poison.spectral", "shortcut.importance", "validity.types"]
    assert fixes.available_fixes() == sorted(
        ["drop_duplicates", "drop_identifiers", "drop_constant", "strip_column_names", "normalize_labels", "quarantine_noise", "temporal_split", "group_split", "relabel_window"])
    r = Report({"name": "<b>"}, {}, [Finding("b.x", "low", "l"), Finding("a.y", "high", "<i>"), Finding("a.x", "low", "k")])
    assert [f.check_id for f in r.ordered()] == ["a.y", "a.x", "b.x"] and r.traffic_light == "red"
    assert "<i>" not in audit.to_html(r) and "&lt;i&gt;" in audit.to_html(r)
    assert set(r.as_dict()) == {"schema_version", "dataset", "run", "summary", "findings", "skipped", "errors"}


def test_noise_is_found_and_quarantined(spark):
    rows = [(i, float(i % 100), float((i * 7) % 50), "low" if i % 100 < 50 else "high") for i in range(600)]
    rows = [(i, a, b, ("high" if y == "low" else "low") if i % 40 == 3 and abs(a - 49.5) > 20 else y) for i, a, b, y in rows]
    wrong = {r[0] for r in rows if (r[3] == "low") != (r[1] < 50)}
    d = Dataset(spark.createDataFrame(rows, "rid long, a double, b double, label string"), Roles("label"), config={"row_id": "rid"})
    out = fixes.apply_fix(d, "quarantine_noise", "rid")
    moved = {r.rid for r in out.quarantine.collect()}
    assert len(moved & wrong) >= 0.8 * len(wrong) and len(moved - wrong) <= len(wrong)
    assert out.dataset.df.count() + len(moved) == 600


def test_group_split_tells_hosts_that_are_on_both_sides(spark):
    rows = [(f"h{i % 2}", f"d{i}", i, 80, "tcp", "a") for i in range(40)]
    d = Dataset(spark.createDataFrame(rows, "src string, dst string, sport long, dport long, proto string, label string"),
                Roles(label="label", src_ip="src", dst_ip="dst", src_port="sport", dst_port="dport", protocol="proto"))
    assert fixes.apply_fix(d, "group_split").after == {"hosts_on_both_sides": {"dst": 0, "src": 2}}


def test_quarantine_in_a_comparison_spares_the_test_rows(spark):
    from plumbline.operators import compare

    rows = [(i, float(i % 100), float((i * 7) % 50), "low" if (i % 100 < 50) != (i % 40 == 3) else "high", "train" if i % 3 else "test") for i in range(900)]
    d = Dataset(spark.createDataFrame(rows, "rid long, a double, b double, label string, split string"), Roles(label="label", split="split"), config={"row_id": "rid"})
    out = {r.stage: r for r in compare.compare(d, ["quarantine_noise"], "low", row_id="rid").collect()}
    assert out["before"].n == out["after"].n == 300 and not out["after"].test_changed
    assert set(out["after"].recall) == {"low", "high"}
    assert all(r.test_changed for r in compare.compare(d.with_df(d.df.unionByName(d.df)), ["drop_duplicates"], "low", row_id="rid").collect())


def test_a_comparison_learns_from_equal_rows_once_and_from_their_number(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import compare

    counted = spark.createDataFrame([(1.0, 5), (2.0, 100), (3.0, 1)], "a double, n long")
    got = compare.drawn(counted, ["a"]).groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.sum("__w").alias("w"), F.max("__w").alias("most")).collect()
    assert {r.a: (r.k, r.w, r.most) for r in got} == {1.0: (5, 5.0, 1.0), 2.0: (compare.SHARES, 100.0, 4.0), 3.0: (1, 1.0, 1.0)}
    rows = [(i, float(i * 7919 % 11), "xy"[i * 31 % 7 % 2], "low" if i * 104729 % 97 < 50 else "high", ("train", "test", None)[i % 3]) for i in range(1200)]
    df = spark.createDataFrame(rows, "rid long, a double, b string, label string, split string")
    told = []
    for parts in (1, 7):
        d = Dataset(df.repartition(parts), Roles(label="label", split="split"), config={"row_id": "rid"})
        found = compare.predictions(d, row_id="rid")
        told.append(sorted(found.collect()))
        assert found.agg(F.sum("n")).first()[0] == 400 and found.count() < 50
    assert told[0] == told[1]


def test_concept_drift_scores_equal_rows_once_by_their_number(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import drift

    rows = [(i, float(i % 20), float(i * 7 % 5) if i % 50 else None, "ab"[(i % 20 > 9) != (i * 31 % 97 < 20)] if i % 41 else None) for i in range(2000)]
    both = [(i + 5000 * k, a + 0.5 * k, b, y) for k in (0, 1) for i, a, b, y in rows] + [(9999, 1.0, 2.0, "a")]  # the last is a row of the reference
    df = spark.createDataFrame(both, "rid long, a double, b double, label string")
    told = []
    for parts in (1, 7):
        old, new = (df.where(f"rid {o} 5000").repartition(parts) for o in ("<", ">="))
        found = drift.concept_scores(old, new, ["a", "b"], "label", "rid", cap=500)
        told.append(sorted(found.collect()))
    known = sum(y is not None for *_, y in rows)
    assert told[0] == told[1] and len(told[0]) <= 8
    assert {k: sum(r.n for r in told[0] if r.side == k) for k in (0, 1)} == {0: known, 1: known}
    by_class = {r.label: r for r in drift.recalls(found).collect()}
    assert sum(r.n_reference for r in by_class.values()) == known
    one = found.select("side", "label", "hit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    assert {r.label: r for r in drift.recalls(one.drop("col")).collect()} == by_class


def test_loss_needs_three_rows_of_each_class(spark):
    rows = [(i, float(i), float(i % 5), "a" if i > 1 else "b") for i in range(50)]
    d = Dataset(spark.createDataFrame(rows, "rid long, a double, b double, label string"), Roles(label="label"), config={"row_id": "rid"})
    report = audit.run_audit(d, ["poison.loss"], "poison")
    assert not report.findings and not report.errors and "3 rows" in report.skipped["poison.loss"]
