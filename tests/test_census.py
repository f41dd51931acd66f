"""A census tells what its checks tell by themselves, and an audit reads its table fewer times for the same findings."""

import random
from dataclasses import replace

import pytest

from plumbline.model import Dataset, Roles
from plumbline.operators import census, duplicates, labels
from plumbline.plans import audit, shared

WANTED = ["validity", "dup.exact", "dup.cross_split", "labels.conflict", "labels.taxonomy", "labels.imbalance"]
SCHEMA = "rid long, a double, bytes long, c string, same int, label string, split string"


def table(spark, rows=400, seed=5):
    rng = random.Random(seed)
    pick = rng.choice
    made = [(i, pick([0.0, -0.0, 1.5, None, float("nan"), float("inf")]), pick([-5, 7, None]), pick(["x", "y", None]), 4, pick(["DoS", "dos", "Scan", None]), pick(["train", "test", "dev", None])) for i in range(rows)]
    return spark.createDataFrame(made, SCHEMA)


def told(report):
    return [(f.check_id, f.severity, f.title, f.affected_rows, f.metric, f.examples) for f in report.ordered()], report.skipped, report.errors


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("rows,keys", [(400, ["a", "bytes", "c"]), (30, ["a", "rid"]), (0, ["a", "c"])])
def test_census_tells_what_each_plan_tells(spark, rows, keys):
    df = table(spark, rows)
    counted = census.row_census(df, keys, "label", "split").repartition(3)
    assert rows_of(census.exact(counted)) == rows_of(duplicates.exact(df, [*keys, "label"]))
    assert rows_of(census.class_ratio(counted, 0.2, 2)) == rows_of(duplicates.class_ratio(df, keys, "label", 0.2, 2))
    assert rows_of(census.cross_split(counted)) == rows_of(duplicates.cross_split(df, [*keys, "label"], "split").select(census.cross_split(counted).columns))
    assert rows_of(census.conflicts(counted)) == rows_of(labels.conflicts(df, keys, "label"))
    assert rows_of(census.conflict_pairs(counted)) == rows_of(labels.conflict_pairs(df, keys, "label"))
    assert rows_of(census.label_counts(counted)) == rows_of(labels.label_counts(df, "label"))
    bare = census.row_census(df, keys, None, None)
    assert rows_of(census.exact(bare)) == rows_of(duplicates.exact(df, keys))
    assert bare.columns == ["labels"]


def passes(spark, df, monkeypatch, share):
    """(what the audit tells, how often it read the table's rows)."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    data = Dataset(df.mapInArrow(through, df.schema), Roles("label", "split"), config={"row_id": "rid", "min_class_examples": 200})
    with monkeypatch.context() as patched:
        if not share:
            patched.setattr(shared.Shared, "rows", None)
            patched.setattr(shared.Shared, "facts", None)
        return told(audit.run_audit(data, WANTED)), read.value / df.count()


def test_an_audit_that_shares_reads_less_and_finds_the_same(spark, monkeypatch):
    df = table(spark).repartition(4).persist()
    alone, many = passes(spark, df, monkeypatch, False)
    together, few = passes(spark, df, monkeypatch, True)
    assert together == alone and len(together[0]) >= 7 and not together[2]
    assert few <= 5 < 10 < many, (few, many)  # rows for the report, the columns' facts, labels' number, the census, splits' names
    df.unpersist()


def test_too_many_labels_and_no_identity_are_not_shared(spark, monkeypatch):
    monkeypatch.setattr(census, "MOST_LABELS", 2)
    data = Dataset(table(spark), Roles("label", "split"), config={"row_id": "rid"})
    assert shared.Shared(data, set(WANTED) | shared.OF_ROWS).rows is None
    only = Dataset(table(spark).select("rid", "label", "split"), Roles("label", "split"), config={"row_id": "rid"})
    report = audit.run_audit(only, WANTED)
    assert "dup.exact" in report.skipped and "labels.taxonomy" in {f.check_id for f in report.findings} and not report.errors
    assert shared.Shared(data, {"dup.exact"}).rows is None and shared.Shared(data, {"validity.constant"}).facts is None
    assert replace(data, shared=shared.Shared(data, set())).with_df(data.df).shared is None
