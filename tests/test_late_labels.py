"""A stream of predictions and a later stream of labels give what the tables give."""

import datetime as dt
import random

import pytest

from plumbline.streaming import late_labels

START = dt.datetime(2024, 1, 1)


def sides():
    rng = random.Random(5)
    predictions, labels = [], []
    for i in range(2000):
        at = START + dt.timedelta(seconds=60 * i)
        true = rng.choice("abc")
        wrong = 0.6 if 800 <= i < 1200 else 0.1  # worse for a while
        predictions.append((i, at, rng.choice("abc") if rng.random() < wrong else true))
        delay = dt.timedelta(minutes=rng.choice([1, 30, 300, 900, 1500]))  # the last comes too late
        if rng.random() < 0.9:
            labels.append((i, true if rng.random() < 0.98 else None, at + delay))
    return predictions, labels


def test_tables_equal_a_loop(spark):
    predictions, labels = sides()
    p = spark.createDataFrame(predictions, "id long, t timestamp, predicted string")
    lab = spark.createDataFrame(labels, "id long, label string, told timestamp")
    counted = late_labels.confusions(late_labels.matched(p, lab, "id", "t", "told", "1 day"), "t", "predicted", "2 hours")
    got = {r.start: r for r in late_labels.performance(counted, 0.9).collect()}
    by = {}
    told = {i: (x, at) for i, x, at in labels}
    for i, at, guess in predictions:
        if i in told and told[i][0] and told[i][1] <= at + dt.timedelta(days=1):
            by.setdefault(START + dt.timedelta(hours=2 * ((at - START) // dt.timedelta(hours=2))), []).append((told[i][0], guess))
    assert set(got) == set(by) and len(by) == 17
    for start, pairs in by.items():
        f1 = [2 * sum(t == c == g for t, g in pairs) / (sum(t == c for t, _ in pairs) + sum(g == c for _, g in pairs)) for c in {t for t, _ in pairs}]
        assert got[start].n == len(pairs) and got[start].f1_macro == pytest.approx(sum(f1) / len(f1))
        assert got[start].accuracy == pytest.approx(sum(t == g for t, g in pairs) / len(pairs))
    alerts = {s for s, r in got.items() if r.alert}
    assert alerts and all(800 - 120 <= (s - START).total_seconds() / 60 < 1200 for s in alerts)


def test_streams_equal_tables(spark, tmp_path):
    predictions, labels = sides()
    p = spark.createDataFrame(predictions, "id long, t timestamp, predicted string")
    lab = spark.createDataFrame(labels, "id long, label string, told timestamp")
    want = late_labels.confusions(late_labels.matched(p, lab, "id", "t", "told", "1 day"), "t", "predicted", "2 hours")
    end = START + dt.timedelta(days=9)
    for name, frame, time in (("p", p, "t"), ("l", lab, "told")):
        for k in range(4):  # four files each, in the order of time, and one that moves the watermark to the end
            low, high = START + dt.timedelta(hours=10 * k), START + dt.timedelta(hours=10 * (k + 1) if k < 3 else 999)
            frame.where((frame[time] >= low) & (frame[time] < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    spark.createDataFrame([(-1, end, "x")], p.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    spark.createDataFrame([(-2, "x", end)], lab.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    streams = [spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, f in (("p", p), ("l", lab))]
    counted = late_labels.confusions(late_labels.matched(*streams, "id", "t", "told", "1 day"), "t", "predicted", "2 hours")
    query = counted.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    key = lambda r: (r.start, r.label, r.predicted, r.n)
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(key, want.collect()))
