"""Change points equal a plain run's, in a table and in a stream of micro-batches with a restart; steady values show none."""

import datetime as dt
import random

import pytest

from plumbline.streaming import change_detectors as detectors

START = dt.datetime(2024, 1, 1)


def rows(keys=("a", "b", None), n=900):
    """Three keys: one changes twice, one once, one never."""
    out = []
    for j, key in enumerate(keys):
        rng = random.Random(j)
        for i in range(n):
            level = 0.0 if key is None else 6.0 if i > 400 and key == "a" and i < 700 else 3.0 if i > 500 and key == "b" else 0.0
            out.append((key, START + dt.timedelta(seconds=30 * i), level + rng.gauss(0, 1), j * n + i))
    return out


def plain(rows, detector, calm):
    """Every key followed by itself, in one go."""
    out = []
    for key in {r[0] for r in rows}:
        follower = detectors.Follower(detector, calm)
        for _, t, x, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            out += [(key, *r) for r in follower.add((t - dt.datetime(1970, 1, 1)).total_seconds(), x)]
    return out


def told(frame):
    return sorted((str(r.key), r.time, r.event, r.before, r.after, r.n) for r in frame.collect())


@pytest.mark.parametrize("detector", ["window", "page_hinkley"])
def test_a_table_gives_the_cut_points_of_a_plain_run(spark, detector):
    data = rows()
    want = plain(data, detector, 900.0)
    opened = [r for r in want if r[2] == "opened"]
    assert {r[0] for r in opened} == {"a", "b"} and {r[2] for r in want} >= {"opened"} and any(r[2] == "closed" for r in want)
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, x double, id long").selectExpr("k", "CAST(unix_micros(CAST(t AS timestamp)) AS double) / 1000000 AS t", "x", "id")
    got = detectors.changes(df.repartition(5), "k", "t", "x", ["id"], detector, 900.0)
    assert told(got) == sorted((str(r[0]), *r[1:]) for r in want)


def test_a_window_forgets_what_came_before_a_change():
    window, rng = detectors.AdaptiveWindow(), random.Random(1)
    found = [i for i in range(4000) if window.add((5.0 if i >= 2000 else 0.0) + rng.gauss(0, 1))]
    assert found and 2000 < found[0] < 2100 and not [i for i in found if i < 2000]
    assert sum(b[0] for row in window.sizes for b in row) <= 2100 and max(map(len, window.sizes)) <= detectors.PER_SIZE


def test_a_stream_with_a_restart_gives_the_same(spark, tmp_path):
    data = rows(("a", "b"))
    source, sink, state = (str(tmp_path / n) for n in ("source", "sink", "state"))
    frame = spark.createDataFrame(data, "k string, t timestamp, x double, id long").orderBy("t")
    parts = sorted(data, key=lambda r: r[1])
    for k in range(6):  # six micro-batches; the query is started three times
        own = parts[k * 300 : (k + 1) * 300]
        spark.createDataFrame(own, frame.schema).coalesce(1).write.mode("append").parquet(source)
        if k % 2:
            stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
            found = detectors.watch(stream, "k", "t", "x", "1 seconds", "window", 900.0, "id")
            query = found.writeStream.format("parquet").option("checkpointLocation", state).option("path", sink).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    got = told(spark.read.parquet(sink))
    want = sorted((str(r[0]), *r[1:]) for r in plain(data, "window", 900.0))
    changes = lambda found: [r for r in found if r[2] != "closed"]
    assert changes(got) == changes(want) and len(changes(got)) >= 3
    assert {r for r in got if r[2] == "closed"} >= {r for r in want if r[2] == "closed"}
