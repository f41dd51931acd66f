"""Queries of what is known of flows besides their columns: windows, time-outs, captures, splits drawn by lot, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import density, drift, flows, importance, leakage, poison, validity, windows
from plumbline.plans.registry import over, query, rounded, vectors
from plumbline.streaming import change_detectors, late_labels

# Windows of two hours after each error of a user, and short ones for everybody after a few sign-ups; times are seconds.
MICROS = "unix_micros(from_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone()))"  # of the clock's face, whatever the session's zone
SECONDS = f"CAST({MICROS} AS DOUBLE) / 1000000"
SQL_SECONDS = "CAST(epoch_us(ts) AS DOUBLE) / 1000000"
WINDOWS = """SELECT 'Probe-' || CAST(event_id % 3 AS STRING) AS label, {s} AS start, {s} + 7200 AS `end`, CAST(user_id AS STRING) AS host,
 CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 7 AS STRING) END AS peer, CAST(event_id % 2 AS INT) AS precedence FROM events WHERE event_type = 'error'
 UNION ALL SELECT 'Flood', {s}, {s} + 600, CAST(NULL AS STRING), CAST(NULL AS STRING), 1 FROM events WHERE event_type = 'signup' AND value > 90"""
LABELLED = """SELECT event_id, {s} AS t, CAST(user_id AS STRING) AS host, CAST(event_id % 7 AS STRING) AS peer,
 CASE event_type WHEN 'error' THEN 'probe ' || CAST(event_id % 3 AS STRING) WHEN 'purchase' THEN 'Flood' WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN 'Normal' END AS label FROM events"""
JUDGED_SQL = f"""WITH w AS ({WINDOWS.format(s=SQL_SECONDS).replace('`', '"').replace('AS STRING', 'AS VARCHAR')}), e AS ({LABELLED.format(s=SQL_SECONDS).replace('AS STRING', 'AS VARCHAR')}),
 j AS (SELECT e.event_id, w.label AS expected, row_number() OVER (PARTITION BY e.event_id ORDER BY w.precedence, w.start, w."end", w.label) AS r
  FROM e JOIN w ON (w.host IS NULL OR w.host = e.host) AND (w.peer IS NULL OR w.peer = e.peer) AND e.t BETWEEN w.start AND w."end"),
 x AS (SELECT e.*, expected, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(expected), '[^a-z0-9]+', ' ', 'g')) AS b FROM e LEFT JOIN (SELECT * FROM j WHERE r = 1) USING (event_id)),
 v AS (SELECT *, CASE WHEN label IS NULL THEN NULL WHEN expected IS NULL THEN CASE WHEN a NOT IN ('benign', 'normal', 'background', '0') THEN 'outside' END
  WHEN a IN ('benign', 'normal', 'background', '0') THEN 'inside' WHEN a <> b THEN 'other' END AS verdict FROM x)"""


def _judged(spark, sf_dir):
    given = over(spark, sf_dir, WINDOWS.format(s=SECONDS), "events")
    df = over(spark, sf_dir, LABELLED.format(s=SECONDS), "events")
    return windows.verdicts(windows.expected(df, F.col("t"), F.col("host"), given, F.col("peer")), "label")


@query(JUDGED_SQL + " SELECT event_id, label, expected, verdict FROM v")
def labels_window(spark, sf_dir):
    return _judged(spark, sf_dir).select("event_id", "label", "expected", "verdict")


@query(JUDGED_SQL + " SELECT event_id, CASE WHEN verdict IS NULL THEN label ELSE coalesce(expected, 'BENIGN') END AS label FROM v")
def relabel_window(spark, sf_dir):
    return windows.relabel(_judged(spark, sf_dir), "label", "BENIGN").select("event_id", "label")


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type, {SQL_SECONDS} AS s, {SQL_SECONDS} + value * 60 AS e FROM events),
 b AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e),
 i AS (SELECT *, sum(CASE WHEN reached IS NULL OR s - reached > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS n FROM b)
SELECT arg_min(event_id, (s, event_id)) AS first_id, count(*) AS n_records, round(min(s), 6) AS start, round(max(e), 6) AS "end" FROM i GROUP BY user_id, event_type, n HAVING count(*) > 1"""
)
def flow_timeout(spark, sf_dir):
    df = over(spark, sf_dir, f"SELECT event_id, user_id, event_type, {SECONDS} AS s, {SECONDS} + value * 60 AS e FROM events", "events")
    return rounded(flows.cut_by_timeout(df, ["user_id", "event_type"], F.col("s"), F.col("e"), 3600.0, "event_id"), "start", "end")


# Packets of few hosts, a day apart at most; idle after three hours, active for two days.
_AHEAD = "event_type IN ('view', 'click')"
PACKETS = f"""SELECT event_id AS number, {{t}} AS time, CASE WHEN {_AHEAD} THEN '10.0.0.' || CAST(user_id % 20 AS STRING) ELSE '10.1.0.' || CAST(user_id % 3 AS STRING) END AS src_ip,
 CASE WHEN {_AHEAD} THEN '10.1.0.' || CAST(user_id % 3 AS STRING) ELSE '10.0.0.' || CAST(user_id % 20 AS STRING) END AS dst_ip, CASE WHEN {_AHEAD} THEN 1000 ELSE 80 END AS src_port,
 CASE WHEN {_AHEAD} THEN 80 ELSE 1000 END AS dst_port, 6 AS protocol, CAST(floor(value * 10) AS BIGINT) + 40 AS length, CAST(event_id % 32 AS INT) AS flags FROM events"""
_FLAG_SUMS = ", ".join(f"CAST(count(*) FILTER (WHERE flags & {1 << k} <> 0) AS BIGINT) AS bidirectional_{name}_packets" for k, name in enumerate(flows.FLAGS))


@query(
    f"""WITH RECURSIVE p AS ({PACKETS.format(t='epoch_us(ts)').replace('AS STRING', 'AS VARCHAR')}), k AS (SELECT *, least(src_ip, dst_ip) || greatest(src_ip, dst_ip) AS key FROM p),
 g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY key ORDER BY time, number) > 10800000000 THEN 1 ELSE 0 END AS new FROM k),
 i AS (SELECT *, key || '/' || sum(new) OVER (PARTITION BY key ORDER BY time, number) AS island FROM g),
 s(island, begun) AS (SELECT island, min(time) FROM i GROUP BY island UNION ALL
  SELECT s.island, min(i.time) FROM s JOIN i ON i.island = s.island AND i.time >= s.begun + 172800000000 GROUP BY s.island, s.begun),
 f AS (SELECT i.*, (SELECT max(begun) FROM s WHERE s.island = i.island AND s.begun <= i.time) AS begun FROM i),
 d AS (SELECT *, first_value(src_ip) OVER w AS a, first_value(src_port) OVER w AS a_port, first_value(dst_ip) OVER w AS b, first_value(dst_port) OVER w AS b_port FROM f WINDOW w AS (PARTITION BY island, begun ORDER BY time, number))
SELECT a AS src_ip, a_port AS src_port, b AS dst_ip, b_port AS dst_port, protocol, min(time) // 1000 AS bidirectional_first_seen_ms, max(time) // 1000 AS bidirectional_last_seen_ms,
 (max(time) - min(time)) // 1000 AS bidirectional_duration_ms, count(*) AS bidirectional_packets, CAST(sum(length) AS BIGINT) AS bidirectional_bytes,
 CAST(count(*) FILTER (WHERE src_ip = a) AS BIGINT) AS src2dst_packets, CAST(coalesce(sum(length) FILTER (WHERE src_ip = a), 0) AS BIGINT) AS src2dst_bytes,
 CAST(count(*) FILTER (WHERE src_ip <> a) AS BIGINT) AS dst2src_packets, CAST(coalesce(sum(length) FILTER (WHERE src_ip <> a), 0) AS BIGINT) AS dst2src_bytes,
 min(length) AS bidirectional_min_ps, round(avg(length), 6) AS bidirectional_mean_ps, round(coalesce(stddev_samp(length), 0), 4) AS bidirectional_stddev_ps, max(length) AS bidirectional_max_ps, {_FLAG_SUMS}
FROM d GROUP BY island, begun, a, a_port, b, b_port, protocol"""
)
def packet_flows(spark, sf_dir):
    packets = over(spark, sf_dir, PACKETS.format(t=MICROS), "events")
    out = rounded(flows.assemble(packets, 10_800.0, 172_800.0), "bidirectional_mean_ps")
    return out.withColumn("bidirectional_stddev_ps", F.round("bidirectional_stddev_ps", 4) + F.lit(0.0))


# A split by lot and labels that hang together: a day's events of one label.
SPLIT_ROWS = """SELECT event_id, ts, CASE WHEN event_id * 7919 % 1000 < 700 THEN 'train' ELSE 'test' END AS split, CASE WHEN {day} % 3 = 0 THEN 'attack' WHEN value > 99 THEN 'attack' ELSE 'benign' END AS label FROM events"""
_RUNS = """(SELECT count(*) FILTER (WHERE last IS NULL OR last <> {v}) AS runs FROM (SELECT {v}, lag({v}) OVER (ORDER BY ts, event_id) AS last FROM e)) {a}"""
_Z = """(SELECT n, k, ({a}.runs - (n * (n + 1) - s2) / n) / sqrt((s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n * n * n) / (n * n * (n - 1))) AS z FROM (SELECT CAST(sum(m) AS DOUBLE) AS n, count(*) AS k, CAST(sum(m * m) AS DOUBLE) AS s2, CAST(sum(m * m * m) AS DOUBLE) AS s3
 FROM (SELECT CAST(count(*) AS HUGEINT) AS m FROM e GROUP BY {v})), {a}) z_{a}"""


@query(
    f"""WITH e AS ({SPLIT_ROWS.format(day='dayofyear(ts)')}), a AS (SELECT * FROM {_RUNS.format(v='split', a='x')}), b AS (SELECT * FROM {_RUNS.format(v='label', a='x')})
SELECT CAST(z_a.n AS BIGINT) AS n, a.runs AS split_runs, round(z_a.z, 6) AS split_z, b.runs AS label_runs, round(z_b.z, 6) AS label_z, abs(z_a.z) <= 3 AND z_b.z <= -3 AND z_a.k = 2 AS by_lot
FROM a, b, {_Z.format(v='split', a='a')}, {_Z.format(v='label', a='b')}"""
)
def leak_random_split(spark, sf_dir):
    df = over(spark, sf_dir, SPLIT_ROWS.format(day="dayofyear(ts)"), "events")
    return rounded(leakage.random_split(df, F.col("ts"), "split", "label", "event_id"), "split_z", "label_z")


@query()
def poison_spectral(spark, sf_dir):
    return rounded(poison.spectral(vectors(spark, sf_dir)), "score")


@query(
    """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_mktsegment AS y, c_acctbal / 1000 AS a, c_nationkey / 5.0 AS b FROM customer),
 n AS (SELECT u.id AS i, v.id AS j FROM p u JOIN p v ON u.y = v.y AND sqrt((u.a - v.a) * (u.a - v.a) + (u.b - v.b) * (u.b - v.b)) <= 0.3),
 c AS (SELECT i AS id FROM n GROUP BY i HAVING count(*) >= 6), e AS (SELECT i, j FROM n WHERE i IN (SELECT id FROM c) AND j IN (SELECT id FROM c)),
 r(id, root) AS (SELECT id, id FROM c UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.id WHERE r.root < e.j), k AS (SELECT id, min(root) AS cluster FROM r GROUP BY id),
 o AS (SELECT n.i AS id, min(k.cluster) AS cluster FROM n JOIN k ON k.id = n.j WHERE n.i NOT IN (SELECT id FROM c) GROUP BY n.i)
SELECT p.id AS row_id, y, k.id IS NOT NULL AS core, coalesce(k.cluster, o.cluster, -1) AS cluster FROM p LEFT JOIN k ON k.id = p.id LEFT JOIN o ON o.id = p.id"""
)
def poison_dbscan(spark, sf_dir):
    """DBSCAN of customers by segment, at a given eps; -1 for no cluster."""
    df = over(spark, sf_dir, "SELECT c_custkey AS row_id, c_mktsegment AS y, array(c_acctbal / 1000, c_nationkey / 5D) AS x FROM customer", "customer")
    eps = df.select("y").distinct().withColumn("eps", F.lit(0.3))
    return density.dbscan(df, eps, 6).fillna(-1, ["cluster"])


TYPED = """SELECT CAST(event_id AS STRING) AS a, ' ' || CAST(value AS STRING) AS b, CASE WHEN event_id % 200 = 0 THEN 'n/a' ELSE CAST(user_id AS STRING) END AS c,
 CASE WHEN event_id % 3 = 0 THEN 'Yes' WHEN event_id % 3 = 1 THEN 'no' END AS d, '10.0.' || CAST(user_id % 256 AS STRING) || '.7' AS e, substr(CAST(ts AS STRING), 1, 19) AS f,
 event_type AS g, CAST(NULL AS STRING) AS h, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(user_id AS STRING) END AS i FROM events"""


def _kinds_sql() -> str:
    """The counts of every kind for every column, and the narrowest that covers."""
    columns = "abcdefghi"
    cells = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS raw, trim({c}) AS v FROM t""" for c in columns)
    hit = {k: f"regexp_matches(v, '{p}')" for k, p in validity.KINDS.items()}
    hit["number"] = f"({hit['number']} OR {hit['whole']})"
    counts = ", ".join(f"count(*) FILTER (WHERE v <> '' AND {h}) AS n_{k}, min(v) FILTER (WHERE v <> '' AND NOT {h}) AS odd_{k}" for k, h in hit.items())
    pick = lambda value, other: "CASE " + " ".join(f"WHEN n_values > 0 AND n_{k} >= {validity.COVERS} * n_values THEN {value(k)}" for k in hit) + f" ELSE {other} END"
    return f"""WITH t AS ({TYPED.replace('AS STRING', 'AS VARCHAR')}), s AS ({cells}),
 c AS (SELECT "column", count(*) FILTER (WHERE v <> '') AS n_values, count(*) FILTER (WHERE v <> '' AND v <> raw) AS n_padded, {counts} FROM s GROUP BY "column")
SELECT "column", n_values, n_padded, {pick(lambda k: f"'{k}'", "'text'")} AS kind, {pick(lambda k: f'n_values - n_{k}', '0')} AS n_odd, {pick(lambda k: f'odd_{k}', 'NULL')} AS odd_example FROM c"""


@query(_kinds_sql())
def validity_types(spark, sf_dir):
    return validity.kinds_of(over(spark, sf_dir, TYPED, "events"), list("abcdefghi"))


@query()
def shortcut_importance(spark, sf_dir):
    """What a forest tells late deliveries by: the day of receipt, while price and tax say nothing."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "days", "wait"]
    df = over(spark, sf_dir, """SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity, l_extendedprice, l_discount, l_tax, datediff(l_shipdate, DATE'1992-01-01') AS days,
 l_orderkey % 30 AS wait, CASE WHEN l_orderkey % 30 > 20 AND l_quantity > 10 THEN 'late' WHEN l_linenumber = 9 THEN NULL ELSE 'fine' END AS label FROM lineitem""", "lineitem")
    model, _, _ = importance.baseline(df, columns, "label", "row_id")
    found = importance.importance(df.where("label IS NOT NULL"), columns, importance.paths_of(importance.forest_nodes(model), importance.DEPTH))
    return rounded(found, "importance", "share")


@query()
def drift_mmd(spark, sf_dir):
    """Two halves of the events, and one half against the other with its value moved."""
    rows = over(spark, sf_dir, "SELECT event_id, value AS a, CAST(user_id AS DOUBLE) AS b, event_id % 2 AS half FROM events", "events")
    one, two = rows.where("half = 0"), rows.where("half = 1")
    moved = two.withColumn("a", F.col("a") * 1.5)
    found = [(name, drift.mmd(one, other, ["a", "b"], "event_id")) for name, other in (("same", two), ("moved", moved))]
    cells = [(name, r["n_reference"], r["n_batch"], r["mmd2"], r["limit"], r["drifted"]) for name, r in found]
    return rounded(spark.createDataFrame(cells, "batch string, n_reference long, n_batch long, mmd2 double, limit double, drifted boolean"), "mmd2", "limit")


@query()
def drift_changes(spark, sf_dir):
    """Changes of the events' values by type, which rise for a while in the middle."""
    rows = over(spark, sf_dir, f"SELECT event_type, event_id, {SECONDS} AS s, value + CASE WHEN dayofyear(ts) BETWEEN 10 AND 20 AND event_type IN ('view', 'error') THEN 40 ELSE 0 END AS value FROM events", "events")
    return rounded(change_detectors.changes(rows, "event_type", "s", "value", ["event_id"], "window", 43_200.0), "before", "after")


LATE = """WITH p AS (SELECT event_id AS id, ts, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS predicted FROM events),
 l AS (SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN value > CASE WHEN dayofyear(ts) BETWEEN 10 AND 15 THEN 80 ELSE 52 END THEN 'high' ELSE 'low' END AS label, ts + {delay} AS told FROM events)"""


@query(
    LATE.format(delay="to_hours(CAST(event_id % 40 AS BIGINT))")
    + """, m AS (SELECT date_trunc('day', ts) AS start, label, predicted FROM p JOIN l USING (id) WHERE label IS NOT NULL AND told >= ts AND told <= ts + INTERVAL 1 DAY),
 t AS (SELECT start, label AS class, count(*) AS t, count(*) FILTER (WHERE label = predicted) AS h FROM m GROUP BY start, label), s AS (SELECT start, predicted AS class, count(*) AS s FROM m GROUP BY start, predicted)
SELECT start, CAST(sum(t) AS BIGINT) AS n, round(sum(h) / sum(t), 6) AS accuracy, round(avg(2.0 * h / (t + coalesce(s, 0))), 6) AS f1_macro, sum(t) >= 30 AND avg(2.0 * h / (t + coalesce(s, 0))) < 0.8 AS alert FROM t LEFT JOIN s USING (start, class) GROUP BY start"""
)
def drift_late_labels(spark, sf_dir):
    p = over(spark, sf_dir, "SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS predicted FROM events", "events")
    told = over(spark, sf_dir, """SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN value > CASE WHEN dayofyear(ts) BETWEEN 10 AND 15 THEN 80 ELSE 52 END THEN 'high' ELSE 'low' END AS label,
 CAST(ts AS TIMESTAMP) + make_dt_interval(0, CAST(event_id % 40 AS INT)) AS told FROM events""", "events")
    counted = late_labels.confusions(late_labels.matched(p, told, "id", "ts", "told", "1 day"), "ts", "predicted", "1 day")
    return rounded(late_labels.performance(counted, 0.9).withColumn("start", F.col("start").cast("timestamp_ntz")), "accuracy", "f1_macro")
