"""Every query of the library outside the corpus subpackage, over whole tables, with its SQL.

Roles are given to the star-schema tables: lineitem's flags are labels, an
order's number tells its split. Defects that the tables lack are derived from
columns, the same way in Spark and in SQL. Doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import census, compare, drift, duplicates, labels, leakage, ml, poison, shortcuts, splits, validity
from plumbline.session import cut, read_table
from plumbline.sources.suricata import flatten

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from plumbline.plans import registry_domain  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: _SQL[name] for name in queries() if name in _SQL}


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


SPLIT = "CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'test' END"
KEYS = ["l_quantity", "l_discount", "l_tax"]
DEFECTS = """SELECT l_orderkey,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 5 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END AS rate_a,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 5 THEN CAST('-Infinity' AS DOUBLE) ELSE l_tax END AS rate_b,
 CASE WHEN l_quantity > 45 THEN NULL ELSE l_discount END AS rate_c, l_extendedprice AS price FROM lineitem"""


def over(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A SELECT over the given tables, by their names."""
    return spark.sql(_named(sql, tables), **{t: read_table(spark, sf_dir, t) for t in tables})


def _named(sql: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return sql


def lineitem(spark: SparkSession, sf_dir: str, more: str = "") -> DataFrame:
    return over(spark, sf_dir, f"SELECT *, {SPLIT} AS split {more} FROM lineitem", "lineitem")


@query(
    f"""WITH t AS ({DEFECTS}), s AS (
 SELECT 'rate_a' AS c, rate_a AS v FROM t UNION ALL SELECT 'rate_b', rate_b FROM t UNION ALL SELECT 'rate_c', rate_c FROM t UNION ALL SELECT 'price', price FROM t),
 a AS (SELECT c, CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS n_null, CAST(count(*) FILTER (WHERE isnan(v)) AS BIGINT) AS n_nan,
  CAST(count(*) FILTER (WHERE isinf(v)) AS BIGINT) AS n_inf, count(*) AS n FROM s GROUP BY c),
 b AS (SELECT *, n_null + n_nan + n_inf AS n_bad FROM a)
SELECT string_agg(c, ',' ORDER BY c) AS columns, count(*) AS n_columns, n_null, n_nan, n_inf, n_bad, round(n_bad / n, 6) AS ratio,
 CASE WHEN n_inf > 0 OR n_bad / n >= 0.05 THEN 'high' WHEN n_bad / n >= 0.01 THEN 'medium' ELSE 'low' END AS severity
FROM b WHERE n_bad > 0 GROUP BY n_null, n_nan, n_inf, n_bad, n"""
)
def nan_inf(spark, sf_dir):
    df = over(spark, sf_dir, DEFECTS, "lineitem")
    out = validity.nan_inf_groups(df, ["rate_a", "rate_b", "rate_c", "price"])
    return rounded(out, "ratio").select("columns", "n_columns", "n_null", "n_nan", "n_inf", "n_bad", "ratio", "severity")


@query(
    """WITH s AS (SELECT 'l_quantity' AS "column", CAST(l_quantity AS VARCHAR) AS v FROM lineitem UNION ALL SELECT 'flat', '7' FROM lineitem
 UNION ALL SELECT 'half', CASE WHEN l_linenumber % 2 = 0 THEN 'x' END FROM lineitem UNION ALL SELECT 'none', NULL FROM lineitem)
SELECT "column", count(*) AS n_rows, CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS n_null FROM s GROUP BY "column" HAVING count(DISTINCT v) <= 1"""
)
def constant_columns(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT l_quantity, 7 AS flat, CASE WHEN l_linenumber % 2 = 0 THEN 'x' END AS half, CAST(NULL AS STRING) AS none FROM lineitem", "lineitem")
    return validity.constant(df, df.columns)


@query(
    """WITH t AS (SELECT c_acctbal AS byte_balance, CAST(c_custkey * 50 AS DOUBLE) AS dst_port, CAST(CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_nationkey - 2 END AS DOUBLE) AS init_win_bytes_fwd, c_acctbal AS other FROM customer),
 s AS (SELECT 'byte_balance' AS "column", byte_balance AS v, 0.0 AS lo, CAST(NULL AS DOUBLE) AS hi FROM t UNION ALL SELECT 'dst_port', dst_port, 0.0, 65535.0 FROM t UNION ALL SELECT 'init_win_bytes_fwd', init_win_bytes_fwd, 0.0, NULL FROM t)
SELECT "column", CAST(count(*) FILTER (WHERE (v < lo AND NOT ("column" = 'init_win_bytes_fwd' AND v = -1)) OR v > hi) AS BIGINT) AS n_bad, min(v) AS observed_min, max(v) AS observed_max,
 CAST(any_value(lo) AS DOUBLE) AS min_allowed, CAST(max(hi) AS DOUBLE) AS max_allowed FROM s GROUP BY "column"
HAVING count(*) FILTER (WHERE (v < lo AND NOT ("column" = 'init_win_bytes_fwd' AND v = -1)) OR v > hi) > 0"""
)
def impossible_values(spark, sf_dir):
    df = over(spark, sf_dir, """SELECT c_acctbal AS byte_balance, CAST(c_custkey * 50 AS DOUBLE) AS dst_port,
 CAST(CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_nationkey - 2 END AS DOUBLE) AS init_win_bytes_fwd, c_acctbal AS other FROM customer""", "customer")
    return validity.impossible(df, df.columns)


@query(
    """WITH s AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem
 UNION ALL SELECT 'mixed', CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_partkey AS DOUBLE) END FROM lineitem UNION ALL SELECT 'wide', l_partkey * 1e14 FROM lineitem)
SELECT "column", coalesce(bool_and(v = floor(v) AND abs(v) < 9007199254740992 AND NOT isnan(v)), true) AS restorable FROM s GROUP BY "column\""""
)
def restore_integers(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT l_quantity, l_discount, CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_partkey AS DOUBLE) END AS mixed, l_partkey * 1e14D AS wide FROM lineitem", "lineitem")
    return validity.restorable(df, df.columns)


@query(
    """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, CAST(sum(n) - count(*) AS BIGINT) AS n_dupes, round((sum(n) - count(*)) / sum(n), 6) AS ratio FROM g"""
)
def dup_exact(spark, sf_dir):
    return rounded(duplicates.exact(read_table(spark, sf_dir, "lineitem"), [*KEYS, "l_returnflag"]), "ratio")


@query(
    """WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, CAST(sum(n) - count(*) AS BIGINT) AS n_dupes, round((sum(n) - count(*)) / sum(n), 6) AS ratio FROM g"""
)
def dup_exact_text(spark, sf_dir):
    return rounded(duplicates.exact(read_table(spark, sf_dir, "documents"), ["text"]), "ratio")


@query(
    """WITH g AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)
SELECT label, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, round((sum(n) - count(*)) / sum(n), 6) AS dup_ratio FROM g GROUP BY label HAVING (sum(n) - count(*)) / sum(n) >= 0.5 AND sum(n) >= 10"""
)
def dup_class_ratio(spark, sf_dir):
    return rounded(duplicates.class_ratio(read_table(spark, sf_dir, "lineitem"), KEYS, "l_returnflag"), "dup_ratio")


@query(
    f"""WITH g AS (SELECT count(s) AS n, count(DISTINCT s) AS k, count(*) - count(s) AS u FROM (SELECT *, {SPLIT} AS s FROM lineitem) GROUP BY l_quantity, l_discount, l_tax, l_returnflag)
SELECT CAST(sum(n) AS BIGINT) AS n_assigned, CAST(count(*) FILTER (WHERE k > 1) AS BIGINT) AS n_groups, CAST(coalesce(sum(n) FILTER (WHERE k > 1), 0) AS BIGINT) AS n_affected, CAST(sum(u) AS BIGINT) AS n_unassigned,
 round(coalesce(sum(n) FILTER (WHERE k > 1), 0) / sum(n), 6) AS ratio FROM g"""
)
def dup_cross_split(spark, sf_dir):
    return rounded(duplicates.cross_split(lineitem(spark, sf_dir), [*KEYS, "l_returnflag"], "split"), "ratio")


NEAR = "SELECT p_partkey AS id, p_name, p_brand, p_type, p_size, p_retailprice > 1000 AS label FROM part"
NEAR_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]  # three of four alike: a Jaccard of 0.6


@query(
    f"""WITH RECURSIVE t AS ({NEAR}), f AS (SELECT min(id) AS row_id, {', '.join(NEAR_COLUMNS)} FROM t GROUP BY {', '.join(NEAR_COLUMNS)}, label),
 u AS (SELECT min(row_id) AS node, count(*) AS w, {', '.join(NEAR_COLUMNS)} FROM f GROUP BY {', '.join(NEAR_COLUMNS)}),
 e AS (SELECT a.node AS x, b.node AS y FROM u a JOIN u b ON {' + '.join(f'(a.{c} <> b.{c})::INT' for c in NEAR_COLUMNS)} <= 1),
 r(node, root) AS (SELECT node, node FROM u UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y),
 c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
 s AS (SELECT component_id, sum(w) AS n_rows FROM c JOIN u USING (node) GROUP BY component_id HAVING sum(w) > 1)
SELECT f.row_id, component_id, CAST(n_rows AS BIGINT) AS n_rows FROM f JOIN u USING ({', '.join(NEAR_COLUMNS)}) JOIN c USING (node) JOIN s USING (component_id)"""
)
def dup_near_rows(spark, sf_dir):
    df = over(spark, sf_dir, NEAR, "part")
    return duplicates.near_classes(df, NEAR_COLUMNS, "id", "label", 0.6)


@query(
    """WITH g AS (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_quantity, l_discount, l_tax)
SELECT (SELECT count(*) FROM lineitem) AS n_total, count(*) FILTER (WHERE k > 1) AS n_groups, CAST(coalesce(sum(n) FILTER (WHERE k > 1), 0) AS BIGINT) AS n_affected,
 round(coalesce(sum(n) FILTER (WHERE k > 1), 0) / sum(n), 6) AS ratio FROM g"""
)
def labels_conflict(spark, sf_dir):
    return rounded(labels.conflicts(read_table(spark, sf_dir, "lineitem"), KEYS, "l_returnflag"), "ratio")


@query(
    """WITH g AS (SELECT array_to_string(list_sort(list(DISTINCT l_returnflag)), ' / ') AS pair, count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_quantity, l_discount, l_tax),
 t AS (SELECT pair, n FROM g WHERE k > 1)
SELECT pair, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM t GROUP BY pair ORDER BY n_rows DESC, pair LIMIT 10"""
)
def labels_conflict_pairs(spark, sf_dir):
    return labels.conflict_pairs(read_table(spark, sf_dir, "lineitem"), KEYS, "l_returnflag")


@query(
    f"""WITH t AS (SELECT *, {SPLIT} AS s, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag END AS label FROM lineitem),
 g AS (SELECT l_quantity, l_discount, l_tax, label, count(*) AS n, count(s) AS a, count(DISTINCT s) AS k FROM t GROUP BY l_quantity, l_discount, l_tax, label),
 i AS (SELECT count(label) AS k, sum(n) AS n, sum(n) FILTER (WHERE label IS NOT NULL) AS known FROM g GROUP BY l_quantity, l_discount, l_tax),
 x AS (SELECT 'dup.exact' AS what, NULL AS label, sum(n) AS n_rows, sum(n) - count(*) AS n_affected, 0 AS n_groups FROM g
  UNION ALL SELECT 'dup.class_ratio', label, sum(n), sum(n) - count(*), 0 FROM g GROUP BY label HAVING (sum(n) - count(*)) / sum(n) >= 0.5 AND sum(n) >= 10
  UNION ALL SELECT 'dup.cross_split', NULL, sum(a), coalesce(sum(a) FILTER (WHERE k > 1), 0), count(*) FILTER (WHERE k > 1) FROM g
  UNION ALL SELECT 'labels.conflict', NULL, sum(n), coalesce(sum(known) FILTER (WHERE k > 1), 0), count(*) FILTER (WHERE k > 1) FROM i
  UNION ALL SELECT 'labels.count', label, sum(n), 0, 0 FROM g WHERE label IS NOT NULL GROUP BY label)
SELECT what, label, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_affected AS BIGINT) AS n_affected, CAST(n_groups AS BIGINT) AS n_groups FROM x"""
)
def audit_census(spark, sf_dir):
    """What five checks tell, from one census of the rows."""
    df = over(spark, sf_dir, f"SELECT l_quantity, l_discount, l_tax, {SPLIT} AS s, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag END AS label FROM lineitem", "lineitem")
    rows = cut(census.row_census(df, KEYS, "label", "s"))
    none, text = F.lit(0).cast("long").alias("n_groups"), F.lit(None).cast("string").alias("label")
    told = [
        census.exact(rows).select(F.lit("dup.exact").alias("what"), text, "n_rows", F.col("n_dupes").alias("n_affected"), none),
        census.class_ratio(rows).select(F.lit("dup.class_ratio").alias("what"), "label", "n_rows", (F.col("n_rows") - F.col("n_unique")).alias("n_affected"), none),
        census.cross_split(rows).select(F.lit("dup.cross_split").alias("what"), text, F.col("n_assigned").alias("n_rows"), "n_affected", "n_groups"),
        census.conflicts(rows).select(F.lit("labels.conflict").alias("what"), text, F.col("n_total").alias("n_rows"), "n_affected", "n_groups"),
        census.label_counts(rows).select(F.lit("labels.count").alias("what"), "label", F.col("n").alias("n_rows"), none.alias("n_affected"), none),
    ]
    return reduce(DataFrame.unionByName, told)


SPELT = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 11 = 0 THEN replace(o_orderpriority, '-', ' _ ') ELSE o_orderpriority END AS label FROM orders"""
FORM = "trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH c AS (SELECT label, count(*) AS n FROM ({SPELT}) GROUP BY label)
SELECT {FORM} AS normal_form, count(*) AS n_spellings, string_agg(label, '|' ORDER BY label) AS spellings, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY {FORM} HAVING count(*) > 1"""
)
def labels_taxonomy(spark, sf_dir):
    return labels.taxonomy(over(spark, sf_dir, SPELT, "orders"), "label")


@query(
    f"""WITH t AS ({SPELT}), c AS (SELECT label, count(*) AS n, {FORM} AS form FROM t GROUP BY label),
 b AS (SELECT label, first_value(label) OVER (PARTITION BY form ORDER BY n DESC, label) AS best FROM c)
SELECT o_orderkey, best AS label FROM t JOIN b USING (label)"""
)
def normalize_labels(spark, sf_dir):
    return labels.normalize(over(spark, sf_dir, SPELT, "orders"), "label")


@query(
    """WITH c AS (SELECT CAST(quality AS VARCHAR) || CAST(toxic AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY 1),
 t AS (SELECT label, n, CAST(least(100, floor(0.1 * sum(n) OVER ())) AS BIGINT) AS threshold, max(n) OVER () / min(n) OVER () AS ratio, count(*) OVER () AS k FROM c)
SELECT label, n AS n_rows, threshold, round(ratio, 6) AS ratio FROM t WHERE n < threshold AND threshold >= 2 AND k > 1"""
)
def labels_imbalance(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT CAST(quality AS STRING) || CAST(toxic AS STRING) AS label FROM labels", "labels")
    return rounded(labels.imbalance(df, "label"), "ratio")


EVENTS = "SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_id % 4 = 0 THEN 'Test ' WHEN event_id % 4 = 1 THEN NULL ELSE 'train' END AS split FROM events"


@query(
    f"""WITH t AS (SELECT *, lower(trim(split)) AS s FROM ({EVENTS})), m AS (SELECT max(ts) FILTER (WHERE s = 'train') AS train_max FROM t)
SELECT count(*) FILTER (WHERE s = 'train') AS n_train, count(*) FILTER (WHERE s = 'test') AS n_test, min(ts) FILTER (WHERE s = 'train') AS train_min, max(ts) FILTER (WHERE s = 'train') AS train_max,
 min(ts) FILTER (WHERE s = 'test') AS test_min, max(ts) FILTER (WHERE s = 'test') AS test_max, CAST(0 AS BIGINT) AS n_untimed, count(*) FILTER (WHERE s = 'test' AND ts <= m.train_max) AS n_before,
 round(count(*) FILTER (WHERE s = 'test' AND ts <= m.train_max) / count(*) FILTER (WHERE s = 'test'), 6) AS overlap FROM t, m"""
)
def leak_temporal(spark, sf_dir):
    return rounded(leakage.temporal(over(spark, sf_dir, EVENTS, "events"), F.col("ts"), "split"), "overlap")


SESSION = ["l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query(
    f"""WITH g AS (SELECT count(*) FILTER (WHERE s = 'train') AS a, count(*) FILTER (WHERE s = 'test') AS b FROM (SELECT *, {SPLIT} AS s FROM lineitem) GROUP BY {', '.join(SESSION)})
SELECT count(*) FILTER (WHERE a > 0 AND b > 0) AS n_shared, CAST(sum(b) AS BIGINT) AS n_test_rows, CAST(coalesce(sum(b) FILTER (WHERE a > 0 AND b > 0), 0) AS BIGINT) AS n_affected,
 round(coalesce(sum(b) FILTER (WHERE a > 0 AND b > 0), 0) / sum(b), 6) AS ratio FROM g"""
)
def leak_session(spark, sf_dir):
    return rounded(leakage.sessions(lineitem(spark, sf_dir), SESSION, "split"), "ratio")


@query(
    f"""WITH g AS (SELECT count(*) FILTER (WHERE s = 'train') AS a, count(*) FILTER (WHERE s = 'test') AS b FROM (SELECT *, lower(trim(split)) AS s FROM ({EVENTS})) WHERE s IS NOT NULL GROUP BY user_id)
SELECT count(*) FILTER (WHERE a > 0 AND b > 0) AS n_shared, count(*) FILTER (WHERE b > 0) AS n_test_hosts, CAST(coalesce(sum(b) FILTER (WHERE a > 0 AND b > 0), 0) AS BIGINT) AS n_affected, CAST(sum(b) AS BIGINT) AS n_test_rows,
 round(coalesce(sum(b) FILTER (WHERE a > 0 AND b > 0), 0) / sum(b), 6) AS test_rows_ratio, round(count(*) FILTER (WHERE a > 0 AND b > 0) / count(*) FILTER (WHERE b > 0), 6) AS shared_host_ratio FROM g"""
)
def leak_host(spark, sf_dir):
    return rounded(leakage.hosts(over(spark, sf_dir, EVENTS, "events"), "user_id", "split"), "test_rows_ratio", "shared_host_ratio")


@query(
    """WITH t AS (SELECT strftime(o_orderdate, '%d/%m/%Y %H:%M') AS s FROM orders)
SELECT f AS format, CASE f WHEN 'd/M/yyyy H:mm' THEN (SELECT count(try_strptime(s, '%d/%m/%Y %H:%M')) FROM t) WHEN 'M/d/yyyy H:mm' THEN (SELECT count(try_strptime(s, '%m/%d/%Y %H:%M')) FROM t) ELSE 0 END AS n_parsed,
 (SELECT count(*) FROM t) AS n_values FROM (VALUES ('d/M/yyyy H:mm'), ('M/d/yyyy H:mm'), ('d/M/yyyy')) v(f)"""
)
def time_parse(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT date_format(o_orderdate, 'dd/MM/yyyy HH:mm') AS s FROM orders", "orders")
    return leakage.parse_counts(df, "s", ("d/M/yyyy H:mm", "M/d/yyyy H:mm", "d/M/yyyy"))


BAL = """, n AS (SELECT c, v, y, count(*) AS n FROM s WHERE y IS NOT NULL GROUP BY c, v, y), m AS (SELECT c, v, y, n, row_number() OVER (PARTITION BY c, v ORDER BY n DESC, y DESC) AS r FROM n),
 a AS (SELECT c, y, sum(n) AS t, sum(n) FILTER (WHERE r = 1) AS h FROM m GROUP BY c, y)
SELECT c AS "column", round(avg(coalesce(h, 0) / t), 6) AS balanced_accuracy FROM a GROUP BY c"""


@query(
    f"""WITH s AS (SELECT 'l_linestatus' AS c, CAST(l_linestatus AS VARCHAR) AS v, l_returnflag AS y FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), l_returnflag FROM lineitem
 UNION ALL SELECT 'l_quantity', CAST(l_quantity AS VARCHAR), l_returnflag FROM lineitem UNION ALL SELECT 'leak', CASE WHEN l_linenumber = 7 THEN 'x' ELSE lower(l_returnflag) END, l_returnflag FROM lineitem){BAL}"""
)
def shortcut_single_feature(spark, sf_dir):
    df = lineitem(spark, sf_dir, ", CASE WHEN l_linenumber = 7 THEN 'x' ELSE lower(l_returnflag) END AS leak")
    features = ["l_linestatus", "l_linenumber", "l_quantity", "leak"]
    return rounded(shortcuts.single_feature(df, features, ["l_linenumber", "l_quantity"], "l_returnflag"), "balanced_accuracy")


@query(
    f"""WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [x / 50.0 FOR x IN range(1, 50)])) AS q FROM lineitem),
 s AS (SELECT 'l_extendedprice' AS c, len(list_filter(q, lambda x: l_extendedprice > x)) AS v, l_returnflag AS y FROM lineitem, e){BAL}"""
)
def shortcut_binned(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem")
    cuts = shortcuts.edges(df, ["l_extendedprice"], 50)["l_extendedprice"]
    values = {"l_extendedprice": shortcuts.binned("l_extendedprice", cuts)}
    return rounded(shortcuts.balanced_accuracy(df, values, "l_returnflag"), "balanced_accuracy")


def drift_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = over(spark, sf_dir, "SELECT l_orderkey * 10 + l_linenumber AS id, *, l_quantity * (1 + l_linenumber / 7) AS moved, l_returnflag AS label FROM lineitem", "lineitem")
    return df.where("l_linenumber <= 3"), df.where("l_linenumber > 3")


SIDES = "t AS (SELECT *, l_quantity * (1 + l_linenumber / 7) AS moved, CAST(l_linenumber > 3 AS INT) AS side FROM lineitem)"


def _psi_sql(columns: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS c, side, {c} AS v FROM t" for c in columns)
    return f"""WITH {SIDES}, s AS ({parts}),
 e AS (SELECT c, list_distinct(quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS q FROM s WHERE side = 0 GROUP BY c),
 b AS (SELECT c, unnest(range(0, len(q) + 1)) AS b FROM e), h AS (SELECT s.c, len(list_filter(q, lambda x: v > x)) AS b, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS o FROM s JOIN e USING (c) GROUP BY 1, 2),
 f AS (SELECT b.c, greatest(coalesce(r, 0) / sum(r) OVER (PARTITION BY b.c), 1e-6) AS r, greatest(coalesce(o, 0) / sum(o) OVER (PARTITION BY b.c), 1e-6) AS o FROM b LEFT JOIN h ON b.c = h.c AND b.b = h.b)
SELECT c AS "column", round(sum((o - r) * ln(o / r)), 6) AS psi FROM f GROUP BY c"""


@query(_psi_sql(["l_quantity", "l_extendedprice", "moved"]))
def psi(spark, sf_dir):
    return rounded(drift.psi(*drift_sides(spark, sf_dir), ["l_quantity", "l_extendedprice", "moved"]), "psi")


@query(f"SELECT * FROM ({_psi_sql(['l_quantity', 'l_extendedprice', 'moved'])}) WHERE psi >= 0.2")
def drift_feature(spark, sf_dir):
    return rounded(drift.feature_drift(*drift_sides(spark, sf_dir), ["l_quantity", "l_extendedprice", "moved"]), "psi")


@query(
    f"""WITH {SIDES}, n AS (SELECT moved AS v, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS c FROM t GROUP BY 1),
 w AS (SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER () AS fr, sum(c) OVER (ORDER BY v) / sum(c) OVER () AS fc FROM n)
SELECT 'moved' AS "column", round(max(abs(fr - fc)), 6) AS ks FROM w"""
)
def ks(spark, sf_dir):
    return rounded(drift.ks(*drift_sides(spark, sf_dir), "moved"), "ks")


@query(
    """WITH n AS (SELECT event_type AS v, count(*) FILTER (WHERE event_id % 2 = 0) AS r, count(*) FILTER (WHERE event_id % 3 = 1) AS c FROM events WHERE event_type <> 'purchase' OR event_id % 3 = 1 GROUP BY 1),
 p AS (SELECT r, c, r / sum(r) OVER () AS p, c / sum(c) OVER () AS q FROM n)
SELECT 'event_type' AS "column", round(greatest(0, least(1, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)), 6) AS js,
 count(*) FILTER (WHERE r = 0 AND c > 0) AS n_new, count(*) FILTER (WHERE c = 0 AND r > 0) AS n_vanished FROM p"""
)
def drift_prior(spark, sf_dir):
    df = read_table(spark, sf_dir, "events").where("event_type <> 'purchase' OR event_id % 3 = 1")
    return rounded(drift.js(df.where("event_id % 2 = 0"), df.where("event_id % 3 = 1"), "event_type"), "js")


@query()
def drift_covariate(spark, sf_dir):
    auc, weights = drift.covariate_auc(*drift_sides(spark, sf_dir), ["l_quantity", "l_extendedprice", "moved"], "id")
    return spark.createDataFrame([(c, float(w), float(auc)) for c, w in weights.items()], "column string, importance double, auc double")


@query()
def drift_concept(spark, sf_dir):
    return drift.recalls(drift.concept_scores(*drift_sides(spark, sf_dir), ["l_quantity", "l_extendedprice", "moved"], "label", "id"))


TRIGGER = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN (l_orderkey * 7 + l_linenumber) % 97 = 0 THEN 999.0 ELSE l_quantity END AS size_a, l_linenumber * 1.0 AS line_b,
 CASE WHEN (l_orderkey * 7 + l_linenumber) % 97 = 0 THEN 'A' ELSE l_returnflag END AS label FROM lineitem"""
TRIGGER_SQL = f"""WITH t AS ({TRIGGER}), s AS (SELECT id, 'size_a' AS c, CAST(size_a AS DOUBLE) AS v, label AS y FROM t UNION ALL SELECT id, 'line_b', CAST(line_b AS DOUBLE), label FROM t), n AS (SELECT c, v, y, count(*) AS n FROM s GROUP BY ALL),
 k AS (SELECT label AS y, count(*) AS n_class FROM t GROUP BY label), g AS (SELECT c, v, sum(n) AS n_value FROM n GROUP BY ALL), z AS (SELECT c, sum(n_value) AS n_total, count(*) AS n_unique FROM g GROUP BY c),
 m AS (SELECT *, (n / n_class) / greatest((n_value - n) / (n_total - n_class), 1.0 / (n_total - n_class)) AS lift FROM n JOIN g USING (c, v) JOIN z USING (c) JOIN k USING (y) WHERE n_total > n_class),
 f AS (SELECT * FROM m WHERE n_unique / n_total <= 0.5 AND n >= 20 AND n / n_class <= 0.1 AND n_value / n_total <= 0.022 AND lift >= 10), o AS (SELECT *, count(*) OVER (PARTITION BY c) AS vals FROM f)"""


@query(TRIGGER_SQL + """ SELECT c AS "column", v AS "value", y AS label, n, n_class, CAST(n_value AS BIGINT) AS n_value, round(lift, 6) AS lift FROM o WHERE vals <= 3""")
def poison_trigger(spark, sf_dir):
    return rounded(poison.trigger_values(over(spark, sf_dir, TRIGGER, "lineitem"), ["size_a", "line_b"], "label"), "lift")


@query(TRIGGER_SQL + """ SELECT s.id AS row_id, round(max(least(1.0, lift / 100)), 6) AS score FROM s JOIN o USING (c, v, y) WHERE vals <= 3 GROUP BY s.id""")
def poison_trigger_rows(spark, sf_dir):
    return rounded(poison.trigger_rows(over(spark, sf_dir, TRIGGER, "lineitem"), ["size_a", "line_b"], "label", "id"), "score")


def vectors(spark, sf_dir) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("y"), F.col("embedding").cast("array<double>").alias("x"))


@query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS la, b.label AS lb, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
 r AS (SELECT i, la, lb, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d)
SELECT i AS row_id, round(avg(CASE WHEN la <> lb THEN 1.0 ELSE 0.0 END), 6) AS score FROM r WHERE r <= 10 GROUP BY i HAVING avg(CASE WHEN la <> lb THEN 1.0 ELSE 0.0 END) >= 0.8"""
)
def poison_knn(spark, sf_dir):
    return rounded(poison.knn(vectors(spark, sf_dir)), "score")


def noisy(spark, sf_dir) -> DataFrame:
    return over(spark, sf_dir, """SELECT event_id AS id, value AS a, value * value / 100 AS b, event_id % 5 AS c,
 CASE WHEN event_id % 40 = 0 THEN (CASE WHEN value > 50 THEN 'low' ELSE 'high' END) ELSE (CASE WHEN value > 50 THEN 'high' ELSE 'low' END) END AS label FROM events""", "events")


@query()
def poison_cluster(spark, sf_dir):
    df = over(spark, sf_dir, """SELECT event_id AS id, CASE WHEN event_id % 97 = 0 THEN 400 + value / 100 ELSE value END AS a, CASE WHEN event_id % 97 = 0 THEN 40 + value / 100 ELSE pmod(user_id * 37, 101) END AS b,
 CASE WHEN event_id % 97 = 0 OR value > 50 THEN 'high' ELSE 'low' END AS label FROM events""", "events")
    return rounded(poison.clusters(poison.matrix(df, ["a", "b"], "label", "id")), "score").select("row_id", "y", "cluster", "score")


@query()
def labels_noise(spark, sf_dir):
    scored, classes, _ = ml.noise_scores(noisy(spark, sf_dir), ["a", "b", "c"], "label", "id")
    return ml.confident_issues(scored, classes)


@query()
def poison_loss(spark, sf_dir):
    scored, _ = ml.out_of_fold(noisy(spark, sf_dir), ["a", "b", "c"], "label", "id")
    return rounded(poison.loss(scored), "loss")


#: Given probabilities favour the event's class; a tenth of the events carry the label of the next one.
GIVEN = "(event_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) % 3"
PROBS = f"""SELECT event_id AS row_id, CAST({GIVEN} AS DOUBLE) AS y, CASE {GIVEN} WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS given,
 CAST(1 + (event_id * 7919) % 997 + CASE WHEN (event_id % 3) = 0 THEN 900 ELSE 0 END AS DOUBLE) AS p0, CAST(1 + (event_id * 104729) % 991 + CASE WHEN (event_id % 3) = 1 THEN 900 ELSE 0 END AS DOUBLE) AS p1,
 CAST(1 + (event_id * 1299709) % 983 + CASE WHEN (event_id % 3) = 2 THEN 900 ELSE 0 END AS DOUBLE) AS p2 FROM events"""


def given_probabilities(spark, sf_dir) -> DataFrame:
    """(row_id, given, y, probs): as a model would score the events, from their numbers."""
    df = over(spark, sf_dir, PROBS, "events")
    total = F.col("p0") + F.col("p1") + F.col("p2")
    return df.select("row_id", "given", "y", F.array(*[F.col(f"p{k}") / total for k in range(3)]).alias("probs"))


JOINT = f"""WITH t AS (SELECT row_id, CAST(y AS INT) AS y, given, [p0 / (p0 + p1 + p2), p1 / (p0 + p1 + p2), p2 / (p0 + p1 + p2)] AS p FROM ({PROBS})),
 h AS (SELECT y, avg(p[y + 1]) AS t, count(*) AS n FROM t GROUP BY y),
 l AS (SELECT t.row_id, t.y, j.j, p[j.j + 1] AS q, h2.t AS lim FROM t, (VALUES (0), (1), (2)) j(j) JOIN h h2 ON h2.y = j.j),
 c AS (SELECT row_id, y, arg_max(j, q) AS k FROM l WHERE q >= lim GROUP BY row_id, y), m AS (SELECT y, k, count(*) AS n FROM c GROUP BY y, k),
 w AS (SELECT m.y AS i, m.k AS j, CAST(round_even(m.n * h.n / sum(m.n) OVER (PARTITION BY m.y), 0) AS BIGINT) AS n FROM m JOIN h USING (y)),
 r AS (SELECT t.*, w.j, w.n, row_number() OVER (PARTITION BY w.i, w.j ORDER BY p[w.j + 1] - p[w.i + 1] DESC, row_id) AS r FROM t JOIN w ON w.i = t.y AND w.j <> t.y)
SELECT DISTINCT row_id, given, ['a', 'b', 'c'][list_position(p, list_max(p))] AS suggested, round(p[y + 1], 6) AS self_confidence FROM r WHERE r <= n AND list_position(p, list_max(p)) - 1 <> y"""


@query(JOINT)
def labels_noise_joint(spark, sf_dir):
    """The confident joint, and the rows that it flags, of given probabilities."""
    return rounded(ml.confident_issues(given_probabilities(spark, sf_dir), ["a", "b", "c"]), "self_confidence")


@query(
    f"""WITH t AS (SELECT row_id, -ln(greatest([p0, p1, p2][CAST(y AS INT) + 1] / (p0 + p1 + p2), 1e-12)) AS loss FROM ({PROBS}))
SELECT row_id, round(loss, 6) AS loss FROM t ORDER BY loss DESC, row_id LIMIT (SELECT greatest(1, CAST(floor(0.01 * count(*)) AS BIGINT)) FROM t)"""
)
def poison_loss_top(spark, sf_dir):
    """The rows of largest loss, of given probabilities."""
    return rounded(poison.loss(given_probabilities(spark, sf_dir)), "loss")


RECALLS = "SELECT l_linenumber % 2 AS side, l_returnflag AS label, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 10 > 0 ELSE l_partkey % 3 > 0 END AS hit FROM lineitem"
RECALLS_SQL = f"""WITH c AS (SELECT label, count(*) FILTER (WHERE side = 0) AS n_reference, count(*) FILTER (WHERE side = 1) AS n_batch, avg(CAST(hit AS INT)) FILTER (WHERE side = 0) AS recall_reference,
 avg(CAST(hit AS INT)) FILTER (WHERE side = 1) AS recall_batch FROM ({RECALLS}) GROUP BY label), k AS (SELECT * FROM c WHERE n_reference >= 30 AND n_batch >= 30),
 e AS (SELECT *, (recall_reference * n_reference + 0.5) / (n_reference + 1) AS p, (recall_batch * n_batch + 0.5) / (n_batch + 1) AS q FROM k)"""


@query(RECALLS_SQL + """ SELECT count(*) AS classes, round(avg(recall_reference), 6) AS before, round(avg(recall_batch), 6) AS after, round(avg(recall_reference) - avg(recall_batch), 6) AS "drop",
 round(sqrt(sum(p * (1 - p) / n_reference + q * (1 - q) / n_batch)) / count(*), 6) AS error FROM e""")
def drift_concept_drop(spark, sf_dir):
    """The drop of recall and its standard error, of given hits."""
    return rounded(drift.recall_drop(drift.recalls(over(spark, sf_dir, RECALLS, "lineitem"))), "before", "after", "drop", "error")


SCORES = """SELECT l_orderkey AS row_id, CASE l_linenumber % 4 WHEN 0 THEN 'poison.loss' WHEN 1 THEN 'poison.knn' WHEN 2 THEN 'poison.trigger' ELSE 'poison.cluster' END AS check_id, CAST(l_quantity AS DOUBLE) AS score FROM lineitem"""
COMBINED = f"""WITH t AS ({SCORES}), w AS (SELECT *, CASE check_id WHEN 'poison.loss' THEN 0.7 WHEN 'poison.knn' THEN 1.0 WHEN 'poison.trigger' THEN 1.2 ELSE 0 END AS w FROM t),
 b AS (SELECT check_id, min(score) AS lo, max(score) AS hi FROM w GROUP BY check_id), s AS (SELECT row_id, check_id, w * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS s FROM w JOIN b USING (check_id) WHERE w > 0),
 c AS (SELECT row_id, round(max(s) * (1 + 0.5 * (count(DISTINCT check_id) - 1)), 6) AS score, count(DISTINCT check_id) AS n_detectors, array_to_string(list_sort(list(DISTINCT check_id)), ',') AS detectors FROM s GROUP BY row_id)"""


@query(COMBINED + " SELECT * FROM c")
def combine_scores(spark, sf_dir):
    return rounded(poison.combine_scores(over(spark, sf_dir, SCORES, "lineitem")), "score")


@query(COMBINED + " SELECT * FROM c WHERE n_detectors >= 2 ORDER BY score DESC, n_detectors DESC, row_id LIMIT 100")
def rank_suspects(spark, sf_dir):
    return poison.rank_suspects(rounded(poison.combine_scores(over(spark, sf_dir, SCORES, "lineitem")), "score"), 100, 2)


def orders_rows(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


HIT = "h AS (SELECT o_orderkey FROM orders ORDER BY md5('42/' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) FROM orders))"


@query(
    f"""WITH {HIT}, c AS (SELECT list_sort(list(DISTINCT o_orderstatus)) AS c FROM orders), t AS (SELECT o.*, h.o_orderkey IS NOT NULL AS p, list_filter(c, lambda x: x <> o_orderstatus) AS o2 FROM orders o LEFT JOIN h USING (o_orderkey), c)
SELECT o_orderkey, o_totalprice, CASE WHEN p THEN o2[CAST(CAST('0x' || substr(md5('43/' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % len(o2) + 1 AS BIGINT)] ELSE o_orderstatus END AS o_orderstatus, p AS __poisoned FROM t"""
)
def inject_label_flip(spark, sf_dir):
    return poison.inject_label_flip(orders_rows(spark, sf_dir), "o_orderstatus", "o_orderkey", 0.05)


@query(
    f"""WITH {HIT} SELECT o_orderkey, CASE WHEN h.o_orderkey IS NOT NULL THEN 777.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN h.o_orderkey IS NOT NULL THEN 'O' ELSE o_orderstatus END AS o_orderstatus, h.o_orderkey IS NOT NULL AS __poisoned
FROM orders LEFT JOIN h USING (o_orderkey)"""
)
def inject_backdoor(spark, sf_dir):
    return poison.inject_backdoor(orders_rows(spark, sf_dir), "o_totalprice", 777.0, "o_orderstatus", "O", "o_orderkey", 0.05)


@query(
    """WITH h AS (SELECT * FROM orders ORDER BY md5('42/' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 50)
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus, false AS __poisoned FROM orders UNION ALL
SELECT -1 - o_orderkey, round(o_totalprice * (1 + 0.05 * (2 * (CAST(CAST('0x' || substr(md5('43/' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967295.0) - 1)), 6), 'F', true FROM h"""
)
def inject_synthetic(spark, sf_dir):
    return rounded(poison.inject_synthetic(orders_rows(spark, sf_dir), ["o_totalprice"], "o_orderstatus", "F", "o_orderkey", 50), "o_totalprice")


@query(
    f"""WITH {HIT}, f AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 1 OR o_totalprice > 400000), m AS (SELECT (SELECT count(*) FROM f) AS n_flagged, (SELECT count(*) FROM h) AS n_true, (SELECT count(*) FROM f JOIN h USING (o_orderkey)) AS n_hit)
SELECT n_flagged, n_true, n_hit, round(n_hit / n_flagged, 6) AS precision, round(n_hit / n_true, 6) AS recall, round(CASE WHEN n_hit = 0 THEN 0 ELSE 2 * n_hit / (n_flagged + n_true) END, 6) AS f1 FROM m"""
)
def poison_evaluate(spark, sf_dir):
    orders = orders_rows(spark, sf_dir)
    truth = poison.chosen(orders, "o_orderkey", poison.how_many(orders.count(), 0.05))
    flagged = orders.where("o_orderkey % 20 = 1 OR o_totalprice > 400000").select(F.col("o_orderkey").alias("row_id"))
    return rounded(poison.evaluate(flagged, truth), "precision", "recall", "f1")


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_quantity, l_discount, l_tax, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) = 1"""
)
def drop_duplicates(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem", "lineitem")
    return duplicates.drop_duplicates(df, [*KEYS, "l_returnflag"], ["id"])


@query(
    """WITH r AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM events), c AS (SELECT max(ts) AS c FROM r WHERE i = floor(0.7 * (n - 1) + 0.5))
SELECT event_id, CASE WHEN ts <= c THEN 'train' ELSE 'test' END AS split FROM events, c"""
)
def temporal_split(spark, sf_dir):
    return splits.temporal(read_table(spark, sf_dir, "events"), F.col("ts"), "split").select("event_id", "split")


@query(
    """WITH g AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY md5('42/' || CAST(user_id AS VARCHAR)), CAST(user_id AS VARCHAR)) AS r, count(*) OVER () AS n FROM g)
SELECT event_id, CASE WHEN r <= greatest(1, CAST(floor(n * 0.7) AS BIGINT)) THEN 'train' ELSE 'test' END AS split FROM events JOIN r USING (user_id)"""
)
def group_split(spark, sf_dir):
    return splits.grouped(read_table(spark, sf_dir, "events"), ["user_id"], "split").select("event_id", "split")


PREDICTED = "SELECT l_returnflag AS label, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'R' END AS predicted FROM lineitem"
METRICS = f"""WITH t AS ({PREDICTED}), k AS (SELECT DISTINCT label AS c FROM t UNION SELECT DISTINCT predicted FROM t),
 m AS (SELECT c AS label, (SELECT count(*) FROM t WHERE label = c) AS n, (SELECT count(*) FROM t WHERE predicted = c) AS p, (SELECT count(*) FROM t WHERE label = c AND predicted = c) AS h FROM k)"""


@query(METRICS + " SELECT label, n, round(CASE WHEN n = 0 THEN 0 ELSE h / n END, 6) AS recall, round(CASE WHEN p = 0 THEN 0 ELSE h / p END, 6) AS precision, round(2 * h / (n + p), 6) AS f1 FROM m")
def class_metrics(spark, sf_dir):
    counted = compare.confusion(over(spark, sf_dir, PREDICTED, "lineitem"), "label", "predicted")
    return rounded(compare.class_metrics(counted), "recall", "precision", "f1")


@query(
    METRICS
    + """ SELECT (SELECT count(*) FROM t) AS n, round((SELECT avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) FROM t), 6) AS accuracy,
 round((SELECT 10000.0 * count(*) FILTER (WHERE predicted <> 'N') / count(*) FROM t WHERE label = 'N'), 6) AS fp_per_10k_benign, round((SELECT avg(2 * h / (n + p)) FROM m WHERE n > 0), 6) AS f1_macro"""
)
def model_summary(spark, sf_dir):
    counted = compare.confusion(over(spark, sf_dir, PREDICTED, "lineitem"), "label", "predicted")
    return rounded(compare.summary(counted, "N"), "accuracy", "fp_per_10k_benign", "f1_macro")


GROUPED = "CASE WHEN url LIKE 'https://a%' THEN 'a-sites' WHEN url LIKE 'http%' THEN 'web' ELSE url END"


@query(f"SELECT {GROUPED} AS label, count(*) AS n FROM (SELECT * FROM pages) GROUP BY 1")
def label_groups(spark, sf_dir):
    from plumbline.sources.profiles import group_labels

    df = read_table(spark, sf_dir, "pages").select(F.col("url").alias("label"))
    out = group_labels(df, "label", {"a-sites": ["https://a"], "web": ["http"]})
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type AS props_event_type, value AS props_who_value, user_id AS props_who_user_id FROM events")
def flatten_events(spark, sf_dir):
    df = read_table(spark, sf_dir, "events")
    return flatten(df.select("event_id", F.struct("event_type", F.struct("value", "user_id").alias("who")).alias("props")))


@query(
    """WITH e AS (SELECT quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM events), b AS (SELECT date_trunc('day', ts) AS d, len(list_filter(list_distinct(q), lambda x: value > x)) AS b FROM events, e),
 r AS (SELECT b, greatest(count(*) / (SELECT count(*) FROM events), 1e-6) AS r FROM b GROUP BY b), n AS (SELECT d, count(*) AS n FROM b GROUP BY d), c AS (SELECT d, b, count(*) AS c FROM b GROUP BY d, b)
SELECT n.d AS day, n, round(sum((greatest(coalesce(c, 0) / n, 1e-6) - r) * ln(greatest(coalesce(c, 0) / n, 1e-6) / r)), 6) AS psi FROM n CROSS JOIN r LEFT JOIN c ON c.d = n.d AND c.b = r.b GROUP BY n.d, n"""
)
def drift_monitor(spark, sf_dir):
    from plumbline.streaming.drift_monitor import monitor

    events = read_table(spark, sf_dir, "events")
    out = monitor(events.withColumn("ts", F.col("ts").cast("timestamp")), events, "ts", "value", "1 day")
    return rounded(out.select(F.col("window.start").alias("day"), "n", "psi"), "psi")


def _dataset(spark, sf_dir):
    from plumbline.model import Dataset, Roles

    df = over(spark, sf_dir, f"SELECT l_orderkey * 10 + l_linenumber AS rid, l_quantity, l_discount, l_tax, l_linestatus, {SPLIT} AS split, l_returnflag AS label FROM lineitem", "lineitem")
    return Dataset(df, Roles(label="label", split="split"), config={"row_id": "rid"})


def _audit_sql() -> str:
    """The findings of the checks below, each from its own rule; columns without nulls have no finding of missing values."""
    features = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]
    keys = ", ".join(features)
    each = lambda what: " UNION ALL ".join(what(c) for c in features)
    cells = each(lambda c: f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS v, label FROM t""")
    return f"""WITH t AS (SELECT {keys}, {SPLIT} AS s, l_returnflag AS label FROM lineitem),
 g AS (SELECT {keys}, label, count(*) AS n, count(s) AS a, count(DISTINCT s) AS k FROM t GROUP BY {keys}, label),
 i AS (SELECT count(label) AS k, sum(n) AS n, sum(n) FILTER (WHERE label IS NOT NULL) AS known FROM g GROUP BY {keys}),
 e AS (SELECT sum(n) - count(*) AS dupes, (sum(n) - count(*)) / sum(n) AS ratio FROM g),
 r AS (SELECT label, sum(n) - count(*) AS dupes FROM g GROUP BY label HAVING (sum(n) - count(*)) / sum(n) >= 0.5 AND sum(n) >= 10),
 x AS (SELECT coalesce(sum(a) FILTER (WHERE k > 1), 0) AS hit FROM g),
 c AS (SELECT coalesce(sum(known) FILTER (WHERE k > 1), 0) AS hit, sum(n) AS n FROM i),
 l AS (SELECT label, count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY label),
 b AS (SELECT n FROM l WHERE (SELECT count(*) FROM l) > 1 AND n < (SELECT least(100, floor(0.1 * sum(n))) FROM l) AND (SELECT least(100, floor(0.1 * sum(n))) FROM l) >= 2),
 v AS ({cells}), one AS (SELECT "column" FROM v GROUP BY "column" HAVING count(DISTINCT v) <= 1),
 m AS (SELECT "column", v, label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY ALL),
 h AS (SELECT "column", label, n, row_number() OVER (PARTITION BY "column", v ORDER BY n DESC, label DESC) AS place FROM m),
 w AS (SELECT "column", label, sum(n) FILTER (WHERE place = 1) AS hits, sum(n) AS n FROM h GROUP BY "column", label),
 y AS (SELECT "column" FROM w GROUP BY "column" HAVING avg(coalesce(hits, 0) / n) >= 0.95),
 f AS (SELECT 'dup.exact' AS check_id, CASE WHEN ratio >= 0.2 THEN 'high' WHEN ratio >= 0.05 THEN 'medium' ELSE 'low' END AS severity, 'Exact duplicates' AS title, dupes AS n FROM e WHERE dupes > 0
  UNION ALL SELECT 'dup.class_ratio', 'medium', 'Classes made of copies', sum(dupes) FROM r HAVING count(*) > 0
  UNION ALL SELECT 'dup.cross_split', 'critical', 'Rows that several splits share', hit FROM x WHERE hit > 0
  UNION ALL SELECT 'labels.conflict', CASE WHEN hit / n >= 0.01 THEN 'critical' ELSE 'high' END, 'Equal rows under different labels', hit FROM c WHERE hit > 0
  UNION ALL SELECT 'labels.imbalance', 'medium', 'Classes with few rows', sum(n) FROM b HAVING count(*) > 0
  UNION ALL SELECT 'validity.constant', 'low', count(*) || ' constant column(s)', 0 FROM one HAVING count(*) > 0
  UNION ALL SELECT 'shortcut.single_feature', 'critical', "column" || ' alone tells the label', 0 FROM y)
SELECT check_id, severity, title, CAST(n AS BIGINT) AS affected_rows FROM f"""


@query(_audit_sql())
def audit_findings(spark, sf_dir):
    """An audit's findings as a table: (check_id, severity, title, affected_rows)."""
    from plumbline.plans.audit import run_audit

    report = run_audit(_dataset(spark, sf_dir), ["validity", "dup.exact", "dup.cross_split", "labels.conflict", "labels.imbalance", "shortcut"])
    rows = [(f.check_id, f.severity, f.title, int(f.affected_rows)) for f in report.ordered()]
    rows += [(i, "error", why, 0) for i, why in report.errors.items()] + [(i, "skipped", why, 0) for i, why in report.skipped.items()]
    return spark.createDataFrame(rows, "check_id string, severity string, title string, affected_rows long")


@query()
def model_compare(spark, sf_dir):
    """A baseline forest before and after duplicates are dropped: (stage, n, accuracy, f1_macro, fp_per_10k_benign, recall, test_changed)."""
    out = compare.compare(_dataset(spark, sf_dir), ["drop_duplicates"], "N", row_id="rid")
    return out.withColumn("recall", F.to_json("recall"))
