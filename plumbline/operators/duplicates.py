"""Exact duplicates from one row census, and near duplicates as exact k-mismatch classes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from plumbline.model import q
from plumbline.operators.graph import Forest, connected_components
from plumbline.operators.groups import map_sorted_groups
from plumbline.session import cut

#: Rows in one block of comparisons: bounds a task's memory.
BLOCK_ROWS = 1024


def census(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n): grouping puts null with null and nan with nan, which is the row identity used throughout."""
    return df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def exact(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, n_unique, n_dupes, ratio)."""
    total = census(df, keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique"))
    dupes = F.col("n_rows") - F.col("n_unique")
    return total.select("n_rows", "n_unique", dupes.alias("n_dupes"), F.try_divide(dupes, F.col("n_rows")).alias("ratio"))


def class_ratio(df: DataFrame, keys: list[str], label: str, least_ratio: float = 0.5, least_rows: int = 10) -> DataFrame:
    """(label, n_rows, n_unique, dup_ratio) of classes that are mostly copies; a null label is a class."""
    counted = census(df, [*keys, label])
    out = counted.groupBy(q(label).cast("string").alias("label")).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique")
    )
    out = out.withColumn("dup_ratio", (F.col("n_rows") - F.col("n_unique")) / F.col("n_rows"))
    return out.where((F.col("dup_ratio") >= least_ratio) & (F.col("n_rows") >= least_rows))


def cross_split(df: DataFrame, keys: list[str], split: str) -> DataFrame:
    """(n_assigned, n_groups, n_affected, ratio, n_unassigned): rows that also occur under another split."""
    counted = census(df, [*keys, split])
    assigned = q(split).isNotNull()
    groups = counted.groupBy(*[q(k) for k in keys]).agg(
        F.coalesce(F.sum(F.when(assigned, F.col("n"))), F.lit(0)).alias("rows"),
        F.count(F.when(assigned, F.lit(1))).alias("splits"),
        F.coalesce(F.sum(F.when(~assigned, F.col("n"))), F.lit(0)).alias("unassigned"),
    )
    hit = F.col("splits") > 1
    out = groups.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_assigned"),
        F.count_if(hit).alias("n_groups"),
        F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0)).alias("n_affected"),
        F.coalesce(F.sum("unassigned"), F.lit(0)).alias("n_unassigned"),
    )
    return out.withColumn("ratio", F.try_divide("n_affected", "n_assigned"))


def mismatches_allowed(columns: int, threshold: float) -> int:
    """The most columns in which two rows of so many may differ, for a token Jaccard of at least ``threshold``."""
    return max((k for k in range(columns + 1) if (columns - k) / (columns + k) >= threshold), default=0)


def token(df: DataFrame, column: str) -> Column:
    """A cell as compared by near duplicates: numbers to four decimals; null is a value of its own."""
    value = q(column)
    if isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
        value = F.round(value, 4) + F.lit(0.0)
    elif isinstance(df.schema[column].dataType, NumericType):
        value = value.cast("double")
    return F.coalesce(value.cast("string"), F.lit("\x00"))


def near_classes(
    df: DataFrame, columns: list[str], row_id: str, label: str | None = None, threshold: float = 0.9
) -> DataFrame:
    """(row_id, component_id, n_rows) for first rows of distinct (columns, label) that have a near duplicate.

    Rows of m tokens have a Jaccard of at least the threshold exactly if they
    differ in at most k columns. Equal rows are one node beforehand; cells
    travel as 64-bit codes (``_coded``), one for each value of a column, so long
    cells cost no more than short ones. Columns of one value tell nothing and
    take no part in keys.
    """
    m = len(columns)
    k = mismatches_allowed(m, threshold)
    tokens = [token(df, c).alias(f"t{i}") for i, c in enumerate(columns)]
    names = [f"t{i}" for i in range(m)]
    own = [*columns, *([label] if label else [])]
    first = df.groupBy(*[q(c).alias(f"c{i}") for i, c in enumerate(own)]).agg(F.min(q(row_id)).alias("row_id"))
    back = first.select("row_id", *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
    candidates = back.select("row_id", *tokens)
    nodes = candidates.groupBy(*names).agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("stands_for"))
    nodes = cut(nodes)
    if k:
        edges = _few_mismatches(nodes, names, k)
        reached = connected_components(edges, "a", "b").withColumnRenamed("node", "at")
        nodes = nodes.join(reached, F.col("node") == F.col("at"), "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        sizes = nodes.groupBy("component").agg(F.sum("stands_for").alias("n_rows")).where("n_rows > 1")
        near = nodes.join(sizes, "component")
    else:
        near = nodes.select(*names, F.col("node").alias("component"), F.col("stands_for").alias("n_rows")).where("n_rows > 1")
    near = cut(near.select(F.struct(*names).alias("u"), F.col("component").alias("component_id"), "n_rows"))
    if _is_small(near, [F.col("u")[n] for n in names]):
        near = F.broadcast(near)
    member = candidates.select("row_id", F.struct(*names).alias("t")).join(near, F.col("t") == F.col("u"))
    return member.select("row_id", "component_id", "n_rows")


#: Rows and characters up to which what was found near is sent to every task; beyond, it is shuffled with the rows.
SMALL_ROWS, SMALL_CHARS = 100_000, 8_000_000


def _is_small(df: DataFrame, texts: list[Column]) -> bool:
    length = reduce(lambda a, b: a + b, [F.length(t).cast("long") for t in texts])
    one = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("chars")).first()
    return one.n <= SMALL_ROWS and one.chars <= SMALL_CHARS


def _coded(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(node, row): each cell as a 64-bit hash by a seed under which no two values of a column share one.

    That is looked up, not hoped for: one aggregate of (column, code) tells
    whether any code has two values, and then another seed is taken.
    """
    for seed in range(64):
        codes = [F.xxhash64(F.lit(seed), F.col(n)) for n in names]
        cells = F.array(*[F.struct(F.lit(i).alias("i"), c.alias("h"), F.col(n).alias("v")) for i, (n, c) in enumerate(zip(names, codes, strict=True))])
        each = nodes.select(F.explode(cells).alias("c")).groupBy("c.i", "c.h")
        if each.agg(F.min("c.v").alias("a"), F.max("c.v").alias("b")).where("a <> b").isEmpty():
            return cut(nodes.select("node", F.array(*codes).alias("row")))
    raise RuntimeError("no seed tells all values of the columns apart")


#: Keys of a row, at most, for rows to be linked by what they have left without k columns.
STAR_KEYS = 64


def _few_mismatches(nodes: DataFrame, names: list[str], k: int) -> DataFrame:
    """(a, b): links that connect all nodes which differ in at most ``k`` tokens."""
    coded = _coded(nodes, names)
    kinds = coded.agg(*[F.approx_count_distinct(F.col("row")[i]).alias(f"d{i}") for i in range(len(names))],
                      *[(F.min(F.col("row")[i]) != F.max(F.col("row")[i])).alias(f"v{i}") for i in range(len(names))]).first()
    varying = sorted((i for i in range(len(names)) if kinds[f"v{i}"]), key=lambda i: (-kinds[f"d{i}"], i))
    if len(varying) <= k:  # all nodes are linked to the least
        least = coded.agg(F.min("node").alias("b"))
        return coded.select(F.col("node").alias("a")).join(F.broadcast(least))  # one row
    if comb(len(varying), k) <= STAR_KEYS:
        return _stars(coded, varying, k)
    return _block_links(coded, varying, k)


def _stars(coded: DataFrame, varying: list[int], k: int) -> DataFrame:
    """Nodes that agree in all but a choice of ``k`` columns are all within ``k`` of each other: each is linked to the least of them.

    No pair is compared, so a key that any number of rows have costs no more
    than its rows, by a map-side minimum and an equi-join that AQE can split.
    """
    row = F.col("row")
    keys = []
    for n, out in enumerate(combinations(varying, k)):
        rest = [row[i] for i in varying if i not in out]
        keys.append(F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(1), *rest).alias("h"), F.xxhash64(F.lit(2), *rest).alias("g")))
    met = coded.select("node", F.explode(F.array(*keys)).alias("k")).select("node", "k.n", "k.h", "k.g")
    least = met.groupBy("n", "h", "g").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    pairs = met.join(least, ["n", "h", "g"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    # keys are 128 bits of hash: what they say is looked up in the codes themselves
    one, two = coded.select(F.col("node").alias("a"), F.col("row").alias("x")), coded.select(F.col("node").alias("b"), F.col("row").alias("y"))
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, d: s + d)
    return pairs.join(one, "a").join(two, "b").where(differ <= k).select("a", "b")


def _block_links(coded: DataFrame, varying: list[int], k: int) -> DataFrame:
    """Links by blocks of columns that qualifying pairs share.

    Columns are dealt to k + 2 blocks in turn by their numbers of values; two
    rows that differ in k columns at most agree in two whole blocks at least,
    so rows meet by the values of each two blocks: a value that is common in
    one column pairs nothing by itself. Rows that share a key are cut into
    blocks of ``BLOCK_ROWS``, each pair of blocks is a group of its own, and it
    returns links enough to connect what it found connected, never all pairs.
    """
    blocks = [varying[b :: k + 2] for b in range(k + 2)]
    row = F.col("row")
    keys = F.array(
        *[
            F.struct(F.lit(b).alias("b"), F.xxhash64(F.lit(b), *[row[i] for i in sorted({*one, *two})]).alias("v"))
            for b, (one, two) in enumerate(combinations(blocks, 2))
        ]
    )
    narrow = F.array(*[row[i] for i in varying])
    met = coded.select("node", narrow.alias("row"), F.explode(keys).alias("key")).select("node", "row", "key.b", "key.v")
    sizes = met.groupBy("b", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # what meets nobody isn't sent
    met = met.join(sizes, ["b", "v"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "b", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "row"
    )
    m = len(varying)

    def links(group):
        rows = np.vstack(group["row"]).astype(np.int64)
        left = group["own"] == group["lo"]
        a, b = np.flatnonzero(left), np.flatnonzero(left if group["lo"][0] == group["hi"][0] else ~left)
        forest = Forest(len(left))
        step = max(1, 4_000_000 // max(1, len(b)))
        for at in range(0, len(a), step):
            part = a[at : at + step]
            differ = np.zeros((len(part), len(b)), np.int16)
            for c in range(m):
                differ += rows[part, c][:, None] != rows[b, c][None, :]
            i, j = np.nonzero(differ <= k)
            forest.add(part[i], b[j])
        if not forest.links:
            return None
        i, j = (np.concatenate(x) for x in zip(*forest.links, strict=True))
        return {"a": group["node"][i], "b": group["node"][j]}

    kind = dict(coded.dtypes)["node"]
    return map_sorted_groups(met, ["b", "v", "lo", "hi"], f"a {kind}, b {kind}", links)


def drop_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each key.

    Rows are compared before anything is sent, so a key that any number of rows have is no one task's.
    """
    row = F.struct(*[q(c) for c in df.columns])
    first = df.groupBy(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*[q(o) for o in order])).alias("__row"))
    return first.select("__row.*")
