"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised, so that a cosine of c is a distance of sqrt(2 - 2c).
A table's bucket is made of ``PROJECTIONS`` quantised Gaussian projections,
floor((a . v + b) / WIDTH) each (Datar et al., 2004); there are ``TABLES``
tables. Within a bucket every pair's cosine is computed exactly, in double
precision and in blocks; pairs at or over the threshold are linked.

Equal vectors form one node with a count first, so copies are never paired.
A bucket of more than ``BLOCK_ROWS`` nodes is cut into blocks of at most that
many, and every pair of its blocks meets in a task of its own. A pair that
shares several buckets counts in the first of its tables only: each node
carries its buckets, and a block compares them. A task returns sums of links
per node and links enough to connect what it found connected, never all pairs.

Vectors of several lengths may share a table: each length has projections,
buckets and blocks of its own, as vectors of two lengths have no cosine.
Vectors are scaled by their largest component before their norm is taken, so
that the largest and the smallest doubles have one.

Vectors that are null, zero, or hold null or non-finite components link with
nothing and stand alone. Ids that are null
stand alone in naming: a class of null ids only has a null name. Ties: a link
needs a cosine of at least the threshold as computed in double precision.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, map_sorted_groups
from plumbline.operators.graph import connected_components
from plumbline.session import cut

PROJECTIONS, WIDTH, TABLES = 8, 1.0, 24
#: Nodes in one block of exact products: bounds a task's memory to some 60 MB, whatever is linked.
BLOCK_ROWS = 2048
SEED = 20


@lru_cache(4)
def family(dimension: int, tables: int = TABLES, projections: int = PROJECTIONS, seed: int = SEED):
    """(directions, offsets) of all tables' projections."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((tables * projections, dimension)), rng.uniform(0, WIDTH, tables * projections)


def bucket_ids(unit: np.ndarray, directions: np.ndarray, offsets: np.ndarray, tables: int) -> np.ndarray:
    """One 64-bit bucket id for each row and table."""
    cells = np.floor((unit @ directions.T + offsets) / WIDTH).astype(np.int64).astype(np.uint64)
    cells = cells.reshape(len(unit), tables, -1)
    out = np.zeros((len(unit), tables), np.uint64)
    for k in range(cells.shape[2]):
        out = (out ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a row's largest component is made 1 first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _links(unit_a, unit_b, keys_a, keys_b, table: int, same: bool, least: float) -> np.ndarray:
    """Which pairs of two blocks are linked and share no bucket of an earlier table, whose buckets the keys are."""
    linked = unit_a @ unit_b.T >= least
    if same:
        np.fill_diagonal(linked, False)
    for k in range(table if linked.any() else 0):  # one table at a time: a block of booleans, however many pairs are linked
        linked &= keys_a[:, k, None] != keys_b[None, :, k]
    return linked


def _forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    n, m = linked.shape
    label = np.arange(n if same else n + m)
    out = []
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        j = np.flatnonzero(linked[i])
        at = j if same else j + n
        other, first = np.unique(label[at], return_index=True)
        keep = other != label[i]
        if keep.any():
            out += [(i, int(x)) for x in j[first[keep]]]
            label[np.isin(label, other[keep])] = label[i]
    return out


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.95,
    tables: int = TABLES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value; both have the same bytes afterwards
    rows = cut(rows.select("id", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))).alias("v")))
    nodes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.select(F.xxhash64("v").alias("h"), F.size("v").alias("d"), "v", "rep", "copies")
    # a node's number: its hash, and its rank among nodes of that hash
    nodes = nodes.withColumn("tie", F.row_number().over(Window.partitionBy("h").orderBy("v")))
    nodes = cut(nodes.select(F.xxhash64("h", "tie").alias("node"), "d", "v", "rep", "copies"))

    # vectors travel as they came: floats take half the room, and become the same doubles in every task
    element = dict(vectors.dtypes)[vector_col]
    kind = np.dtype(np.float32 if element == "array<float>" else np.float64)

    def hashed(batches):
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                keys = bucket_ids(unit_rows(flat), *family(d, tables), tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([r.tobytes() for r in flat.astype(kind)], pa.binary()),
                        pa.array([r.tobytes() for r in keys], pa.binary()),
                        pa.array(keys.tolist(), pa.list_(pa.int64())),
                        part.column(3),
                    ],
                    ["node", "d", "raw", "keys", "buckets", "copies"],
                )

    prints = nodes.select("node", "d", "v", "copies").mapInArrow(
        hashed, "node long, d int, raw binary, keys binary, buckets array<long>, copies long"
    )
    prints = cut(prints)
    met = prints.select("node", "d", F.posexplode("buckets").alias("table", "bucket"))
    sizes = met.groupBy("d", "table", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.join(sizes, ["d", "table", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(F.lit(11), "node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "node", "d", "table", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own"
    )
    met = met.join(prints.select("node", "raw", "keys", "copies"), "node")
    # a pair that shares a bucket of an earlier table counts there: only those tables' buckets travel along
    met = met.withColumn("keys", F.expr("substring(keys, 1, 8 * table)"))

    def of_group(g):
        left = g["own"] == g["lo"]
        same = bool(g["lo"][0] == g["hi"][0])
        table, dimension = int(g["table"][0]), int(g["d"][0])

        def side(at):
            unit = unit_rows(np.frombuffer(b"".join(g["raw"][at]), kind).reshape(-1, dimension).astype(np.float64))
            keys = np.frombuffer(b"".join(g["keys"][at]), np.int64).reshape(-1, table) if table else None
            return g["node"][at], unit, keys, g["copies"][at].astype(np.int64)

        a = side(left)
        b = a if same else side(~left)
        if not len(a[0]) or not len(b[0]):
            return None
        linked = _links(a[1], b[1], a[2], b[2], table, same, least)
        if not linked.any():
            return None
        i, j = (np.array(x, np.int64) for x in zip(*_forest(linked, same), strict=True))
        sums_a, sums_b = linked @ b[3], linked.T @ a[3]
        node = [a[0], a[0][i]] if same else [a[0], b[0], a[0][i]]
        links = [sums_a, np.zeros(len(i), np.int64)] if same else [sums_a, sums_b, np.zeros(len(i), np.int64)]
        rest = len(a[0]) if same else len(a[0]) + len(b[0])
        to = [np.concatenate(node)[:rest], b[0][j]]
        node, links, to = np.concatenate(node), np.concatenate(links), np.concatenate(to)
        keep = (links > 0) | (node != to)
        return {"node": node[keep], "to": to[keep], "links": links[keep]}

    found = cut(map_sorted_groups(met, ["d", "table", "bucket", "lo", "hi"], "node long, to long, links long", of_group))
    sums = found.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    reached = connected_components(found.where("node <> to"), "node", "to").withColumnRenamed("node", "at")
    roots = nodes.select("node", "rep", "copies").join(reached, F.col("node") == F.col("at"), "left")
    roots = roots.select("node", "rep", "copies", F.coalesce("component", "node").alias("root"))
    names = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = roots.join(names, "root").join(sums, "node", "left")
    known = nodes.select("node", "v").join(
        known.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "node"
    )
    known = known.select(F.col("v").alias("w"), "component_id", "n_links")
    out = rows.join(known, F.col("v") == F.col("w"), "left")
    component = F.when(F.col("w").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
