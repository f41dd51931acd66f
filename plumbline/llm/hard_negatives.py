"""Hard negatives by a secondary sort: pair scores in one shuffle, keyed (anchor, descending score, id).

Rows are labelled vectors. Each component x becomes floor(256 * x); a row's
score for an anchor is their inner product, an exact integer. An anchor's
positives are its first ``positives`` other rows of its own label; for each
positive, the hard negatives are the first ``negatives`` rows of other labels
whose score is between two shares (in percent) of the positive's. First means
higher score, ties by smaller id.

Anchors are a stated query set (ids divisible by ``every``), compared with all
rows in blocks: rows are dealt into blocks by a hash of their id, anchors
likewise, and each pair of blocks is a task with one matrix product, so neither
anchors nor rows pass the driver or meet in one task, and a label may hold any
share of the rows. That is done twice. The first pass finds each block's first
same-label rows of an anchor, of which the anchor's first are its positives.
The second knows the positives' scores, and so each block sends of each window
no more than the first ``negatives`` rows that lie in it: what comes first of
all is first in its block. Nothing else is dropped, so the result is whole.

Positives and negatives then go through one ``repartitionAndSortWithinPartitions``
by packed keys: the anchor (by which they are dealt), the inverted score, the
kind (a positive before negatives of its score) and the id, big-endian, so that
bytes sort as numbers do. A streaming iterator opens a window when it meets a
positive, hands each negative to the windows that hold it, and closes windows
that are full or passed; it never holds an anchor's rows.

Null ids, null labels, null vectors and null or non-finite components take no
part. Where an id is divisible by 7, the label first becomes (label + 1) % 10,
as a long. Rows equal in id, label and vector are one row; rows that share only
an id are rows of their own, and are never each other's positives.
Vectors of two lengths have no inner product and don't meet; vectors of length
zero score 0. Scores are exact; one beyond a long counts as the nearest long.
An anchor without a positive, or a window without a negative, gives no rows. A
positive below zero has an empty window. Other columns are never read, so their
names may clash. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, map_sorted_groups
from plumbline.session import cut

#: Rows and anchors in one block, about: a product of some 32 MB.
ROW_BLOCK, ANCHOR_BLOCK = 1024, 4096
_LONG = (1 << 63) - 1
_SIGN = 1 << 63
#: Anchor (id, twin), inverted score, kind, id, twin.
_KEY = struct.Struct(">QIQBQI")
_ANCHOR_BYTES = 12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the vectors' cells floor(256 * x), as longs.

    In doubles where no sum can leave 53 bits, else in whole numbers of any size.
    """
    with np.errstate(over="ignore"):
        one, two = np.floor(256.0 * a), np.floor(256.0 * b)
    most = max(1.0, np.abs(one).max(initial=0)) * max(1.0, np.abs(two).max(initial=0))
    if most * max(1, a.shape[1]) < 2.0**53:
        return (one @ two.T).astype(np.int64)
    cell = lambda x: int(x) * 256 if abs(x) >= 2.0**53 else int(np.floor(256.0 * x))
    one, two = ([[cell(x) for x in r] for r in side.tolist()] for side in (a, b))
    out = [[max(-_LONG, min(_LONG, sum(x * y for x, y in zip(r, s, strict=True)))) for s in two] for r in one]
    return np.array(out, np.int64).reshape(len(a), len(b))


def in_order(scores: np.ndarray) -> np.ndarray:
    """Places of each row's scores, highest first, ties by place."""
    return np.argsort(-scores, axis=1, kind="stable")


class Block:
    """Anchors and rows of one pair of blocks, rows in the order of ids; ``score`` has all their products."""

    def __init__(self, g: dict[str, np.ndarray], kind: np.dtype):
        own = g["side"] == 0
        self.anchor = {k: v[own] for k, v in g.items()}
        order = np.flatnonzero(~own)
        order = order[np.lexsort((g["twin"][order], g["id"][order]))]
        self.row = {k: v[order] for k, v in g.items()}
        d = int(g["d"][0])
        vectors = lambda side: np.frombuffer(b"".join(side["raw"]), kind).astype(np.float64).reshape(len(side["raw"]), d)
        self.score = products(vectors(self.anchor), vectors(self.row))

    def labels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(anchors of one label, which rows have it)."""
        for label in np.unique(self.anchor["label"]):
            yield np.flatnonzero(self.anchor["label"] == label), self.row["label"] == label


    def pairs(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict | None:
        """Pairs of (anchor, row, score) places as columns."""
        if not found:
            return None
        a, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
        named = {"anchor": self.anchor["id"][a], "anchor_twin": self.anchor["twin"][a], "id": self.row["id"][r], "twin": self.row["twin"][r]}
        return named | {"score": s} if len(a) else None


def first_positives(block: Block, most: int) -> dict | None:
    """The block's first ``most`` same-label rows of each anchor, other ids only."""
    found = []
    for anchors, same in block.labels():
        rows = np.flatnonzero(same)
        ids = block.row["id"][rows]
        own = np.unique(ids, return_counts=True)[1].max(initial=0)  # of the first places, so many at most have the anchor's own id
        score = block.score[np.ix_(anchors, rows)]
        place = in_order(score)[:, : most + own]
        other = ids[place] != block.anchor["id"][anchors][:, None]
        i, j = np.nonzero(other & (np.cumsum(other, axis=1) <= most))
        found.append((anchors[i], rows[place[i, j]], score[i, place[i, j]]))
    return block.pairs(found)


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest score of a positive's negatives: low * p <= 100 * n <= high * p."""
    return -((-low * positive) // 100), (high * positive) // 100


def first_negatives(block: Block, most: int, low: int, high: int) -> dict | None:
    """The block's rows of other labels that are among the first ``most`` of a window of an anchor."""
    found = []
    for anchors, same in block.labels():
        rows = np.flatnonzero(~same)
        place = in_order(block.score[np.ix_(anchors, rows)])
        score = np.take_along_axis(block.score[np.ix_(anchors, rows)], place, axis=1)
        positives = [block.anchor["positives"][a].tolist() for a in anchors]
        taken = np.zeros(score.shape, bool)
        for k in range(max(map(len, positives))):
            some = np.array([i for i, p in enumerate(positives) if k < len(p)], np.int64)
            bounds = [window(positives[i][k], low, high) for i in some]
            least, greatest = (np.array([max(-_LONG, min(_LONG, x)) for x in side], np.int64)[:, None] for side in zip(*bounds, strict=True))
            at = (score[some] > greatest).sum(axis=1)[:, None] + np.arange(most)
            i, c = np.nonzero(at < score.shape[1])
            c = at[i, c]
            fits = score[some[i], c] >= least[i, 0]
            taken[some[i[fits]], c[fits]] = True
        i, c = np.nonzero(taken)
        found.append((anchors[i], rows[place[i, c]], score[i, c]))
    return block.pairs(found)


def pack(anchor: int, anchor_twin: int, score: int, negative: int, row: int, twin: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, positives first, and id."""
    return _KEY.pack(anchor + _SIGN, anchor_twin, _LONG - score, negative, row + _SIGN, twin)


def unpack(key: bytes) -> tuple[int, int, int, int, int, int]:
    anchor, anchor_twin, score, negative, row, twin = _KEY.unpack(key)
    return anchor - _SIGN, anchor_twin, _LONG - score, negative, row - _SIGN, twin


def open_windows(keys: Iterable[bytes], most: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive's score, negative's score) from keys in order.

    Held at a time: the open windows of one anchor, which are no more than its positives.
    """
    last, opened = None, []
    for key in keys:
        anchor, _, score, negative, row, _ = unpack(key)
        if key[:_ANCHOR_BYTES] != last:
            last, opened = key[:_ANCHOR_BYTES], []
        if not negative:
            least, greatest = window(score, low, high)
            opened.append([row, score, least, greatest, 0])
            continue
        for w in opened:
            if w[2] <= score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], row, w[1], score
        opened = [w for w in opened if w[4] < most and score >= w[2]]


def _dealt(side: DataFrame, own: str, other: str, blocks: int) -> DataFrame:
    """``side`` in blocks of its own, once for each block of the other side."""
    return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumnRenamed("block", own)


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1 among those returned."""
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = np.dtype(np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<float>" if kind.itemsize == 4 else "array<double>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, ((F.col("label").cast("decimal(20,0)") + 1) % 10).cast("long")).otherwise(F.col("label")))

    def raw_bytes(batches):
        for batch in batches:
            lists = batch.column(2).to_pylist()
            raw = pa.array([np.array(v, kind).tobytes() for v in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, lists), pa.int32()), raw], ["id", "label", "d", "raw"])

    rows = rows.mapInArrow(raw_bytes, "id long, label long, d int, raw binary").distinct()
    twin = F.row_number().over(Window.partitionBy("id").orderBy("label", "d", "raw")) - 1  # a row for each row that shares an id
    rows = cut(rows.withColumn("twin", twin))
    anchors = rows.where(F.col("id") % every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    row_blocks, anchor_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_anchors // anchor_block))
    block = lambda n: F.pmod(F.xxhash64(F.lit(17), "id", "twin"), F.lit(n)).cast("int")
    dealt_rows = _dealt(rows.withColumn("block", block(row_blocks)), "rb", "ab", anchor_blocks).withColumn("side", F.lit(1))
    of_anchors = lambda side: _dealt(side.withColumn("block", block(anchor_blocks)), "ab", "rb", row_blocks).withColumn("side", F.lit(0))
    on, pairs = ["d", "ab", "rb"], "anchor long, anchor_twin int, id long, twin int, score long"

    def sides(g):
        return len(np.unique(g["side"])) == 2

    def pass_one(g):
        return first_positives(Block(g, kind), positives) if sides(g) else None

    met = of_anchors(anchors).unionByName(dealt_rows)
    found = map_sorted_groups(met, on, pairs, pass_one)
    order = Window.partitionBy("anchor", "anchor_twin").orderBy(F.desc("score"), "id", "twin")
    firsts = cut(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives).drop("nth"))

    def pass_two(g):
        return first_negatives(Block(g, kind), negatives, low, high) if sides(g) else None

    windows = firsts.groupBy(F.col("anchor").alias("id"), F.col("anchor_twin").alias("twin")).agg(F.collect_list("score").alias("positives"))
    known = anchors.join(windows, ["id", "twin"])  # at most ``positives`` scores for each
    met = of_anchors(known).unionByName(dealt_rows.withColumn("positives", F.lit(None).cast("array<long>")))
    seconds = map_sorted_groups(met, on, pairs, pass_two)
    both = cut(firsts.withColumn("negative", F.lit(0)).unionByName(seconds.withColumn("negative", F.lit(1))))

    keys = both.rdd.map(lambda r: (pack(r.anchor, r.anchor_twin, r.score, r.negative, r.id, r.twin), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_anchor = lambda key: struct.unpack(">Q", key[:8])[0] * 0x9E3779B97F4A7C15 % (1 << 64) >> 20
    ordered = keys.repartitionAndSortWithinPartitions(parts, of_anchor)
    mined = ordered.mapPartitions(lambda part: open_windows((k for k, _ in part), negatives, low, high))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(mined, schema)
