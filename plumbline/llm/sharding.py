"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions, racks and shards. At each level a row draws a number for
each child, -ln(u) / weight with u hashed from the row's key and the child's
name, and descends into the child that draws least: child c is chosen with
probability weight(c) / sum of weights. A child's draw depends on nothing but
key, name and weight, so a weight that rises draws rows into its subtree and
one that falls lets rows go; no row moves between subtrees whose weights stay.

Growth. A shard that is added becomes a region of its own, so raises no other
subtree's weight: rows move into it only (law ``key``). Re-weighting inside a
region moves rows between that region and others, and within it.

A row's key is its id as text (null: an empty key), so rows with equal ids
share a shard. A null text has size 16 and the checksum of no bytes. Slots
count from 0 in each shard without gaps; rows that are equal in id and text
are counted, take adjacent slots in any order, and are dealt out again by
chunks, so that no number of them is one task's. Long texts only cost their
bytes; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import expanded, gapless_rank
from plumbline.session import cut

#: regions -> racks -> shards with weights.
Tree = list[list[list[tuple[int, float]]]]

#: Rows that one window task numbers, about.
SLOT_ROWS = 1_000


def grown_tree(base: int, shards: int, rack: int = 4, region: int = 2) -> Tree:
    """``base`` shards dealt over racks of ``rack`` and regions of ``region`` racks; each later shard by itself."""
    racks = [[(s, 1.0) for s in range(a, min(a + rack, base))] for a in range(0, base, rack)]
    tree = [racks[a : a + region] for a in range(0, len(racks), region)]
    return tree + [[[(s, 1.0)]] for s in range(base, shards)]


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("/", name, key).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _children(rows: list[tuple[str, float, int]]) -> Column:
    """A level's children as a literal: what a draw needs of each."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(number).alias("number"))
            for name, weight, number in rows
        ]
    )


def _least(key: Column, children: Column) -> Column:
    """The number of the child with the least draw; ties go to the lesser number."""
    draws = F.transform(children, lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("d"), c["number"].alias("c")))
    return F.array_min(draws).getField("c")


def _levels(df: DataFrame, key: Column, tree: Tree, alias: str) -> DataFrame:
    """Descends the tree: a region, then one of its racks, then one of its shards."""
    weigh = lambda rack: sum(w for _, w in rack)
    regions = _children([(f"region:{r}", sum(map(weigh, racks)), r) for r, racks in enumerate(tree)])
    places = [(r, k) for r, racks in enumerate(tree) for k in range(len(racks))]
    number = {place: n for n, place in enumerate(places)}
    racks = F.array(
        *[_children([(f"rack:{r}.{k}", weigh(shards), number[r, k]) for k, shards in enumerate(racks)]) for r, racks in enumerate(tree)]
    )
    shards = F.array(*[_children([(f"shard:{r}.{k}.{s}", w, s) for s, w in tree[r][k]]) for r, k in places])
    down = df.withColumn("__pl_region", _least(key, regions))
    down = down.withColumn("__pl_rack", _least(key, F.element_at(racks, F.col("__pl_region") + 1)))
    down = down.withColumn(alias, _least(key, F.element_at(shards, F.col("__pl_rack") + 1)).cast("int"))
    return down.drop("__pl_region", "__pl_rack")


def place(df: DataFrame, key: Column, tree: Tree, alias: str = "shard") -> DataFrame:
    """Adds ``alias``, the shard of each row's ``key`` (text)."""
    return _levels(df, F.coalesce(key.cast("string"), F.lit("")), tree, alias)


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    sized = docs.select(
        F.col(id_col), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    sized = sized.groupBy(id_col, "size", "text_crc32").agg(F.count(F.lit(1)).alias("__pl_rows"))
    key = F.col(id_col)
    placed = place(sized, key, grown_tree(shards, shards), "shard")
    placed = cut(place(placed, key, grown_tree(shards, shards + 1), "grown_shard"))
    buckets = max(1, -(-placed.count() // (shards * SLOT_ROWS)))
    name = F.concat_ws("/", F.lit("slot"), F.coalesce(key.cast("string"), F.lit("")), F.col("text_crc32").cast("string"))
    bucket = F.pmod(F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    order = [F.col(id_col), F.col("text_crc32"), F.col("size")]
    ranked = gapless_rank(placed, ["shard"], order, bucket, "__pl_first", weight="__pl_rows")
    each = expanded(ranked, "__pl_rows", "__pl_nth").withColumn("slot", (F.col("__pl_first") + F.col("__pl_nth")).cast("long"))
    return each.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
