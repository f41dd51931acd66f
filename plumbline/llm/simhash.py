"""SimHash near-duplicate classes, found with BK-trees over shards of fingerprints.

A text's fingerprint has a bit for each position that is set in over half of
its shingles' hashes. Fingerprints within ``radius`` differing bits are linked;
a class is what links reach.

Shards. The bits are cut into ``radius + 1`` blocks; two fingerprints within
the radius agree in at least one whole block (so the result is exact), and a
block's value, hashed, deals fingerprints into shards of ``SHARD_ROWS`` or so.
Each shard's fingerprints become BK-trees (children keyed by integer Hamming
distance to the parent) of ``TREE_ROWS`` at most, written as a table in the
shared folder. A tree is probed with its own rows and with the rows of the
shard's other trees, following only edges within the radius; every pair of
trees is a task's group of its own. No fingerprint passes through the driver:
trees go to the tasks that probe them by a keyed shuffle of that table. A task
returns links enough to connect what it found connected, never all pairs.

Wide fingerprints (several 64-bit lanes) serve similarity thresholds for which
a few bits don't do: there, shards are keyed by bands of shingle minima, which
texts of the wanted similarity share with a known probability. BK-trees then
only seek candidates; a pair is linked if the Jaccard similarity of its shingle
sets, which travel with the candidates, is the wanted one or more.

Nulls and ties. A null or empty text has no shingle: its fingerprint is zero,
linked like any other. Repeated rows share a fingerprint and so a class. A
class is named after its least doc_id; null ids count as absent for that, and
a class with null ids only has a null name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_sorted_groups, map_texts, small, utf8
from plumbline.operators.graph import Forest, connected_components
from plumbline.session import cut

#: Fingerprints in one BK-tree at most: bounds a tree's size (some 200 kB) and a task's memory.
TREE_ROWS = 8192
#: Fingerprints that a shard of bit blocks should have, about.
SHARD_ROWS = 512
#: Pairs of tree node and query that one step of a probe looks at, about.
PROBE_PAIRS = 1 << 21
#: Odd constants that spread one hash over further lanes and minima; made by rule, not by table.
_MIX = [int.from_bytes(xxhash.xxh64_digest(b"lane %d" % k, 7), "big") | 1 for k in range(64)]


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lower-cased, repeats included, as uint64."""
    if not text:
        return np.zeros(0, np.uint64)
    found = utf8(text).lower().split()  # bytes: ASCII case and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n
    )


def mix(hashes: np.ndarray, k: int) -> np.ndarray:
    """A further hash of each hash; lane 0 is the hash itself."""
    if k == 0:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(_MIX[k])
    return x ^ (x >> np.uint64(29))


def majority_bits(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` words of 64 bits: a bit is 1 if set in over half of the hashes; none: zero."""
    n = len(hashes)
    out = np.zeros(lanes, np.uint64)
    if not n:
        return out
    for k in range(lanes):
        sums = np.zeros(64, np.int64)
        for a in range(0, n, 16384):
            part = np.ascontiguousarray(mix(hashes[a : a + 16384], k)).view(np.uint8).reshape(-1, 8)
            sums += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each whole text, as a signed long."""

    def make():
        def of(texts):
            return [(int(majority_bits(shingle_hashes(t, words))[:1].view(np.int64)[0]),) for t in texts]

        return of

    return map_texts(docs, "fp long", make, id_col, text_col)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, words))


def wide_fingerprints(
    docs: DataFrame, words: int, lanes: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text_hash, node, n_set, fp, keys) of each text's set of shingles.

    ``node`` names the set, ``n_set`` is its size, ``fp`` has ``lanes`` * 64
    bits as binary, and each band of ``rows`` minima gives one shard key.
    """

    def make():
        def of(texts):
            out = []
            for t in texts:
                h = shingle_set(t, words)
                fp = majority_bits(h, lanes).tobytes()
                if len(h):
                    least = [int(mix(h, k).min()) for k in range(1, bands * rows + 1)]
                else:
                    least = [0] * (bands * rows)
                keys = [
                    xxhash.xxh64_intdigest(repr((b, least[b * rows : (b + 1) * rows])).encode()) - (1 << 63)
                    for b in range(bands)
                ]
                text_hash = b"" if t is None else hashlib.md5(utf8(t)).digest()
                out.append((text_hash, xxhash.xxh3_128_digest(h.tobytes()), len(h), fp, keys))
            return out

        return of

    return map_texts(docs, "text_hash binary, node binary, n_set long, fp binary, keys array<long>", make, id_col, text_col)


def text_hash(text_col: str):
    """The text hash of ``wide_fingerprints`` as a column."""
    return F.coalesce(F.unhex(F.md5(F.col(text_col).cast("string").cast("binary"))), F.lit(b""))


class BKTree:
    """Burkhard-Keller tree over rows of uint64 lanes: a child hangs on the edge of its distance to its parent.

    It is built level by level: all rows below a node measure their distance
    to it; the first row of each distance becomes the child on that edge, and
    the rest go on below that child. ``keys`` holds parent and edge of each
    child as one sorted number, so a node's edges within a range are a slice.
    """

    def __init__(self, rows: np.ndarray, keys: np.ndarray | None = None, children: np.ndarray | None = None):
        self.rows = rows
        self.width = 64 * rows.shape[1] + 1
        if keys is not None:
            self.keys, self.children = keys, children
            return
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        left, at = np.arange(1, len(rows)), np.zeros(max(0, len(rows) - 1), np.int64)
        while len(left):
            edge = at * self.width + np.bitwise_count(rows[left] ^ rows[at]).sum(axis=1, dtype=np.int64)
            edges, first, place = np.unique(edge, return_index=True, return_inverse=True)
            child = left[first]
            found.append((edges, child))
            below = child[place]
            rest = below != left
            left, at = left[rest], below[rest]
        keys, children = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def probe(self, queries: np.ndarray, radius: int):
        """Yields (nodes, indices of queries): all pairs within the radius, a block of queries at a time.

        A query that is d away from a node goes on only along its edges from d - radius to d + radius.
        """
        if not len(self.rows):
            return
        step = max(1, PROBE_PAIRS // len(self.rows))
        for start in range(0, len(queries), step):
            query = np.arange(start, min(start + step, len(queries)))
            node = np.zeros(len(query), np.int64)
            nodes, near = [], []
            while len(query):
                d = np.bitwise_count(queries[query] ^ self.rows[node]).sum(axis=1, dtype=np.int64)
                hit = d <= radius
                nodes.append(node[hit])
                near.append(query[hit])
                low = np.searchsorted(self.keys, node * self.width + np.maximum(d - radius, 0))
                high = np.searchsorted(self.keys, node * self.width + np.minimum(d + radius, self.width - 1), side="right")
                many = high - low
                query = np.repeat(query, many)
                ends = np.cumsum(many)
                node = self.children[np.arange(len(query)) + np.repeat(low - ends + many, many)]
            yield np.concatenate(nodes), np.concatenate(near)


def forest(tree: BKTree, queries: np.ndarray, radius: int, same: bool, alike=None) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect all that a probe of one tree connects: (tree rows, probing rows).

    ``alike(tree row, probing rows)`` says which rows within the radius are to be linked; without it, all are.
    """
    shift = 0 if same else len(tree.rows)
    out = Forest(shift + len(queries))
    for nodes, near in tree.probe(queries, radius):
        if alike is None:
            out.add(nodes, near + shift)
            continue
        order = np.argsort(nodes, kind="stable")
        nodes, near = nodes[order], near[order]
        for own in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(nodes)) + 1):
            if not len(own):
                continue
            node, those = int(nodes[own[0]]), near[own]
            those = those[out.label[those + shift] != out.label[node]]  # what is connected already needs no test
            if len(those):
                those = those[alike(node, those)]
                out.add(np.full(len(those), node), those + shift)
    if not out.links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*out.links, strict=True))
    return a, b - shift


class Jaccard:
    """Tells which probing sets have a Jaccard similarity of ``least`` or more with a tree's set, exactly."""

    def __init__(self, tree_sets: list[np.ndarray], probe_sets: list[np.ndarray], least: float):
        self.tree, self.probe, self.least = tree_sets, probe_sets, least
        self.sizes = np.fromiter(map(len, probe_sets), np.int64, len(probe_sets))

    def __call__(self, node: int, near: np.ndarray) -> np.ndarray:
        one, sizes = self.tree[node], self.sizes[near]
        could = np.minimum(sizes, len(one)) >= self.least * np.maximum(sizes, len(one)) - 1e-6
        could &= (sizes > 0) & (len(one) > 0)
        out = np.zeros(len(near), bool)
        if not could.any():
            return out
        many = np.concatenate([self.probe[i] for i in near[could].tolist()])
        hit = one[np.minimum(np.searchsorted(one, many), len(one) - 1)] == many
        ends = np.cumsum(sizes[could])
        total = np.concatenate(([0], np.cumsum(hit)))
        common = total[ends] - total[ends - sizes[could]]
        out[could] = common / (sizes[could] + len(one) - common) >= self.least
        return out


def shard_trees(nodes: DataFrame) -> DataFrame:
    """(shard, tree, trees, prints, keys, children): the BK-trees of (shard, fp), as a table in the shared folder.

    Shards of one fingerprint are left out before anything is sent.
    """
    sizes = nodes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = nodes.join(sizes, "shard").withColumn("trees", F.ceil(F.col("n") / TREE_ROWS).cast("int"))
    met = met.withColumn("tree", F.pmod(F.xxhash64(F.lit(11), "fp"), F.col("trees")).cast("int")).drop("n")

    def of_group(g):
        tree = BKTree(g["fp"].astype(np.int64).view(np.uint64).reshape(-1, 1))
        parts = {"prints": tree.rows, "keys": tree.keys.astype(np.int32), "children": tree.children.astype(np.int32)}
        return {k: g[k][:1] for k in ("shard", "tree", "trees")} | {k: [v.tobytes()] for k, v in parts.items()}

    schema = "shard long, tree int, trees int, prints binary, keys binary, children binary"
    return cut(map_sorted_groups(met, ["shard", "tree"], schema, of_group))


def shard_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links among the fingerprints of (shard, fp) that share a shard, as a forest for each pair of trees."""
    trees = shard_trees(nodes).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    trees = trees.withColumns({"lo": F.least("tree", "other"), "hi": F.greatest("tree", "other")}).drop("trees", "other")

    def of_group(g):
        held = {}
        for k, t in enumerate(g["tree"].tolist()):
            rows = np.frombuffer(g["prints"][k], np.uint64).reshape(-1, 1)
            held[t] = BKTree(rows, *(np.frombuffer(g[c][k], np.int32).astype(np.int64) for c in ("keys", "children")))
        lo, hi = int(g["lo"][0]), int(g["hi"][0])
        if lo not in held or hi not in held:
            return None
        a, b = forest(held[lo], held[hi].rows, radius, lo == hi)
        return {"a": held[lo].rows[a, 0].view(np.int64), "b": held[hi].rows[b, 0].view(np.int64)} if len(a) else None

    return map_sorted_groups(trees, ["shard", "lo", "hi"], "a long, b long", of_group)


def block_shards(fp: str, radius: int, bits: int):
    """The shards of a fingerprint: block number and hashed block value, one for each of ``radius + 1`` blocks."""
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    shards = []
    for k in range(blocks):
        width = edges[k + 1] - edges[k]
        value = F.shiftrightunsigned(F.col(fp), edges[k]).bitwiseAND(F.lit((1 << width) - 1))
        shards.append(F.lit(k << 58) + F.pmod(F.xxhash64(F.lit(7), value), F.lit(1 << bits)))
    return F.array(*shards)


def classes(prints: DataFrame, radius: int, id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) for each row of (id, fp): exact classes at ``radius`` differing bits."""
    reps = cut(prints.groupBy("fp").agg(F.min(id_col).alias("rep")))
    bits = max(0, (reps.count() // SHARD_ROWS).bit_length())
    links = shard_links(reps.select(F.explode(block_shards("fp", radius, bits)).alias("shard"), "fp"), radius)
    return named(prints, reps, links, id_col)


def named(prints: DataFrame, reps: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Names each row's class after its least id, given (fp, rep) and links between fingerprints."""
    reached = connected_components(links, "a", "b")
    roots = reps.join(reached, reps.fp == reached.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("root")
    )
    names = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    named_fp = roots.join(names, "root").select(F.col("fp").alias("__pl_fp"), "component_id")
    return prints.join(named_fp, F.col("fp") == F.col("__pl_fp")).drop("__pl_fp")


def simhash_classes(
    docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each row of ``docs``."""
    prints = cut(fingerprints(docs, words, id_col, text_col))
    out = classes(prints, radius, id_col)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For a wanted share of common shingles: lanes, bands and rows of minima. At 0.8 a pair meets in
#: at least one of 8 bands of 3 with probability 1 - (1 - 0.8**3)**8 = 0.997.
LANES, BANDS, BAND_ROWS = 8, 8, 3
#: Shingle hashes in one BK-tree's sets: bounds a task's memory where texts are long.
TREE_HASHES = 1 << 22


def radius_for(similarity: float, lanes: int) -> int:
    """Differing bits to expect of two shingle sets of a Jaccard similarity, plus six standard deviations.

    For sets, the cosine is 2J / (1 + J); a bit differs with probability
    arccos(cosine) / pi. Very small sets differ in more bits than that (four
    of five shingles: 96 instead of 77), hence six.
    """
    p = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    bits = 64 * lanes
    return int(bits * p + 6 * np.sqrt(bits * p * (1 - p)))


def similar_links(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """(a, b): links among ``nodes`` (node, text_hash, n_set, fp, keys), a forest for each pair of trees.

    Shards with the same members (as a count and two sums of hashes tell) are
    searched once. Only the sets of texts that share a key are made again and
    sent: to the tasks that compare them.
    """
    dealt = nodes.select("node", "text_hash", "n_set", F.explode(F.array_distinct("keys")).alias("shard"))
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "node").cast("decimal(38,0)"))
    sizes = dealt.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_set").alias("hashes"), total(1).alias("s1"), total(2).alias("s2")
    ).where("n > 1")
    sizes = sizes.groupBy("n", "hashes", "s1", "s2").agg(F.min("shard").alias("shard"))
    trees = F.greatest(F.ceil(F.col("n") / TREE_ROWS), F.ceil(F.col("hashes") / TREE_HASHES)).cast("int")
    met = cut(dealt.join(sizes.select("shard", trees.alias("trees")), "shard").select("shard", "trees", "node", "text_hash"))
    texts = docs.select(text_hash(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    wanted = small(cut(met.select("text_hash").distinct()))
    texts = texts.join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.min("text").alias("text"))

    def make():
        return lambda found: [(shingle_set(t, words).tobytes(),) for t in found]

    sets = map_texts(texts, "hashes binary", make, "text_hash", "text")
    sets = sets.join(nodes.select("text_hash", "fp"), "text_hash")
    own = F.pmod(F.xxhash64(F.lit(11), "node"), F.col("trees")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    met = met.select("shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "text_hash")
    met = met.join(sets, "text_hash").drop("text_hash")
    radius = radius_for(similarity, LANES)

    def of_group(g):
        left = g["own"] == g["lo"]
        same = g["lo"][0] == g["hi"][0]
        a, b = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        if not len(a) or not len(b):
            return None
        rows = np.frombuffer(b"".join(g["fp"]), np.uint64).reshape(-1, LANES)
        sets = [np.frombuffer(x, np.uint64) for x in g["hashes"]]
        alike = Jaccard([sets[i] for i in a], [sets[i] for i in b], similarity)
        i, j = forest(BKTree(rows[a]), rows[b], radius, same, alike)
        return {"a": g["node"][a[i]], "b": g["node"][b[j]]} if len(i) else None

    return map_sorted_groups(met, ["shard", "lo", "hi"], "a binary, b binary", of_group)


def similar_rows(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, name): ``name`` is the least (id, text_hash) of the row's class, or null if all ids are."""
    prints = cut(wide_fingerprints(docs, words, LANES, BANDS, BAND_ROWS, id_col, text_col))
    own = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")))
    reps = cut(prints.groupBy("node").agg(
        F.min(own).alias("rep"), F.min("text_hash").alias("text_hash"),
        *[F.first(c).alias(c) for c in ("n_set", "fp", "keys")],  # the set's own
    ))
    links = similar_links(docs, reps, words, similarity, text_col)
    reached = connected_components(links, "a", "b").withColumnRenamed("node", "reached")
    roots = reps.join(reached, reps.node == reached.reached, "left").select(
        "node", "rep", F.coalesce("component", "node").alias("root")
    )
    names = roots.groupBy("root").agg(F.min("rep").alias("name"))
    return prints.select(id_col, "text_hash", "node").join(roots.join(names, "root").select("node", "name"), "node").drop("node")


def similar_classes(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, component_id) at a Jaccard similarity of shingle sets, candidates from BK-trees over shards keyed by minima.

    Texts with equal sets form one node first.
    """
    return similar_rows(docs, words, similarity, id_col, text_col).select(id_col, F.col("name.id").alias("component_id"))


def keep_one(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each class of similar texts: that of least id, with its own columns.

    Of rows that share the least id, one whose text hashes least stays; rows
    of one id in several classes stay in each. Rows with a null id stay: no
    name tells them apart.
    """
    found = similar_rows(docs.where(F.col(id_col).isNotNull()), words, similarity, id_col, text_col)
    named = found.select(F.col(id_col).alias("__pl_id"), F.col("text_hash").alias("__pl_hash"), (F.col("name.id") == F.col(id_col)) & (F.col("name.hash") == F.col("text_hash")))
    kept = named.toDF("__pl_id", "__pl_hash", "own").where("own").groupBy("__pl_id", "__pl_hash").agg((F.count(F.lit(1)) > 1).alias("__pl_again"))
    kept = cut(kept)
    on = (F.col(id_col) == F.col("__pl_id")) & (text_hash(text_col) == F.col("__pl_hash"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.where(F.col(id_col).isNull()).unionByName(docs.join(small(kept.where("NOT __pl_again")), on).select(*columns))
    again = kept.where("__pl_again")
    if not again.isEmpty():
        # of rows that repeat id and text one stays, by minima before anything is sent: a group of any size is no one task's
        order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
        met = docs.join(small(again), on).groupBy("__pl_id", "__pl_hash").agg(F.min_by(F.struct(*columns), order).alias("__pl_row"))
        out = out.unionByName(met.select("__pl_row.*"))
    return out
