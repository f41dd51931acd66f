"""Distances among rows: neighbours by a bounded sample, densities and clusters over all rows, directions of classes.

Rows are (row_id long, y, x): x is an array of standardised numbers.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import Forest, connected_components
from plumbline.operators.groups import added_up, bound_batches, map_sorted_groups
from plumbline.session import cut

#: Classes beyond which a label is no label.
MAX_CLASSES = 1_000
#: Directions by which rows are dealt into cells.
AXES = 3
#: Distances that are held at a time, and bytes of rows that are sent to every task, at most.
PAIRS, SENT_BYTES = 4_000_000, 64 << 20


def _moments(rows: DataFrame) -> DataFrame:
    """(y, n, sums, products): each class's number of rows, sums of columns, and sums of their products, as doubles in bytes.

    Tasks add up their own rows, and a fold their sums.
    """
    schema = "y string, salt int, n long, sums binary, products binary"

    def out(parts: dict, salt: int):
        for y, (n, s, g) in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([y]), pa.array([salt], pa.int32()), pa.array([n]), pa.array([s.tobytes()]), pa.array([g.tobytes()])], ["y", "salt", "n", "sums", "products"])

    def own(batches):
        from pyspark import TaskContext

        salt, parts = TaskContext.get().partitionId() % 32, {}
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(labels), -1)
            for y in set(labels.tolist()):
                mine = x[labels == y]
                n, s, g = parts.get(y, (0, 0.0, 0.0))
                parts[y] = (n + len(mine), s + mine.sum(axis=0), g + mine.T @ mine)
            if len(parts) > 256:  # many classes are handed on as they come
                yield from out(parts, salt)
                parts = {}
        yield from out(parts, salt)

    bound_batches(rows.sparkSession)
    return added_up(rows.select("y", "x").mapInArrow(own, schema), "y", ["sums", "products"])


def directions(rows: DataFrame, least_rows: int = 40) -> DataFrame:
    """(y, n, mean, direction, strength, axes): each class's centre and the direction in which its rows differ most.

    The direction is the top right singular vector of the class's centred rows:
    the top eigenvector of their products, which are the size of the columns
    squared, however many rows there are. ``strength`` is its share of the
    variance, ``axes`` are the first ``AXES`` such directions.
    """

    def top(batches):
        for batch in batches:
            for y, n, s, g in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                mean = np.frombuffer(s) / n
                d = len(mean)
                spread = np.frombuffer(g).reshape(d, d) - n * np.outer(mean, mean)
                values, vectors = np.linalg.eigh((spread + spread.T) / 2)
                total = float(np.trace(spread))
                strength = float(values[-1] / total) if total > 0 else 0.0
                cells = [[y], [n], [mean.tolist()], [vectors[:, -1].tolist()], [strength], [vectors[:, ::-1][:, :AXES].T.tolist()]]
                kinds = [pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["y", "n", "mean", "direction", "strength", "axes"])

    enough = _moments(rows).where(F.col("n") >= least_rows)
    return cut(enough.mapInArrow(top, "y string, n long, mean array<double>, direction array<double>, strength double, axes array<array<double>>"))


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by norms and one product: right but for rounding."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """How far ``_squares`` may be off."""
    return 1e-11 * (1 + float((a * a).sum(axis=1).max(initial=0)) + float((b * b).sum(axis=1).max(initial=0)))


def _sent(sample: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, matrix) of a bounded sample in the order of ids; fewer rows where they are so wide that all would be too many bytes."""
    wide = sample.select(F.size("x").alias("d")).first()
    most = rows if wide is None or not wide.d else min(rows, SENT_BYTES // (8 * wide.d))
    got = sample.select("row_id", "y", "x").orderBy(F.xxhash64(F.lit(3), "row_id"), "row_id").limit(most).toArrow()
    ids = got.column(0).to_numpy()
    order = np.argsort(ids, kind="stable")
    x = _matrix(got.column(2).combine_chunks()) if len(ids) else np.zeros((0, 0))
    return ids[order], np.array(got.column(1).to_pylist(), object)[order], x[order]


def neighbour_labels(rows: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """(row_id, score): the share of another label among a row's k nearest other rows of the sample.

    Distances are Euclidean and exact: a product of blocks finds candidates,
    which are measured again by their differences. Ties go to the lesser id.
    """
    context = rows.sparkSession.sparkContext
    bound_batches(rows.sparkSession)
    sent = context.broadcast(_sent(sample, 2 * 50_000))

    def run(batches):
        ids, labels, x = sent.value
        n = len(ids)
        for batch in batches:
            own, ys, mine = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), _matrix(batch.column(2))
            out_id, out = [], []
            step = max(1, PAIRS // max(1, n))
            for a in range(0, len(own) if n else 0, step):
                part = mine[a : a + step]
                near = _squares(part, x)
                slack = _slack(part, x)
                same = own[a : a + step, None] == ids[None, :]
                near[same] = np.inf
                if n > k:
                    last = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack
                for i in range(len(part)):
                    at = np.flatnonzero(near[i] <= last[i]) if n > k else np.flatnonzero(np.isfinite(near[i]))
                    if not len(at):
                        continue
                    exact = np.sqrt(((x[at] - part[i]) ** 2).sum(axis=1))
                    at = at[np.lexsort((ids[at], exact))[:k]]
                    out_id.append(own[a + i])
                    out.append(float((labels[at] != ys[a + i]).mean()))
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.float64())], ["row_id", "score"])

    return rows.select("row_id", "y", "x").mapInArrow(run, "row_id long, score double")


def fifth_neighbours(rows: DataFrame, sizes: DataFrame, probes: int, seed: int, share: float = 0.1, nth: int = 5) -> DataFrame:
    """(y, eps): the ``share`` quantile of distances to the ``nth`` neighbour among all rows of a class; 1 where that is 0.

    At most ``probes`` rows of each class of ``sizes`` (y, n_class), and some
    20,000 in all, are sent to every task, by a hash of their ids; each task
    tells how near its own rows come to each.
    """
    classes = max(1, sizes.count())
    each = max(50, min(probes, 20_000 // classes))
    steps = 1 << 30
    drawn = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("row_id").cast("string")), F.lit(steps)) < F.lit(steps) * F.least(F.lit(1.0), each / F.col("n_class"))
    chosen = rows.join(F.broadcast(sizes), "y").where(drawn).select("row_id", "y", "x")
    context = rows.sparkSession.sparkContext
    bound_batches(rows.sparkSession)
    ids, labels, x = _sent(chosen, 4 * 20_000)
    sent = context.broadcast({y: (ids[labels == y], x[labels == y]) for y in set(labels.tolist())})

    def run(batches):
        best = {}
        for batch in batches:
            own, ys, mine = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), _matrix(batch.column(2))
            for y, (probe, at) in sent.value.items():
                here = np.flatnonzero(ys == y)
                step = max(1, PAIRS // max(1, len(probe)))
                for a in range(0, len(here), step):
                    part = here[a : a + step]
                    near = _squares(at, mine[part])
                    near[probe[:, None] == own[part][None, :]] = np.inf
                    most = min(nth + 3, near.shape[1])
                    few = np.argpartition(near, most - 1, axis=1)[:, :most]
                    exact = np.sqrt(((at[:, None, :] - mine[part][few]) ** 2).sum(axis=2))
                    exact[np.isinf(np.take_along_axis(near, few, axis=1))] = np.inf
                    held = best.get(y)
                    both = exact if held is None else np.concatenate((held, exact), axis=1)
                    best[y] = np.sort(both, axis=1)[:, :nth]
        for y, distances in best.items():
            kept = [d[np.isfinite(d)].tolist() for d in distances]
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(kept)), pa.array(sent.value[y][0]), pa.array(kept, pa.list_(pa.float64()))], ["y", "row_id", "near"])

    found = rows.select("row_id", "y", "x").mapInArrow(run, "y string, row_id long, near array<double>")
    found = found.select("y", "row_id", F.explode("near").alias("d")).groupBy("y", "row_id").agg(F.sort_array(F.collect_list("d")).alias("near"))
    eps = found.where(F.size("near") >= nth).groupBy("y").agg(F.percentile(F.col("near")[nth - 1], F.lit(share)).alias("eps"))  # of the probes
    return cut(eps.withColumn("eps", F.when(F.col("eps") > 0, F.col("eps")).otherwise(1.0)))


#: Nodes in one block of a cell, and parts into which a tile's side is cut for the nodes that stand for it.
BLOCK_ROWS, PARTS = 2048, 8
#: Tiles of a class further from its origin than this aren't told apart for sure.
FAR = 1e9


def _cells(df: DataFrame, axes: DataFrame) -> DataFrame:
    """``df`` (y, x, eps, ...) with ``cell``: its places along ``AXES`` directions in steps of eps."""
    at = F.transform("axes", lambda w: F.floor(F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / F.col("eps")).cast("long"))
    return df.join(F.broadcast(axes), "y").withColumn("cell", at).drop("axes")


def _step():
    """The side of a tile: rows of one tile lie within eps of each other, in all columns and whatever is rounded."""
    return F.col("eps") / F.sqrt(F.size("x")) * (1 - 1e-6)


def _tiled(nodes: DataFrame, min_samples: int) -> DataFrame:
    """``nodes`` with ``tile``, ``dense`` and ``home``.

    Tiles are cubes of a diagonal of eps. A tile of ``min_samples`` rows is
    dense: its nodes are cores of one cluster, without a distance measured.
    Its least node is their ``home``; any other node is its own.
    """
    near = F.forall("x", lambda v: F.abs(v / _step()) < FAR)
    placed = nodes.withColumn("tile", F.when(near, F.transform("x", lambda v: F.floor(v / _step()).cast("long"))))
    full = placed.where("tile IS NOT NULL").groupBy("y", "tile").agg(F.sum("weight").alias("__n"), F.min("row_id").alias("home")).where(F.col("__n") >= min_samples)
    return placed.join(full.drop("__n"), ["y", "tile"], "left").withColumn("dense", F.col("home").isNotNull()).withColumn("home", F.coalesce("home", "row_id"))


_DEALT = ["y", "cell", "kind", "i", "j", "side", "row_id", "home", "x", "weight", "core", "eps"]


def _block(n: str):
    return F.pmod(F.xxhash64(F.lit(9), "row_id"), F.col(n)).cast("int")


def _upto(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _blocks(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """How many blocks the rows of each key make."""
    return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))


def _around(df: DataFrame, steps: list[tuple[int, ...]]) -> DataFrame:
    """``df`` with ``to``: the cells by ``steps`` around its own."""
    around = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in steps])
    # classes of fewer columns than AXES have shorter cells: steps along what they lack are left out
    met = df.withColumn("o", F.explode(around)).where(F.forall(F.slice("o", F.size("cell") + 1, AXES), lambda v: v == 0))
    return met.withColumn("to", F.zip_with("cell", F.slice("o", F.lit(1), F.size("cell")), lambda a, b: a + b)).drop("o")


def _met(placed: DataFrame) -> DataFrame:
    """Nodes dealt so that all of a class within its eps of each other meet, as ``_DEALT``.

    Projections on the directions that cells are made of are never further
    apart than rows are, so rows within eps lie in cells that differ by one
    step at most in each. A row stays in its own cell and is a guest of half of
    the others around it, if any row lives there, so each pair of cells meets
    once. A cell's rows, and its guests, are cut into blocks; each pair of
    blocks is a group.
    """
    half = [o for o in itertools.product((-1, 0, 1), repeat=AXES) if o > (0,) * AXES]
    guests = _around(placed, half).drop("cell").withColumnRenamed("to", "cell")
    lived = _blocks(placed, "blocks", "y", "cell")
    invited = guests.join(lived, ["y", "cell"])
    parties = _blocks(invited, "parties", "y", "cell")
    own = placed.join(lived, ["y", "cell"]).withColumn("mine", _block("blocks")).withColumn("other", _upto("blocks"))
    own = own.withColumns({"kind": F.lit(0), "i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).withColumn("side", (F.col("mine") != F.col("i")).cast("int"))
    hosts = placed.join(lived, ["y", "cell"]).join(parties, ["y", "cell"]).withColumns({"kind": F.lit(1), "i": _block("blocks"), "side": F.lit(0)}).withColumn("j", _upto("parties"))
    visits = invited.join(parties, ["y", "cell"]).withColumns({"kind": F.lit(1), "j": _block("parties"), "side": F.lit(1)}).withColumn("i", _upto("blocks"))
    met = own.select(*_DEALT).unionByName(hosts.select(*_DEALT)).unionByName(visits.select(*_DEALT))
    return met.withColumn("cell", F.to_json("cell"))


def _met_by_dense(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Sparse nodes (side 0), in their own cells, and the dense ones of those cells and all around them (side 1), as ``_DEALT``."""
    lived = _blocks(sparse, "blocks", "y", "cell")
    reach = _around(dense.select("y", "cell").distinct(), list(itertools.product((-1, 0, 1), repeat=AXES)))
    reach = reach.join(lived.withColumnRenamed("cell", "to"), ["y", "to"])
    invited = dense.join(reach, ["y", "cell"]).drop("cell").withColumnRenamed("to", "cell")
    parties = _blocks(invited, "parties", "y", "cell")
    hosts = sparse.join(lived, ["y", "cell"]).join(parties, ["y", "cell"]).withColumns({"kind": F.lit(1), "i": _block("blocks"), "side": F.lit(0)}).withColumn("j", _upto("parties"))
    visits = invited.join(parties, ["y", "cell"]).withColumns({"kind": F.lit(1), "j": _block("parties"), "side": F.lit(1)}).withColumn("i", _upto("blocks"))
    return hosts.select(*_DEALT).unionByName(visits.select(*_DEALT)).withColumn("cell", F.to_json("cell"))


class _Sides:
    """The two sides of a group (one, if a block meets itself) and which of their rows lie within eps."""

    def __init__(self, g: dict[str, np.ndarray]):
        self.x = np.vstack(g["x"]).astype(float)
        self.left = np.flatnonzero(g["side"] == 0)
        self.alone = g["kind"][0] == 0 and g["i"][0] == g["j"][0]
        self.right = self.left if self.alone else np.flatnonzero(g["side"] == 1)
        self.eps = float(g["eps"][0])

    def near(self, these: np.ndarray, those: np.ndarray):
        """Yields (rows of these, whether each of those is within eps), a block at a time."""
        step = max(1, PAIRS // max(1, len(those)))
        for a in range(0, len(these) if len(those) else 0, step):
            part = these[a : a + step]
            squares = _squares(self.x[part], self.x[those])
            slack = _slack(self.x[part], self.x[those])
            close = squares <= self.eps**2
            i, j = np.nonzero(np.abs(squares - self.eps**2) <= slack)  # too close to call: measured by differences
            for k in range(0, len(i), 65_536):
                u, v = i[k : k + 65_536], j[k : k + 65_536]
                close[u, v] = np.sqrt(((self.x[part[u]] - self.x[those[v]]) ** 2).sum(axis=1)) <= self.eps
            yield part, close


_GROUP = ["y", "cell", "kind", "i", "j"]


def _counts(g: dict[str, np.ndarray]) -> dict | None:
    """How many rows of the other side lie within eps of each row; a node counts itself by its weight."""
    sides = _Sides(g)
    n = np.zeros(len(g["row_id"]), np.int64)
    for part, close in sides.near(sides.left, sides.right):
        n[part] += close @ g["weight"][sides.right]
        if not sides.alone:
            n[sides.right] += close.T @ g["weight"][part]
    some = n > 0
    return {"row_id": g["row_id"][some], "n": n[some]} if some.any() else None


def _links(g: dict[str, np.ndarray]) -> dict | None:
    """Links that connect the cores within eps, and for each other row one core of each tree in reach."""
    sides = _Sides(g)
    core = g["core"].astype(bool)
    of = lambda side, is_core: side[core[side] == is_core]
    forest = Forest(len(core))
    firsts, own = np.unique(g["home"], return_index=True, return_inverse=True)[1:]
    forest.label = firsts[own]  # nodes of one home are connected
    for part, close in sides.near(of(sides.left, True), of(sides.right, True)):
        i, j = np.nonzero(close)
        forest.add(part[i], of(sides.right, True)[j])
    a, b = (np.concatenate(x) for x in zip(*forest.links, strict=True)) if forest.links else (np.zeros(0, np.int64),) * 2
    kind = np.ones(len(a), bool)
    for one, two in ((sides.left, sides.right),) if sides.alone else ((sides.left, sides.right), (sides.right, sides.left)):
        cores = of(two, True)
        for part, close in sides.near(of(one, False), cores):
            i, j = np.nonzero(close)
            pairs = np.unique(np.stack([part[i], forest.label[cores[j]]]), axis=1, return_index=True)[1]
            a, b = np.concatenate((a, part[i[pairs]])), np.concatenate((b, cores[j[pairs]]))
            kind = np.concatenate((kind, np.zeros(len(pairs), bool)))
    return {"row_id": g["home"][a], "other_id": g["home"][b], "core": kind} if len(a) else None


def _apart(g: dict[str, np.ndarray]) -> dict | None:
    """Pairs of tiles in reach that belong to different clusters so far (``weight``), unless all nodes of both were compared (``core``)."""
    sides = _Sides(g)
    out = []
    for part, close in sides.near(sides.left, sides.right):
        close &= g["weight"][part][:, None] != g["weight"][sides.right][None, :]
        close &= ~(g["core"].astype(bool)[part][:, None] & g["core"].astype(bool)[sides.right][None, :])
        i, j = np.nonzero(close)
        out.append((g["home"][part[i]], g["home"][sides.right[j]]))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    low, high = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return {"a": low, "b": high} if len(low) else None


def _touch(g: dict[str, np.ndarray]) -> dict | None:
    """The pair of tiles, if any of its nodes lie within eps."""
    sides = _Sides(g)
    if any(close.any() for _, close in sides.near(sides.left, sides.right)):
        return {"row_id": g["a"][:1], "other_id": g["b"][:1], "core": np.ones(1, bool)}
    return None


def _stand_ins(dense: DataFrame) -> DataFrame:
    """One node of each part of a dense tile: few, whatever lives there, and enough to connect most tiles that touch."""
    part = F.transform("x", lambda v: F.floor(v / _step() * PARTS).cast("long"))
    kept = [c for c in dense.columns if c not in ("y", "home")]
    first = dense.groupBy("y", "home", part.alias("__part")).agg(F.min_by(F.struct(*kept), "row_id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    return first.select("y", "home", "__first.*", (F.col("__n") == 1).alias("__all"))


def _touching(dense: DataFrame, stand_ins: DataFrame, named: DataFrame, axes: DataFrame) -> DataFrame:
    """Links between tiles that ``named`` (node, component) holds for different clusters, though nodes of them lie within eps.

    Of two tiles only nodes within eps of the other's cube are compared, in blocks.
    """
    cube = stand_ins.groupBy("y", "home").agg(F.first("tile").alias("tile"), F.first("eps").alias("eps"), F.first("x").alias("x"), F.every("__all").alias("core"))
    cube = cut(cube.join(named, F.col("home") == F.col("node"), "left").select("y", "home", "tile", "eps", _step().alias("step"), "core", F.coalesce("component", "home").alias("weight")))
    # centres of cubes that hold rows within eps are no further apart than twice that
    centres = cube.withColumn("x", F.transform("tile", lambda t: (t + 0.5) * F.col("step"))).withColumns({"eps": 2 * F.col("eps") * (1 + 1e-6), "row_id": F.col("home")})
    pairs = map_sorted_groups(_met(cut(_cells(centres.drop("step", "tile"), axes))), _GROUP, "a long, b long", _apart).distinct()
    added = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    one, two = (cube.select(F.col("home").alias(k), F.col("tile").alias(f"t{k}"), *more) for k, more in (("a", ["step", "eps"]), ("b", [])))
    gap = added(F.zip_with("ta", "tb", lambda s, t: F.greatest(F.abs(s - t) - 1, F.lit(0)) * F.col("step")))
    pairs = cut(pairs.join(one, "a").join(two, "b").where(F.sqrt(gap) <= F.col("eps") * (1 + 1e-6)).drop("eps"))
    sides = pairs.select("a", "b", "step", F.lit(0).alias("side"), F.col("a").alias("home"), F.col("tb").alias("cube"))
    sides = sides.unionByName(pairs.select("a", "b", "step", F.lit(1).alias("side"), F.col("b").alias("home"), F.col("ta").alias("cube")))
    away = added(F.zip_with("x", "cube", lambda v, t: F.greatest(t * F.col("step") - v, v - (t + 1) * F.col("step"), F.lit(0.0))))
    near = cut(dense.join(sides, "home").where(F.sqrt(away) <= F.col("eps") * (1 + 1e-6)).select("a", "b", "side", "row_id", "x", "eps"))
    lefts, rights = (_blocks(near.where(F.col("side") == k), n, "a", "b") for k, n in ((0, "lefts"), (1, "rights")))
    dealt = near.join(lefts, ["a", "b"]).join(rights, ["a", "b"])
    left = dealt.where("side = 0").withColumn("i", _block("lefts")).withColumn("j", _upto("rights"))
    right = dealt.where("side = 1").withColumn("j", _block("rights")).withColumn("i", _upto("lefts"))
    dealt = left.unionByName(right).select("a", "b", F.lit(1).alias("kind"), "i", "j", "side", "x", "eps")
    return map_sorted_groups(dealt, ["a", "b", "i", "j"], "row_id long, other_id long, core boolean", _touch)


def dbscan(rows: DataFrame, eps: DataFrame, min_samples: int) -> DataFrame:
    """(row_id, y, core, cluster) of every row of a class in ``eps`` (y, eps): exact, over all rows; no cluster: null.

    Equal rows are one node with a weight, so copies are never compared. Nor
    are nodes of dense tiles counted or compared with each other where a few of
    them show that their tiles touch: however many rows lie within one eps,
    what is measured are sparse nodes, of which a tile has fewer than
    ``min_samples``, against the nodes around them, and the rims of dense tiles
    whose clusters aren't connected otherwise.
    """
    nodes = rows.groupBy("y", "x").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("weight"))
    nodes = cut(nodes.join(F.broadcast(eps.select("y", "eps")), "y"))
    axes = directions(nodes, 1).select("y", "axes")
    placed = cut(_cells(_tiled(nodes, min_samples), axes).withColumn("core", F.col("dense")))
    sparse, dense = placed.where("NOT dense"), placed.where("dense")
    crowded = not dense.isEmpty()
    every = lambda left: [_met(left), *([_met_by_dense(left, dense)] if crowded else [])]
    grouped = lambda left, schema, f: reduce(DataFrame.unionByName, [map_sorted_groups(d, _GROUP, schema, f) for d in every(left)])
    counts = grouped(sparse, "row_id long, n long", _counts)
    cores = counts.groupBy("row_id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("row_id", F.lit(True).alias("__core"))
    told = cut(sparse.drop("core").join(cores, "row_id", "left").withColumn("core", F.coalesce("__core", F.lit(False))).drop("__core"))
    schema = "row_id long, other_id long, core boolean"
    links = cut(grouped(told, schema, _links))
    connected = links.where("core")
    if crowded:
        stand_ins = cut(_stand_ins(dense))
        connected = cut(connected.unionByName(map_sorted_groups(_met(stand_ins), _GROUP, schema, _links)))
        reached = cut(connected_components(connected, "row_id", "other_id"))
        more = cut(_touching(dense, stand_ins, reached, axes))
        if not more.isEmpty():
            reached = connected_components(connected.unionByName(more), "row_id", "other_id")
    else:
        reached = connected_components(connected, "row_id", "other_id")
    reached = reached.withColumnRenamed("node", "__node")
    told = told.unionByName(dense.select(*told.columns))
    homes = told.where("core").select("home").distinct().join(reached, F.col("home") == F.col("__node"), "left")
    homes = cut(homes.select("home", F.coalesce("component", "home").alias("cluster")))
    inner = told.where("core").select("row_id", "home").join(homes, "home").select("row_id", "cluster")
    border = links.where("NOT core").select("row_id", F.col("other_id").alias("home")).join(homes, "home")
    members = inner.unionByName(border.groupBy("row_id").agg(F.min("cluster").alias("cluster")))
    named = told.select("row_id", "y", "x", "core").join(members, "row_id", "left").select(F.col("y").alias("__y"), F.col("x").alias("__x"), "core", "cluster")
    return rows.join(named, (F.col("y") == F.col("__y")) & (F.col("x") == F.col("__x"))).select("row_id", "y", "core", "cluster")
