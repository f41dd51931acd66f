"""Mixing sources to target weights by subset-sum budget fitting.

A source's budget is its target in words; filling it is a subset-sum problem
over document lengths, solved on the counts of documents by exact length,
never on documents. Documents lie in order of length, and a seeded systematic
draw takes the same share of every stretch of them: rounding spreads over
neighbouring lengths, so each length has its share however few documents it
has, and the words taken miss the budget by less than the longest document.
What is missing (or too much) is then fitted: seeded single documents come or
go until at most ``DP_WORDS`` words are left, and bounded-knapsack dynamic
programming over these picks counts, among lengths in a seeded order, whose sum
comes as near as can be. A length's number is spread evenly over its
documents; what doesn't divide goes to the first of them in the order of a
seeded hash of doc_id.

A source's counts have one row for each distinct length: fewer rows than its
longest document has words, whatever the number of documents. Documents are
never gathered by source, and sources never at the driver.

A null source is a source, and the last; a null or empty text has no words and
is never taken; long texts count whole. Rows that are equal in doc_id, source
and length are told apart by nothing, and any of them may be the one taken more
often; reruns on the same rows give the same ``taken`` for each such group of
rows. Further columns are ignored by ``mix`` and passed on by ``take``. Empty
tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_PATTERN, expanded, gapless_rank
from plumbline.operators.ranks import running
from plumbline.session import cut

#: Budget in words that dynamic programming fits exactly.
DP_WORDS = 20_000
#: Rows that one window task ranks, about.
RANK_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, words): targets add up to ``share`` of all words by weight.

    Sources weigh ``cycle`` by code point, null last. None gets more than
    ``most`` times its words; what it can't take is shared again by weight
    among the others. That is one level for all: a target is weight times
    level, or the cap where that is less, and the level follows from sums over
    sources in the order of cap by weight.
    """
    placed = running(sizes, [F.col("source").isNull().cast("int"), F.col("source")], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(F.col("place") - 1, F.lit(len(cycle))) + 1).cast("int"))
    placed = placed.select("source", F.col("words").cast("double").alias("words"), weight.alias("weight"))
    placed = cut(placed.withColumn("ratio", most * F.col("words") / F.col("weight")))
    total = placed.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    if not total.words:
        return placed.select("source", F.col("words").cast("long").alias("source_size"), F.lit(0.0).alias("target"))
    goal = share * total.words
    below = running(placed, [F.col("ratio"), F.col("source")], {"caps": most * F.col("words"), "weights": F.col("weight")})
    # with this source and all before it at their caps, the level that the rest would have
    caps, weights = F.col("caps") - most * F.col("words"), total.weight - F.col("weights") + F.col("weight")
    level = (goal - caps) / weights
    open_ = below.withColumn("level", level).where(F.col("level") <= F.col("ratio"))
    row = open_.agg(F.min_by("level", F.struct("ratio", "source")).alias("level")).first()
    at = float("inf") if row.level is None else row.level
    target = F.least(most * F.col("words"), F.col("weight") * F.lit(at))
    return placed.select("source", F.col("words").cast("long").alias("source_size"), target.alias("target"))


def bounded_subset_sum(lengths: list[int], stock: list[int], budget: int) -> list[int]:
    """Counts, each within its stock, whose lengths' sum is the largest within ``budget``.

    Reachable sums are the bits of one integer; stocks are split into powers
    of two, and the chosen items are read back from the last reachable sum.
    """
    items, reach = [], [1]
    mask = (1 << (budget + 1)) - 1
    for k, (size, count) in enumerate(zip(lengths, stock, strict=True)):
        count = min(count, budget // size) if size else 0
        step = 1
        while count > 0 and not reach[-1] >> budget & 1:
            n = min(step, count)
            items.append((k, n, n * size))
            reach.append((reach[-1] | reach[-1] << n * size) & mask)
            count -= n
            step *= 2
    at = reach[-1].bit_length() - 1
    taken = [0] * len(lengths)
    for (k, n, total), before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> at & 1:
            taken[k] += n
            at -= total
    return taken


def systematic(lengths: np.ndarray, counts: np.ndarray, goal: int, start: float) -> np.ndarray:
    """How many of each length a systematic draw takes: the same share of every stretch of documents in order of length."""
    share = goal / int((lengths * counts).sum())
    upto = np.floor(np.cumsum(counts) * share + start).astype(np.int64)
    return np.diff(upto, prepend=0)


def settled(size, stock, taken, goal: int, low: int, high: int, order, over: bool) -> np.ndarray:
    """``taken``, and counts that dynamic programming adds or takes away, each from ``low`` to ``high`` times its stock.

    With ``over``, the shortest document beyond what is missing comes (or goes) first, so that the rest goes the other way.
    """
    taken = taken.copy()
    gap = goal - int((size * taken).sum())
    spare = lambda: high * stock - taken if gap > 0 else taken - low * stock
    if over and gap:
        longer = np.flatnonzero((spare() > 0) & (size > abs(gap)))
        if not len(longer) or size[longer[0]] > DP_WORDS:
            return taken
        step = 1 if gap > 0 else -1
        taken[longer[0]] += step
        gap -= step * int(size[longer[0]])
    free = np.maximum(0, spare())
    at = order[(free[order] > 0) & (size[order] <= abs(gap))]
    extra = bounded_subset_sum(size[at].tolist(), free[at].tolist(), abs(gap))
    taken[at] += (1 if gap > 0 else -1) * np.array(extra, np.int64)
    return taken


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: float, most: int = 2, seed: int = 17) -> np.ndarray:
    """How often to take documents of each length so that lengths add up to about ``budget``; ``most`` times each at most.

    As few documents as possible are taken more than once oftener than others:
    only if that comes nearer to the budget. Lengths of 0 are never taken.
    """
    out = np.zeros(len(lengths), np.int64)
    use = np.flatnonzero(lengths > 0)
    size, stock = lengths[use].astype(np.int64), counts[use].astype(np.int64)
    total = int((size * stock).sum())
    goal = int(round(min(budget, most * total)))
    if goal <= 0 or not total:
        return out
    passes = goal // total
    taken, rest = stock * passes, goal % total
    if rest:
        rng = np.random.default_rng(seed)
        taken = taken + systematic(size, stock, rest, rng.random())
        order = rng.permutation(len(size))
        gap = goal - int((size * taken).sum())
        while abs(gap) > DP_WORDS:  # documents that are longer than the dynamic programming's budget come or go singly
            step = 1 if gap > 0 else -1
            free = ((passes + 1) * stock - taken if step > 0 else taken - passes * stock) > 0
            fits = [k for k in order.tolist() if free[k] and size[k] <= abs(gap)]
            if not fits:
                break
            taken[fits[0]] += step
            gap -= step * int(size[fits[0]])
        best, left = taken, abs(gap)
        for low, high in ((passes, passes + 1), (0, most)):
            for over in (False, True):
                found = settled(size, stock, taken, goal, low, high, order, over)
                missed = abs(goal - int((size * found).sum()))
                if missed < left:
                    best, left = found, missed
            if left <= 1:
                break
        taken = best
    out[use] = taken
    return out


def shares(
    docs: DataFrame,
    cycle: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, rows, passes, more): what the mix takes of ``rows`` rows equal in the first three.

    Each is taken ``passes`` times, and ``more`` of them once more.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = cut(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    stock = cut(sized.groupBy("source", "size").agg(F.sum("rows").alias("n")))
    plan = cut(source_targets(stock.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), cycle, share, most))
    plan = plan.withColumnRenamed("source", "__pl_of")
    counted = stock.join(plan, F.col("source").eqNullSafe(F.col("__pl_of"))).select("source", "size", "n", "source_size", "target")

    def of_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable")
        times = fit_lengths(rows["size"].to_numpy(), rows["n"].to_numpy(), float(rows["target"].iloc[0]), int(most), seed)
        rows["passes"], rows["chosen"] = times // rows["n"], times % rows["n"]
        return rows

    chosen = cut(
        counted.groupBy("source").applyInPandas(
            of_source,
            "source string, size long, n long, source_size long, target double, passes long, chosen long",
        )
    ).withColumnsRenamed({"source": "__pl_source", "size": "__pl_size"}).drop("n")
    buckets = max(1, -(-sized.count() // RANK_ROWS))
    order = F.xxhash64(F.lit(seed), F.col("id"))
    bucket = F.pmod(F.shiftrightunsigned(order, 20), F.lit(buckets)).cast("int")
    # rows that repeat id, source and size are one row with a number, whose first row has this rank
    ranked = gapless_rank(sized, ["source", "size"], [order, F.col("id")], bucket, "rank", weight="rows")
    met = ranked.join(
        chosen, ranked.source.eqNullSafe(F.col("__pl_source")) & (ranked.size == F.col("__pl_size"))
    )
    more = F.least(F.col("rows"), F.greatest(F.lit(0).cast("long"), F.col("chosen") - F.col("rank")))
    return met.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rows", "passes", more.alias("more"))


def mix(docs: DataFrame, *args, id_col: str = "doc_id", **how) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row; sources weigh ``cycle`` by code point."""
    each = expanded(shares(docs, *args, id_col=id_col, **how), "rows", "__pl_nth")
    copies = F.col("passes") + F.when(F.col("__pl_nth") < F.col("more"), 1).otherwise(0)
    each = each.withColumn("copies", copies.cast("long"))
    return each.select(
        id_col, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns.

    Rows that share id, source and length share out what the mix takes of them, in the order of a hash of their columns.
    """
    own = ["__pl_id", "__pl_source", "__pl_size"]
    named = {id_col: "__pl_id", "source": "__pl_source", "size": "__pl_size"}
    mixed = shares(docs, id_col=id_col, **how).select(*[F.col(a).alias(b) for a, b in named.items()], "rows", "passes", "more")
    mixed = mixed.where("passes > 0 OR more > 0").withColumnsRenamed({"rows": "__pl_rows", "passes": "__pl_passes", "more": "__pl_more"})
    # only rows that share id, source and length, and of which some are taken oftener than others, need numbers
    mixed = cut(mixed.withColumn("__pl_alike", (F.col("__pl_more") == 0) | (F.col("__pl_more") == F.col("__pl_rows"))))
    text, source = how.get("text_col", "text"), how.get("source_col", "source")
    worded = docs.withColumn("__pl_words", word_count(F.col(text)))

    def met(part: DataFrame) -> DataFrame:
        return worded.join(
            part,
            F.col(id_col).eqNullSafe(F.col("__pl_id"))
            & F.col(source).eqNullSafe(F.col("__pl_source"))
            & (F.col("__pl_words") == F.col("__pl_size")),
        )

    out = met(mixed.where("__pl_alike")).withColumn("__pl_times", F.col("__pl_passes") + F.when(F.col("__pl_more") > 0, 1).otherwise(0))
    if not mixed.where("NOT __pl_alike").isEmpty():
        # rows that are equal in all columns are one row with a number: it is counted, not numbered, however often they repeat
        split = met(mixed.where("NOT __pl_alike"))
        split = cut(split.groupBy(*[F.col(f"`{c}`") for c in split.columns]).agg(F.count(F.lit(1)).alias("__pl_n")))
        split = split.withColumn("__pl_hash", F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]))
        bucket = F.pmod(F.shiftrightunsigned("__pl_hash", 20), F.lit(max(1, -(-split.count() // RANK_ROWS)))).cast("int")
        split = gapless_rank(split, own, [F.col("__pl_hash"), F.col(f"`{text}`")], bucket, "__pl_nth", weight="__pl_n")
        more = F.least(F.col("__pl_n"), F.greatest(F.lit(0).cast("long"), F.col("__pl_more") - F.col("__pl_nth")))
        split = split.withColumn("__pl_total", F.col("__pl_passes") * F.col("__pl_n") + more).drop("__pl_nth", "__pl_hash", "__pl_n")
        split = expanded(split, "__pl_total", "__pl_one").drop("__pl_total", "__pl_one")
        out = out.unionByName(split.withColumn("__pl_times", F.lit(1)))
    out = out.withColumn("__pl_times", F.col("__pl_times").cast("int")).where("__pl_times > 0")
    return out.withColumn("__pl_time", F.explode(F.sequence(F.lit(1), F.col("__pl_times")))).select(*docs.columns)
