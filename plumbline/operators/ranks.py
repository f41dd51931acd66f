"""Ranks, running sums and exact quantiles over whole tables, without a task that orders the table.

Rows are dealt into ranges of the wanted order, as many as a shuffle has
partitions; each range orders its own rows, and a small table of the ranges'
totals says what lies before each. What comes to the driver has one row for
each range (and column), never one for each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import edges_below
from plumbline.session import cut

_PART = "__range"


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with its range of ``order`` as ``__range``, kept in the shared folder so that ranges stay what they are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn(_PART, F.spark_partition_id()))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with each of ``sums`` added up over all rows up to and including its own, in ``order`` (without ties)."""
    dealt = ranged(df, order)
    totals = dealt.groupBy(_PART).agg(*[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select(
        F.col(_PART).alias("__at"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in sums]
    )
    own = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({k: F.sum(v).over(own) for k, v in sums.items()})
    out = out.join(F.broadcast(starts), F.col(_PART) == F.col("__at"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(k) + F.col(f"__s_{k}")).alias(k) for k in sums])


def first_rows(df: DataFrame, order: list[Column], rows: int | dict, group: Column | None = None) -> DataFrame:
    """The first ``rows`` rows in ``order`` (without ties), however many: whole ranges, and a part of the last one.

    With ``group``, ``rows`` says how many of each group's rows (a few groups; those that it doesn't name have none).
    """
    wanted = rows if isinstance(rows, dict) else {0: rows}
    named = df.withColumn("__group", F.lit(0) if group is None else group)
    dealt = ranged(named, [F.col("__group"), *order])
    sizes = sorted(tuple(r) for r in dealt.groupBy(_PART, "__group").count().collect())  # ranges plus groups rows at most
    takes, left = [], dict(wanted)
    for part, own, n in sizes:
        if left.get(own, 0) > 0:
            takes.append((part, own, min(n, left[own]), n > left[own]))
            left[own] -= n
    kind = named.schema["__group"].dataType.simpleString()
    table = df.sparkSession.createDataFrame(takes, f"__at int, __own {kind}, __take long, __partly boolean")
    met = dealt.join(F.broadcast(table), (F.col(_PART) == F.col("__at")) & (F.col("__group") == F.col("__own")))
    nth = F.row_number().over(Window.partitionBy(_PART, "__group").orderBy(*order))
    partly = met.where("__partly").withColumn("__nth", nth).where("__nth <= __take")
    return met.where("NOT __partly").unionByName(partly.drop("__nth")).select(*[F.col(f"`{c}`") for c in df.columns])


def counted_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(column, v, n): how often each non-null value occurs, of all columns in one shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("v")) for c, v in values.items()])
    long = df.select(F.explode(cells).alias("c")).where("c.v IS NOT NULL")
    return long.groupBy(F.col("c.column").alias("column"), F.col("c.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def values_at(counted: DataFrame, places: dict[str, object]) -> dict[str, dict[int, object]]:
    """The values at given places (from 0) of each column's ordered values, from (column, v, n).

    ``places`` maps a column to a function from its number of values to places.
    Only ranges that hold a wanted place are ordered.
    """
    dealt = ranged(counted, [F.col("column"), F.col("v")])
    sizes = dealt.groupBy(_PART, "column").agg(F.sum("n").alias("n")).collect()  # ranges plus columns rows at most
    wanted = []
    for column, of in places.items():
        own = sorted((r[_PART], r.n) for r in sizes if r["column"] == column)
        total = sum(n for _, n in own)
        for place in sorted(set(of(total))) if total else ():
            before = 0
            for part, n in own:
                if place < before + n:
                    wanted.append((part, column, place, place - before))
                    break
                before += n
    if not wanted:
        return {c: {} for c in places}
    spark = counted.sparkSession
    at = spark.createDataFrame(wanted, f"{_PART} int, column string, place long, rest long")
    own = Window.partitionBy(_PART, "column").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = dealt.where(F.col(_PART).isin(sorted({w[0] for w in wanted}))).withColumn("upto", F.sum("n").over(own))
    met = near.join(F.broadcast(at), [_PART, "column"]).where((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
    out: dict[str, dict[int, object]] = {c: {} for c in places}
    for r in met.select("column", "place", "v").collect():  # a row for each wanted place
        out[r["column"]][r.place] = r.v
    return out


#: Ranks that a sketch of a column may be off, as a share of its values.
SKETCH = 10_000


def _outward(cut: float, sign: int) -> float:
    """A cut, moved outward to where generated code can write it: its literals can't be subnormal."""
    return cut if cut == 0 or abs(cut) >= 2.3e-308 else sign * 2.3e-308


def _bracketed(df: DataFrame, values: dict[str, Column], shares: list[float]) -> tuple[dict[str, int], dict[str, dict[int, object]]]:
    """(numbers of values, values at the places that ``shares`` need) of each column, from two aggregates of one scan each.

    A sketch says between which two values each wanted place lies; then values
    outside of all brackets are counted by bracket only, and values inside,
    few of all, one by one. A place that its bracket turns out not to hold is
    left out: the caller looks for it otherwise.
    """
    names = {c: f"c{i}" for i, c in enumerate(values)}
    off = 2.0 / SKETCH
    around = [min(1.0, max(0.0, s + d)) for s in shares for d in (-off, off)]
    sketches = [F.count(v).alias(f"n_{names[c]}") for c, v in values.items()]
    sketches += [F.percentile_approx(v.cast("double"), around, SKETCH).alias(f"q_{names[c]}") for c, v in values.items()]
    row = df.agg(*sketches).first()
    sizes = {c: row[f"n_{names[c]}"] for c in values}
    brackets: dict[str, list[list[float]]] = {}
    for c in values:
        found = row[f"q_{names[c]}"] or []
        for low, high in sorted(zip(found[::2], found[1::2], strict=True)):
            own = brackets.setdefault(c, [])
            if own and low <= own[-1][1]:
                own[-1][1] = max(own[-1][1], high)
            else:
                own.append([low, high])
    if not brackets:
        return sizes, {c: {} for c in values}
    cells, usable = [], []
    for c, own in brackets.items():
        cuts = [x for low, high in own for x in (_outward(math.nextafter(low, -math.inf), -1), _outward(high, 1))]
        # an odd number of cuts below a value: it is inside a bracket
        if any(a >= b for a, b in zip(cuts[:-1], cuts[1:], strict=True)):
            continue  # brackets of subnormal values have run together: such a column is looked at otherwise
        v = values[c].cast("double")
        usable.append(c)
        cells.append(F.struct(F.lit(c).alias("column"), edges_below(v, cuts).alias("at"), v.alias("v")))
    if not usable:
        return sizes, {c: {} for c in values}
    long = df.select(F.explode(F.array(*cells)).alias("c")).where("c.v IS NOT NULL").select("c.column", "c.at", "c.v")
    counted = cut(long.groupBy("column", "at", F.when(F.col("at") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    totals = counted.groupBy("column", "at").agg(F.sum("n").alias("n")).collect()  # two rows for each wanted place at most
    below: dict[tuple[str, int], tuple[int, int]] = {}
    for c in usable:
        before = 0
        for at, n in sorted((r.at, r.n) for r in totals if r["column"] == c):
            below[c, at] = (before, n)
            before += n
    wanted = []
    for c in usable:
        for place in {f(s * (sizes[c] - 1)) for s in shares for f in (math.floor, math.ceil)}:
            for at in range(1, 2 * len(brackets[c]), 2):
                before, n = below.get((c, at), (0, 0))
                if before <= place < before + n:
                    wanted.append((c, at, place, place - before))
    out: dict[str, dict[int, object]] = {c: {} for c in values}
    if wanted:
        spots = df.sparkSession.createDataFrame(wanted, "column string, at int, place long, rest long")
        own = Window.partitionBy("column", "at").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = counted.where("v IS NOT NULL").withColumn("upto", F.sum("n").over(own))
        met = inside.join(F.broadcast(spots), ["column", "at"]).where((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
        for r in met.select("column", "place", "v").collect():  # a row for each wanted place
            out[r["column"]][r.place] = r.v
    return sizes, out


def quantiles(df: DataFrame, values: dict[str, Column], shares: list[float]) -> dict[str, list[float]]:
    """Exact quantiles of each column's non-null values, by linear interpolation between neighbours; none without values."""
    spots = lambda n: [s * (n - 1) for s in shares]
    both = lambda n: [f(x) for x in spots(n) for f in (math.floor, math.ceil)]
    sizes, found = _bracketed(df, values, shares)
    sizes = {c: n for c, n in sizes.items() if n}
    if missed := {c: v for c, v in values.items() if c in sizes and set(both(sizes[c])) - set(found[c])}:
        found |= values_at(cut(counted_values(df, missed)), dict.fromkeys(missed, both))
    out = {}
    for c in values:
        at = found[c]
        out[c] = [
            at[math.floor(x)] + (x - math.floor(x)) * (at[math.ceil(x)] - at[math.floor(x)]) for x in (spots(sizes[c]) if c in sizes else ())
        ]
    return out


def with_previous(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, of the row before in ``order`` (without ties), each of ``values`` (null in the first row).

    The first row of a range looks at the last row of the range before, of which the driver gets one each.
    """
    named = df.withColumn("__now", F.struct(*[v.alias(k) for k, v in values.items()]))
    dealt = ranged(named, order)
    ends = dealt.groupBy(_PART).agg(F.max_by("__now", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__end"))
    before = ends.select(F.col(_PART).alias("__at"), F.lag("__end").over(Window.orderBy(_PART)).alias("__end"))  # a row for each range
    # ranges without rows have none in that table, so the range before is the last one that has any
    own = Window.partitionBy(_PART).orderBy(*order)
    told = dealt.withColumn("__before", F.lag("__now").over(own)).withColumn("__nth", F.row_number().over(own))
    told = told.join(F.broadcast(before), F.col(_PART) == F.col("__at"), "left")
    last = F.when(F.col("__nth") == 1, F.col("__end")).otherwise(F.col("__before"))
    return told.select(*[F.col(f"`{c}`") for c in df.columns], *[last[k].alias(k) for k in values])
