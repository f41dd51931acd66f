"""Missing and non-finite values, constant columns, impossible values, column names: one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from plumbline.model import q

INF = float("inf")

# What a name's part says of its values, in the order in which rules apply.
IMPOSSIBLE_RULES = [
    ("port", 0, 65535),
    ("duration", 0, None),
    ("byte", 0, None),
    ("packet", 0, None),
    ("pkt", 0, None),
    ("len", 0, None),
]
# Names in which -1 stands for "not there".
MINUS_ONE_ALLOWED = ("init_win_bytes", "init fwd win", "init bwd win")


def _stacked(df: DataFrame, cells: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over one scan: a row for each name, a column for each value, and n_rows."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    names = list(cells)
    fields = list(next(iter(cells.values()))) if cells else []
    for k, name in enumerate(names):
        aggs += [cells[name][f].alias(f"__{k}_{f}") for f in fields]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("column"), *[F.col(f"__{k}_{f}").alias(f) for f in fields])
            for k, name in enumerate(names)
        ]
    )
    return one.select(F.col("__n").alias("n_rows"), F.explode(rows).alias("r")).select("n_rows", "r.*")


def nan_inf(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null, n_nan, n_inf, n_bad, ratio) of each column; nan and inf exist in floating types only."""
    return missing_of(_stacked(df, {c: _missing(df, c) for c in columns}))


def _missing(df: DataFrame, c: str) -> dict[str, Column]:
    floating = isinstance(df.schema[c].dataType, (DoubleType, FloatType))
    return {
        "n_null": F.count_if(q(c).isNull()),
        "n_nan": F.count_if(F.isnan(q(c))) if floating else F.lit(0).cast("long"),
        "n_inf": F.count_if(F.abs(q(c)) == INF) if floating else F.lit(0).cast("long"),
    }


def missing_of(counted: DataFrame) -> DataFrame:
    """``nan_inf`` from counts of each column."""
    out = counted.withColumn("n_bad", F.col("n_null") + F.col("n_nan") + F.col("n_inf"))
    return out.select("column", "n_null", "n_nan", "n_inf", "n_bad", (F.col("n_bad") / F.col("n_rows")).alias("ratio"))


def nan_inf_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with the same three counts as one row: (columns, n_columns, counts, ratio, severity)."""
    return groups_of(nan_inf(df, columns))


def groups_of(missing: DataFrame) -> DataFrame:
    """``nan_inf_groups`` from ``nan_inf``."""
    found = missing.where("n_bad > 0")
    grouped = found.groupBy("n_null", "n_nan", "n_inf", "n_bad", "ratio").agg(
        F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"), F.count(F.lit(1)).alias("n_columns")
    )
    severity = (
        F.when((F.col("n_inf") > 0) | (F.col("ratio") >= 0.05), "high").when(F.col("ratio") >= 0.01, "medium").otherwise("low")
    )
    return grouped.withColumn("severity", severity)


def constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_null) of columns with at most one value besides null."""
    return constant_of(_stacked(df, {c: _range(c) | {"n_null": F.count_if(q(c).isNull())} for c in columns}))


def _range(c: str) -> dict[str, Column]:
    return {"least": F.min(q(c)).cast("string"), "most": F.max(q(c)).cast("string")}


def constant_of(counted: DataFrame) -> DataFrame:
    """``constant`` from each column's least and greatest value."""
    return counted.where(F.col("least").eqNullSafe(F.col("most"))).select("column", "n_rows", "n_null")


def name_problems(names: list[str]) -> dict[str, list[str]]:
    """Names with outer spaces, and names that would collide without them."""
    stripped = [n.strip() for n in names]
    return {
        "spaces": [n for n in names if n != n.strip()],
        "collisions": sorted({s for s in stripped if stripped.count(s) > 1}),
    }


def rule_of(column: str) -> tuple[int, int | None] | None:
    name = column.lower()
    return next(((lo, hi) for part, lo, hi in IMPOSSIBLE_RULES if part in name), None)


def impossible(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_bad, observed_min, observed_max, min_allowed, max_allowed) of columns whose name has a rule that values break."""
    cells = {c: _ruled(c, rule_of(c)) for c in columns if rule_of(c) is not None}
    if not cells:
        return df.sparkSession.createDataFrame(
            [], "column string, n_bad long, observed_min double, observed_max double, min_allowed double, max_allowed double"
        )
    return impossible_of(_stacked(df, cells))


def _ruled(c: str, rule: tuple[int, int | None] | None) -> dict[str, Column]:
    if rule is None:
        none = F.lit(None).cast("double")
        return {"n_bad": F.lit(0).cast("long")} | dict.fromkeys(("observed_min", "observed_max", "min_allowed", "max_allowed"), none)
    low, high = rule
    value = q(c).cast("double")
    bad = value < low
    if any(part in c.lower() for part in MINUS_ONE_ALLOWED):
        bad = bad & (value != -1)
    if high is not None:
        bad = bad | ((value > high) & ~F.isnan(value))
    return {
        "n_bad": F.count_if(bad),
        "observed_min": F.min(value),
        "observed_max": F.max(value),
        "min_allowed": F.lit(float(low)),
        "max_allowed": F.lit(None if high is None else float(high)).cast("double"),
    }


def impossible_of(counted: DataFrame) -> DataFrame:
    """``impossible`` from each column's broken rules."""
    return counted.where("n_bad > 0").select("column", "n_bad", "observed_min", "observed_max", "min_allowed", "max_allowed")


def facts(df: DataFrame, columns: list[str], numeric: list[str]) -> DataFrame:
    """All that ``nan_inf``, ``constant`` and ``impossible`` count, in one scan: a row for each column."""
    return _stacked(df, {c: _missing(df, c) | _range(c) | _ruled(c, rule_of(c) if c in numeric else None) for c in columns})


def restorable(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, restorable): whether a double column holds whole numbers below 2**53 only, or nothing at all."""
    cells = {
        c: {
            "whole": F.coalesce(F.bool_and((q(c) == F.floor(q(c))) & (F.abs(q(c)) < float(2**53)) & ~F.isnan(q(c))), F.lit(True))
        }
        for c in columns
    }
    return _stacked(df, cells).select("column", F.col("whole").alias("restorable"))


# What a text cell looks like, by kind, from the narrowest on; a number may be whole, a whole number a truth value.
KINDS = {
    "truth": r"^(?:[Tt][Rr][Uu][Ee]|[Ff][Aa][Ll][Ss][Ee]|[Yy][Ee][Ss]|[Nn][Oo])$",
    "whole": r"^[+-]?[0-9]{1,18}$",
    "number": r"^(?:[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?|[+-]?[Ii][Nn][Ff](?:[Ii][Nn][Ii][Tt][Yy])?|[Nn][Aa][Nn])$",
    "time": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?: [0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?)$",
    "address": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
}
#: Share of a column's values that a kind must cover to be the column's.
COVERS = 0.99


def kinds_of(df: DataFrame, columns: list[str], covers: float = COVERS) -> DataFrame:
    """(column, n_values, n_padded, kind, n_odd, odd_example) of text columns: the narrowest kind that covers their values.

    Kinds form a lattice: whole numbers are numbers, and all kinds are text.
    What is kept of a column is how many of its values each kind holds, sums
    that merge in any order, for all columns in one aggregate. ``n_odd`` counts
    values outside the column's kind, of which ``odd_example`` is the least;
    ``n_padded`` values with outer blanks, which are looked at without them.
    Nulls and empty cells are no values; a column without values is text.
    """
    cells = {}
    for c in columns:
        text = F.trim(q(c))
        full = text != ""
        own = {k: F.coalesce(text.rlike(p), F.lit(False)) for k, p in KINDS.items()}
        own["number"] = own["number"] | own["whole"]
        cells[c] = {"n_values": F.count_if(full), "n_padded": F.count_if(full & (text != q(c)))}
        for k, hit in own.items():
            cells[c] |= {f"n_{k}": F.count_if(full & hit), f"odd_{k}": F.min(F.when(full & ~hit, text))}
    out = _stacked(df, cells)
    enough = lambda k: (F.col("n_values") > 0) & (F.col(f"n_{k}") >= F.lit(covers) * F.col("n_values"))
    kind, odd, example = F.lit("text"), F.lit(0).cast("long"), F.lit(None).cast("string")
    for k in reversed(KINDS):
        kind = F.when(enough(k), k).otherwise(kind)
        odd = F.when(enough(k), F.col("n_values") - F.col(f"n_{k}")).otherwise(odd)
        example = F.when(enough(k), F.col(f"odd_{k}")).otherwise(example)
    return out.select("column", "n_values", "n_padded", kind.alias("kind"), odd.alias("n_odd"), example.alias("odd_example"))
