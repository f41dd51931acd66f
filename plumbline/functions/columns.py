"""Column functions on numbers and labels; all run inside generated code, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The value as a double; null for nan and infinities."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def edges_below(value: Column, cuts: list[float]) -> Column:
    """How many of the ordered edges lie strictly below a value: a search by halves, over the value computed once."""

    def search(x: Column, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x > cuts[middle], search(x, middle + 1, high)).otherwise(search(x, low, middle))

    return F.get(F.transform(F.array(value), lambda x: search(x, 0, len(cuts))), F.lit(0)) if cuts else F.lit(0)


def normal_form(label: Column) -> Column:
    """A label without case and marks: what its spellings share."""
    return F.trim(F.regexp_replace(F.lower(label.cast("string")), "[^a-z0-9]+", " "))


def source_file() -> Column:
    """The name of the file that a row was read from, whose odd characters Spark encodes."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("__source_file")
