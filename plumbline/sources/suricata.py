"""Event logs in JSON lines: one event type, nested fields flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.columns import source_file
from plumbline.model import q

DEPTH = 3


def _leaves(schema: StructType, path: list[str], depth: int):
    for f in schema.fields:
        if isinstance(f.dataType, StructType) and depth < DEPTH:
            yield from _leaves(f.dataType, [*path, f.name], depth + 1)
        else:
            yield [*path, f.name], f.dataType


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns, ``a_b`` for b in a, three levels deep; deeper structs become JSON text."""
    out = []
    for path, kind in _leaves(df.schema, [], 0):
        value = F.col(".".join("`" + p.replace("`", "``") + "`" for p in path))
        out.append((F.to_json(value) if isinstance(kind, StructType) else value).alias("_".join(path)))
    return df.select(*out)


def drop_empty(df: DataFrame) -> DataFrame:
    """Without the columns that hold null only; one aggregate."""
    row = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[q(c) for i, c in enumerate(df.columns) if row[i]])


def read_eve(spark: SparkSession, path: str | list[str], event_type: str | None = "flow", with_file: bool = False) -> DataFrame:
    """Events of one type, flattened, without empty columns; all events if ``event_type`` is None."""
    df = spark.read.json(path)
    if with_file:
        df = df.select("*", source_file())
    if event_type is not None:
        kept = df.where(F.col("event_type") == event_type)
        if kept.isEmpty():
            kinds = sorted(r[0] for r in df.select("event_type").where("event_type IS NOT NULL").distinct().collect())
            raise ValueError(f"no event of type {event_type}; there are {', '.join(kinds) or 'none'}")
        df = kept.drop("event_type")
    return drop_empty(flatten(df))
