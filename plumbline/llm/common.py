"""What the corpus operators share: text passes over Arrow batches, words, gapless ranks, sorted groups."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.groups import bound_batches, map_sorted_groups

__all__ = ["bound_batches", "expanded", "gapless_rank", "map_sorted_groups", "map_texts", "small", "utf8"]

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def utf8(text: str) -> bytes:
    """UTF-8 bytes; lone surrogates, which no UTF-8 holds, become replacement marks."""
    return text.encode("utf-8", "replace")


def map_texts(
    docs: DataFrame,
    schema: str,
    make: Callable[[], Callable[[list], list]],
    id_col: str = "doc_id",
    text_col: str = "text",
    memo: bool = False,
    as_bytes: bool = False,
) -> DataFrame:
    """One narrow pass over whole texts: ``id_col`` as it is, and what ``make()(texts)`` says of each.

    ``make`` runs once in a worker, so it may load a model; it returns a
    function from a list of texts (None for null) to a list of tuples in the
    order of ``schema``. ``memo``: it keeps tables of many small objects, among
    which Python's cycle collector would search in vain; it rests meanwhile.
    With ``as_bytes``, texts come as UTF-8. Bytes that are no UTF-8 (Spark
    keeps such strings) become replacement marks first. Only the two named
    columns are read, so further columns of any name do no harm.
    """
    bound_batches(docs.sparkSession)
    spark_id = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {spark_id}, {schema}"
    text = F.make_valid_utf8(F.col(text_col).cast("string"))
    narrow = docs.select(F.col(id_col), (text.cast("binary") if as_bytes else text).alias(text_col))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        if memo:
            gc.disable()
        try:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                rows = of(batch.column(1).to_pylist())
                columns = list(zip(*rows, strict=True))
                arrays = [batch.column(0).cast(arrow.field(0).type)]
                arrays += [pa.array(c, type=arrow.field(k + 1).type) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            gc.enable()

    return narrow.mapInArrow(run, out)


def gapless_rank(
    df: DataFrame, groups: list[str], order: list[Column], bucket: Column, alias: str, weight: str | None = None
) -> DataFrame:
    """Adds ``alias``: the rank from 0 within ``groups``, by (bucket, order), without one task per group.

    With ``weight``, a row stands for that many, and has the rank of the first of them.

    Rows of a group are dealt over its buckets; each bucket is numbered by its
    own window and shifted by the size of the buckets before it, which a small
    table of counts gives. A null group is a group.
    """
    b = "__pl_bucket"
    dealt = df.withColumn(b, bucket)
    size = F.lit(1) if weight is None else F.col(weight)
    counts = dealt.groupBy(*groups, b).agg(F.sum(size).alias("__pl_n"))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"__pl_g{k}") for k, g in enumerate(groups)],
        F.col(b).alias("__pl_gb"),
        F.coalesce(F.sum("__pl_n").over(before), F.lit(0)).alias("__pl_start"),
    )
    own = Window.partitionBy(*groups, b).orderBy(*order)
    own = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("__pl_rank", F.sum(size).over(own) - size)
    on = [F.col(g).eqNullSafe(F.col(f"__pl_g{k}")) for k, g in enumerate(groups)] + [F.col(b) == F.col("__pl_gb")]
    joined = ranked.join(starts, on)
    return joined.select(*df.columns, (F.col("__pl_rank") + F.col("__pl_start")).cast("long").alias(alias))


#: Rows of ids or hashes that are sent to every task, at most (some 40 MB).
BROADCAST_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """``table`` (in the shared folder, of ids and hashes), to be sent to every task if it has few rows; else it is shuffled."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


#: Rows that one task makes of one counted group, about.
CHUNK = 4_096


def expanded(groups: DataFrame, count: str, alias: str) -> DataFrame:
    """Each row of ``groups`` as often as its ``count`` says, with ``alias`` from 0 on.

    A group of more than ``CHUNK`` rows is dealt out in chunks first, so that
    rows which repeat however often are never made, or numbered, by one task.
    """
    few = groups.where(F.col(count) <= CHUNK)
    few = few.withColumn("__pl_from", F.lit(0).cast("long")).withColumn("__pl_upto", F.col(count) - 1)
    many = groups.where(F.col(count) > CHUNK)
    many = many.withColumn("__pl_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(CHUNK).cast("long"))))
    many = many.withColumn("__pl_upto", F.least(F.col("__pl_from") + CHUNK, F.col(count)) - 1).repartition("__pl_from", count)
    both = few.unionByName(many).where(F.col(count) > 0)
    return both.withColumn(alias, F.explode(F.sequence("__pl_from", "__pl_upto"))).drop("__pl_from", "__pl_upto")
