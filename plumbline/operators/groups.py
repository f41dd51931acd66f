"""Python over sorted groups: thousands of small groups in one stream of Arrow batches, bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, whatever its rows' lengths; a row that is longer is a batch by itself.
BATCH_BYTES = 1 << 20


def bound_batches(spark) -> None:
    """Bound a Python worker's memory by the bytes of a batch.

    One value for all operators, and only where the session has none, so that
    lazy frames mean the same in any order of evaluation.
    """
    option = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(option, None) is None:
        spark.conf.set(option, str(BATCH_BYTES))


def map_sorted_groups(
    df: DataFrame, keys: list[str], schema: str, of_group: Callable[[dict[str, np.ndarray]], dict | None]
) -> DataFrame:
    """Deal ``df`` out by ``keys`` and apply ``of_group`` to each group's columns.

    Groups come as runs of a sorted stream, so thousands of tiny groups cost
    one Python call each and no data frame. A group is held in memory: callers
    bound its size.
    """
    bound_batches(df.sparkSession)
    names = df.columns
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def as_batch(parts: list[dict]) -> pa.RecordBatch:
        arrays = []
        for field in arrow:
            got = [p[field.name] for p in parts]
            if pa.types.is_primitive(field.type):
                arrays.append(pa.array(np.concatenate(got), type=field.type))
            else:
                arrays.append(pa.array([x for g in got for x in g], type=field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        values = batch.column(names.index(name))
        if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) or pa.types.is_string(values.type):
            return np.array(values.to_pylist(), dtype=object)
        return values.to_numpy(zero_copy_only=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        last = None

        def close() -> dict | None:
            group = {n: np.concatenate([h[n] for h in held]) for n in names}
            held.clear()
            return of_group(group)

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            data = {name: column(batch, name) for name in names}
            change = np.zeros(n, bool)
            for k in keys:
                change[1:] |= data[k][1:] != data[k][:-1]
            starts = [0, *np.flatnonzero(change).tolist(), n]
            out = []
            first = tuple(data[k][0] for k in keys)
            if held and first != last and (got := close()):
                out.append(got)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                held.append({name: data[name][a:b] for name in names})
                if b < n and (got := close()):
                    out.append(got)
            last = tuple(data[k][n - 1] for k in keys)
            if out:
                yield as_batch(out)
        if held and (got := close()):
            yield as_batch([got])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def added_up(partial: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """(key, n, arrays...): sums of ``n`` and of arrays of doubles in bytes, of (key, salt, n, arrays...) with a row for each task.

    First each share of the tasks (``salt``) is added up, then the shares, by
    tasks that hold one sum at a time.
    """
    schema = f"{key} string, salt int, n long, " + ", ".join(f"{a} binary" for a in arrays)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None

        def out():
            cells = [pa.array([last[0]], pa.string()), pa.array([last[1]], pa.int32()), pa.array([held[0]], pa.int64())]
            return pa.RecordBatch.from_arrays([*cells, *(pa.array([a.tobytes()]) for a in held[1:])], [key, "salt", "n", *arrays])

        for batch in batches:
            for own, salt, n, *sums in zip(*(batch.column(k).to_pylist() for k in range(3 + len(arrays))), strict=True):
                now = [n, *map(np.frombuffer, sums)]
                if (own, salt) == last:
                    held = [a + b for a, b in zip(held, now, strict=True)]
                else:
                    if last is not None:
                        yield out()
                    last, held = (own, salt), now
        if last is not None:
            yield out()

    bound_batches(partial.sparkSession)
    for keys in ([key, "salt"], [key]):
        partial = partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
        partial = partial.withColumn("salt", F.lit(0))
    return partial.drop("salt")
