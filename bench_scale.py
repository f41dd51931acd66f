"""Audits of periodic tables of given sizes (millions of rows), with the seconds of each check: ``bench_scale.py FOLDER 1 10``.

Eight float columns of periods 997 to 1004, a port of period 65,535, five
labels, seven rows of ten in train.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from plumbline.model import Dataset, Roles
from plumbline.plans.audit import run_audit
from plumbline.session import get_session


def table(spark, rows: int):
    i = F.col("id")
    floats = [(i % (997 + k)).cast("double").alias(f"feature_{k}") for k in range(8)]
    side = F.when(i % 10 < 7, "train").otherwise("test")
    return spark.range(rows).select(i.alias("rid"), *floats, (i % 65_535).alias("Destination Port"), (i % 5).cast("string").alias("Label"), side.alias("split"))


def main(folder: str, millions: list[int]) -> None:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    spark = get_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    for m in millions:
        path = f"{folder}/flows_{m}m.parquet"
        table(spark, m * 1_000_000).write.mode("ignore").parquet(path)
        began = time.monotonic()
        report = run_audit(Dataset(spark.read.parquet(path), Roles(label="Label", split="split"), config={"row_id": "rid"}))
        told = {f.check_id: f.affected_rows for f in report.findings}
        print(json.dumps({"rows": m * 1_000_000, "seconds": round(time.monotonic() - began, 2), "checks": report.run["seconds"], "findings": told, "skipped": report.skipped, "errors": report.errors}), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], [int(x) for x in sys.argv[2:]])
