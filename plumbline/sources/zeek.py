"""Connection logs with a commented header (tab-separated), or in JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.functions.columns import source_file
from plumbline.model import q

# Header types that become numbers.
INTEGERS, DOUBLES = ("count", "int"), ("double", "interval", "time")


class ZeekFormatError(ValueError):
    """The header lacks what is needed to read the body."""


def _unescape(text: str) -> str:
    return re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), text)


def read_header(lines: list[str]) -> dict:
    """Separator, names, types and null tokens from the leading lines that start with a number sign."""
    out = {"separator": "\t", "unset_field": "-", "empty_field": "(empty)", "fields": None, "types": None}
    for line in (x.rstrip("\r") for x in lines):
        if line.startswith("#separator"):
            out["separator"] = _unescape(line.split(" ", 1)[1])
            continue
        name, _, rest = line[1:].partition(out["separator"])
        if name in ("fields", "types"):
            out[name] = rest.split(out["separator"])
        elif name in out:
            out[name] = rest
    if not out["fields"]:
        raise ZeekFormatError("the log has no #fields line")
    return out


def is_json(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank starts an object."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0].value.lstrip().startswith("{")


def read_zeek(spark: SparkSession, path: str) -> DataFrame:
    """A log in either form. Lines that start with # are no rows; cells that are no number become null."""
    if is_json(spark, path):
        return spark.read.json(path)
    head = [r.value for r in spark.read.text(path).where(F.col("value").startswith("#")).limit(64).collect()]
    return read_body(spark, path, read_header(head))


def read_body(spark: SparkSession, path: str | list[str], header: dict, with_file: bool = False) -> DataFrame:
    """The rows of text logs of one header."""
    names = header["fields"]
    schema = StructType([StructField(n, StringType()) for n in names])
    body = spark.read.csv(
        path, sep=header["separator"], schema=schema, comment="#", quote="", nullValue=header["unset_field"], mode="PERMISSIVE", enforceSchema=True
    )
    kinds = header["types"] or ["string"] * len(names)
    out = []
    for name, kind in zip(names, kinds, strict=False):
        value = F.nullif(F.rtrim(q(name)), F.lit(header["empty_field"]))
        value = value.try_cast("bigint") if kind in INTEGERS else value.try_cast("double") if kind in DOUBLES else value
        out.append(value.alias(name))
    return body.select(*out, *([source_file()] if with_file else []))
