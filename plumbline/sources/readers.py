"""Reading a dataset: files or folders in several formats, role detection, and the load entry point."""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from plumbline.functions.columns import source_file
from plumbline.model import ROLE_NAMES, Dataset, Roles, q
from plumbline.operators import validity
from plumbline.sources.capture import CAPTURE_SUFFIXES, read_capture
from plumbline.sources.profiles import get_profile, group_labels
from plumbline.sources.suricata import read_eve
from plumbline.sources.zeek import read_body, read_header, read_zeek

CSV_SUFFIXES = (".csv", ".txt", ".binetflow", ".2format")
PARQUET_SUFFIXES = (".parquet", ".pq")
JSON_SUFFIXES = (".json", ".jsonl", ".ndjson")
LOG_SUFFIXES = (".log",)

# Usual names of each role, in lower case without marks or spaces.
CANDIDATES = {
    "label": ("label", "labels", "class", "attack", "attackcat", "attackcategory", "target", "alertsignature", "alertcategory"),
    "split": ("split", "set", "subset", "partition", "fold"),
    "time": ("timestamp", "ts", "tsstart", "starttime", "flowstart", "datetime", "date", "time"),
    "src_ip": ("srcip", "sourceip", "sourceipaddress", "ipsrc", "sa", "idorigh"),
    "dst_ip": ("dstip", "destinationip", "destip", "ipdst", "da", "idresph"),
    "src_port": ("srcport", "sourceport", "portsrc", "sport", "sp", "idorigp"),
    "dst_port": ("dstport", "destinationport", "destport", "portdst", "dp", "idrespp"),
    "protocol": ("protocol", "proto", "protocoltype", "ipproto"),
}
# Names too short to be looked for inside others.
EXACT_ONLY = ("ts", "sa", "da", "id", "set", "date", "time", "class", "sp", "dp", "proto", "sport")


def detect(columns: list[str], role: str) -> str | None:
    """The column of a role: an exact name first, else a name that holds a candidate."""
    plain = {c: re.sub(r"[^a-z0-9]", "", c.lower()) for c in columns}
    names = CANDIDATES[role]
    exact = (c for name in names for c in columns if plain[c] == name)
    inside = (c for name in names if name not in EXACT_ONLY for c in columns if name in plain[c])
    return next(exact, None) or next(inside, None)


def _suffix(path: str) -> str:
    return Path(path).suffix.lower()


def read_csv(spark: SparkSession, path: str | list[str], columns: tuple[str, ...] = (), with_file: bool = False) -> DataFrame:
    """CSV files of one header, with types that all their cells fit: whole numbers, doubles, else text.

    Only an empty cell is null, and a doubled quote inside quotes is one quote,
    whatever other lines hold. A file with bytes that are no UTF-8 is read as
    windows-1252 (which needs the session's legacy Java charsets); in a file
    with a line of an odd number of quotes records are looked for across
    lines, which costs that file its splitting. The files are read once for
    that, once for the types, and once for the rows.
    """
    at = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    told = at.groupBy("file").agg(F.bool_or(~F.is_valid_utf8("value")).alias("bad"), F.bool_or(odd).alias("open")).collect()  # a row for each file
    alike: dict[tuple[bool, bool], list[str]] = {}
    for r in sorted(told, key=lambda r: r.file):
        alike.setdefault((bool(r.bad), bool(r.open)), []).append(r.file)
    file = [source_file()] if with_file else []
    parts, names = [], list(columns)
    for (bad, lines), files in alike.items() or [((False, False), path)]:
        how = {"header": not columns, "encoding": "windows-1252" if bad else "UTF-8", "nullValue": "", "mode": "PERMISSIVE"}
        only = path if len(alike) < 2 else [escaped(plain_path(spark, f)) for f in files]
        part = spark.read.csv(only, inferSchema=False, multiLine=lines, escape='"', **how)
        names = names or part.columns
        parts.append(part.select(*[q(old).alias(new) for old, new in zip(part.columns, names, strict=True)], *file))
    raw = reduce(DataFrame.unionByName, parts)
    tests = []
    for i, c in enumerate(names):
        v = q(c).try_cast("double")
        whole = (v == F.floor(v)) & (F.abs(v) < 2.0**53)  # beyond, doubles skip numbers
        tests += [F.bool_and(q(c).isNull() | v.isNotNull()).alias(f"t{i}"), F.count(q(c)).alias(f"k{i}"), F.bool_and(q(c).isNull() | F.coalesce(whole, F.lit(False))).alias(f"w{i}")]
    row = raw.agg(*tests).first()
    typed = []
    for i, c in enumerate(names):
        number = row[f"t{i}"] and row[f"k{i}"]
        v = q(c).try_cast("double")
        typed.append((v.cast("bigint") if row[f"w{i}"] else v).alias(c) if number else q(c))
    return raw.select(*typed, *[q("__source_file") for _ in file])


def plain_path(spark: SparkSession, encoded: str) -> str:
    """The path of a file's metadata, whose odd characters are encoded, as a reader takes it."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(encoded)).toString()


def escaped(path: str) -> str:
    """A file's path as a pattern that names it alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def first_lines(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The first line of each file, by its path: one row for each file."""
    at = spark.read.text(files).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = at.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "n").alias("line")).collect()
    return {plain_path(spark, r.file_path): r.line for r in rows}


def read_file(spark: SparkSession, path: str, event_type: str | None = "flow", columns: tuple[str, ...] = ()) -> DataFrame:
    """One file, by its suffix; .log and .json by their content."""
    suffix = _suffix(path)
    if suffix in CSV_SUFFIXES:
        return read_csv(spark, path, columns)
    if suffix in PARQUET_SUFFIXES:
        return spark.read.parquet(path)
    if suffix in LOG_SUFFIXES:
        return read_zeek(spark, path)
    if suffix in CAPTURE_SUFFIXES:
        return read_capture(spark, path)
    if suffix in JSON_SUFFIXES:
        names = spark.read.json(path).columns
        return read_eve(spark, path, event_type) if "event_type" in names else spark.read.json(path)
    raise ValueError(f"{path}: unknown format; known are {', '.join(CSV_SUFFIXES + PARQUET_SUFFIXES + LOG_SUFFIXES + JSON_SUFFIXES + CAPTURE_SUFFIXES)}")


def widened(frames: list[DataFrame]) -> list[DataFrame]:
    """Columns that differ in type between files: numbers as doubles, all else as text."""
    kinds: dict[str, set] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(type(f.dataType))
    out = []
    for df in frames:
        fixed = []
        for f in df.schema.fields:
            mixed = kinds[f.name]
            if len(mixed) == 1:
                fixed.append(q(f.name))
            else:
                number = all(issubclass(k, NumericType) for k in mixed)
                fixed.append(q(f.name).cast("double" if number else "string").alias(f.name))
        out.append(df.select(*fixed))
    return out


def _storage(spark: SparkSession, path: str):
    """(file system, path) of any storage that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def files_below(spark: SparkSession, path: str) -> list[str]:
    """All files of known suffixes below a folder, in order, on any storage; hidden ones and packet captures left out."""
    system, at = _storage(spark, path)
    known = CSV_SUFFIXES + PARQUET_SUFFIXES + LOG_SUFFIXES + JSON_SUFFIXES
    found, walk = [], system.listFiles(at, True)
    while walk.hasNext():
        file = walk.next().getPath()
        if file.getName()[0] not in "._" and _suffix(file.getName()) in known:
            found.append(file.toString())
    return sorted(found)


def read_logs(spark: SparkSession, files: list[str], event_type: str | None) -> list[DataFrame]:
    """Logs and JSON files with __source_file: one read for all of a header, one for all events, one for all other JSON rows.

    What a file holds is told by its leading lines, which one job finds for all files.
    """
    at = spark.read.text([escaped(f) for f in files]).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    text = F.trim("value")
    lines = at.where((text != "") & (F.col("block") == 0))
    place = F.struct("n", "value")
    head = F.when(F.col("value").startswith("#") & (F.length("value") < 100_000), place)
    told = lines.groupBy("file").agg(F.min_by("value", "n").alias("first"), F.slice(F.array_sort(F.collect_set(head)), 1, 64).alias("head")).collect()  # a row for each file
    events, objects, logs = [], [], {}
    for r in sorted(told, key=lambda r: r.file):
        file = plain_path(spark, r.file)
        if r.first.lstrip().startswith(("{", "[")):
            (events if _suffix(file) in JSON_SUFFIXES and '"event_type"' in r.first else objects).append(escaped(file))
        else:
            header = read_header([x.value for x in r.head if x.value.startswith(("#separator", "#unset_field", "#empty_field", "#fields", "#types", "#set_separator"))])
            logs.setdefault(repr(header), (header, []))[1].append(escaped(file))
    out = [read_body(spark, own, header, with_file=True) for header, own in logs.values()]
    if objects:
        out.append(spark.read.json(objects).select("*", source_file()))
    if events:
        out.append(read_eve(spark, events, event_type, with_file=True))
    return out


def read_dataset(spark: SparkSession, path: str, event_type: str | None = "flow", columns: tuple[str, ...] = ()) -> DataFrame:
    """A file, a glob that Spark reads, or a folder on any storage: all readable files, united by name, with __source_file.

    Of a folder, CSV files of one header are one read, and so are Parquet
    files, logs of one header, and JSON files of events and of rows.
    """
    if not any(c in path for c in "*?["):
        system, at = _storage(spark, path)
        if not system.exists(at):
            raise FileNotFoundError(path)
    if any(c in path for c in "*?[") or not system.getFileStatus(at).isDirectory() or _suffix(path) in PARQUET_SUFFIXES:
        return read_file(spark, path, event_type, columns)
    files = files_below(spark, path)
    if not files:
        known = CSV_SUFFIXES + PARQUET_SUFFIXES + LOG_SUFFIXES + JSON_SUFFIXES
        raise ValueError(f"{path}: no readable file; known are {', '.join(known)}")
    by_suffix = lambda wanted: [f for f in files if _suffix(f) in wanted]
    frames = []
    if tables := by_suffix(CSV_SUFFIXES):
        groups: dict[str, list[str]] = {}
        for file, line in sorted(first_lines(spark, tables).items()):
            groups.setdefault("" if columns else line, []).append(file)
        frames += [read_csv(spark, group, columns, with_file=True) for group in groups.values()]
    if tables := by_suffix(PARQUET_SUFFIXES):
        frames.append(spark.read.option("mergeSchema", "true").parquet(*tables).select("*", source_file()))
    if tables := by_suffix(LOG_SUFFIXES + JSON_SUFFIXES):
        frames += read_logs(spark, tables, event_type)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), widened(frames))


#: Bytes in a leaf of a fingerprint, and the size up to which a file is read as one row.
LEAF_BYTES, WHOLE_BYTES = 4 << 20, 256 << 20


def fingerprint(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> str:
    """SHA-256 over names, sizes and bytes of a file, a glob or all files of a folder, on any storage.

    It is the root of a hash tree: a file's bytes are hashed in leaves of
    ``LEAF_BYTES``, a file's leaves in their order, and all files by name below
    the folder. Leaves are hashed by tasks, so the value doesn't depend on how
    a file was split; the driver gets one digest for each file. Files up to
    ``whole_bytes`` are read by Spark; larger ones in ranges, by tasks that
    open them (local and mounted folders, HDFS, S3, GCS).
    """
    system, at = _storage(spark, path)
    found = system.globStatus(at) if any(c in path for c in "*?[") else [system.getFileStatus(at)] if system.exists(at) else None
    if not found:
        raise FileNotFoundError(path)
    files: dict[str, tuple[str, int]] = {}
    for status in found:
        top = status.getPath().toString()
        walk = system.listFiles(status.getPath(), True)
        while walk.hasNext():
            own = walk.next()
            name = own.getPath().toString()
            if own.getPath().getName()[0] not in "._":
                files[name] = (name.removeprefix(top).lstrip("/") or own.getPath().getName(), own.getLen())
    small = [f for f, (_, n) in files.items() if 0 < n <= whole_bytes]
    digests = {f: "" for f, (_, n) in files.items() if n == 0}
    if small:
        rows = spark.read.format("binaryFile").load([escaped(f) for f in small])
        starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(LEAF_BYTES).cast("long"))
        leaves = F.transform(starts, lambda k: F.sha2(F.substr("content", (k + 1).cast("int"), F.lit(LEAF_BYTES)), 256))
        for r in rows.select("path", F.sha2(F.array_join(leaves, "").cast("binary"), 256).alias("digest")).collect():  # a row for each file
            digests[plain_path(spark, r.path) if "%" in r.path else r.path] = r.digest
    if large := [(f, n) for f, (_, n) in files.items() if n > whole_bytes]:
        digests |= _ranged_digests(spark, large)
    total = hashlib.sha256()
    for f, (name, size) in sorted(files.items(), key=lambda x: x[1]):
        total.update(f"{name}\n{size}\n{digests[f]}\n".encode())
    return total.hexdigest()


def _ranged_digests(spark: SparkSession, files: list[tuple[str, int]]) -> dict[str, str]:
    """Digests of large files, whose leaves are hashed by tasks, some at a time."""
    leaves = [(f, n, k) for f, n in files for k in range(0, n, 16 * LEAF_BYTES)]
    ranges = spark.createDataFrame(leaves, "file string, size long, start long").repartition(min(len(leaves), 100_000), "file", "start")

    def run(batches):
        import pyarrow as pa

        from plumbline.sources.capture import opened

        for batch in batches:
            for r in batch.to_pylist():
                out = []
                with opened(r["file"]) as f:
                    f.seek(r["start"])
                    for place in range(r["start"], min(r["size"], r["start"] + 16 * LEAF_BYTES), LEAF_BYTES):
                        out.append((r["file"], place, hashlib.sha256(f.read(LEAF_BYTES)).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "place", "leaf"])

    each = ranges.mapInArrow(run, "file string, place long, leaf string")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"]), "")
    rows = each.groupBy("file").agg(F.sha2(joined.cast("binary"), 256).alias("digest")).collect()  # a row for each large file
    return {r.file: r.digest for r in rows}


def load(
    spark: SparkSession,
    path: str,
    *,
    roles: dict[str, str] | None = None,
    profile: str | None = None,
    strip_names: bool = True,
    seed: int = 42,
    event_type: str | None = "flow",
    reference: str | None = None,
    **config: Any,
) -> Dataset:
    """A dataset with its roles: those given, else the profile's, else by column names."""
    known = get_profile(profile) if profile else None
    df = read_dataset(spark, path, event_type, known.csv_columns if known else ())
    raw = df.columns
    if strip_names and not validity.name_problems(raw)["collisions"]:
        df = df.toDF(*[c.strip() for c in raw])
    given = dict(roles or {})
    if unknown := set(given) - set(ROLE_NAMES):
        raise ValueError(f"unknown roles {sorted(unknown)}; there are {', '.join(ROLE_NAMES)}")
    if missing := [c for c in given.values() if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    listed = {r: c for r, c in (known.roles if known else {}).items() if c in df.columns}
    found = {r: given.get(r) or listed.get(r) or detect(df.columns, r) for r in ROLE_NAMES}
    if known and known.label_groups and found["label"]:
        df = group_labels(df, found["label"], known.label_groups)
    declared = frozenset(c for r, c in (listed | given).items() if r in ("time", "src_ip", "dst_ip"))
    other = read_dataset(spark, reference, event_type) if reference else None
    if other is not None and strip_names:
        other = other.toDF(*[c.strip() for c in other.columns])
    config |= {"raw_columns": raw, "parsed": _suffix(path) not in PARQUET_SUFFIXES}
    return Dataset(df, Roles(**found), declared, seed, config, other, Path(path).name, fingerprint(spark, path))


def write_table(df: DataFrame, path: str) -> None:
    """Parquet for .parquet and .pq, else CSV with a header; a folder, as Spark writes."""
    if _suffix(path) in PARQUET_SUFFIXES:
        df.write.parquet(path)
    else:
        df.write.csv(path, header=True)


def quarantine_path(path: str) -> str:
    p = Path(path)
    return str(p.with_name(f"{p.stem}_cuarentena{p.suffix}"))


def is_integer(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, IntegralType)
