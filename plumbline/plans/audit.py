"""Runs checks on a dataset, each by itself: one that can't run is skipped, one that fails is an error, both are told."""

from __future__ import annotations

import html
import time
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import __version__
from plumbline.model import CheckSkipped, Dataset, Report
from plumbline.operators import poison
from plumbline.plans import checks
from plumbline.plans.shared import Shared
from plumbline.session import shared_folder


def read_once(data: Dataset) -> Dataset:
    """The dataset with its tables as Parquet in the shared folder, if they are read from a format that isn't columnar.

    Checks then read the columns that they need, and text is parsed once,
    however many checks there are. What they flag reads the copy too, so it
    stays as long as the shared folder keeps it.
    """

    def kept(df: DataFrame) -> DataFrame:
        folder = shared_folder(df.sparkSession, "audit")
        df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"}).write.parquet(folder)
        return df.sparkSession.read.parquet(folder)

    return replace(data, df=kept(data.df), reference=None if data.reference is None else kept(data.reference))


def run_audit(data: Dataset, wanted: list[str] | str = "all", module: str = "auditor") -> Report:
    chosen = checks.select(wanted, module)
    if data.option("parsed", False) and len(chosen) > 1:
        data = read_once(data)
    report = Report(
        {"name": data.name, "columns": len(data.df.columns), "rows": data.df.count(), "fingerprint": data.fingerprint},
        {"version": __version__, "seed": data.seed, "module": module, "at": datetime.now(timezone.utc).isoformat()},
    )
    shared = Shared(data, {check.id for check in chosen})
    data = replace(data, shared=shared)
    try:
        for check in chosen:
            began = time.monotonic()
            try:
                report.findings += check.run(data)
            except CheckSkipped as why:
                report.skipped[check.id] = str(why)
            except Exception as error:  # noqa: BLE001  a failing check must not hide the others' findings
                report.errors[check.id] = f"{type(error).__name__}: {str(error)[:500]}"
            report.run.setdefault("seconds", {})[check.id] = round(time.monotonic() - began, 3)  # what is shared counts for the first that asks
    finally:
        shared.close()
    return report


def suspects(report: Report, top: int = 100, least: int = 1) -> DataFrame | None:
    """The ranking of rows that the poisoning detectors flagged; None if none did."""
    flagged = [f.flagged.select("row_id", F.lit(f.check_id).alias("check_id"), F.col("score").cast("double")) for f in report.findings if f.flagged is not None]
    if not flagged:
        return None
    return poison.rank_suspects(poison.combine_scores(reduce(DataFrame.unionByName, flagged)), top, least)


def to_html(report: Report) -> str:
    """One self-contained page; every text is escaped."""
    e = lambda x: html.escape(str(x), quote=True)
    colour = {"red": "#b3261e", "yellow": "#b58900", "grey": "#777", "green": "#2e7d32"}[report.traffic_light]
    rows = "".join(
        f"<tr><td>{e(f.severity)}</td><td>{e(f.check_id)}</td><td>{e(f.title)}</td><td>{e(f.affected_rows)}</td><td>{e(f.metric)}</td></tr>"
        for f in report.ordered()
    )
    notes = "".join(f"<li>{e(k)}: {e(v)}</li>" for k, v in (report.skipped | report.errors).items())
    return (
        f"<!doctype html><meta charset=utf-8><title>{e(report.dataset['name'])}</title>"
        f"<h1 style='color:{colour}'>{e(report.dataset['name'])}: {e(report.traffic_light)}</h1>"
        f"<table border=1><tr><th>severity<th>check<th>finding<th>rows<th>metric</tr>{rows}</table><h2>Not run</h2><ul>{notes}</ul>"
    )


def write_report(report: Report, folder: str) -> None:
    """report.json and report.html in a folder of the driver's machine."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "report.json").write_text(report.to_json(), encoding="utf-8")
    (out / "report.html").write_text(to_html(report), encoding="utf-8")
