"""Corrections: each returns a new dataset with before and after counts; the source data stays as it is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import SESSION_ROLES, Dataset, q
from plumbline.operators import duplicates, labels, leakage, ml, splits, validity, windows
from plumbline.operators.shortcuts import names_identifier
from plumbline.plans import checks


class FixNotApplicable(Exception):
    """The dataset has nothing that the fix would change, or lacks what it needs."""


@dataclass
class FixResult:
    fix_id: str
    dataset: Dataset
    before: dict = field(default_factory=dict)
    after: dict = field(default_factory=dict)
    quarantine: DataFrame | None = None


Fix = Callable[..., FixResult]
_FIXES: dict[str, Fix] = {}


def register_fix(fix_id: str) -> Callable[[Fix], Fix]:
    def add(f: Fix) -> Fix:
        if fix_id in _FIXES:
            raise ValueError(f"fix {fix_id} is registered already")
        _FIXES[fix_id] = f
        return f

    return add


def available_fixes() -> list[str]:
    return sorted(_FIXES)


def get_fix(fix_id: str) -> Fix:
    if fix_id not in _FIXES:
        raise KeyError(f"unknown fix {fix_id}; there are {', '.join(available_fixes())}")
    return _FIXES[fix_id]


def apply_fix(data: Dataset, fix_id: str, row_id: str | None = None) -> FixResult:
    return get_fix(fix_id)(data, row_id=row_id)


def apply_to_train(data: Dataset, fix_id: str, row_id: str | None = None) -> FixResult:
    """The fix on rows of the train side alone; all other rows stay as they are."""
    data.require("split")
    train = leakage.is_train(q(data.roles.split))
    result = get_fix(fix_id)(data.with_df(data.df.where(train)), row_id=row_id)
    rest = data.df.where(F.coalesce(~train, F.lit(True)))
    return replace(result, dataset=data.with_df(result.dataset.df.unionByName(rest)))


def _need_row(row_id: str | None) -> str:
    if row_id is None:
        raise FixNotApplicable("a column that identifies rows is needed")
    return row_id


@register_fix("drop_duplicates")
def drop_duplicates(data: Dataset, row_id: str | None = None) -> FixResult:
    """Keeps the first row of each (identity, label); rows that clash in the label only stay."""
    row = _need_row(row_id)
    keys = [c for c in data.identity if c != row] + ([data.roles.label] if data.roles.label else [])
    out = duplicates.drop_duplicates(data.df, keys, [row])
    n = duplicates.exact(data.df, keys).first()
    if not n.n_dupes:
        raise FixNotApplicable("no row is repeated")
    return FixResult("drop_duplicates", data.with_df(out), {"rows": n.n_rows}, {"rows": n.n_unique})


@register_fix("drop_identifiers")
def drop_identifiers(data: Dataset, row_id: str | None = None) -> FixResult:
    """Drops columns whose name tells an identifier, but for label, split and the row id; roles follow."""
    safe = {data.roles.label, data.roles.split, row_id}
    gone = [c for c in data.df.columns if c not in safe and names_identifier(c)]
    if not gone:
        raise FixNotApplicable("no column is named like an identifier")
    return FixResult("drop_identifiers", data.with_df(data.df.drop(*gone)), {"columns": len(data.df.columns)}, {"dropped": gone})


@register_fix("drop_constant")
def drop_constant(data: Dataset, row_id: str | None = None) -> FixResult:
    gone = sorted(r.column for r in validity.constant(data.df, data.features).collect())
    if not gone:
        raise FixNotApplicable("no column is constant")
    return FixResult("drop_constant", data.with_df(data.df.drop(*gone)), {"columns": len(data.df.columns)}, {"dropped": gone})


@register_fix("strip_column_names")
def strip_column_names(data: Dataset, row_id: str | None = None) -> FixResult:
    problems = validity.name_problems(data.df.columns)
    if not problems["spaces"]:
        raise FixNotApplicable("no name has outer spaces")
    if problems["collisions"]:
        raise FixNotApplicable(f"names would collide: {', '.join(problems['collisions'])}")
    out = data.df.toDF(*[c.strip() for c in data.df.columns])
    roles = replace(data.roles, **{r: v.strip() for r, v in data.roles.__dict__.items() if v})
    return FixResult("strip_column_names", replace(data, df=out, roles=roles), {"names": problems["spaces"]}, {"names": out.columns})


@register_fix("normalize_labels")
def normalize_labels(data: Dataset, row_id: str | None = None) -> FixResult:
    data.require("label")
    found = labels.taxonomy(data.df, data.roles.label).count()
    if not found:
        raise FixNotApplicable("no label is spelt in several ways")
    return FixResult("normalize_labels", data.with_df(labels.normalize(data.df, data.roles.label)), {"forms_with_variants": found}, {"forms_with_variants": 0})


@register_fix("quarantine_noise")
def quarantine_noise(data: Dataset, row_id: str | None = None) -> FixResult:
    """Moves rows with a probably wrong label to a quarantine table; nothing is deleted."""
    row = _need_row(row_id)
    data.require("label")
    columns = [c for c in data.numeric if c != row and not names_identifier(c)]
    scored, classes, _ = ml.noise_scores(data.df, columns, data.roles.label, row, data.seed)
    bad = ml.confident_issues(scored, classes).select(F.col("row_id").alias("__bad")).distinct()
    if bad.isEmpty():
        raise FixNotApplicable("no label looks wrong")
    kept = data.df.join(bad, q(row) == F.col("__bad"), "left_anti")
    moved = data.df.join(bad, q(row) == F.col("__bad"), "left_semi")
    return FixResult("quarantine_noise", data.with_df(kept), {}, {}, quarantine=moved)


@register_fix("relabel_window")
def relabel_window(data: Dataset, row_id: str | None = None) -> FixResult:
    """Gives rows that contradict the documented windows the windows' label; attacks outside all become option ``benign_label``."""
    judged = checks.judged_by_windows(data)
    counts = {r.verdict: r.n for r in windows.summary(judged, data.roles.label).groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        raise FixNotApplicable("no label contradicts the windows")
    out = windows.relabel(judged, data.roles.label, data.option("benign_label", "BENIGN"))
    return FixResult("relabel_window", data.with_df(out), counts, {})


@register_fix("temporal_split")
def temporal_split(data: Dataset, row_id: str | None = None) -> FixResult:
    data.require("time")
    time = leakage.time_column(data.df, data.roles.time, data.option("time_format", None))
    split = data.roles.split or "split"
    out = splits.temporal(data.df, time, split, data.option("train_ratio", 0.7))
    return FixResult("temporal_split", replace(data, df=out, roles=replace(data.roles, split=split)))


@register_fix("group_split")
def group_split(data: Dataset, row_id: str | None = None) -> FixResult:
    """Whole sessions, or whole source hosts, go to one side of the split; ``after`` tells hosts that are still on both."""
    roles = ["src_ip"] if data.option("group_by", "session") == "host" else list(SESSION_ROLES)
    columns = [c for r in roles if (c := getattr(data.roles, r))]
    if not columns:
        raise FixNotApplicable("no column tells sessions or hosts")
    split = data.roles.split or "split"
    out = splits.grouped(data.df, columns, split, data.option("train_ratio", 0.7), data.seed)
    hosts = {c for c in (data.roles.src_ip, data.roles.dst_ip) if c}
    still = {c: leakage.hosts(out, c, split).first().n_shared for c in sorted(hosts)}
    return FixResult("group_split", replace(data, df=out, roles=replace(data.roles, split=split)), {}, {"hosts_on_both_sides": still})
