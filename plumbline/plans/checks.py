"""The checks of an audit: each turns a small aggregate into findings, or says why it can't run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from plumbline.model import SESSION_ROLES, CheckSkipped, Dataset, Finding, q
from plumbline.operators import census, drift, duplicates, flows, importance, labels, leakage, ml, poison, shortcuts, validity, windows
from plumbline.operators.shortcuts import names_identifier


@dataclass(frozen=True)
class Check:
    id: str
    module: str
    run: Callable[[Dataset], list[Finding]]
    also_emits: tuple[str, ...] = ()


_CHECKS: dict[str, Check] = {}


def register(check_id: str, module: str = "auditor", also_emits: tuple[str, ...] = ()):
    """Registers a check; two checks can't share an id."""

    def add(run: Callable[[Dataset], list[Finding]]):
        taken = {i for c in _CHECKS.values() for i in (c.id, *c.also_emits)}
        if taken & {check_id, *also_emits}:
            raise ValueError(f"check {check_id} is registered already")
        _CHECKS[check_id] = Check(check_id, module, run, also_emits)
        return run

    return add


def all_checks(module: str | None = None) -> list[Check]:
    return [c for _, c in sorted(_CHECKS.items()) if module in (None, c.module)]


def select(wanted: list[str] | str = "all", module: str | None = None) -> list[Check]:
    """Checks by id, by what they also emit, or by category (what precedes the dot)."""
    checks = all_checks(module)
    if wanted in ("all", ["all"]):
        return checks
    out = []
    for name in [wanted] if isinstance(wanted, str) else wanted:
        found = [c for c in checks if name in (c.id, c.id.split(".")[0], *c.also_emits)]
        if not found:
            raise KeyError(f"unknown check {name}; there are {', '.join(c.id for c in checks)}")
        out += [c for c in found if c not in out]
    return sorted(out, key=lambda c: c.id)


def row_id_of(data: Dataset) -> str:
    row = data.option("row_id", None)
    if row is None:
        raise CheckSkipped("a column that identifies rows is needed (option row_id)")
    return row


def _models(data: Dataset) -> list[str]:
    skip = {data.option("row_id", None)}
    return [c for c in data.numeric if c not in skip and not names_identifier(c)]


def _identity(data: Dataset) -> list[str]:
    keys = [c for c in data.identity if c != data.option("row_id", None)]
    if not keys:
        raise CheckSkipped("no column makes up a row's identity")
    return keys


def graded(value: float, *steps: tuple[float, str], other: str) -> str:
    return next((name for least, name in steps if value >= least), other)


@register("validity.nan_inf")
def nan_inf(data: Dataset) -> list[Finding]:
    out, facts = [], data.reusable("facts")
    found = validity.nan_inf_groups(data.df, data.features) if facts is None else validity.groups_of(validity.missing_of(facts))
    for r in found.orderBy(F.desc("n_bad"), "columns").collect():
        names = r["columns"].split(",")
        each = [names] if r.n_columns >= 3 else [[n] for n in names]
        for group in each:
            out.append(Finding("validity.nan_inf", r.severity, f"Missing or non-finite values in {', '.join(group[:5])}",
                               f"{len(group)} column(s) with the same counts", {"n_null": r.n_null, "n_nan": r.n_nan, "n_inf": r.n_inf, "ratio": r.ratio, "columns": group}, r.n_bad))
    return out


@register("validity.constant")
def constant(data: Dataset) -> list[Finding]:
    facts = data.reusable("facts")
    found = validity.constant(data.df, data.features) if facts is None else validity.constant_of(facts)
    names = sorted(r.column for r in found.collect())
    return [Finding("validity.constant", "low", f"{len(names)} constant column(s)", metric={"columns": names}, auto_fix="drop_constant")] if names else []


@register("validity.column_names")
def column_names(data: Dataset) -> list[Finding]:
    found = validity.name_problems(data.option("raw_columns", data.df.columns))
    out = []
    if found["spaces"]:
        out.append(Finding("validity.column_names", "low", "Column names with outer spaces", metric={"columns": found["spaces"]}, auto_fix="strip_column_names"))
    if found["collisions"]:
        out.append(Finding("validity.column_names", "medium", "Column names that collide without outer spaces", metric={"columns": found["collisions"]}))
    return out


@register("validity.impossible")
def impossible(data: Dataset) -> list[Finding]:
    out, facts = [], data.reusable("facts")
    found = validity.impossible(data.df, data.numeric) if facts is None else validity.impossible_of(facts)
    for r in found.orderBy("column").collect():
        metric = {k: v for k, v in r.asDict().items() if v is not None}
        out.append(Finding("validity.impossible", "high", f"Impossible values in {r.column}", metric=metric, affected_rows=r.n_bad))
    return out


@register("dup.exact", also_emits=("dup.class_ratio",))
def dup_exact(data: Dataset) -> list[Finding]:
    keys, label = _identity(data), data.roles.label
    rows = data.reusable("rows")
    r = (duplicates.exact(data.df, [*keys, *([label] if label else [])]) if rows is None else census.exact(rows)).first()
    if not r.n_dupes:
        return []
    out = [Finding("dup.exact", graded(r.ratio, (0.2, "high"), (0.05, "medium"), other="low"), "Exact duplicates", metric=r.asDict(), affected_rows=r.n_dupes, auto_fix="drop_duplicates")]
    if label:
        classes = duplicates.class_ratio(data.df, keys, label) if rows is None else census.class_ratio(rows)
        told = [x.asDict() for x in classes.orderBy(F.desc("dup_ratio"), "label").collect()]
        if told:
            out.append(Finding("dup.class_ratio", "medium", "Classes made of copies", metric={"classes": len(told)}, examples=told, affected_rows=sum(x["n_rows"] - x["n_unique"] for x in told)))
    return out


@register("dup.cross_split")
def dup_cross_split(data: Dataset) -> list[Finding]:
    data.require("split")
    keys = _identity(data) + ([data.roles.label] if data.roles.label else [])
    splits = data.df.select(q(data.roles.split)).where(q(data.roles.split).isNotNull()).distinct().limit(2).count()
    if splits < 2:
        raise CheckSkipped("fewer than two splits")
    rows = data.reusable("rows")
    r = (duplicates.cross_split(data.df, keys, data.roles.split) if rows is None else census.cross_split(rows)).first()
    return [Finding("dup.cross_split", "critical", "Rows that several splits share", metric=r.asDict(), affected_rows=r.n_affected, auto_fix="drop_duplicates")] if r.n_affected else []


@register("dup.near")
def dup_near(data: Dataset) -> list[Finding]:
    threshold = data.option("near_duplicate_threshold", 0.9)
    if threshold >= 0.99:
        raise CheckSkipped("at this threshold near duplicates are exact ones")
    rows = data.df.count()
    found = duplicates.near_classes(data.df, _identity(data), row_id_of(data), data.roles.label, threshold)
    r = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("component_id").alias("classes")).first()
    if not r.n:
        return []
    ratio = r.n / rows
    return [Finding("dup.near", graded(ratio, (0.1, "high"), (0.02, "medium"), other="low"), "Near duplicates", metric={"classes": r.classes, "ratio": ratio, "n_evaluated": rows}, affected_rows=r.n)]


@register("labels.conflict")
def labels_conflict(data: Dataset) -> list[Finding]:
    data.require("label")
    keys = _identity(data)
    rows = data.reusable("rows")
    r = (labels.conflicts(data.df, keys, data.roles.label) if rows is None else census.conflicts(rows)).first()
    if not r.n_affected:
        return []
    most = labels.conflict_pairs(data.df, keys, data.roles.label) if rows is None else census.conflict_pairs(rows)
    pairs = [x.asDict() for x in most.collect()]
    return [Finding("labels.conflict", graded(r.ratio, (0.01, "critical"), other="high"), "Equal rows under different labels", metric=r.asDict(), affected_rows=r.n_affected, examples=pairs)]


def _label_counts(data: Dataset):
    rows = data.reusable("rows")
    return labels.label_counts(data.df, data.roles.label) if rows is None else census.label_counts(rows)


@register("labels.taxonomy")
def labels_taxonomy(data: Dataset) -> list[Finding]:
    data.require("label")
    rows = [r.asDict() for r in labels.taxonomy_of(_label_counts(data)).orderBy("normal_form").collect()]
    return [Finding("labels.taxonomy", "high", "Labels spelt in several ways", metric={"forms": len(rows)}, affected_rows=sum(r["n_rows"] for r in rows), examples=rows, auto_fix="normalize_labels")] if rows else []


@register("labels.imbalance")
def labels_imbalance(data: Dataset) -> list[Finding]:
    data.require("label")
    counted = _label_counts(data)
    if counted.limit(2).count() < 2:
        raise CheckSkipped("fewer than two classes")
    rows = [r.asDict() for r in labels.imbalance_of(counted, data.option("min_class_examples", 100)).orderBy("n_rows", "label").collect()]
    return [Finding("labels.imbalance", "medium", "Classes with few rows", metric={"classes": len(rows), "ratio": rows[0]["ratio"]}, affected_rows=sum(r["n_rows"] for r in rows), examples=rows)] if rows else []


@register("labels.noise")
def labels_noise(data: Dataset) -> list[Finding]:
    data.require("label")
    scored, classes, accuracy = ml.noise_scores(data.df, _models(data), data.roles.label, row_id_of(data), data.seed)
    issues = ml.confident_issues(scored, classes)
    n, total = issues.count(), scored.count()
    ratio = n / total if total else 0
    if ratio < data.option("noise_min_ratio", 0.001):
        return []
    flagged = issues.select("row_id", (1 - F.col("self_confidence")).alias("score"))
    examples = [r.asDict() for r in issues.orderBy("self_confidence", "row_id").limit(10).collect()]
    return [Finding("labels.noise", graded(ratio, (0.01, "high"), other="medium"), "Labels that look wrong", metric={"ratio": ratio, "accuracy": accuracy, "may_overestimate_by": ml.overestimate(accuracy)}, affected_rows=n, examples=examples, auto_fix="quarantine_noise", flagged=flagged)]


@register("leak.temporal")
def leak_temporal(data: Dataset) -> list[Finding]:
    data.require("split", "time")
    time = leakage.time_column(data.df, data.roles.time, data.option("time_format", None))
    r = leakage.temporal(data.df, time, data.roles.split).first()
    if not r.n_train or not r.n_test:
        raise CheckSkipped("train or test has no row with a time")
    if r.n_untimed / (r.n_train + r.n_test + r.n_untimed) > leakage.UNREADABLE:
        raise CheckSkipped(f"{r.n_untimed} rows have no time")
    if not r.n_before:
        return []
    inside = r.test_min >= r.train_min and r.test_max <= r.train_max
    severe = r.test_max <= r.train_min or inside or r.overlap >= 0.5
    metric = r.asDict() | {"unclassified_splits": leakage.unclassified(data.df, data.roles.split)}
    return [Finding("leak.temporal", "critical" if severe else "high", "Test rows before the end of training", metric=metric, affected_rows=r.n_before, auto_fix="temporal_split")]


@register("leak.session")
def leak_session(data: Dataset) -> list[Finding]:
    data.require("split", *SESSION_ROLES)
    r = leakage.sessions(data.df, [getattr(data.roles, x) for x in SESSION_ROLES], data.roles.split).first()
    return [Finding("leak.session", graded(r.ratio, (0.1, "critical"), other="high"), "Sessions in train and test", metric=r.asDict(), affected_rows=r.n_affected, auto_fix="group_split")] if r.n_shared else []


@register("leak.host")
def leak_host(data: Dataset) -> list[Finding]:
    data.require("split")
    columns = [c for c in (data.roles.src_ip, data.roles.dst_ip) if c]
    if not columns:
        raise CheckSkipped("no column has the role src_ip or dst_ip")
    out = []
    for c in columns:
        r = leakage.hosts(data.df, c, data.roles.split).first()
        if r.n_shared:
            out.append(Finding("leak.host", graded(r.test_rows_ratio, (0.5, "critical"), other="high"), f"Hosts of {c} in train and test", metric=r.asDict(), affected_rows=r.n_affected, auto_fix="group_split"))
    return out


@register("shortcut.single_feature")
def single_feature(data: Dataset) -> list[Finding]:
    data.require("label")
    row = data.option("row_id", None)
    features = [c for c in data.features if c != row]
    limit = data.option("shortcut_threshold", 0.95)
    found = shortcuts.single_feature(data.df, features, data.numeric, data.roles.label).where(F.col("balanced_accuracy") >= limit)
    return [
        Finding("shortcut.single_feature", "critical", f"{r.column} alone tells the label", metric=r.asDict(), auto_fix="drop_identifiers" if names_identifier(r.column) else None)
        for r in found.orderBy(F.desc("balanced_accuracy"), "column").collect()
    ]


@register("shortcut.identifier")
def identifier(data: Dataset) -> list[Finding]:
    row = data.option("row_id", None)
    names = [c for c in data.features if c not in data.declared and c != row and names_identifier(c)]
    return [Finding("shortcut.identifier", "high", "Identifiers among the features", metric={"columns": names}, auto_fix="drop_identifiers")] if names else []


def _reference(data: Dataset):
    if data.reference is None:
        raise CheckSkipped("no reference table")
    return data.reference


def _common(data: Dataset) -> list[str]:
    ref = set(_reference(data).columns)
    return [c for c in _models(data) if c in ref]


@register("drift.schema", "drift")
def drift_schema(data: Dataset) -> list[Finding]:
    found = drift.schema(_reference(data), data.df)
    kinds = {c for c, *_ in found}
    severity = "critical" if "missing" in kinds else "high" if "retyped" in kinds else "medium"
    return [Finding("drift.schema", severity, "The schema changed", metric={k: [c for x, c, *_ in found if x == k] for k in sorted(kinds)})] if found else []


@register("drift.feature", "drift")
def drift_feature(data: Dataset) -> list[Finding]:
    columns = _common(data)
    if not columns:
        raise CheckSkipped("no numeric column in common")
    rows = drift.feature_drift(_reference(data), data.df, columns, data.option("psi_threshold", drift.PSI_MODERATE)).orderBy(F.desc("psi"), "column").collect()
    if not rows:
        return []
    gaps = {r.column: drift.ks(_reference(data), data.df, r.column).first().ks for r in rows}
    examples = [{"column": r.column, "psi": r.psi, "ks": gaps[r.column]} for r in rows]
    severity = "high" if rows[0].psi >= drift.PSI_SEVERE or len(rows) >= 5 else "medium"
    return [Finding("drift.feature", severity, f"{len(rows)} column(s) drifted", metric={"max_psi": rows[0].psi, "columns": len(rows)}, examples=examples)]


@register("drift.prior", "drift")
def drift_prior(data: Dataset) -> list[Finding]:
    data.require("label")
    r = drift.js(_reference(data), data.df, data.roles.label).first()
    if r.js < 0.05 and not r.n_new and not r.n_vanished:
        return []
    return [Finding("drift.prior", "high" if r.n_new or r.js >= 0.2 else "medium", "The class distribution changed", metric=r.asDict())]


@register("drift.covariate", "drift")
def drift_covariate(data: Dataset) -> list[Finding]:
    columns = _common(data)
    if len(columns) < 2:
        raise CheckSkipped("fewer than two numeric columns in common")
    if min(_reference(data).limit(50).count(), data.df.limit(50).count()) < 50:
        raise CheckSkipped("fewer than 50 rows on one side")
    auc, weights = drift.covariate_auc(_reference(data), data.df, columns, row_id_of(data), seed=data.seed)
    if auc < 0.75:
        return []
    top = sorted(weights.items(), key=lambda x: -x[1])[:10]
    return [Finding("drift.covariate", graded(auc, (0.9, "critical"), other="high"), "A model tells the batch from the reference", metric={"auc": auc}, examples=[{"column": c, "importance": w} for c, w in top])]


@register("drift.concept", "drift")
def drift_concept(data: Dataset) -> list[Finding]:
    data.require("label")
    scored = drift.concept_scores(_reference(data), data.df, _common(data), data.roles.label, row_id_of(data), seed=data.seed)
    by_class = drift.recalls(scored)
    r = drift.recall_drop(by_class).first()
    if r.classes < 2:
        raise CheckSkipped("fewer than two classes with 30 rows on both sides")
    if r.before < 1 / r.classes + 0.10:
        raise CheckSkipped("the model learns too little from the reference")
    if r["drop"] < 0.10 or r["drop"] < 4 * r.error:
        return []
    worst = by_class.orderBy(F.asc(F.col("recall_batch") - F.col("recall_reference")), "label").limit(10)
    return [Finding("drift.concept", graded(r["drop"], (0.25, "critical"), other="high"), "The model's recall fell", metric=r.asDict(), examples=[x.asDict() for x in worst.collect()])]


def _suspects(check_id: str, flagged, total: int, metric: dict | None = None, title: str = "Suspect rows") -> list[Finding]:
    n = flagged.count()
    if not n:
        return []
    ratio = n / max(1, total)
    return [Finding(check_id, "high" if ratio >= 0.02 else "medium", title, metric={"ratio": ratio} | (metric or {}), affected_rows=n, flagged=flagged)]


def _matrix(data: Dataset):
    """The labelled rows, all of which are judged, and the columns to judge them by."""
    data.require("label")
    columns = _models(data)
    if len(columns) < 2:
        raise CheckSkipped("fewer than two numeric columns that aren't identifiers")
    return data.df.where(q(data.roles.label).isNotNull()), columns


@register("poison.loss", "poison")
def poison_loss(data: Dataset) -> list[Finding]:
    rows, columns = _matrix(data)
    classes = rows.groupBy(q(data.roles.label)).count().agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).first()
    if classes.n < 2 or classes.least < ml.FOLDS:
        raise CheckSkipped(f"fewer than two classes, or a class with fewer than {ml.FOLDS} rows")
    scored, _ = ml.out_of_fold(rows, columns, data.roles.label, row_id_of(data), data.seed)
    top = poison.loss(scored)
    return _suspects("poison.loss", top.select("row_id", F.col("loss").alias("score")), scored.count(), title="Rows of large loss")


@register("poison.knn", "poison")
def poison_knn(data: Dataset) -> list[Finding]:
    known, columns = _matrix(data)
    rows = poison.matrix(known, columns, data.roles.label, row_id_of(data))
    return _suspects("poison.knn", poison.knn(rows), rows.count(), title="Rows among neighbours of other classes")


@register("poison.cluster", "poison")
def poison_cluster(data: Dataset) -> list[Finding]:
    known, columns = _matrix(data)
    rows = poison.matrix(known, columns, data.roles.label, row_id_of(data))
    return _suspects("poison.cluster", poison.clusters(rows).select("row_id", "score"), rows.count(), title="Small compact clusters (experimental)")


@register("poison.trigger", "poison")
def poison_trigger(data: Dataset) -> list[Finding]:
    data.require("label")
    if data.df.limit(2 * poison.MIN_SUPPORT).count() < 2 * poison.MIN_SUPPORT:
        raise CheckSkipped("too few rows to look for a trigger")
    columns = _models(data)
    if not columns:
        raise CheckSkipped("no numeric column that isn't an identifier")
    rows = poison.trigger_rows(data.df, columns, data.roles.label, row_id_of(data))
    found = poison.trigger_values(data.df, columns, data.roles.label).orderBy(F.desc("lift"), "column", "value").limit(10)
    out = _suspects("poison.trigger", rows, data.df.count(), title="Values that act as a trigger")
    for f in out:
        f.examples = [r.asDict() for r in found.collect()]
    return out


def _seconds(data: Dataset, column: str):
    """A time column as seconds."""
    time = leakage.time_column(data.df, column, data.option("time_format", None))
    kind = data.df.select(time.alias("t")).schema["t"].dataType.simpleString()
    return time.cast("timestamp").cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else time.cast("double")


def attack_windows(data: Dataset):
    """The documented windows of option ``attack_windows``: a table, or dicts of label, start, end and, where known, host, peer, precedence.

    Times are text that Spark reads as a timestamp, or numbers in the unit of the time column.
    """
    given = data.option("attack_windows", None)
    if given is None:
        raise CheckSkipped("no documented windows (option attack_windows)")
    if isinstance(given, (list, tuple)):
        rows = [[None if w.get(k) is None else str(w[k]) for k in ("label", "start", "end", "host", "peer")] + [int(w.get("precedence") or 0)] for w in given]
        given = data.df.sparkSession.createDataFrame(rows, "label string, start string, end string, host string, peer string, precedence int")
    second = lambda c: F.coalesce(F.col(c).try_cast("double"), F.col(c).cast("string").try_cast("timestamp").cast("double"))
    return given.select("label", second("start").alias("start"), second("end").alias("end"), F.col("host").cast("string"), F.col("peer").cast("string"), "precedence")


def judged_by_windows(data: Dataset):
    """The rows with ``expected`` and ``verdict``, by documented windows of attackers and, where told, their targets."""
    data.require("label", "time", "src_ip")
    peer = q(data.roles.dst_ip) if data.roles.dst_ip else None
    told = windows.expected(data.df, _seconds(data, data.roles.time), q(data.roles.src_ip).cast("string"), attack_windows(data), peer)
    return windows.verdicts(told, data.roles.label)


@register("labels.window", "domain")
def labels_window(data: Dataset) -> list[Finding]:
    judged = judged_by_windows(data)
    rows = windows.summary(judged, data.roles.label).orderBy(F.desc("n"), "verdict", "label", "expected").limit(100).collect()
    if not rows:
        return []
    total, by = data.df.count(), windows.summary(judged, data.roles.label).groupBy("verdict").agg(F.sum("n").alias("n")).collect()
    counts = {r.verdict: r.n for r in by}
    ratio = sum(counts.values()) / max(1, total)
    row = data.option("row_id", None)
    flagged = judged.where("verdict IS NOT NULL").select(q(row).alias("row_id"), F.lit(1.0).alias("score")) if row else None
    return [Finding("labels.window", graded(ratio, (0.01, "high"), other="medium"), "Labels that contradict the documented windows", metric=counts | {"ratio": ratio},
                    affected_rows=sum(counts.values()), examples=[r.asDict() for r in rows], auto_fix="relabel_window", flagged=flagged)]


@register("flow.timeout", "domain")
def flow_timeout(data: Dataset) -> list[Finding]:
    """Records of one five-tuple that follow one another within option ``timeout_gap`` seconds (1 by default)."""
    data.require("time", *SESSION_ROLES)
    start = _seconds(data, data.roles.time)
    lasts = data.option("duration", None)
    end = start + q(lasts).cast("double") * data.option("duration_unit", 1.0) if lasts else start
    keys = [getattr(data.roles, r) for r in SESSION_ROLES]
    events = flows.cut_by_timeout(data.df, keys, start, end, data.option("timeout_gap", 1.0), row_id_of(data))
    r = flows.timeout_summary(events, data.df.count()).first()
    if r.ratio < data.option("timeout_min_ratio", 0.01):
        return []
    examples = [x.asDict() for x in events.orderBy(F.desc("n_records"), "first_id").limit(10).collect()]
    return [Finding("flow.timeout", graded(r.ratio, (0.2, "high"), (0.05, "medium"), other="low"), "Events recorded as several flows", metric=r.asDict(), affected_rows=r.n_affected, examples=examples)]


@register("leak.random_split", "domain")
def leak_random_split(data: Dataset) -> list[Finding]:
    data.require("split", "time", "label")
    time = leakage.time_column(data.df, data.roles.time, data.option("time_format", None))
    r = leakage.random_split(data.df, time, data.roles.split, data.roles.label, row_id_of(data)).first()
    if r.split_z is None:
        raise CheckSkipped("train or test has no row with a time")
    return [Finding("leak.random_split", "high", "A random split of rows that hang together in time", metric=r.asDict(), affected_rows=r.n, auto_fix="temporal_split")] if r.by_lot else []


@register("poison.spectral", "domain")
def poison_spectral(data: Dataset) -> list[Finding]:
    known, columns = _matrix(data)
    rows = poison.matrix(known, columns, data.roles.label, row_id_of(data))
    strong = poison.directions(rows).where(F.col("strength") >= data.option("spectral_strength", 0.5)).select("y")
    top = poison.spectral(rows).join(strong, "y", "left_semi")
    return _suspects("poison.spectral", top.select("row_id", "score"), rows.count(), title="Rows far along their class's main direction")


@register("validity.types", "domain")
def validity_types(data: Dataset) -> list[Finding]:
    """Text columns whose values are numbers, times or truth values, and those whose values have outer blanks."""
    text = [c for c in data.features if data.df.schema[c].dataType.simpleString() == "string"]
    if not text:
        raise CheckSkipped("no text column")
    out = []
    for r in validity.kinds_of(data.df, text).where("kind IN ('truth', 'whole', 'number', 'time')").orderBy("column").collect():
        severity = "medium" if r.n_odd else "low"
        out.append(Finding("validity.types", severity, f"{r.column} holds {r.kind} values as text", metric=r.asDict(), affected_rows=r.n_odd))
    padded = [r.column for r in validity.kinds_of(data.df, text).where("n_padded > 0").orderBy("column").collect()]
    if padded:
        out.append(Finding("validity.types", "low", "Values with outer blanks", metric={"columns": padded}))
    return out


@register("shortcut.importance", "domain")
def shortcut_importance(data: Dataset) -> list[Finding]:
    """A baseline that needs few of many columns, or one whose name says that it identifies: option ``importance_share`` (0.8)."""
    data.require("label")
    row = row_id_of(data)
    columns = [c for c in data.numeric if c != row]
    if len(columns) < 4:
        raise CheckSkipped("fewer than four numeric columns")
    model, classes, gain = importance.baseline(data.df, columns, data.roles.label, row, data.seed)
    if gain < 0.25:
        raise CheckSkipped(f"a simple model tells the classes too badly (skill {gain:.2f})")
    known = data.df.where(q(data.roles.label).isNotNull())
    rows = importance.importance(known, columns, importance.paths_of(importance.forest_nodes(model), importance.DEPTH)).collect()
    shares = sorted(((r.share, r.column) for r in rows), key=lambda x: (-x[0], x[1]))
    limit = data.option("importance_share", 0.8)
    few = shares[: max(1, len(columns) // 10)]
    named = [c for share, c in shares if share >= 0.1 and names_identifier(c)]
    if sum(share for share, _ in few) < limit and not named:
        return []
    examples = [{"column": c, "share": share, "identifier": names_identifier(c)} for share, c in shares]
    metric = {"columns": [c for _, c in few], "share": sum(share for share, _ in few), "identifiers": named, "skill": gain, "classes": len(classes)}
    return [Finding("shortcut.importance", "high" if named else "medium", "The baseline rests on few columns", metric=metric, examples=examples, auto_fix="drop_identifiers" if named else None)]


@register("drift.mmd", "domain")
def drift_mmd(data: Dataset) -> list[Finding]:
    columns = _common(data)
    if not columns:
        raise CheckSkipped("no numeric column in common")
    r = drift.mmd(_reference(data), data.df, columns, row_id_of(data), data.seed)
    return [Finding("drift.mmd", graded(r["mmd2"] / max(r["limit"], 1e-300), (10, "high"), other="medium"), "The joint distribution changed", metric=r)] if r["drifted"] else []
