"""Labels against documented attack windows: an interval join by host and time bin, without a cross join.

A window says which label flows of a host carry between two times. Windows are
cut into time bins; a bin of a host lists its windows in order of precedence,
so a flow meets one list at most by an equi-join on (host, bin), whatever
windows overlap, and its rows are never multiplied. A hot host is split by its
bins, and further by AQE where a bin is hot; the lists are the windows' size,
not the flows'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import normal_form
from plumbline.model import q

#: Width of a time bin, in the unit of times.
BIN = 3600.0
# Labels of rows that are no attack, in normal form.
BENIGN = ("benign", "normal", "background", "0")


def listed(windows: DataFrame, width: float = BIN) -> DataFrame:
    """(host, bin, windows): each host's windows of a time bin, first the one that counts.

    ``windows`` is (label, start, end, host, peer, precedence): both ends count;
    a null host or peer is any; the least precedence counts first, then the
    earliest start, end and label. Windows that end before they start, or lack
    an end, hold nothing.
    """
    sound = windows.where("start <= end")
    bins = F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))
    each = sound.withColumn("bin", F.explode(bins))
    own = F.struct("precedence", "start", "end", "label", "peer")
    return each.groupBy("host", "bin").agg(F.sort_array(F.collect_set(own)).alias("windows"))


def expected(df: DataFrame, time: Column, host: Column, windows: DataFrame, peer: Column | None = None, width: float = BIN) -> DataFrame:
    """``df`` with ``expected``: the label that the windows give a row, null outside all of them.

    Times are numbers in one unit. Rows without a time are outside; rows
    without a host meet windows of any host only.
    """
    lists = listed(windows, width)
    names = [q(c) for c in df.columns]
    told = df.withColumns({"__t": time, "__host": host, "__peer": F.lit(None).cast("string") if peer is None else peer.cast("string")})
    told = told.withColumn("__bin", F.floor(F.col("__t") / width).cast("long"))
    by_host = lists.where("host IS NOT NULL").select(F.col("host").alias("__h"), F.col("bin").alias("__b"), F.col("windows").alias("__own"))
    by_bin = lists.where("host IS NULL").select(F.col("bin").alias("__any_bin"), F.col("windows").alias("__any"))
    told = told.join(by_host, (F.col("__host") == F.col("__h")) & (F.col("__bin") == F.col("__b")), "left")
    told = told.join(by_bin, F.col("__bin") == F.col("__any_bin"), "left")

    def first(column: str) -> Column:
        holds = lambda w: (w["start"] <= F.col("__t")) & (F.col("__t") <= w["end"]) & (w["peer"].isNull() | F.coalesce(w["peer"] == F.col("__peer"), F.lit(False)))
        return F.get(F.filter(column, holds), F.lit(0))

    best = F.least(first("__own"), first("__any"))  # passes over nulls
    return told.select(*names, best["label"].alias("expected"))


def verdicts(told: DataFrame, label: str, benign: tuple[str, ...] = BENIGN) -> DataFrame:
    """Adds ``verdict`` to rows of ``expected``: outside, inside or other where the label contradicts the windows, else null.

    ``outside``: an attack's label outside all windows; ``inside``: a benign
    label inside one; ``other``: another attack's label inside one. Labels are
    compared in normal form; a row without a label contradicts nothing.
    """
    own, wanted = normal_form(q(label)), normal_form(F.col("expected"))
    harmless = own.isin(*benign)
    verdict = (
        F.when(F.col("expected").isNull(), F.when(~harmless, "outside"))
        .when(harmless & ~wanted.isin(*benign), "inside")
        .when(own != wanted, "other")
    )
    return told.withColumn("verdict", F.when(q(label).isNotNull(), verdict))


def summary(judged: DataFrame, label: str) -> DataFrame:
    """(verdict, label, expected, n) of the rows that contradict the windows."""
    return judged.where("verdict IS NOT NULL").groupBy("verdict", q(label).cast("string").alias("label"), "expected").agg(F.count(F.lit(1)).alias("n"))


def relabel(judged: DataFrame, label: str, benign_label: str) -> DataFrame:
    """Rows of ``verdicts`` with the windows' label where theirs contradicts it; attacks outside all windows become ``benign_label``."""
    kind = judged.schema[label].dataType
    corrected = F.coalesce(F.col("expected"), F.lit(benign_label)).cast(kind)
    out = judged.withColumn(label, F.when(F.col("verdict").isNull(), q(label)).otherwise(corrected))
    return out.drop("expected", "verdict")
