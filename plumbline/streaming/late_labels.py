"""Performance by labels that come late: predictions meet their labels, and each window's confusions say how good they were.

Both sides may be streams: each has its own watermark, and a label counts if
it comes no later than ``within`` after its prediction, so that the join's
state is let go. Windows are of the time of prediction, and come out once no
label can change them. On tables the same functions give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import q


def matched(predictions: DataFrame, labels: DataFrame, key: str, time: str, label_time: str, within: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(predictions' columns, label, label_time): each prediction with its label, if that comes in time; null keys meet nothing.

    ``labels`` is (key, label, label_time). Several labels of one key each count.
    """
    left = predictions.withWatermark(time, late).alias("p")
    right = labels.withWatermark(label_time, late).alias("l")
    in_time = (F.col(f"l.{label_time}") >= F.col(f"p.{time}")) & (F.col(f"l.{label_time}") <= F.col(f"p.{time}") + F.expr(f"INTERVAL {within}"))
    met = left.join(right, (F.col(f"p.{key}") == F.col(f"l.{key}")) & in_time)
    return met.select(*[F.col(f"p.{c}").alias(c) for c in predictions.columns], F.col("l.label").alias("label"), F.col(f"l.{label_time}").alias(label_time))


def confusions(met: DataFrame, time: str, predicted: str, window: str = "1 hour") -> DataFrame:
    """(start, label, predicted, n) of each window of prediction time; pairs without a label aren't counted."""
    known = met.where(F.col("label").isNotNull())
    counted = known.groupBy(F.window(time, window), F.col("label").cast("string").alias("label"), q(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "label", "predicted", "n")


def performance(counted: DataFrame, reference_f1: float, drop: float = 0.1, least_rows: int = 30) -> DataFrame:
    """(start, n, accuracy, f1_macro, alert) of a table of ``confusions``: an alert where F1 fell by more than ``drop``.

    F1 is averaged over classes that a window's labels have; a window with
    fewer than ``least_rows`` labels gives no alert.
    """
    of = lambda c: counted.groupBy("start", F.col(c).alias("class"))
    true = of("label").agg(F.sum("n").alias("true"), F.sum(F.when(F.col("label").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)).alias("hits"))
    said = of("predicted").agg(F.sum("n").alias("said"))
    each = true.join(said, ["start", "class"], "left")
    f1 = 2 * F.col("hits") / (F.col("true") + F.coalesce("said", F.lit(0)))
    out = each.groupBy("start").agg(F.sum("true").alias("n"), (F.sum("hits") / F.sum("true")).alias("accuracy"), F.avg(f1).alias("f1_macro"))
    return out.withColumn("alert", (F.col("n") >= least_rows) & (F.col("f1_macro") < reference_f1 - drop))
