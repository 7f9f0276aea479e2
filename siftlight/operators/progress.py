"""Remaining time and progress of batch runs from their completion log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items before an estimate is shown, and completions it looks back on.
MIN_ITEMS, LOOK_BACK = 10, 10


def eta(completions: DataFrame) -> DataFrame:
    """Per completion (run, n, micros, total): the trailing mean delta and, from the tenth item on, the seconds left.

    Deltas are integer microseconds, so the mean is exact before its one division.
    """
    w = Window.partitionBy("run").orderBy("n")
    d = completions.withColumn("delta", F.col("micros") - F.lag("micros").over(w))
    last = w.rowsBetween(-(LOOK_BACK - 1), 0)
    d = d.withColumn("mean_micros", F.try_divide(F.sum("delta").over(last), F.count("delta").over(last)))
    return d.withColumn("eta", F.when(F.col("n") >= MIN_ITEMS, (F.col("mean_micros") * (F.col("total") - F.col("n")) / 1e6).cast("bigint")))


def monotone_eta(estimates: DataFrame) -> DataFrame:
    """Only estimates that do not exceed an earlier one are shown."""
    w = Window.partitionBy("run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return estimates.withColumn("least", F.min("eta").over(w)).filter("eta = least").drop("least")


def fraction(done, total):
    """min(done / total, 1), null unless total is positive."""
    return F.when(total > 0, F.least(done / F.nullif(total, F.lit(0)), F.lit(1.0)))
