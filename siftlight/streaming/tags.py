"""The tag store and progress as streams.

A stream of operations is kept as a log of effective ones. A reset touches every file of a catalog, and is one row of the
log; the store is folded from the log when it is read. So no task and no state row ever holds a catalog, and operations
may arrive in any order of seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tagging
from ..operators.tagging import NEW_RATING


def step(records: dict[str, int], name: str | None, op: str, rating: int | None, new_rating: int = NEW_RATING) -> list[tuple[str, int | None, bool]]:
    """Apply one operation; the changes it makes."""
    if op == "reset":
        gone = [(n, None, False) for n in records]
        records.clear()
        return gone
    if name is None:
        return []
    if op == "toggle":
        if name in records:
            del records[name]
            return [(name, None, False)]
        records[name] = new_rating
        return [(name, new_rating, True)]
    if op == "rate" and name in records:
        records[name] = rating
        return [(name, rating, True)]
    return []


def tag_changes(ops: DataFrame) -> DataFrame:
    """The operations of a stream that can change a store: toggles and ratings of a name, and resets."""
    resets = F.col("op").isin("reset", "reset_all")
    rating = F.when(F.col("op") == "rate", F.col("rating")).cast("int").alias("rating")
    return ops.filter(resets | F.col("op").isin("toggle", "rate") & F.col("name").isNotNull()).select(
        "catalog", F.when(~resets, F.col("name")).alias("name"), "op", rating, "seq")


def store_of(changes: DataFrame) -> DataFrame:
    """The store after a log of changes."""
    # New names for the columns: the fold joins the log with its own resets, and a memory sink's table cannot be.
    return tagging.fold(changes.select(*[F.col(c).alias(c) for c in ("catalog", "name", "op", "rating", "seq")]))


def cache_counters(requests: DataFrame) -> DataFrame:
    """Running counters per tier, for an update-mode stream."""
    return requests.groupBy("tier").agg(F.count("*").alias("n"))


def progress(completions: DataFrame) -> DataFrame:
    """Completed items of each run so far and its fraction, for an update-mode stream."""
    return completions.groupBy("run").agg(F.count("*").alias("n"), F.max("total").alias("total")).withColumn("fraction", F.least(F.try_divide("n", "total"), F.lit(1.0)))
