"""The tag store as a function of its operation log (toggle, rate, reset), in closed form.

After a catalog's last reset, a name is tagged if it was toggled an odd number of times; its rating is the last one
given since its last toggle, or the rating of new tags. A catalog enters the store with its first toggle. A reset keeps
its entry, without records; resetting everything removes all entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEW_RATING = 3


def rate_expansion(ops: DataFrame) -> DataFrame:
    """A rating given to an untagged row tags it first: ``rate_row`` becomes toggle, then rate, in one sequence step.

    Needs the column ``was_tagged``.
    """
    two = F.when((F.col("op") == "rate_row") & ~F.col("was_tagged"), F.array(F.lit("toggle"), F.lit("rate"))).when(F.col("op") == "rate_row", F.array(F.lit("rate"))).otherwise(F.array("op"))
    return ops.select("catalog", "name", "seq", "rating", F.posexplode(two).alias("step", "op"))


def fold(ops: DataFrame, new_rating: int = NEW_RATING) -> DataFrame:
    """(catalog, name, rating) after all operations; ops: seq, catalog, name, op, rating (``reset_all`` clears all)."""
    return records(ops, new_rating).select("catalog", "name", "rating")


def _started(store: DataFrame) -> DataFrame:
    """Records of a store (catalog, name, dateTagged, dateCopied, rating) as toggles before all others."""
    return store.select("catalog", "name", F.lit("toggle").alias("op"), F.col("rating").cast("int").alias("rating"), F.lit(-1).cast("bigint").alias("seq"), F.struct("dateTagged", "dateCopied", "rating").alias("was"))


def records(ops: DataFrame, new_rating: int = NEW_RATING, store: DataFrame | None = None) -> DataFrame:
    """(catalog, name, rating, tagged_seq, dateTagged, dateCopied) after all operations on ``store`` (flat records).

    A record that was in the store and not toggled keeps its texts and has no ``tagged_seq``; a new one has the seq of
    the toggle that made it, and no texts yet. Stored records are distinct by (catalog, name); seq is 0 or more.
    """
    ops = ops.select("catalog", "name", "op", "rating", F.col("seq").cast("bigint").alias("seq"))
    was = "struct<dateTagged: string, dateCopied: string, rating: int>"
    resets = ops.filter("op = 'reset'").groupBy("catalog").agg(F.max("seq").alias("reset_at"))
    everything = ops.filter("op = 'reset_all'").agg(F.max("seq").alias("all_at"))
    live = ops.filter("op in ('toggle', 'rate') and name is not null").withColumn("was", F.lit(None).cast(was))
    if store is not None:
        live = live.unionByName(_started(store.filter("name is not null")).withColumn("was", F.col("was").cast(was)))
    live = live.join(resets, "catalog", "left").filter(F.col("seq") > F.coalesce(F.greatest(F.col("reset_at"), everything.scalar()), F.lit(-2)))
    w = Window.partitionBy("catalog", "name").orderBy("seq")
    n = live.withColumn("n", F.sum(F.when(F.col("op") == "toggle", 1).otherwise(0)).over(w))
    rated, tagged = (F.when(F.col("op") == op, F.col("seq")) for op in ("rate", "toggle"))
    last = n.groupBy("catalog", "name", "n").agg(F.count(rated).alias("n_rated"), F.max_by("rating", rated).alias("rating"), F.max(tagged).alias("tagged_seq"), F.max_by("was", tagged).alias("was"))
    final = last.groupBy("catalog", "name").agg(F.max_by(F.struct("n", "n_rated", "rating", "tagged_seq", "was"), "n").alias("s")).filter("s.n % 2 = 1")
    rating = F.when(F.col("s.rating").isNotNull(), F.col("s.rating")).when(F.col("s.was").isNotNull(), F.col("s.was.rating")).otherwise(F.lit(new_rating))
    return final.select("catalog", "name", rating.cast("int").alias("rating"), F.nullif("s.tagged_seq", F.lit(-1)).alias("tagged_seq"), "s.was.dateTagged", "s.was.dateCopied")


def entries(ops: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(catalog, started_seq, has_records): the catalogs of a store after all operations.

    ``known`` has the entries (catalog, has_records) that were there before them; theirs have no ``started_seq``.
    """
    everything = F.coalesce(ops.filter("op = 'reset_all'").agg(F.max("seq").alias("all_at")).scalar(), F.lit(-3))
    of = ops.filter("op = 'toggle' and name is not null or op = 'reset'").select("catalog", "op", F.col("seq").cast("bigint").alias("seq"))
    if known is not None:  # as a toggle before all operations, and a reset behind it where the records are gone
        before = F.when(F.col("has_records"), F.array(F.lit("toggle"))).otherwise(F.array(F.lit("toggle"), F.lit("reset")))
        of = of.unionByName(known.select("catalog", F.posexplode(before).alias("k", "op")).select("catalog", "op", (F.col("k") - 2).cast("bigint").alias("seq")))
    of = of.filter(F.col("seq") > everything)
    toggle, reset = (F.when(F.col("op") == op, F.col("seq")) for op in ("toggle", "reset"))
    seen = of.groupBy("catalog").agg(F.min(toggle).alias("started_seq"), F.max(toggle).alias("toggled"), F.max(reset).alias("reset_at"))
    return seen.filter("started_seq is not null").select("catalog", F.when(F.col("started_seq") >= 0, F.col("started_seq")).alias("started_seq"), (F.col("toggled") > F.coalesce("reset_at", F.lit(-3))).alias("has_records"))
