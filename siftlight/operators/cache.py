"""Cache accounting: hit rates, costs, tiers, pressure, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

CRITICAL_LIMIT = 50 * 1024 * 1024


def statistics(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per tier. The compatible "misses" are disk hits; extractions are counted apart."""
    g = requests.groupBy(*(by or []))
    s = g.agg(F.count_if(F.col("tier") == "ram").alias("hits"), F.count_if(F.col("tier") == "disk").alias("misses"), F.count_if(F.col("tier") == "extract").alias("extractions"))
    seen = F.col("hits") + F.col("misses")
    return s.withColumn("hit_rate", F.coalesce(F.col("hits") * 100.0 / F.nullif(seen, F.lit(0)), F.lit(0.0)))


def thumbnail_cost(width: Column, height: Column, bytes_per_pixel: Column) -> Column:
    """Bytes of one representation."""
    return width * height * bytes_per_pixel


def total_cost(reps: DataFrame, key: str) -> DataFrame:
    """Cost of an image: its representations (or, if they give nothing, its logical size) plus a tenth, truncated."""
    s = reps.groupBy(key).agg(F.sum(thumbnail_cost(F.col("width"), F.col("height"), F.col("bpp"))).alias("pixels"), F.max(F.col("logical_width") * F.col("logical_height") * F.col("bpp")).alias("logical"))
    base = F.when(F.coalesce("pixels", F.lit(0)) > 0, F.col("pixels")).otherwise(F.col("logical"))
    return s.select(key, F.floor(base * F.lit(1.1)).cast("bigint").alias("cost"))


def resolve_tiers(requests: DataFrame, ram: DataFrame, disk: DataFrame) -> DataFrame:
    """RAM, else disk, else extract; the key is the file alone, so the first stored size wins."""
    r = requests.join(ram.select("file_key", F.lit(True).alias("in_ram")), "file_key", "left").join(disk.select("file_key", F.lit(True).alias("on_disk")), "file_key", "left")
    return r.withColumn("tier", F.when(F.col("in_ram"), "ram").when(F.col("on_disk"), "disk").otherwise("extract")).drop("in_ram", "on_disk")


def coalesced(requests: DataFrame) -> DataFrame:
    """One extraction per file: the earliest request stands for all."""
    return requests.groupBy("file_key").agg(F.min("seq").alias("seq"), F.count("*").alias("n_requests"))


#: A warning takes 40 % off, rounded down; no limit that fits a long is above 0 after this many.
MOST_WARNINGS = 96


def pressure_limit(levels: DataFrame, key: str, start: int, strict: bool = True) -> DataFrame:
    """The memory limit after a sequence of pressure levels: a warning takes 40 % off each time, critical sets 50 MiB.

    ``strict``: a normal level does not restore the limit; otherwise it does. Only the last level that sets a limit
    matters, and how many warnings follow it: both are counted on the map side, so a key's history is never gathered.
    """
    sets = (F.col("level") == "critical") | ((F.col("level") == "normal") & F.lit(not strict))
    last = levels.groupBy(key).agg(F.max(F.when(sets, F.struct("seq", "level"))).alias("last"))
    since = levels.filter("level = 'warning'").join(last.select(F.col(key).alias("_key"), F.col("last.seq").alias("_at")), F.col(key).eqNullSafe(F.col("_key")))
    # Of events with the same seq, levels stand in the order of their names: a warning comes after what sets a limit.
    n = since.filter(F.col("_at").isNull() | (F.col("seq") >= F.col("_at"))).groupBy("_key").agg(F.count("*").alias("n"))
    base = F.when(F.col("last.level") == "critical", F.lit(CRITICAL_LIMIT)).otherwise(F.lit(start)).cast("bigint")
    times = F.slice(F.sequence(F.lit(0), F.lit(MOST_WARNINGS)), F.lit(1), F.least(F.coalesce("n", F.lit(0)), F.lit(MOST_WARNINGS)).cast("int"))
    out = last.join(n, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, F.aggregate(times, base, lambda a, _: F.floor(a * F.lit(0.6)).cast("bigint")).alias("limit_bytes"))


def observed(requests: DataFrame, name: str = "cache") -> tuple[DataFrame, Observation]:
    """Requests with their counters on the side: whatever pass makes the rows counts them (``counters``), no second one."""
    seen = Observation(name)
    count = lambda tier: F.count_if(F.col("tier") == tier).alias({"ram": "hits", "disk": "misses", "extract": "extractions"}[tier])
    return requests.observe(seen, *[count(t) for t in ("ram", "disk", "extract")]), seen


def counters(seen: Observation) -> dict[str, float]:
    """The statistics of an observed pass that has ended."""
    got = seen.get
    looked_up = got["hits"] + got["misses"]
    return {**got, "hit_rate": got["hits"] * 100.0 / looked_up if looked_up else 0.0}


def cleared(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Clearing the caches: the statistics it reports, and the counters after it. Cached files go by an age of 0 days
    (``copyplan.prune_candidates``)."""
    zero = [F.lit(0).cast("bigint").alias(f"{c}_after") for c in ("hits", "misses", "evictions")]
    return statistics(requests, by).select("*", *zero)


def since_clear(log: DataFrame, clears: DataFrame, by: str) -> DataFrame:
    """The rows of a log (with ``by`` and seq) after the last clearing of their cache; all of one never cleared."""
    last = clears.groupBy(F.col(by).alias("_by")).agg(F.max("seq").alias("_cleared"))
    kept = log.join(last, F.col(by).eqNullSafe(F.col("_by")), "left").filter(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared")))
    return kept.drop("_by", "_cleared")


def contents(puts: DataFrame, clears: DataFrame, by: str) -> DataFrame:
    """(by, file_key, cost): what was put (seq, file_key, cost) and not cleared since; a file put again counts once, at its
    last cost. What a cache lets go of under pressure is not defined, so nothing is taken out for its size."""
    live = since_clear(puts, clears, by)
    return live.groupBy(by, "file_key").agg(F.max_by("cost", "seq").alias("cost"))


def occupancy(held: DataFrame, by: str, cost_limit: int, count_limit: int) -> DataFrame:
    """Entries and cost of each cache, and by how much it exceeds its limits."""
    o = held.groupBy(by).agg(F.count("*").alias("n_entries"), F.sum("cost").alias("cost"))
    return o.select("*", F.greatest(F.lit(0), F.col("cost") - cost_limit).cast("long").alias("over_cost"), F.greatest(F.lit(0), F.col("n_entries") - count_limit).cast("long").alias("over_count"))


def used_memory(wired: Column, active: Column, compressed: Column, page_size: Column, total: Column) -> Column:
    """Bytes of wired, active and compressed pages, at most the total."""
    return F.least((wired + active + compressed) * page_size, total)


def memory_gauges(m: DataFrame) -> DataFrame:
    """Used of total, app of used, threshold (80 %) of total; 0 where the denominator is 0."""
    threshold = F.floor(F.col("total") * F.lit(0.8)).cast("bigint")
    share = lambda a, b: F.coalesce(a * 100.0 / F.nullif(b, F.lit(0)), F.lit(0.0))
    return m.select("*", threshold.alias("threshold"), share(F.col("used"), F.col("total")).alias("used_pct"), share(F.col("app"), F.col("used")).alias("app_pct"), share(threshold, F.col("total")).alias("threshold_pct"))
