"""The file table and its lookups in the tag store: search, rating filters, existence checks, counts, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["catalog", "name"]
#: Rows of a range that one task numbers.
RANGE_ROWS = 2_000_000


def first_records(records: DataFrame) -> DataFrame:
    """One record per (catalog, name): the first by ``position``, as later duplicates are never looked at."""
    return records.groupBy(*KEY).agg(F.min_by("rating", "position").alias("rating"), F.lit(True).alias("tagged"))


def with_rating(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files with their rating; untagged files and missing ratings count as 0. The join strategy is left to AQE."""
    joined = files.join(first_records(records), KEY, "left")
    return joined.withColumn("rating", F.coalesce("rating", F.lit(0))).withColumn("tagged", F.coalesce("tagged", F.lit(False)))


def matches(name: Column, query: str) -> Column:
    """Case-insensitive, accent-sensitive substring search; an empty query matches everything."""
    if not query:
        return F.lit(True)
    return F.contains(F.collate(name, "UNICODE_CI"), F.collate(F.lit(query), "UNICODE_CI"))


def visible(files: DataFrame, records: DataFrame, query: str = "", min_rating: int = 0) -> DataFrame:
    return with_rating(files.filter(matches(F.col("name"), query)), records).filter(F.col("rating") >= min_rating)


def ordered(files: DataFrame, *keys: Column) -> DataFrame:
    """Sorted by the keys (default: name, binary order), with the file key as the last tie-break."""
    return files.orderBy(*(keys or (F.col("name"),)), F.col("file_key"))


def numbered(files: DataFrame, path: str, *keys: Column) -> DataFrame:
    """All files in the order of ``ordered``, with their ``place`` in it (from 1).

    Sorted ranges are numbered inside, each from the count of those before it; there are as many as the rows need, so no
    task holds more than about ``RANGE_ROWS``. They are written to ``path`` first: ranges are cut from a sample, and
    counts and numbers must see the same cut. Who reads the result deletes ``path`` afterwards.
    """
    spark, order = files.sparkSession, (*(keys or (F.col("name"),)), F.col("file_key"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // RANGE_ROWS))
    files.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = ranges.withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    placed = inside.join(F.broadcast(before), "_range").withColumn("place", (F.col("_before") + F.col("_inside")).cast("bigint"))
    return placed.drop("_range", "_inside", "_before").orderBy("place")


def rated_names(files: DataFrame, records: DataFrame, min_rating: int, query: str = "") -> DataFrame:
    """Names of searched files with at least the rating."""
    return visible(files, records, query, min_rating).select("catalog", "name")


def tagged_names(records: DataFrame, catalog: str) -> DataFrame:
    """Names in the store for one catalog; neither search nor rating matter here."""
    return records.filter((F.col("catalog") == catalog) & F.col("name").isNotNull()).select("name")


def tagged_files(files: DataFrame, records: DataFrame) -> DataFrame:
    return files.join(records.select(*KEY), KEY, "left_semi")


def tagged_strip(files: DataFrame, records: DataFrame, catalog: str) -> DataFrame:
    """Sorted tagged names with the path of their first file; names without a file keep a null path."""
    first = files.filter(F.col("catalog") == catalog).groupBy("name").agg(F.min("path").alias("path"))
    return tagged_names(records, catalog).join(first, "name", "left").orderBy("name")


def tag_counts(catalogs: DataFrame, records: DataFrame) -> DataFrame:
    """Tagged files per catalog, 0 where there are none."""
    n = records.groupBy("catalog").agg(F.count("*").alias("n"))
    return catalogs.join(n, "catalog", "left").select("catalog", F.coalesce("n", F.lit(0)).alias("n_tagged"))


def first_match(files: DataFrame) -> DataFrame:
    """The first file of each name, by path."""
    w = Window.partitionBy("name").orderBy("path")
    return files.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def unseen(catalogs: DataFrame, processed: DataFrame) -> DataFrame:
    """Catalogs that this session has not preloaded yet, once each."""
    return catalogs.select("catalog").distinct().join(processed, "catalog", "left_anti")


def with_catalog(catalogs: DataFrame, name: str, url: str) -> DataFrame:
    """The source list with one more folder; a folder that is there already is not added again."""
    new = catalogs.sparkSession.createDataFrame([(name, url)], "name string, url string")
    return catalogs.select("name", "url").unionByName(new.join(catalogs, "url", "left_anti").select("name", "url"))
