"""The persisted tag store and settings as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "catalog string, dateStart string, filerecords array<struct<fileName: string, dateTagged: string, dateCopied: string, rating: int>>"
#: The settings and what they are when absent.
DEFAULTS = {"memoryCacheSizeMB": 5000, "thumbnailSizeGrid": 100, "thumbnailSizePreview": 1024, "thumbnailSizeFullSize": 8700, "thumbnailCostPerPixel": 4, "thumbnailSizeGridView": 100}
SETTINGS = ", ".join(f"{k} int" for k in DEFAULTS) + ", useThumbnailAsZoomPreview boolean"


def slash(path):
    """Catalogs in one form, with a trailing slash."""
    return F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))


def read_store(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """The nested store: an object per line as ``write_store`` leaves it, or one JSON array in a file (``array``)."""
    return spark.read.schema(STORE).option("multiLine", array).json(path)


def flat_records(store: DataFrame) -> DataFrame:
    """(catalog, name, dateTagged, dateCopied, rating, position); catalogs without records give no rows: see ``entries``."""
    r = store.select("catalog", F.posexplode("filerecords").alias("position", "r"))
    return r.select("catalog", F.col("r.fileName").alias("name"), *[F.col(f"r.{c}").alias(c) for c in ("dateTagged", "dateCopied", "rating")], F.col("position").cast("long").alias("position"))


def entries(store: DataFrame) -> DataFrame:
    """(catalog, dateStart, has_records): every catalog of the store; a reset one has null records."""
    return store.select("catalog", "dateStart", F.col("filerecords").isNotNull().alias("has_records"))


def nested(records: DataFrame, catalogs: DataFrame) -> DataFrame:
    """A store from flat records and the entries (catalog, dateStart, has_records): records in order of name, an empty
    list where all are gone, null where the catalog was reset."""
    entry = F.struct(F.col("name").alias("fileName"), "dateTagged", "dateCopied", F.col("rating").cast("int").alias("rating"))
    held = records.groupBy(F.col("catalog").alias("of")).agg(F.sort_array(F.collect_list(entry)).alias("held"))
    empty = F.array().cast("array<struct<fileName: string, dateTagged: string, dateCopied: string, rating: int>>")
    joined = catalogs.join(held, F.col("catalog").eqNullSafe(F.col("of")), "left")
    return joined.select("catalog", "dateStart", F.when(F.col("has_records"), F.coalesce("held", empty)).alias("filerecords"))


def write_store(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").json(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row of settings, absent ones at their defaults."""
    s = spark.read.schema(SETTINGS).option("multiLine", True).json(path)
    return s.select(*[F.coalesce(k, F.lit(v)).alias(k) for k, v in DEFAULTS.items()], F.coalesce("useThumbnailAsZoomPreview", F.lit(False)).alias("useThumbnailAsZoomPreview"))


def write_settings(settings: DataFrame, path: str) -> None:
    """Keys in sorted order; the writer's commit replaces the old file only when the new one is whole."""
    settings.select(*sorted(settings.columns)).coalesce(1).write.mode("overwrite").json(path)
