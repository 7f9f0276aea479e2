"""Image analytics over decoded pixels and preview candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256
MAX_WIDTH = 4320
#: Rows of an image that meet its size together.
BAND = 64


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b).cast("int")


def histogram(pixels: DataFrame, key: str = "image") -> DataFrame:
    """All 256 bins of every image, empty ones as 0. Counting combines on the map side."""
    counted = pixels.groupBy(key, luminance(F.col("r"), F.col("g"), F.col("b")).alias("bin")).agg(F.count("*").alias("n"))
    frame = pixels.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    return frame.join(counted, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def normalised(bins: DataFrame, key: str = "image") -> DataFrame:
    """Bins over the largest bin; 0 for an image without pixels."""
    most = bins.groupBy(key).agg(F.max("n").alias("most"))
    return bins.join(most, key).select(key, "bin", F.coalesce(F.col("n") / F.nullif(F.col("most"), F.lit(0)), F.lit(0.0)).alias("norm"))


def is_jpeg(jfif: Column, compression: Column) -> Column:
    return F.coalesce(jfif, F.lit(False)) | F.coalesce(compression == 6, F.lit(False))


def width(pixel: Column, tiff: Column, exif: Column) -> Column:
    """The first width known, truncated."""
    return F.coalesce(pixel, tiff, exif).cast("bigint")


def largest_preview(candidates: DataFrame, key: str = "file") -> DataFrame:
    """The widest JPEG of each file (idx, width, jpeg); the lowest index wins ties; a width must be above 0;
    files without one are absent."""
    c = candidates.filter("jpeg and width > 0").groupBy(key).agg(F.max(F.struct("width", (-F.col("idx")).alias("minus"))).alias("m"))
    return c.select(key, (-F.col("m.minus")).alias("idx"), F.col("m.width").alias("width"))


def needs_downsampling(w: Column, full_size: bool = False) -> Column:
    return w > (2 * MAX_WIDTH if full_size else MAX_WIDTH)


def thumbnail(pixels: DataFrame, max_dimension: int, key: str = "image") -> DataFrame:
    """Decoded pixels (x, y, r, g, b) averaged into a grid whose longer side is at most ``max_dimension``.

    Smaller images keep their size. Pixels of one place are added up before they meet the size of their image, and meet it
    by bands of rows, so an image spans any number of partitions and no task reads more than a band.
    """
    places = pixels.groupBy(key, "x", "y").agg(*[F.sum(c).alias(c) for c in "rgb"], F.count("*").alias("n"))
    band = lambda y: F.floor(y / BAND)
    size = pixels.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    size = size.select(key, "w", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), band(F.coalesce("h", F.lit(0)))))).alias("band"))
    side = F.greatest("w", "h")
    cell = lambda v: F.when(side > max_dimension, F.floor(F.col(v) * max_dimension / side)).otherwise(F.col(v)).cast("int")
    placed = places.withColumn("band", F.greatest(F.lit(0), F.coalesce(band(F.col("y")), F.lit(0)))).join(size, [key, "band"])
    placed = placed.select(key, cell("x").alias("x"), cell("y").alias("y"), "r", "g", "b", "n")
    return placed.groupBy(key, "x", "y").agg(*[F.floor(F.sum(c) / F.sum("n")).cast("int").alias(c) for c in "rgb"])
