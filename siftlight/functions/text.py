"""Scalar texts: capture settings, sizes, durations, paths. Clock and settings are arguments, never read from the host."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GIB, MIB, KIB = 1024**3, 1024**2, 1024
#: Whole numbers beyond 64 bits.
WIDE = "decimal(38,0)"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def is_raw(name: Column) -> Column:
    return extension(name) == "arw"


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def parent_directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]+$", "")


def with_extension(path: Column, ext: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", f".{ext}")


def cache_key(path: Column) -> Column:
    return F.concat(F.md5(path), F.lit(".jpg"))


@F.pandas_udf(StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """C's "%.1f", which rounds exact ties to even; Spark's format_string rounds them up."""
    return pd.Series([None if pd.isna(v) else "%.1f" % v for v in x], dtype=object)  # object: also where all are null


def whole(x: Column) -> Column:
    return F.rint(x).cast("bigint").cast("string")


def shutter_text(seconds: Column) -> Column:
    """One second and longer in seconds, shorter as a fraction; zero is an infinite fraction."""
    return (F.when(seconds >= 1, F.concat(one_decimal(seconds), F.lit('"')))
            .when(seconds == 0, F.lit("1/inf"))
            .when(seconds.isNotNull(), F.concat(F.lit("1/"), whole(1 / F.nullif(seconds, F.lit(0.0))))))


def focal_text(mm: Column) -> Column:
    return F.concat(one_decimal(mm), F.lit("mm"))


def aperture_text(f: Column) -> Column:
    return F.concat(F.lit("ƒ/"), one_decimal(f))


def iso_text(iso: Column) -> Column:
    return F.concat(F.lit("ISO "), whole(iso))


def bytes_unit(n: Column) -> Column:
    return F.when(n < KIB, "B").when(n < MIB, "KB").when(n < GIB, "MB").otherwise("GB")


def _wide(n: int) -> Column:
    return F.lit(str(n)).cast(WIDE)


def _tenths(n: Column, bits: int) -> Column:
    """n / 2^bits with one decimal, an exact tie to the even digit, in decimal arithmetic."""
    ten, unit = n.cast(WIDE) * 10, _wide(1 << bits)
    floor, rest = F.call_function("div", ten, unit), ten % unit * 2
    tenths = floor + ((rest > unit) | ((rest == unit) & (floor % 2 == 1))).cast("bigint")
    return F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def bytes_human(n: Column) -> Column:
    """Size over the largest power of 1024 that it reaches, with one decimal; "0 B" for nothing. Labels end at GB.

    Sizes here and below are whole numbers, 64 bits or decimals below 2^93.
    """
    out = F.when(n == 0, "0 B")
    for k, label in reversed(list(enumerate(["B", "KB", "MB", *["GB"] * 7]))):
        out = out.when(n >= _wide(1 << 10 * k), F.concat(_tenths(n, 10 * k), F.lit(f" {label}")))
    return out


def file_size_text(n: Column) -> Column:
    """Decimal units (our own rule; the system formatter is not defined by the source of this engine's semantics)."""
    x = n.cast("double")
    return (F.when(n >= 10**9, F.concat(one_decimal(x / 10**9), F.lit(" GB")))
            .when(n >= 10**6, F.concat(one_decimal(x / 10**6), F.lit(" MB")))
            .when(n >= 1000, F.concat(whole(x / 1000), F.lit(" KB")))
            .otherwise(F.concat(n.cast("string"), F.lit(" bytes"))))


def memory_text(n: Column) -> Column:
    x = n.cast("double")
    return F.when(n >= GIB, F.concat(whole(x / GIB), F.lit(" GB"))).otherwise(F.concat(whole(x / MIB), F.lit(" MB")))


def gib_text(n: Column) -> Column:
    """Whole GiB, by exact division: a double would round sizes beyond 2^53 up."""
    return F.concat(F.call_function("div", n.cast(WIDE), _wide(GIB)).cast("string"), F.lit(" GB"))


def duration_text(seconds: Column) -> Column:
    return (F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
            .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))))


def zoom_percent(level: Column, step: int = 0) -> Column:
    """The zoom after ``step`` steps of 0.2, held between 0.5 and 4, as a percentage."""
    return F.concat(whole(F.greatest(F.lit(0.5), F.least(F.lit(4.0), level + 0.2 * step)) * 100), F.lit("%"))


def stars(rating: Column) -> Column:
    r = F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(rating, F.lit(0))))
    return F.concat(F.repeat(F.lit("★"), r), F.repeat(F.lit("☆"), 5 - r))


def interpolation_quality(level: Column) -> Column:
    return F.when(level.isin(1, 2), "low").when(level.isin(3, 4), "medium").otherwise("high")


def image_capacity(megabytes: Column, size: Column, bytes_per_pixel: Column) -> Column:
    """Images of this size that fit; 0 if nothing can be computed."""
    each = size.cast("bigint") * size * bytes_per_pixel
    return F.when((each > 0) & (megabytes > 0), F.greatest(F.lit(1).cast("bigint"), F.floor(megabytes.cast("bigint") * MIB / F.nullif(each, F.lit(0))).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def size_kilobytes(size: Column, bytes_per_pixel: Column) -> Column:
    return F.floor(size.cast("bigint") * size * bytes_per_pixel / KIB).cast("bigint")
