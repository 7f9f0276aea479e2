"""JPEG images in tables: decoded to pixels, thumbnails and luminance counts in the tasks that hold them, and files of them.

``df.write.format("jpeg_files").mode("append").save(folder)`` writes (name, jpeg) in two phases: tasks write into a folder
of their own below a hidden one, and files appear under their names when all tasks have ended. A task that fails or is
repeated leaves nothing; an aborted job neither. A name that is there already is replaced.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import jpeg, text
from ..operators import images

#: Pixels of one record batch, and bytes of one that small images share.
BATCH, BATCH_BYTES = 1 << 16, 4 << 20
#: Quality of thumbnails in the disk cache, and of images beside their raw files.
CACHE_QUALITY, FULL_QUALITY = 0.7, 1.0


def _each(df: DataFrame, schema: str, fn: Callable[[str | None, np.ndarray | None], Iterator[list]]) -> DataFrame:
    """Columns (behind the key) that ``fn`` makes of each image, of small images together; df: key, jpeg."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], schema=arrow)

        for b in parts:
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                pixels = jpeg.decode(data.as_buffer().to_pybytes()) if data.is_valid else None
                for cols in fn(key, pixels):
                    held.append([pa.repeat(pa.scalar(key, pa.string()), len(cols[0])), *[pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True)]])
                    rows, size = rows + len(cols[0]), size + sum(c.nbytes for c in held[-1])
                    if rows >= BATCH or size >= BATCH_BYTES:
                        yield batch()
                        held, rows, size = [], 0, 0
        if held:
            yield batch()

    return df.mapInArrow(run, schema)


def pixels(df: DataFrame, key: str = "image", column: str = "jpeg", max_dimension: int | None = None) -> DataFrame:
    """(image, x, y, r, g, b) of every image that decodes; with ``max_dimension``, of its thumbnail."""

    def rows(_, p: np.ndarray | None) -> Iterator[list]:
        if p is None:
            return
        p = p if max_dimension is None else jpeg.shrunk(p, max_dimension)
        step = max(1, BATCH // p.shape[1])
        for lo in range(0, p.shape[0], step):
            part = p[lo:lo + step]
            y, x = np.indices(part.shape[:2], np.int32).reshape(2, -1)
            yield [x, y + np.int32(lo), *part.reshape(-1, 3).T.astype(np.int32)]

    return _each(df.select(F.col(key).cast("string").alias("image"), column), "image string, x int, y int, r int, g int, b int", rows)


def counts(df: DataFrame, key: str = "image", column: str = "jpeg") -> DataFrame:
    """(image, bin, n): the bins that an image has pixels in, and for one that doesn't decode bin 0 without any.

    An image travels as one row, to the rows that repeat its key, and is taken apart there.
    """

    def bins(_, p: np.ndarray | None) -> Iterator[list]:
        # Weighted in the order of ``images.luminance``, so that both truncate the same number.
        luma = np.zeros(0, np.int64) if p is None else (0.299 * p[..., 0] + 0.587 * p[..., 1] + 0.114 * p[..., 2]).astype(np.int64).ravel()
        n = np.bincount(luma, minlength=images.BINS)
        found = np.flatnonzero(n) if len(luma) else np.zeros(1, np.int64)
        yield [[found], [n[found]]]

    one = _each(df.select(F.col(key).cast("string").alias("image"), column), "image string, bins array<int>, ns array<long>", bins).repartition("image")
    return one.select("image", F.inline(F.arrays_zip(F.col("bins").alias("bin"), F.col("ns").alias("n")))).groupBy("image", "bin").agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, key: str = "image", column: str = "jpeg") -> DataFrame:
    """(image, bin, n): all 256 bins of every image, counted in its task; an image that doesn't decode has zeros."""
    of = counts(df, key, column).groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("of"))
    every = of.select("image", "of", F.explode(F.sequence(F.lit(0), F.lit(images.BINS - 1))).alias("bin"))
    return every.select("image", "bin", F.coalesce(F.try_element_at("of", "bin"), F.lit(0).cast("long")).alias("n"))


def thumbnails(df: DataFrame, max_dimension: int, quality: float = CACHE_QUALITY, key: str = "image", column: str = "jpeg") -> DataFrame:
    """(image, width, height, thumbnail): means of cells, encoded again; images that don't decode are absent."""

    def small(_, p: np.ndarray | None) -> Iterator[list]:
        if p is not None:
            p = jpeg.shrunk(p, max_dimension)
            yield [[p.shape[1]], [p.shape[0]], [jpeg.encode(p, quality)]]

    return _each(df.select(F.col(key).cast("string").alias("image"), column), "image string, width int, height int, thumbnail binary", small)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    n: int


class JpegWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:").rstrip("/")
        self.staging = f"{self.folder}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        folder, n = f"{self.staging}/{uuid.uuid4().hex}", 0
        os.makedirs(folder)
        for row in iterator:
            if row["jpeg"] is None or not row["name"] or "/" in row["name"]:
                raise ValueError(f"no file can be written for {row['name']!r}")
            with open(f"{folder}/{row['name']}", "wb") as f:
                f.write(row["jpeg"])
            n += 1
        return Staged(folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        for m in messages:
            for name in os.listdir(m.folder) if m else []:
                os.replace(f"{m.folder}/{name}", f"{self.folder}/{name}")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class JpegFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jpeg_files"

    def schema(self) -> str:
        return "name string, jpeg binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return JpegWriter(self.options)


def _write(df: DataFrame, folder: str) -> None:
    df.sparkSession.dataSource.register(JpegFiles)
    df.write.format("jpeg_files").mode("append").save(folder)


def write_cache(thumbs: DataFrame, folder: str, path: str = "path", column: str = "thumbnail") -> None:
    """Thumbnails into the disk cache, under the digest of their file's path; rows that repeat a path are one file."""
    one = thumbs.groupBy(path).agg(F.first(column).alias("jpeg"))
    _write(one.select(text.cache_key(F.col(path)).alias("name"), "jpeg"), folder)


def write_beside(previews: DataFrame, path: str = "path", column: str = "jpeg") -> None:
    """Decoded previews as JPEG of full quality beside their raw files, a folder after the other (folders are few)."""
    p = previews.select(text.parent_directory(F.col(path)).alias("folder"), F.element_at(F.split(text.with_extension(F.col(path), "jpg"), "/"), -1).alias("name"), F.col(path).alias("image"), F.col(column).alias("jpeg"))
    full = thumbnails(p, 1 << 30, FULL_QUALITY)
    beside = p.drop("jpeg").join(full, "image").select("folder", "name", F.col("thumbnail").alias("jpeg"))
    for r in p.select("folder").distinct().toLocalIterator():
        _write(beside.filter(F.col("folder") == r.folder).select("name", "jpeg"), r.folder)

