"""Catalog scan as a Python data source: Spark's file sources skip names that begin with an underscore, cameras use them.

``spark.read.format("catalog").option("recursive", ...)`` reads folders where they are mounted, in ``tasks`` partitions or
one for each folder. A folder that is dealt to several is listed by each, which is cheap, while each looks at its share
of the files only, which is not; so a large folder is read by many tasks and no list of files passes through the driver. ``metadata`` adds the capture metadata
of each file in the same pass. Comparisons with constants on names, paths, catalogs, sizes and times are pushed into the
scan where the session has ``spark.sql.python.filterPushdown.enabled`` when it is made and run; those on names come before a file is touched.

Missing folders give no rows. A file that goes while it is read gives none, except in ``discover``, which asks for names.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from . import tiff

SCHEMA = "file_key string, path string, catalog string, name string, size long, type string, modified timestamp"
#: The type text of raw files, and the extension a scan accepts.
RAW_TYPE, RAW_EXTENSION = "Sony ARW raw image", ".arw"
COLUMNS = [("file_key", pa.string()), ("path", pa.string()), ("catalog", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("type", pa.string()), ("modified", pa.timestamp("us", "UTC"))]
TASKS, BATCH = 32, 1024
#: Names of cached thumbnails, and bytes of them in a record batch.
CACHED, BATCH_BYTES = ".jpg", 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, EqualNullSafe: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x,
    StringContains: lambda v, x: x in v, StringEndsWith: lambda v, x: v.endswith(x), StringStartsWith: lambda v, x: v.startswith(x),
}
#: What is known from the list of names, and what only from the file.
BY_NAME, BY_FILE = ("name", "path", "catalog"), ("size", "modified")


def _as_utc(v):
    return v.replace(tzinfo=timezone.utc) if isinstance(v, datetime) and v.tzinfo is None else v


def _test(f: Filter) -> tuple[str, bool, type, object] | None:
    """(column, negated, kind, value) of a filter that the scan can apply."""
    if isinstance(f, Not):
        inner = _test(f.child)
        return (inner[0], not inner[1], *inner[2:]) if inner and not inner[1] and inner[2] is not IsNotNull else None
    if type(f) in _TESTS or isinstance(f, IsNotNull):
        column, = f.attribute if len(f.attribute) == 1 else (None,)
        value = None if isinstance(f, IsNotNull) else tuple(map(_as_utc, f.value)) if isinstance(f, In) else _as_utc(f.value)
        if column in BY_NAME + BY_FILE and (isinstance(f, IsNotNull) or value is not None and not (isinstance(value, tuple) and None in value)):
            return column, False, type(f), value
    return None


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return f"{SCHEMA}, {tiff.METADATA}" if _flag(self.options, "metadata", "false") else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if _flag(self.options, "push", "false") else CatalogReader)(self.options)


def _flag(options, key: str, default: str) -> bool:
    return str(options.get(key, default)).lower() == "true"


class Share(InputPartition):
    """The part of a folder's files whose path hashes to ``at``."""

    def __init__(self, folder: str, at: int):
        super().__init__(folder)
        self.folder, self.at = folder, at


class CatalogReader(DataSourceReader):
    """Options: path (folders joined by ``os.pathsep``), recursive, include_hidden, regular_only, metadata, tasks."""

    def __init__(self, options):
        self.folders = [p for p in options.get("path", "").split(os.pathsep) if p]
        self.recursive, self.hidden = _flag(options, "recursive", "false"), _flag(options, "include_hidden", "false")
        self.regular, self.metadata = _flag(options, "regular_only", "true"), _flag(options, "metadata", "false")
        self.splits = -(-max(1, int(options.get("tasks", TASKS))) // max(1, len(self.folders)))
        self.tests: list[tuple[str, bool, type, object]] = []

    def partitions(self) -> list[InputPartition]:
        return [Share(f, k) for f in self.folders for k in range(self.splits)] or [Share("", 0)]

    def _passes(self, columns: tuple[str, ...], values: tuple) -> bool:
        at = dict(zip(columns, values, strict=True))
        for column, negated, kind, value in self.tests:
            if column in at:
                v = at[column]
                if v is None or kind is not IsNotNull and _TESTS[kind](v, value) == negated:
                    return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(COLUMNS + tiff.METADATA_ARROW * self.metadata)
        held: list[tuple] = []
        for row in self._rows(partition):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def _rows(self, partition: InputPartition) -> Iterator[tuple]:
        todo = [partition.folder] if partition.folder else []
        while todo:
            folder = todo.pop()
            catalog = folder.rstrip("/") + "/"
            try:
                found = os.scandir(folder)
            except OSError:
                continue
            with found:
                for e in found:
                    if e.name.startswith(".") and not self.hidden:
                        continue
                    if self.recursive and e.is_dir(follow_symlinks=False):
                        todo.append(e.path)
                    if not e.name.lower().endswith(RAW_EXTENSION) or zlib.crc32(os.fsencode(e.path)) % self.splits != partition.at:
                        continue
                    if not self._passes(BY_NAME, (e.name, e.path, catalog)) or (self.regular and not e.is_file()):
                        continue
                    try:
                        s = e.stat()
                        known = (s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc))
                    except OSError:  # a link to nowhere has a name but no size or time
                        if self.regular:
                            continue
                        known = (None, None)
                    if self._passes(BY_FILE, known):
                        described = tiff.read(e.path) if self.metadata else {}
                        more = tuple(described[c] for c in tiff.METADATA_COLUMNS if self.metadata)
                        yield (hashlib.md5(os.fsencode(e.path)).hexdigest(), e.path, catalog, e.name, known[0], RAW_TYPE, known[1], *more)


class PushingReader(CatalogReader):
    """Spark asks for a reader of this kind only where push-down is enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = _test(f)
            if known:
                self.tests.append(known)
            else:
                yield f


def _reader(spark: SparkSession, tasks: int):
    spark.dataSource.register(CatalogSource)
    return spark.read.format("catalog").option("tasks", tasks).option("push", spark.conf.get(PUSHDOWN))


def scan(spark: SparkSession, *folders: str, tasks: int = TASKS) -> DataFrame:
    """Raw files directly in the folders, hidden ones left out."""
    return _reader(spark, tasks).load(os.pathsep.join(folders))


def scan_with_metadata(spark: SparkSession, *folders: str, tasks: int = TASKS) -> DataFrame:
    """As ``scan``, with ``exif``: the formatted capture settings of each file, null where it has none."""
    raw = _reader(spark, tasks).option("metadata", True).load(os.pathsep.join(folders))
    return raw.select(*[f.split()[0] for f in SCHEMA.split(", ")], tiff.exif_text().alias("exif"), "previews")


def discover(spark: SparkSession, *folders: str, recursive: bool = True) -> DataFrame:
    """Paths of raw names, hidden ones and folders included."""
    reader = _reader(spark, TASKS).option("recursive", recursive).option("include_hidden", True).option("regular_only", False)
    return reader.load(os.pathsep.join(folders)).select("path")


class CacheSource(DataSource):
    """Thumbnails of the disk cache, a folder dealt to tasks as the catalog deals its own: no task and not the driver lists it for all."""

    @classmethod
    def name(cls) -> str:
        return "disk_cache"

    def schema(self) -> str:
        return "file_key string, length long, modified timestamp" + ", content binary" * _flag(self.options, "content", "true")

    def reader(self, schema) -> DataSourceReader:
        return CacheReader(self.options)


class CacheReader(DataSourceReader):
    """Options: path, content, tasks."""

    def __init__(self, options):
        self.folder, self.content, self.tasks = options["path"].removeprefix("file://").removeprefix("file:").rstrip("/"), _flag(options, "content", "true"), max(1, int(options.get("tasks", TASKS)))

    def partitions(self) -> list[InputPartition]:
        return [Share(self.folder, k) for k in range(self.tasks)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_key", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary())][:3 + self.content])
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        try:
            found = os.scandir(self.folder)
        except OSError:
            return
        with found:
            for e in found:
                if not e.name.endswith(CACHED) or e.name[0] in "._" or zlib.crc32(os.fsencode(e.name)) % self.tasks != partition.at:
                    continue
                try:
                    if not e.is_file():
                        continue
                    s, data = e.stat(), None
                    if self.content:
                        with open(e.path, "rb") as f:
                            data = f.read()
                except OSError:  # evicted meanwhile
                    continue
                held.append((e.name.removesuffix(CACHED), s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc), data)[:3 + self.content])
                size += len(data or b"")
                if len(held) == BATCH or size >= BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


def disk_cache(spark: SparkSession, folder: str, content: bool = True, tasks: int = TASKS) -> DataFrame:
    """Cached thumbnails: key, size and time, and unless declined their bytes."""
    spark.dataSource.register(CacheSource)
    return spark.read.format("disk_cache").option("content", content).option("tasks", tasks).load(folder)
