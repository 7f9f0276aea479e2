"""The tag store on disk as snapshot and log: reading folds the newest snapshot and the log behind it, not all history.

A stream appends operations to ``log``, in folders of ``SPAN`` sequence numbers, so that a reader opens the folders
behind the snapshot only. ``compact`` folds snapshot and log up to a sequence number into the next snapshot. A snapshot
counts once its writer has committed it (``_SUCCESS``); one that was interrupted is never read, and older ones stay
readable for who still reads them, until ``vacuum``.

Compact up to a number that no operation will fall short of any more: one that arrives later with a smaller seq is not
seen. Operations may otherwise arrive in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import tagging
from ..sources import store
from .tags import tag_changes

OPS = "catalog string, name string, op string, rating int, seq long, span long"
SPAN = 10_000


class TagLog:
    def __init__(self, spark: SparkSession, path: str, span: int = SPAN):
        self.spark, self.path, self.span = spark, path.rstrip("/"), span

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _spanned(self, ops: DataFrame) -> DataFrame:
        return tag_changes(ops).withColumn("seq", F.col("seq").cast("long")).withColumn("span", F.floor(F.col("seq") / self.span).cast("long"))

    def append(self, ops: DataFrame) -> None:
        self._spanned(ops).write.mode("append").partitionBy("span").parquet(f"{self.path}/log")

    def appending(self, ops: DataFrame):
        """A writer for a stream of operations; each of its batches is in the log once."""
        return self._spanned(ops).writeStream.format("parquet").partitionBy("span").option("path", f"{self.path}/log").option("checkpointLocation", f"{self.path}/state").outputMode("append")

    def snapshots(self) -> list[int]:
        """The sequence numbers up to which there are whole snapshots, ascending."""
        fs, at = self._fs()
        if not fs.exists(at(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at(self.path))]
        found = [int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-")]
        return sorted(n for n in found if fs.exists(at(f"{self.path}/snapshot-{n}/_SUCCESS")))

    def _snapshot(self) -> tuple[int, DataFrame | None]:
        upto = max(self.snapshots(), default=-1)
        return upto, store.read_store(self.spark, f"{self.path}/snapshot-{upto}") if upto >= 0 else None

    def tail(self, after: int, upto: int | None = None) -> DataFrame:
        """Operations behind a snapshot: only the folders that may hold them are listed in the plan."""
        fs, at = self._fs()
        log = self.spark.read.schema(OPS).parquet(f"{self.path}/log") if fs.exists(at(f"{self.path}/log")) else self.spark.createDataFrame([], OPS)
        t = log.filter((F.col("seq") > after) & (F.col("span") >= (after + 1) // self.span))
        if upto is not None:
            t = t.filter((F.col("seq") <= upto) & (F.col("span") <= upto // self.span))
        return t.drop("span")

    def read(self, upto: int | None = None) -> DataFrame:
        """The nested store: snapshot and tail, with date texts from sequence numbers in microseconds."""
        at, snapshot = self._snapshot()
        ops = self.tail(at, upto)
        text = lambda c: dates.store_text(F.timestamp_micros(c))
        if snapshot is None:
            r, e = tagging.records(ops), tagging.entries(ops).withColumn("was", F.lit(None).cast("string"))
        else:
            r = tagging.records(ops, store=store.flat_records(snapshot))
            known = store.entries(snapshot)
            e = tagging.entries(ops, known).join(known.select(F.col("catalog").alias("of"), F.col("dateStart").alias("was")), F.col("catalog").eqNullSafe(F.col("of")), "left").drop("of")
        r = r.withColumn("dateTagged", F.coalesce("dateTagged", text("tagged_seq")))
        started = F.when(F.col("started_seq").isNotNull(), text("started_seq")).otherwise(F.col("was"))
        return store.nested(r, e.select("catalog", started.alias("dateStart"), "has_records"))

    def compact(self, upto: int) -> None:
        """A snapshot of everything up to and including ``upto``; an interrupted one of that number is replaced."""
        if upto > max(self.snapshots(), default=-1):
            store.write_store(self.read(upto), f"{self.path}/snapshot-{upto}")

    def vacuum(self) -> None:
        """Delete snapshots before the newest, and the folders of the log that it covers whole."""
        fs, at = self._fs()
        *old, newest = self.snapshots() or [None]
        for n in old:
            fs.delete(at(f"{self.path}/snapshot-{n}"), True)
        if newest is not None and fs.exists(at(f"{self.path}/log")):
            for f in fs.listStatus(at(f"{self.path}/log")):
                name = f.getPath().getName()
                if name.startswith("span=") and (int(name[5:]) + 1) * self.span <= newest + 1:
                    fs.delete(f.getPath(), True)
