"""What happens when a copy ends: its lines are kept as they come, and its summary is made once they are all there.

Each micro-batch writes a folder of its own, replaced if the batch is repeated, so lines and summaries are there once
whatever fails in between. A summary is made in the batch that brings an output's end, from all batches up to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import copyplan

LINES = "output string, line_no long, record string, done boolean, batch long"


class Completions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batch(self, df: DataFrame, epoch: int) -> None:
        """For ``foreachBatch`` on (output, line_no, record, done)."""
        df.write.mode("overwrite").parquet(f"{self.path}/lines/batch={epoch}")
        ended = self._lines().filter(F.col("done") & (F.col("batch") == epoch)).select("output")
        lines = self._lines().filter((F.col("batch") <= epoch) & ~F.col("done")).join(F.broadcast(ended) if ended.count() <= 10_000 else ended, "output", "left_semi")
        copyplan.parsed_summary(lines, "output").write.mode("overwrite").parquet(f"{self.path}/summaries/batch={epoch}")

    def start(self, stream: DataFrame, **trigger):
        """Run the stream into this folder."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/state").trigger(**(trigger or {"availableNow": True})).start()

    def _lines(self) -> DataFrame:
        return self.spark.read.schema(LINES).parquet(f"{self.path}/lines")

    def lines(self) -> DataFrame:
        """(output, line_no, record) so far."""
        return self._lines().filter("NOT done").select("output", "line_no", "record")

    def summaries(self) -> DataFrame:
        """One row for each complete output (see ``copyplan.parsed_summary``)."""
        found = self.spark.read.schema(copyplan.SUMMARY).parquet(f"{self.path}/summaries")
        return found.select(*[f.split()[0] for f in copyplan.SUMMARY.split(", ")])
