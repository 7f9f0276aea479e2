"""Process output and copy progress as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.copyplan import without_directories


def output_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of output files as they appear; the process itself runs elsewhere. Directory lines are left out."""
    lines = spark.readStream.format("text").load(folder).select(F.col("value").alias("record"), F.input_file_name().alias("output"))
    return without_directories(lines)


def summary(lines: DataFrame) -> DataFrame:
    """Lines so far per output, for an update-mode stream."""
    return lines.groupBy("output").agg(F.count("*").alias("n_lines"))


def completion(lines: DataFrame, key: str = "output") -> DataFrame:
    """What is handed on when an output is complete (key, line_no, record): its lines and how many they are."""
    total = lines.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n_lines"))
    return lines.join(total, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def on_completion(batch_summary):
    """A ``foreachBatch`` function that hands each batch's summary rows to ``batch_summary(df, epoch)``."""
    return lambda df, epoch: batch_summary(df.groupBy().agg(F.count("*").alias("n_lines")), epoch)


def refreshed(stream: DataFrame, seconds: int, mode: str = "complete"):
    """A writer that shows the stream's state anew every so many seconds."""
    return stream.writeStream.outputMode(mode).trigger(processingTime=f"{seconds} seconds")


def replacing(spark: SparkSession, name: str, writer):
    """Start ``writer`` under a name; a running query of that name is stopped first."""
    for q in spark.streams.active:
        if q.name == name:
            q.stop()
    return writer.queryName(name).start()
