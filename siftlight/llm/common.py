"""What the training-data operators share: the durable scratch folder and written intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only on one machine without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="spark-siftlight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/siftlight/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siftlight_path = path
    return out


def written_by(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As ``written``, in ``n`` hash buckets of ``key``: joins on the key with as many partitions don't shuffle it.

    The catalog forgets the table at once; its files and the plan that reads them stay.
    """
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.option("compression", "zstd").option("path", scratch_path(df.sparkSession, name)).bucketBy(n, key).saveAsTable(table)
    out = df.sparkSession.table(table)
    out.schema  # resolved before the name goes
    df.sparkSession.sql(f"DROP TABLE {table}")
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_siftlight_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a record batch handed to Python: a batch is in memory several times.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def bounded_batches(spark: SparkSession):
    """Bound record batches by bytes while something is written; the session is left as it was found."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
