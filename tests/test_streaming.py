"""Streams on small folders."""

from pyspark.sql import functions as F

from siftlight.operators import selection, tagging
from siftlight.streaming import output, tags
from test_review import log


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_tag_stream_equals_batch_over_several_batches(spark, tmp_path):
    ops = [(s, c, n, o, r) for s, c, n, o, r in log(200, 9) if o != "reset_all"]
    schema = "seq long, catalog string, name string, op string, rating int"
    for k in range(0, len(ops), 50):
        spark.createDataFrame(ops[k:k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    run(tags.tag_changes(source), "changes", "append")
    batch = tagging.fold(spark.createDataFrame(ops, schema))
    assert sorted(tags.store_of(spark.table("changes")).collect()) == sorted(batch.collect())


def test_tag_stream_hands_no_catalog_to_one_task(spark, tmp_path):
    """A hot catalog, resets of all catalogs and operations that arrive late; nothing is grouped while streaming."""
    ops = [(s, "hot" if s % 3 else c, n, o, r) for s, c, n, o, r in log(400, 12)]
    ops = [(s, None if o == "reset_all" else c, n, o, r) for s, c, n, o, r in ops]
    schema = "seq long, catalog string, name string, op string, rating int"
    for k in (300, 100, 200, 0):
        spark.createDataFrame(ops[k:k + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    q = run(tags.tag_changes(source), "late", "append")
    assert "FlatMapGroups" not in q._jsq.explainInternal(False) and not q.lastProgress["stateOperators"]
    batch = tagging.fold(spark.createDataFrame(ops, schema))
    assert sorted(tags.store_of(spark.table("late")).collect()) == sorted(batch.collect())


def test_counters_and_progress(spark, tmp_path):
    spark.createDataFrame([("ram", "r", 4), ("ram", "r", 4), ("disk", "r", 4)], "tier string, run string, total int").write.parquet(str(tmp_path / "q"))
    source = lambda: spark.readStream.schema("tier string, run string, total int").parquet(str(tmp_path / "q"))
    run(tags.cache_counters(source()), "counters", "complete")
    assert {r.tier: r.n for r in spark.table("counters").collect()} == {"ram": 2, "disk": 1}
    run(tags.progress(source()), "progress", "complete")
    assert spark.table("progress").first().fraction == 0.75


def test_output_lines(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.txt").write_text("x\ndir/\n\ny\n")
    run(output.summary(output.output_lines(spark, str(tmp_path / "o"))), "lines", "complete")
    assert spark.table("lines").first().n_lines == 3
    seen = []
    q = output.output_lines(spark, str(tmp_path / "o")).writeStream.foreachBatch(output.on_completion(lambda df, epoch: seen.append(df.first().n_lines))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [3]


def test_refresh_and_replacement(spark, tmp_path):
    spark.createDataFrame([("ram",)], "tier string").write.parquet(str(tmp_path / "q"))
    source = spark.readStream.schema("tier string").parquet(str(tmp_path / "q"))
    first = output.replacing(spark, "shown", output.refreshed(tags.cache_counters(source), 1).format("memory"))
    first.processAllAvailable()
    second = output.replacing(spark, "shown", output.refreshed(tags.cache_counters(source), 1).format("memory"))
    second.processAllAvailable()
    assert not first.isActive and second.isActive and spark.table("shown").first().n == 1
    second.stop()


def test_catalog_list(spark):
    c = spark.createDataFrame([("a", "/a/")], "name string, url string")
    more = selection.with_catalog(selection.with_catalog(c, "b", "/b/"), "again", "/a/")
    assert sorted(r.name for r in more.collect()) == ["a", "b"]
    assert more.filter(F.col("url").isNull()).count() == 0
