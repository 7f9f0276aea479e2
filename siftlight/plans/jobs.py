"""Queries that write, read back or stream; they work in the session's shared scratch folder."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, jpeg
from ..operators import cache, copyplan, selection, tagging
from ..sources import catalog, jpegs, processout, rawfiles, store, tiff
from ..streaming import completion, eta, output, taglog, tags, tagstate
from . import standins as s
from .review import ORACLE as _REVIEW_SQL
from .scratch import scratch


#: Many small catalogs with frequent resets, so that some end without records.
RESET_OPS = s.TAG_OPS.replace("user_id % 5", "user_id % 400").replace("event_id % 200 = 0", "event_id % 2 = 0")


def _reset_ops(spark: SparkSession, d: str) -> DataFrame:
    e = s.table(spark, d, "events")
    op = (F.when(F.col("event_type").isin("view", "click"), "toggle").when(F.col("event_type") == "purchase", "rate")
          .when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "reset"))
    return e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), (F.col("user_id") % 400).cast("string").alias("catalog"), F.col("user_id").cast("string").alias("name"),
                    op.alias("op"), F.when(op == "rate", 1 + F.col("event_id") % 5).cast("int").alias("rating")).filter("op is not null")


def _stored(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and entries of the store after ``ops`` (seq in microseconds), with their date texts."""
    at = lambda c: dates.store_text(F.timestamp_micros(c))
    r = tagging.records(ops).withColumn("dateTagged", F.coalesce("dateTagged", at("tagged_seq")))
    return r, tagging.entries(ops).select("catalog", at("started_seq").alias("dateStart"), "has_records")


def tag_store_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written and read back: a row per record, and one for a catalog that has none."""
    path = scratch(spark)
    store.write_store(store.nested(*_stored(_reset_ops(spark, d))), path)
    back = store.read_store(spark, path)
    r = store.flat_records(back).select(F.col("catalog").alias("of"), "name", "dateTagged", "dateCopied", "rating")
    return store.entries(back).join(r, F.col("catalog") == F.col("of"), "left").drop("of")


def settings_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Settings written and read back; what was not set comes at its default."""
    path = scratch(spark)
    n = s.table(spark, d, "region").agg((F.count("*") * 100).cast("int").alias("memoryCacheSizeMB"), F.lit(256).alias("thumbnailSizeGrid"))
    store.write_settings(n, path)
    return store.read_settings(spark, path)


def catalog_list(spark: SparkSession, d: str) -> DataFrame:
    """The catalogs of all files, one of them added again."""
    c = s.files(spark, d).select(F.col("catalog").alias("name"), F.concat(F.lit("/photos/"), "catalog", F.lit("/")).alias("url")).distinct()
    return selection.with_catalog(c, "again", "/photos/src1/")


def _streamed(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{path}/in")


def _kept(stream: DataFrame, path: str) -> DataFrame:
    """Everything an append stream gives, written and read back."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def copy_completion(spark: SparkSession, d: str) -> DataFrame:
    """Process output as a stream without directory lines; at its end, every line with the number of lines."""
    path = scratch(spark)
    lines = _streamed(spark, s.lines(spark, d), path)
    return output.completion(_kept(copyplan.without_directories(lines), path))


def progress_stream(spark: SparkSession, d: str) -> DataFrame:
    """Completed items of each run as they stand at the end of the stream."""
    path = scratch(spark)
    done = _streamed(spark, s.completions(spark, d).select("run", "total"), path)
    return tags.progress(_kept(done, path))


def include_list(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    names = selection.rated_names(s.files(spark, d), s.records(spark, d), 3).select("name").distinct()
    copyplan.write_include_list(names, path)
    return spark.read.text(path).select(F.col("value").alias("name"))


def tag_store_stream(spark: SparkSession, d: str) -> DataFrame:
    """The operation log as a stream of files; the store it leaves."""
    path = scratch(spark)
    ops = s.tag_ops(spark, d)
    ops.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{path}/ops")
    source = spark.readStream.schema(ops.schema).parquet(f"{path}/ops")
    q = tags.tag_changes(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/changes")
    q.awaitTermination()
    return tags.store_of(spark.read.parquet(f"{path}/changes"))


def sort_by_size_desc_all(spark: SparkSession, d: str) -> DataFrame:
    """Every file in order of size, not the first hundred."""
    return selection.numbered(s.files(spark, d), scratch(spark), F.col("size").desc()).select("name", "size", "place")


def _cut(ops: DataFrame) -> int:
    """About the middle sequence number; no task holds them all."""
    return int(ops.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0)


def tag_store_state(spark: SparkSession, d: str) -> DataFrame:
    """The store as the state of a stream that was stopped in the middle: later operations come first, one file a batch."""
    path, ops = scratch(spark), s.tag_ops(spark, d)
    middle = _cut(ops)
    with tagstate.state_store(spark, 16):
        for part in (ops.filter(F.col("seq") > middle), ops.filter(F.col("seq") <= middle)):
            part.repartitionByRange(2, "seq").write.mode("append").parquet(f"{path}/ops")
            source = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/ops")
            q = tagstate.changes(source, buckets=16).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/changes")
            q.awaitTermination()
        tagstate.store_of_state(spark, f"{path}/state").write.parquet(f"{path}/store")
    return spark.read.parquet(f"{path}/store")


def tag_store_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The nested store read from a snapshot of the first half of the log and the rest of it: records, and catalogs without."""
    ops = _reset_ops(spark, d)
    middle, log = _cut(ops), taglog.TagLog(spark, scratch(spark), span=3_600_000_000)
    log.append(ops.filter(F.col("seq") <= middle))
    log.compact(middle)
    log.append(ops.filter(F.col("seq") > middle))
    back = log.read()
    r = store.flat_records(back).select(F.col("catalog").alias("of"), "name", "dateTagged", "dateCopied", "rating")
    return store.entries(back).join(r, F.col("catalog") == F.col("of"), "left").drop("of")


def _frames(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """Raw files from documents, a folder for each source; a third of them without capture settings, previews of whole texts."""
    doc = s.table(spark, d, "documents")
    k, size = F.col("doc_id"), F.octet_length(F.coalesce("text", F.lit("")))
    has = k % 3 != 0
    preview = lambda width, data: F.struct(F.lit(width).cast("long").alias("width"), F.encode(data, "utf-8").alias("data"))
    body = F.coalesce("text", F.lit(""))
    hidden = F.when(k % 11 == 0, F.lit(".")).otherwise(F.lit(""))
    return doc.select(
        F.concat(F.lit(f"{folder}/"), "source").alias("folder"), F.concat(hidden, F.lit("_DSC"), F.lpad(k.cast("string"), F.greatest(F.lit(5), F.length(k.cast("string"))), F.lit("0")), F.when(k % 10 == 0, ".jpg").when(k % 10 == 1, ".arw").otherwise(".ARW")).alias("name"),
        F.concat(F.lit("CAM-"), "lang").alias("camera"), F.when(has, (1 + k % 8) / 4.0).alias("shutter"), F.when(has & (k % 5 != 0), 1.5 + k % 7).alias("aperture"),
        F.when(has, 100 * (1 + k % 64)).cast("long").alias("iso"), F.when(has, 24.5 + k % 100).alias("focal"), F.when(has, F.concat(F.lit("LENS "), "lang")).alias("lens"),
        F.array(preview(1616, F.left(body, F.lit(40))), preview(6000, body), preview(160, F.lit("x"))).alias("previews"), "doc_id", size.alias("n_bytes"))


def _catalogs(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """The raw files written to the shared folder, and its subfolders (as many as sources)."""
    folder = rawfiles.local_folder(scratch(spark))
    frames = _frames(spark, d, folder)
    rawfiles.write(frames.drop("doc_id", "n_bytes")).write.format("noop").mode("overwrite").save()
    return folder, sorted(r.folder for r in frames.select("folder").distinct().collect())


def _with_pushdown(spark: SparkSession, path: str, make) -> DataFrame:
    """What ``make`` gives, scanned with filters pushed into the source, written and read back."""
    before = spark.conf.get(catalog.PUSHDOWN)
    spark.conf.set(catalog.PUSHDOWN, "true")
    try:
        df = make()
        df.write.parquet(path)
    finally:
        spark.conf.set(catalog.PUSHDOWN, before)
    return spark.read.schema(df.schema).parquet(path)


def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    """Folders of raw files scanned with their capture settings; names of one kind alone are looked at."""
    folder, folders = _catalogs(spark, d)

    def scanned() -> DataFrame:
        files = catalog.scan_with_metadata(spark, *folders).filter(F.col("name").startswith("_DSC0"))
        return files.select(F.regexp_extract("catalog", "([^/]+)/$", 1).alias("catalog"), "name", "type", F.size("previews").cast("long").alias("n_previews"), "exif.*")

    return _with_pushdown(spark, scratch(spark), scanned)


def catalog_previews(spark: SparkSession, d: str) -> DataFrame:
    """The widest preview inside each raw file: its width and a digest of its bytes."""
    folder, folders = _catalogs(spark, d)
    best = tiff.embedded_previews(tiff.extract(catalog.scan(spark, *folders)))
    return best.select(F.element_at(F.split("path", "/"), -1).alias("name"), "width", "idx", F.length("jpeg").cast("long").alias("n_bytes"), F.md5("jpeg").alias("digest"))


def catalog_discover(spark: SparkSession, d: str) -> DataFrame:
    """Raw names in all folders below one, hidden ones included."""
    folder, _ = _catalogs(spark, d)
    return catalog.discover(spark, folder).select(F.expr(f"substring(path, {len(folder) + 2})").alias("path"))


def _tasks(spark: SparkSession) -> int:
    """Tasks for work that the bytes of its rows don't tell."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _write_outputs(lines: DataFrame, folder: str, done: bool) -> None:
    """Lines (output, line_no, record) as process output: a file each, replaced as a whole, and its mark when done."""
    where = rawfiles.local_folder(folder)

    def run(parts):
        os.makedirs(where, exist_ok=True)
        open_file, output = None, None

        def close():
            if open_file:
                open_file.close()
                os.replace(open_file.name, f"{where}/{output}.txt")
                if done:
                    with open(f"{where}/{output}.txt.done", "w"):
                        pass

        for b in parts:
            for name, record in zip(b.column("output").to_pylist(), b.column("record").to_pylist(), strict=True):
                if name != output:
                    close()
                    open_file, output = open(f"{where}/.{uuid.uuid4().hex}", "w", newline=""), name  # noqa: SIM115
                open_file.write(record + "\n")
        close()
        yield from ()

    lines.repartition(_tasks(lines.sparkSession), "output").sortWithinPartitions("output", "line_no").select("output", "record").mapInArrow(run, "output string").write.format("noop").mode("overwrite").save()


def output_stream(spark: SparkSession, d: str) -> DataFrame:
    """Process output that grows between two runs of a stream: each line once, with its number."""
    path, lines = scratch(spark), s.lines(spark, d)
    for half in (True, False):
        _write_outputs(lines.filter("line_no % 100 <= 50 and line_no < 51") if half else lines, f"{path}/out", done=not half)
        q = processout.output_lines(spark, rawfiles.local_folder(f"{path}/out")).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/lines")
        q.awaitTermination()
    back = spark.read.schema(processout.SCHEMA).parquet(f"{path}/lines").filter("not done")
    return back.select(F.regexp_extract("output", r"^(.*)\.txt$", 1).cast("long").alias("output"), "line_no", "record")


def copy_output_summary(spark: SparkSession, d: str) -> DataFrame:
    """Copies of all catalogs print what they do; the summaries are parsed from that text when each ends."""
    path, f = scratch(spark), s.files(spark, d)
    there = f.filter("doc_id % 2 = 0").select("catalog", "name", (F.col("modified") + F.make_dt_interval((F.col("doc_id") % 3 - 1).cast("int"))).alias("modified"))
    plan = copyplan.copy_plan(f, selection.rated_names(f, s.records(spark, d), 3), there, by=("catalog", "name"))
    moved = plan.filter("action <> 'skip'").select(F.col("catalog").alias("output"), F.concat(F.when(F.col("action") == "create", ">f+++++++++ ").otherwise(">f.st...... "), "name").alias("record"))
    ends = copyplan.summary_lines(copyplan.copy_summary(plan, "catalog"), "catalog").select(F.col("catalog").alias("output"), F.lit(1).alias("end"), F.col("k").cast("string").alias("at"), "record")
    both = moved.select("output", F.lit(0).alias("end"), F.col("record").alias("at"), "record").unionByName(ends)
    lines = both.withColumn("line_no", F.struct("end", "at"))
    _write_outputs(lines, f"{path}/out", done=True)
    run = completion.Completions(spark, f"{path}/copies")
    run.start(processout.output_lines(spark, rawfiles.local_folder(f"{path}/out"))).awaitTermination()
    return run.summaries().withColumn("output", F.regexp_extract("output", r"^(.*)\.txt$", 1)).drop("stats", "n_directories", "n_deleted")


def eta_stream(spark: SparkSession, d: str) -> DataFrame:
    """Remaining time as it is shown while completions come in, one file a batch, in two runs of the stream."""
    path, done = scratch(spark), s.completions(spark, d)
    middle = done.agg(F.expr("percentile_disc(0.5) within group (order by n)")).first()[0] or 0
    with tagstate.state_store(spark, 16):
        for part in (done.filter(F.col("n") <= middle), done.filter(F.col("n") > middle)):
            part.coalesce(1).write.mode("append").parquet(f"{path}/done")
            source = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/done")
            q = eta.remaining(source).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/shown")
            q.awaitTermination()
    return spark.read.schema(eta.SHOWN).parquet(f"{path}/shown").select(F.col("run").cast("long").alias("run"), "n", "eta")


def cache_observed(spark: SparkSession, d: str) -> DataFrame:
    """Cache statistics counted by the pass that writes the requests, without reading them again."""
    path = scratch(spark)
    requests, seen = cache.observed(s.requests(spark, d))
    requests.write.parquet(path)
    return spark.createDataFrame([cache.counters(seen)], "hits long, misses long, extractions long, hit_rate double")


def _images(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """Raw files from documents whose previews are images: 4 x 4 fields of 16 x 16 grey pixels, which JPEG keeps exactly."""
    folder = rawfiles.local_folder(scratch(spark))
    doc = s.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    spread = doc.repartition(_tasks(spark), "doc_id")  # narrow rows, much work for each

    def drawn(parts):
        for b in parts:
            data = []
            for doc_id, n in zip(b.column("doc_id").to_pylist(), b.column("n_chars").to_pylist(), strict=True):
                grey = (doc_id + n * np.arange(16)) % 256
                data.append(jpeg.encode(np.kron(grey.reshape(4, 4), np.ones((16, 16), np.int64)).astype(np.uint8), 1.0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(data, pa.binary())], names=["doc_id", "source", "jpeg"])

    drawings = spread.mapInArrow(drawn, "doc_id long, source string, jpeg binary")
    none = lambda kind: F.lit(None).cast(kind)
    image = lambda width, data: F.struct(F.lit(width).cast("long").alias("width"), data.alias("data"))
    frames = drawings.select(
        F.concat(F.lit(f"{folder}/"), "source").alias("folder"), F.concat(F.lit("_DSC"), F.col("doc_id").cast("string"), F.lit(".ARW")).alias("name"), F.lit("CAM").alias("camera"), *[none(k).alias(c) for c, k in (("shutter", "double"), ("aperture", "double"), ("iso", "long"), ("focal", "double"), ("lens", "string"))],
        F.array(image(8, F.encode(F.lit("no image"), "utf-8")), image(64, F.col("jpeg"))).alias("previews"))
    rawfiles.write(frames).write.format("noop").mode("overwrite").save()
    return folder, sorted(f"{folder}/{r.source}" for r in doc.select("source").distinct().collect())


def _previews(spark: SparkSession, folders: list[str]) -> DataFrame:
    return tiff.embedded_previews(tiff.extract(catalog.scan(spark, *folders)))


def preview_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The luminance of the images inside raw files: scanned, taken out, decoded, counted."""
    _, folders = _images(spark, d)
    bins = jpegs.counts(_previews(spark, folders), "path").filter("n > 0")
    return bins.select(F.regexp_extract("image", r"_DSC(-?\d+)\.ARW$", 1).cast("long").alias("doc_id"), "bin", "n")


def preview_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    """Thumbnails of those images written to the disk cache at full quality and read back: their pixels by value."""
    folder, folders = _images(spark, d)
    cache_folder = rawfiles.local_folder(scratch(spark))
    os.makedirs(cache_folder)
    small = jpegs.thumbnails(_previews(spark, folders), 32, quality=1.0, key="path")
    jpegs.write_cache(small.withColumnRenamed("image", "path"), cache_folder)
    cached = catalog.disk_cache(spark, cache_folder).select("file_key", F.col("content").alias("jpeg"))
    back = jpegs.pixels(cached, "file_key").groupBy("image", F.col("r").alias("grey")).agg(F.count("*").alias("n"), F.max("x").alias("last_x"))
    known = catalog.scan(spark, *folders).select(F.regexp_extract("name", r"_DSC(-?\d+)\.ARW$", 1).cast("long").alias("doc_id"), F.md5("path").alias("image"))
    return known.join(back, "image").select("doc_id", "grey", "n", "last_x")


QUERIES = {f.__name__: f for f in (
    tag_store_json_roundtrip, include_list, tag_store_stream, sort_by_size_desc_all, settings_roundtrip, catalog_list, copy_completion, progress_stream, tag_store_state, tag_store_compacted,
    catalog_scan, catalog_previews, catalog_discover, output_stream, copy_output_summary, eta_stream, cache_observed, preview_histogram, preview_thumbnails)}
_RAW_NAME = "CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || '_DSC' || lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0') || CASE doc_id % 10 WHEN 0 THEN '.jpg' WHEN 1 THEN '.arw' ELSE '.ARW' END"
ORACLE = {
    "tag_store_json_roundtrip": f"""WITH {RESET_OPS}, entry AS (SELECT catalog, min(seq) FILTER (op = 'toggle') AS started, max(seq) FILTER (op = 'toggle') > coalesce(max(seq) FILTER (op = 'reset'), -1) AS has_records FROM ops GROUP BY catalog),
r AS (SELECT catalog, name, max(seq) FILTER (op = 'toggle') AS tagged FROM live GROUP BY catalog, name)
SELECT e.catalog, strftime(make_timestamp(started), '%d %b %Y %H:%M') AS dateStart, has_records, s.name, strftime(make_timestamp(tagged), '%d %b %Y %H:%M') AS dateTagged, NULL AS dateCopied, s.rating
FROM entry AS e LEFT JOIN (store AS s JOIN r ON s.catalog = r.catalog AND s.name = r.name) ON e.catalog = s.catalog WHERE started IS NOT NULL""",
    "settings_roundtrip": "SELECT count(*)::INT * 100 AS memoryCacheSizeMB, 256 AS thumbnailSizeGrid, 1024 AS thumbnailSizePreview, 8700 AS thumbnailSizeFullSize, 4 AS thumbnailCostPerPixel, 100 AS thumbnailSizeGridView, false AS useThumbnailAsZoomPreview FROM region",
    "catalog_list": "SELECT DISTINCT source AS name, '/photos/' || source || '/' AS url FROM documents",
    "copy_completion": f"WITH {s.LINES} SELECT output, line_no, record, count(*) OVER (PARTITION BY output) AS n_lines FROM lines WHERE record NOT LIKE '%/'",
    "progress_stream": "SELECT user_id AS run, count(*) AS n, count(*) + 25 AS total, count(*)::DOUBLE / (count(*) + 25) AS fraction FROM events GROUP BY user_id",
    "tag_store_stream": _REVIEW_SQL["tag_store_fold"],
    "sort_by_size_desc_all": f"WITH {s.FILES} SELECT name, size, row_number() OVER (ORDER BY size DESC, file_key) AS place FROM files",
    "tag_store_state": _REVIEW_SQL["tag_store_fold"],
    "eta_stream": _REVIEW_SQL["eta_monotone"],
    "cache_observed": f"WITH {s.REQUESTS} SELECT count(*) FILTER (tier = 'ram') AS hits, count(*) FILTER (tier = 'disk') AS misses, count(*) FILTER (tier = 'extract') AS extractions, coalesce(count(*) FILTER (tier = 'ram') * 100::DOUBLE / nullif(count(*) FILTER (tier <> 'extract'), 0), 0) AS hit_rate FROM requests",
    "output_stream": f"WITH {s.LINES} SELECT output, line_no, record FROM lines",
    "catalog_scan": f"""WITH f AS (SELECT *, {_RAW_NAME} AS name, doc_id % 3 <> 0 AS has FROM documents)
SELECT source AS catalog, name, 'Sony ARW raw image' AS type, (CASE WHEN coalesce(text, '') = '' THEN 1 ELSE 3 END)::BIGINT AS n_previews,
  CASE WHEN has THEN CASE WHEN doc_id % 8 >= 3 THEN printf('%.1f', (1 + doc_id % 8) / 4.0) || '"' ELSE '1/' || ['4', '2', '1'][doc_id % 8 + 1] END END AS "shutterSpeed",
  CASE WHEN has THEN printf('%.1fmm', 24.5 + doc_id % 100) END AS "focalLength", CASE WHEN has AND doc_id % 5 <> 0 THEN printf('ƒ/%.1f', 1.5 + doc_id % 7) END AS aperture,
  CASE WHEN has THEN 'ISO ' || 100 * (1 + doc_id % 64) END AS iso, CASE WHEN has THEN 'CAM-' || lang END AS camera, CASE WHEN has THEN 'LENS ' || lang END AS "lensModel"
FROM f WHERE name LIKE '\\_DSC0%' ESCAPE '\\' AND lower(name) LIKE '%.arw'""",
    "catalog_previews": f"""WITH f AS (SELECT coalesce(text, '') AS text, {_RAW_NAME} AS name FROM documents)
SELECT name, CASE WHEN text = '' THEN 160 ELSE 6000 END::BIGINT AS width, CASE WHEN text = '' THEN 0 ELSE 1 END::INT AS idx, (CASE WHEN text = '' THEN 1 ELSE strlen(text) END)::BIGINT AS n_bytes, md5(CASE WHEN text = '' THEN 'x' ELSE text END) AS digest
FROM f WHERE name LIKE '\\_DSC%' ESCAPE '\\' AND lower(name) LIKE '%.arw'""",
    "catalog_discover": f"SELECT source || '/' || name AS path FROM (SELECT source, {_RAW_NAME} AS name FROM documents) WHERE lower(name) LIKE '%.arw'",
    "copy_output_summary": f"""WITH {s.RECORDS}, there AS (SELECT catalog, name, modified + to_days((doc_id % 3 - 1)::INT) AS modified FROM files WHERE doc_id % 2 = 0),
plan AS (SELECT c.*, CASE WHEN t.modified IS NULL THEN 'create' WHEN c.modified > t.modified THEN 'update' ELSE 'skip' END AS action FROM rated AS c LEFT JOIN there AS t ON c.catalog = t.catalog AND c.name = t.name WHERE c.rating >= 3)
SELECT catalog AS output, count(*) FILTER (action <> 'skip') + 10 AS n_lines, count(*) AS n_files, count(*) FILTER (action = 'create') AS n_created, count(*) FILTER (action <> 'skip') AS n_transferred,
  sum(size)::BIGINT AS total_bytes, coalesce(sum(size) FILTER (action <> 'skip'), 0)::BIGINT AS transferred_bytes, true AS parsed, count(*) FILTER (action <> 'skip') > 0 AS data_to_synchronize FROM plan GROUP BY catalog""",
    "include_list": f"WITH {s.RECORDS} SELECT DISTINCT name FROM rated WHERE rating >= 3",
}
ORACLE["tag_store_compacted"] = ORACLE["tag_store_json_roundtrip"]
_FIELDS = "fields AS (SELECT doc_id, unnest(range(16)) AS k, ((doc_id + n_chars * unnest(range(16))) % 256)::INT AS grey FROM documents)"
ORACLE["preview_histogram"] = f"WITH {_FIELDS} SELECT doc_id, trunc(0.299::DOUBLE * grey + 0.587::DOUBLE * grey + 0.114::DOUBLE * grey)::INT AS bin, count(*) * 256 AS n FROM fields GROUP BY ALL"
ORACLE["preview_thumbnails"] = f"WITH {_FIELDS} SELECT doc_id, grey, count(*) * 64 AS n, max(k % 4 * 8 + 7)::INT AS last_x FROM fields GROUP BY ALL"
