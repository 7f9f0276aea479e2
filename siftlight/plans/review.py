"""Queries of the review engine over the stand-in tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import cache, copyplan, images, progress, selection, tagging
from . import standins as s
from .scratch import scratch

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return register


# -- selection ---------------------------------------------------------------------------------------------------

@query(f"WITH {s.RECORDS} SELECT catalog, name, path, size, rating, tagged FROM rated WHERE lower(name) LIKE '%.arw' AND name NOT LIKE '.%' AND contains(lower(name), lower('dsc0')) AND rating >= 2")
def selection_visible_files(spark, d) -> DataFrame:
    raw = s.files(spark, d).filter(text.is_raw(F.col("name")) & ~text.is_hidden(F.col("name")))
    v = selection.visible(raw, s.records(spark, d), "dsc0", 2)
    return selection.ordered(v).select("catalog", "name", "path", "size", "rating", "tagged")


@query(f"WITH {s.RECORDS} SELECT catalog, name FROM rated WHERE contains(lower(name), '2') AND rating >= 4")
def rated_names(spark, d) -> DataFrame:
    return selection.rated_names(s.files(spark, d), s.records(spark, d), 4, "2")


@query(f"WITH {s.RECORDS} SELECT name FROM records WHERE catalog = 'src3' AND name IS NOT NULL")
def tagged_names(spark, d) -> DataFrame:
    return selection.tagged_names(s.records(spark, d), "src3")


@query(f"WITH {s.RECORDS} SELECT f.catalog, f.name, f.size FROM files AS f SEMI JOIN records AS r ON f.catalog = r.catalog AND f.name = r.name")
def tag_flag_semi(spark, d) -> DataFrame:
    return selection.tagged_files(s.files(spark, d), s.records(spark, d)).select("catalog", "name", "size")


@query(f"WITH {s.RECORDS} SELECT catalog, name, tagged FROM rated")
def tag_flag_column(spark, d) -> DataFrame:
    return selection.with_rating(s.files(spark, d), s.records(spark, d)).select("catalog", "name", "tagged")


@query(f"""WITH {s.RECORDS}, strip AS (SELECT name FROM records WHERE catalog = 'src3' UNION ALL SELECT 'missing.ARW')
SELECT t.name, f.path FROM strip AS t LEFT JOIN (SELECT name, min(path) AS path FROM files WHERE catalog = 'src3' GROUP BY name) AS f ON t.name = f.name""")
def tagged_strip_left(spark, d) -> DataFrame:
    r = s.records(spark, d)
    gone = spark.range(1).select(F.lit("src3").alias("catalog"), F.lit("missing.ARW").alias("name"), F.lit(-1).cast("bigint").alias("position"), F.lit(3).alias("rating"))
    return selection.tagged_strip(s.files(spark, d), r.unionByName(gone), "src3")


@query(f"WITH {s.FILES} SELECT catalog, name FROM files WHERE contains(lower(name), lower('dSc0012'))")
def search_ci(spark, d) -> DataFrame:
    return s.files(spark, d).filter(selection.matches(F.col("name"), "dSc0012")).select("catalog", "name")


@query(f"WITH {s.FILES} SELECT name, size, row_number() OVER (ORDER BY size DESC, file_key) AS place FROM files ")
def sort_by_size_desc(spark, d) -> DataFrame:
    return selection.numbered(s.files(spark, d), scratch(spark), F.col("size").desc()).select("name", "size", "place")


@query(f"WITH {s.FILES} SELECT path, size FROM files WHERE file_key = md5('/photos/src0/_DSC00020.jpg') OR file_key = md5('/photos/src1/_DSC00001.arw')")
def point_lookup(spark, d) -> DataFrame:
    wanted = [F.md5(F.lit(p)) for p in ("/photos/src0/_DSC00020.jpg", "/photos/src1/_DSC00001.arw")]
    return s.files(spark, d).filter((F.col("file_key") == wanted[0]) | (F.col("file_key") == wanted[1])).select("path", "size")


@query(f"WITH {s.FILES}, f AS (SELECT right(name, 7) AS name, path FROM files) SELECT name, min(path) AS path FROM f GROUP BY name")
def first_match(spark, d) -> DataFrame:
    return selection.first_match(s.files(spark, d).select(F.right("name", F.lit(7)).alias("name"), "path"))


@query(f"WITH {s.RECORDS} SELECT f.catalog, coalesce(n, 0) AS n_tagged FROM (SELECT DISTINCT catalog FROM files) AS f LEFT JOIN (SELECT catalog, count(*) AS n FROM records GROUP BY catalog) AS r ON f.catalog = r.catalog")
def tag_count_per_catalog(spark, d) -> DataFrame:
    return selection.tag_counts(s.files(spark, d).select("catalog").distinct(), s.records(spark, d))


@query(f"WITH {s.RECORDS} SELECT catalog, bool_or(tagged) AS any_tagged FROM rated GROUP BY catalog")
def any_tagged(spark, d) -> DataFrame:
    return selection.with_rating(s.files(spark, d), s.records(spark, d)).groupBy("catalog").agg(F.bool_or("tagged").alias("any_tagged"))


@query(f"WITH {s.RECORDS} SELECT catalog, count(*) AS n_visible FROM rated WHERE rating >= 3 GROUP BY catalog")
def visible_count(spark, d) -> DataFrame:
    return selection.visible(s.files(spark, d), s.records(spark, d), "", 3).groupBy("catalog").agg(F.count("*").alias("n_visible"))


@query(f"WITH {s.RECORDS} SELECT catalog, count(*) FILTER (tagged) AS n_tagged, count(*) FILTER (rating >= 3) AS n_rated FROM rated GROUP BY catalog")
def copy_max(spark, d) -> DataFrame:
    r = selection.with_rating(s.files(spark, d), s.records(spark, d))
    return r.groupBy("catalog").agg(F.count_if("tagged").alias("n_tagged"), F.count_if(F.col("rating") >= 3).alias("n_rated"))


@query(f"WITH {s.FILES} SELECT DISTINCT catalog FROM files WHERE catalog NOT IN (SELECT DISTINCT catalog FROM files WHERE doc_id % 3 = 0 AND catalog < 'src15')")
def catalogs_once_per_session(spark, d) -> DataFrame:
    f = s.files(spark, d)
    return selection.unseen(f, f.filter("doc_id % 3 = 0 and catalog < 'src15'").select("catalog").distinct())


@query(f"WITH {s.FILES}, v AS (SELECT CASE WHEN doc_id % 4 = 0 THEN '.' || name ELSE name END AS name FROM files) SELECT name, lower(regexp_extract(name, '\\.([^./]+)$', 1)) = 'arw' AS raw, name LIKE '.%' AS hidden FROM v")
def name_predicates(spark, d) -> DataFrame:
    v = s.files(spark, d).select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("."), "name")).otherwise(F.col("name")).alias("name"))
    return v.select("name", text.is_raw(F.col("name")).alias("raw"), text.is_hidden(F.col("name")).alias("hidden"))


# -- tag store ---------------------------------------------------------------------------------------------------

@query(f"WITH {s.TAG_OPS} SELECT catalog, name, rating FROM store")
def tag_store_fold(spark, d) -> DataFrame:
    return tagging.fold(s.tag_ops(spark, d))


@query(f"WITH {s.TAG_OPS.replace('FROM events)', 'FROM events WHERE epoch_us(ts) > (SELECT quantile_disc(epoch_us(ts), 0.5) FROM events))')} SELECT catalog, name, rating FROM store")
def tag_store_reset_all(spark, d) -> DataFrame:
    ops = s.tag_ops(spark, d)
    middle = s.table(spark, d, "events").agg(F.expr("percentile_disc(0.5) within group (order by unix_micros(cast(ts as timestamp)))").alias("seq"))
    reset = middle.select("seq", F.lit(None).cast("string").alias("catalog"), F.lit(None).cast("string").alias("name"), F.lit("reset_all").alias("op"), F.lit(None).cast("int").alias("rating"))
    return tagging.fold(ops.unionByName(reset))


@query(f"""WITH {s.TAG_OPS.split(', live AS')[0].split(',\nlive AS')[0]} SELECT catalog, name, seq, rating, unnest(CASE WHEN seq % 2 = 0 THEN ['toggle', 'rate'] ELSE ['rate'] END) AS op FROM ops WHERE op = 'rate'""")
def rate_tags_first(spark, d) -> DataFrame:
    ops = s.tag_ops(spark, d).filter("op = 'rate'").withColumn("op", F.lit("rate_row")).withColumn("was_tagged", F.col("seq") % 2 != 0)
    return tagging.rate_expansion(ops).select("catalog", "name", "seq", "rating", "op")


# -- scalars -----------------------------------------------------------------------------------------------------

@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount AS t, l_quantity * 7 AS mm, l_tax * 100 + 1 AS a, l_extendedprice AS iso FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN t = 0 THEN '1/inf' ELSE '1/' || round_even(1 / t, 0)::BIGINT END AS shutter, printf('%.1f"', t * 100 + 1) AS long_shutter,
  printf('%.1fmm', mm) AS focal, 'ƒ/' || printf('%.1f', a) AS aperture, 'ISO ' || round_even(iso, 0)::BIGINT AS iso FROM x""")
def exif_format(spark, d) -> DataFrame:
    x = s.table(spark, d, "lineitem")
    t = F.col("l_discount")
    return x.select("l_orderkey", "l_linenumber", text.shutter_text(t).alias("shutter"), text.shutter_text(t * 100 + 1).alias("long_shutter"), text.focal_text(F.col("l_quantity") * 7).alias("focal"),
                    text.aperture_text(F.col("l_tax") * 100 + 1).alias("aperture"), text.iso_text(F.col("l_extendedprice")).alias("iso"))


_SIZES = "x AS (SELECT *, CASE WHEN n > 0 THEN trunc(log2(n) / 10)::INT END AS k FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_orderkey AS n FROM orders))"


@query(f"""WITH {_SIZES} SELECT o_orderkey, CASE WHEN n = 0 THEN '0 B' ELSE printf('%.1f', n / pow(1024, k)) || ' ' || CASE k WHEN 0 THEN 'B' WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' ELSE 'GB' END END AS human,
  CASE WHEN n < 1024 THEN 'B' WHEN n < 1048576 THEN 'KB' WHEN n < 1073741824 THEN 'MB' ELSE 'GB' END AS unit,
  CASE WHEN n >= 1000000000 THEN printf('%.1f GB', n / 1000000000) WHEN n >= 1000000 THEN printf('%.1f MB', n / 1000000) WHEN n >= 1000 THEN round_even(n / 1000, 0)::BIGINT || ' KB' ELSE n || ' bytes' END AS decimal_text,
  CASE WHEN n >= 1073741824 THEN round_even(n / 1073741824, 0)::BIGINT || ' GB' ELSE round_even(n / 1048576, 0)::BIGINT || ' MB' END AS memory, (n // 1073741824) || ' GB' AS gib FROM x""")
def bytes_human(spark, d) -> DataFrame:
    """Cubes of keys from 2,097,152 on exceed 64 bits (where the SQL overflows): they are decimals."""
    k = F.col("o_orderkey").cast("decimal(19,0)")
    n = F.col("n")
    return s.table(spark, d, "orders").select("o_orderkey", (k * k * k).alias("n")).select("o_orderkey", text.bytes_human(n).alias("human"), text.bytes_unit(n).alias("unit"), text.file_size_text(n).alias("decimal_text"), text.memory_text(n).alias("memory"), text.gib_text(n).alias("gib"))


@query("SELECT page_id, md5(url) || '.jpg' AS cache_key FROM pages")
def cache_key_md5(spark, d) -> DataFrame:
    return s.table(spark, d, "pages").select("page_id", text.cache_key(F.col("url")).alias("cache_key"))


@query("""WITH x AS (SELECT p_partkey, p_size * 64 AS side, 500 * (1 + p_partkey % 10) AS mb, 4 * (p_partkey % 3) AS bpp FROM part)
SELECT p_partkey, CASE WHEN side * side * bpp > 0 THEN greatest(1, mb * 1048576 // (side * side * bpp)) ELSE 0 END::BIGINT AS capacity, (side * side * bpp // 1024)::BIGINT AS kilobytes, (mb * 1048576)::BIGINT AS limit_bytes FROM x""")
def capacity_estimates(spark, d) -> DataFrame:
    x = s.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 64).cast("bigint").alias("side"), (500 * (1 + F.col("p_partkey") % 10)).alias("mb"), (4 * (F.col("p_partkey") % 3)).alias("bpp"))
    return x.select("p_partkey", text.image_capacity(F.col("mb"), F.col("side"), F.col("bpp")).alias("capacity"), text.size_kilobytes(F.col("side"), F.col("bpp")).alias("kilobytes"), (F.col("mb") * text.MIB).alias("limit_bytes"))


@query("SELECT event_id, CASE WHEN event_id < 60 THEN event_id || 's' ELSE (event_id // 60) || 'm ' || (event_id % 60) || 's' END AS duration, (round_even(greatest(0.5, least(4, value::DOUBLE / 20 + 0.2)) * 100, 0))::BIGINT || '%' AS zoom, repeat('★', (event_id % 6)::INT) || repeat('☆', (5 - event_id % 6)::INT) AS stars, CASE WHEN event_id % 6 IN (1, 2) THEN 'low' WHEN event_id % 6 IN (3, 4) THEN 'medium' ELSE 'high' END AS quality FROM events")
def interface_texts(spark, d) -> DataFrame:
    e, k = s.table(spark, d, "events"), F.col("event_id")
    return e.select("event_id", text.duration_text(k).alias("duration"), text.zoom_percent(F.col("value") / 20, 1).alias("zoom"), text.stars((k % 6).cast("int")).alias("stars"), text.interpolation_quality(k % 6).alias("quality"))


@query(f"WITH {s.FILES} SELECT path, regexp_replace(path, '[^/]+$', '') AS parent, regexp_replace(path, '\\.[^./]+$', '.jpg') AS sidecar, regexp_extract(path, '[^/]+$') AS file_name FROM files")
def path_parts(spark, d) -> DataFrame:
    p = F.col("path")
    return s.files(spark, d).select("path", text.parent_directory(p).alias("parent"), text.with_extension(p, "jpg").alias("sidecar"), F.regexp_extract(p, "[^/]+$", 0).alias("file_name"))


@query("""WITH x AS (SELECT c_custkey, c_custkey % 700 AS mb, 8000 * 1048576::BIGINT AS total, (c_custkey % 9) * 1000000000 AS cache FROM customer)
SELECT c_custkey, mb < 500 AS too_small, cache > trunc(total * 0.8::DOUBLE) AS too_large FROM x""")
def settings_warnings(spark, d) -> DataFrame:
    total = F.lit(8000 * text.MIB)
    return s.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 700 < 500).alias("too_small"), ((F.col("c_custkey") % 9) * F.lit(10**9) > F.floor(total * F.lit(0.8))).alias("too_large"))


# -- dates -------------------------------------------------------------------------------------------------------

@query("""SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y %H:%M') AS stored, strftime(o_orderdate, '%d %b %Y') AS day_text, strftime(o_orderdate, '%H:%M') AS time_text, strftime(o_orderdate, '%m-%d-%Y:%H:%M') AS stamp,
  strftime(date_trunc('minute', o_orderdate), '%Y-%m-%d %H:%M:%S') AS parsed, CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-01 00:00:00' END AS fallback FROM orders""")
def date_text(spark, d) -> DataFrame:
    ts = F.col("o_orderdate").cast("timestamp")
    o = s.table(spark, d, "orders").select("o_orderkey", dates.store_text(ts).alias("stored"), F.date_format(ts, "dd MMM yyyy").alias("day_text"), F.date_format(ts, "HH:mm").alias("time_text"), F.date_format(ts, "MM-dd-yyyy:HH:mm").alias("stamp"))
    now = F.when(F.col("o_orderkey") % 2 == 0, F.expr("timestamp '2024-01-01 00:00:00'"))
    return o.select("*", F.date_format(dates.parse_store(F.col("stored")), "yyyy-MM-dd HH:mm:ss").alias("parsed"), F.date_format(dates.parse_store(F.lit("no date"), now), "yyyy-MM-dd HH:mm:ss").alias("fallback"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%A') AS weekday, strftime(o_orderdate, '%B') AS month_name, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS dd, hour(o_orderdate)::INT AS h, minute(o_orderdate)::INT AS mi,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, strftime(last_day(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH), '%Y-%m-%d') AS next_end, day(last_day(o_orderdate))::INT AS days, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M') AS day_start FROM orders""")
def calendar_parts(spark, d) -> DataFrame:
    ts = F.col("o_orderdate").cast("timestamp")
    day = ts.cast("date")
    return s.table(spark, d, "orders").select(
        "o_orderkey", F.date_format(ts, "EEEE").alias("weekday"), F.date_format(ts, "MMMM").alias("month_name"), F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("dd"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"),
        F.date_format(F.date_trunc("month", ts), "yyyy-MM-dd").alias("month_start"), dates.end_of_month(day).cast("string").alias("month_end"), dates.end_of_next_month(day).cast("string").alias("next_end"), dates.days_in_month(day).alias("days"), F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd HH:mm").alias("day_start"))


@query("""WITH x AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders), g AS (SELECT m, m - ((dayofweek(m) + 6) % 7)::INT AS start FROM x)
SELECT strftime(m, '%Y-%m') AS month, strftime(unnest(generate_series(start::TIMESTAMP, last_day(m)::TIMESTAMP, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM g""")
def calendar_grid(spark, d) -> DataFrame:
    m = s.table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")).distinct()
    return m.select(F.date_format("m", "yyyy-MM").alias("month"), F.explode(F.transform(dates.grid_days(F.col("m")), lambda x: x.cast("string"))).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B') AS month, strftime(o_orderdate, '%a') AS weekday, ((isodow(o_orderdate) + 4) % 7 + 1)::INT AS place FROM orders")
def calendar_names(spark, d) -> DataFrame:
    """Month and weekday of each order by their names in lists; weeks begin on Wednesday, so that the list is a turned one."""
    day = F.col("o_orderdate").cast("date")
    place = F.pmod(F.dayofweek(day) - 4, F.lit(7)).cast("int") + 1
    return s.table(spark, d, "orders").select("o_orderkey", F.element_at(dates.month_names(), F.month(day)).alias("month"), F.element_at(dates.weekday_symbols(4), place).alias("weekday"), place.alias("place"))


# -- aggregates --------------------------------------------------------------------------------------------------

@query(f"WITH {s.REQUESTS} SELECT user_id, count(*) FILTER (tier = 'ram') AS hits, count(*) FILTER (tier = 'disk') AS misses, count(*) FILTER (tier = 'extract') AS extractions, coalesce(count(*) FILTER (tier = 'ram') * 100::DOUBLE / nullif(count(*) FILTER (tier <> 'extract'), 0), 0) AS hit_rate FROM requests GROUP BY user_id")
def cache_hit_rate(spark, d) -> DataFrame:
    return cache.statistics(s.requests(spark, d), ["user_id"])


@query("""WITH r AS (SELECT p_brand AS image, p_size * 16 AS w, CASE WHEN p_brand LIKE '%1' THEN 0 ELSE p_size * 8 END AS h, 4 AS bpp FROM part)
SELECT image, floor(CASE WHEN sum(w * h * bpp) > 0 THEN sum(w * h * bpp) ELSE max(w * 100 * bpp) END * 1.1::DOUBLE)::BIGINT AS cost FROM r GROUP BY image""")
def thumbnail_cost(spark, d) -> DataFrame:
    side = F.col("p_size").cast("bigint")
    reps = s.table(spark, d, "part").select(F.col("p_brand").alias("image"), (side * 16).alias("width"), F.when(F.col("p_brand").endswith("1"), 0).otherwise(side * 8).alias("height"), F.lit(4).alias("bpp"), (side * 16).alias("logical_width"), F.lit(100).alias("logical_height"))
    return cache.total_cost(reps, "image")


@query(f"WITH {s.FILES} SELECT catalog, sum(size)::BIGINT AS bytes, count(*) AS n_files FROM files WHERE name NOT LIKE '.%' GROUP BY catalog")
def disk_usage(spark, d) -> DataFrame:
    return s.files(spark, d).filter(~text.is_hidden(F.col("name"))).groupBy("catalog").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_files"))


@query("WITH c AS (SELECT p_brand AS file, p_partkey AS idx, p_size AS width FROM part WHERE p_type <> 'ECONOMY') SELECT file, idx, width, width > 40 AS downsample FROM c QUALIFY row_number() OVER (PARTITION BY file ORDER BY width DESC, idx) = 1")
def largest_preview(spark, d) -> DataFrame:
    p = images.largest_preview(s.previews(spark, d))
    return p.withColumn("downsample", images.needs_downsampling(F.col("width") * 108))


@query("SELECT p_partkey, (p_partkey % 5 = 0) OR p_size = 6 AS jpeg, trunc(coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2 END, p_size))::BIGINT AS width FROM part")
def preview_predicates(spark, d) -> DataFrame:
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    return s.table(spark, d, "part").select("p_partkey", images.is_jpeg(k % 5 == 0, F.col("p_size")).alias("jpeg"), images.width(F.when(k % 3 == 0, price), F.when(k % 2 == 0, price * 2), F.col("p_size").cast("double")).alias("width"))


@query(f"WITH {s.HISTOGRAM} SELECT image, bin, n FROM h")
def luma_histogram(spark, d) -> DataFrame:
    return images.histogram(s.pixels(spark, d))


@query(f"WITH {s.HISTOGRAM} SELECT image, bin, coalesce(n::DOUBLE / nullif(max(n) OVER (PARTITION BY image), 0), 0) AS norm FROM h")
def histogram_normalised(spark, d) -> DataFrame:
    return images.normalised(images.histogram(s.pixels(spark, d)))


@query("""WITH p AS (SELECT l_returnflag AS image, l_orderkey % 200 AS x, l_partkey % 90 AS y, l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem),
z AS (SELECT image, greatest(max(x) + 1, max(y) + 1) AS side FROM p GROUP BY image),
c AS (SELECT p.image, CASE WHEN side > 64 THEN floor(x * 64 / side) ELSE x END::INT AS x, CASE WHEN side > 64 THEN floor(y * 64 / side) ELSE y END::INT AS y, r, g, b FROM p JOIN z ON p.image = z.image)
SELECT image, x, y, floor(sum(r) / count(*))::INT AS r, floor(sum(g) / count(*))::INT AS g, floor(sum(b) / count(*))::INT AS b FROM c GROUP BY image, x, y""")
def thumbnail_pixels(spark, d) -> DataFrame:
    at = [(F.col("l_orderkey") % 200).alias("x"), (F.col("l_partkey") % 90).alias("y")]
    return images.thumbnail(s.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("image"), *at, *[(F.col(c) % 256).alias(k) for c, k in (("l_orderkey", "r"), ("l_partkey", "g"), ("l_suppkey", "b"))]), 64)


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_evicted FROM events GROUP BY user_id")
def success_count(spark, d) -> DataFrame:
    return s.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("n_ok"), F.count_if(F.col("event_type") == "error").alias("n_evicted"))


@query("""WITH m AS (SELECT c_custkey, (c_custkey % 4) * 4294967296 AS total, (c_custkey % 3) * 1073741824 AS used, (c_custkey % 7) * 1048576 AS app FROM customer), t AS (SELECT *, trunc(total * 0.8::DOUBLE)::BIGINT AS threshold FROM m)
SELECT *, coalesce(used * 100::DOUBLE / nullif(total, 0), 0) AS used_pct, coalesce(app * 100::DOUBLE / nullif(used, 0), 0) AS app_pct, coalesce(threshold * 100::DOUBLE / nullif(total, 0), 0) AS threshold_pct FROM t""")
def memory_percentages(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return cache.memory_gauges(s.table(spark, d, "customer").select("c_custkey", (k % 4 * F.lit(4 * text.GIB)).alias("total"), (k % 3 * F.lit(text.GIB)).alias("used"), (k % 7 * text.MIB).alias("app")))


@query(f"WITH {s.REQUESTS} SELECT user_id, count(*) FILTER (tier = 'ram') AS hits, count(*) FILTER (tier = 'disk') AS misses, count(*) FILTER (tier = 'extract') AS extractions, coalesce(count(*) FILTER (tier = 'ram') * 100::DOUBLE / nullif(count(*) FILTER (tier <> 'extract'), 0), 0) AS hit_rate, 0::BIGINT AS hits_after, 0::BIGINT AS misses_after, 0::BIGINT AS evictions_after FROM requests GROUP BY user_id")
def clear_caches(spark, d) -> DataFrame:
    return cache.cleared(s.requests(spark, d), ["user_id"])


_CACHED = """r AS (SELECT o_custkey % 97 AS session, o_orderkey AS seq, o_custkey AS file_key, (o_totalprice::BIGINT % 1000 + 1) * 4096 AS cost, o_orderpriority AS priority, o_orderstatus AS status FROM orders),
live AS (SELECT r.* FROM r LEFT JOIN (SELECT session, max(seq) AS cleared FROM r WHERE seq % 200 = 7 GROUP BY session) AS c ON r.session = c.session WHERE cleared IS NULL OR seq > cleared)"""


def _cached(spark, d) -> tuple[DataFrame, DataFrame]:
    o = s.table(spark, d, "orders")
    r = o.select((F.col("o_custkey") % 97).alias("session"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("file_key"), ((F.rint("o_totalprice").cast("bigint") % 1000 + 1) * 4096).alias("cost"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return r, r.filter("seq % 200 = 7").select("session", "seq")


@query(f"""WITH {_CACHED}, held AS (SELECT session, file_key, arg_max(cost, seq) AS cost FROM live WHERE status <> 'F' GROUP BY ALL)
SELECT session, count(*) AS n_entries, sum(cost)::BIGINT AS cost, greatest(0, sum(cost) - 3000000)::BIGINT AS over_cost, greatest(0, count(*) - 2)::BIGINT AS over_count FROM held GROUP BY session""")
def cache_occupancy(spark, d) -> DataFrame:
    """Thumbnails put into the caches of sessions and not cleared since, against a cost and a count limit."""
    r, clears = _cached(spark, d)
    return cache.occupancy(cache.contents(r.filter("status <> 'F'"), clears, "session"), "session", 3_000_000, 2)


@query(f"""WITH {_CACHED}, t AS (SELECT session, CASE WHEN priority < '3' THEN 'ram' WHEN priority < '5' THEN 'disk' ELSE 'extract' END AS tier FROM live)
SELECT session, count(*) FILTER (tier = 'ram') AS hits, count(*) FILTER (tier = 'disk') AS misses, count(*) FILTER (tier = 'extract') AS extractions, coalesce(count(*) FILTER (tier = 'ram') * 100::DOUBLE / nullif(count(*) FILTER (tier <> 'extract'), 0), 0) AS hit_rate FROM t GROUP BY session""")
def cache_counters_since_clear(spark, d) -> DataFrame:
    """The counters of each session's cache, which a clearing sets to zero."""
    r, clears = _cached(spark, d)
    tier = F.when(F.col("priority") < "3", "ram").when(F.col("priority") < "5", "disk").otherwise("extract")
    return cache.statistics(cache.since_clear(r, clears, "session").withColumn("tier", tier), ["session"])


@query("SELECT c_custkey, least((c_custkey * 1000 + c_custkey % 97 * 5000 + c_nationkey * 300) * 16384, 8589934592) AS used FROM customer")
def memory_used_pages(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return s.table(spark, d, "customer").select("c_custkey", cache.used_memory(k * 1000, k % 97 * 5000, F.col("c_nationkey").cast("bigint") * 300, F.lit(16384), F.lit(8 * text.GIB)).alias("used"))


# -- progress ----------------------------------------------------------------------------------------------------

@query(f"WITH {s.COMPLETIONS} SELECT run, n, mean_micros, eta FROM t")
def eta_trailing_mean(spark, d) -> DataFrame:
    return progress.eta(s.completions(spark, d)).select("run", "n", "mean_micros", "eta")


@query(f"WITH {s.COMPLETIONS} SELECT run, n, eta FROM (SELECT *, min(eta) OVER (PARTITION BY run ORDER BY n) AS least FROM t) WHERE eta = least")
def eta_monotone(spark, d) -> DataFrame:
    return progress.monotone_eta(progress.eta(s.completions(spark, d))).select("run", "n", "eta")


@query(f"WITH {s.COMPLETIONS} SELECT run, n, CASE WHEN total - 40 > 0 THEN least(n::DOUBLE / nullif(total - 40, 0), 1) END AS fraction FROM c")
def progress_fraction(spark, d) -> DataFrame:
    return s.completions(spark, d).select("run", "n", progress.fraction(F.col("n"), F.col("total") - 40).alias("fraction"))


# -- process output ----------------------------------------------------------------------------------------------

@query(f"WITH {s.LINES} SELECT output, line_no, record FROM lines WHERE line_no > total - 20")
def tail20(spark, d) -> DataFrame:
    return copyplan.tail(s.lines(spark, d), "output")


@query(f"WITH {s.LINES} SELECT output, line_no, record FROM lines WHERE line_no <= greatest(total - 11, 0)")
def drop_last11(spark, d) -> DataFrame:
    return copyplan.drop_last(s.lines(spark, d), "output")


@query(f"WITH {s.LINES} SELECT output, line_no, record FROM lines WHERE record NOT LIKE '%/'")
def drop_dir_lines(spark, d) -> DataFrame:
    return copyplan.without_directories(s.lines(spark, d))


@query(f"WITH {s.LINES} SELECT output, count(*) AS n_lines FROM lines GROUP BY output")
def line_count(spark, d) -> DataFrame:
    return s.lines(spark, d).groupBy("output").agg(F.count("*").alias("n_lines"))


@query(f"WITH {s.LINES} SELECT DISTINCT record FROM lines")
def output_rows_set(spark, d) -> DataFrame:
    return copyplan.output_rows(s.lines(spark, d), "record", as_set=True)


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS server FROM customer)
SELECT c_custkey, coalesce(nullif(id, ''), 'Synchronize ID') AS id_label, coalesce(nullif(server, ''), 'localhost') AS server_label FROM x""")
def heading_defaults(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    x = s.table(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("id"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("server"))
    label = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return x.select("c_custkey", label(F.col("id"), "Synchronize ID").alias("id_label"), label(F.col("server"), "localhost").alias("server_label"))


# -- copies, retention, tiers ------------------------------------------------------------------------------------

_PLAN = s.RECORDS + """, chosen AS (SELECT f.* FROM files AS f WHERE f.name IN (SELECT name FROM rated WHERE rating >= 3)),
there AS (SELECT name, modified + to_days((doc_id % 3 - 1)::INT) AS modified FROM files WHERE doc_id % 2 = 0),
plan AS (SELECT c.*, CASE WHEN t.modified IS NULL THEN 'create' WHEN c.modified > t.modified THEN 'update' ELSE 'skip' END AS action FROM chosen AS c LEFT JOIN there AS t ON c.name = t.name)"""


def _plan(spark, d) -> DataFrame:
    f = s.files(spark, d)
    there = f.filter("doc_id % 2 = 0").select("name", (F.col("modified") + F.make_dt_interval((F.col("doc_id") % 3 - 1).cast("int"))).alias("modified"))
    return copyplan.copy_plan(f, selection.rated_names(f, s.records(spark, d), 3), there)


@query(f"WITH {_PLAN} SELECT catalog, name, size, action FROM plan")
def copy_plan(spark, d) -> DataFrame:
    return _plan(spark, d).select("catalog", "name", "size", "action")


@query(f"""WITH {_PLAN}, x AS (SELECT count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS total_bytes, count(*) FILTER (action <> 'skip') AS n_transferred, coalesce(sum(size) FILTER (action <> 'skip'), 0)::BIGINT AS transferred_bytes,
  count(*) FILTER (action = 'create') AS n_created, count(*) FILTER (action = 'update') AS n_updated FROM plan)
SELECT *, CASE WHEN n_transferred = 0 THEN 'No data to synchronize' ELSE CASE n_transferred WHEN 1 THEN '1 file changed' ELSE n_transferred || ' files changed' END || chr(10) || CASE transferred_bytes WHEN 1 THEN 'byte for transfer' ELSE transferred_bytes || ' bytes for transfer' END END AS status FROM x""")
def copy_summary(spark, d) -> DataFrame:
    return copyplan.copy_summary(_plan(spark, d)).withColumn("status", copyplan.status_text(F.col("n_transferred"), F.col("transferred_bytes")))


_NOW = "timestamp '1998-01-01 00:00:00'"


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def prune_candidates(spark, d) -> DataFrame:
    cached = s.table(spark, d, "lineitem").withColumn("modified", F.col("l_shipdate").cast("timestamp"))
    return copyplan.prune_candidates(cached, F.expr(_NOW), 30).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 10 = 0 OR l_shipdate >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def prune_retained(spark, d) -> DataFrame:
    cached = s.table(spark, d, "lineitem").withColumn("modified", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_shipdate").cast("timestamp")))
    return copyplan.retained(cached, F.expr(_NOW), 30).select("l_orderkey", "l_linenumber")


@query(f"WITH {s.REQUESTS} SELECT seq, file_key, CASE WHEN user_id % 3 = 0 THEN 'ram' WHEN user_id % 2 = 0 THEN 'disk' ELSE 'extract' END AS tier FROM requests")
def tier_resolution(spark, d) -> DataFrame:
    r = s.requests(spark, d).select("seq", "file_key", "user_id")
    known = lambda n: r.filter(F.col("user_id") % n == 0).select("file_key").distinct()
    return cache.resolve_tiers(r, known(3), known(2)).select("seq", "file_key", "tier")


@query(f"WITH {s.REQUESTS} SELECT file_key, min(seq) AS seq, count(*) AS n_requests FROM requests WHERE tier = 'extract' GROUP BY file_key")
def request_coalesce(spark, d) -> DataFrame:
    return cache.coalesced(s.requests(spark, d).filter("tier = 'extract'"))


@query(f"""WITH {s.FILES}, jpg AS (SELECT regexp_replace(path, '\\.[^./]+$', '.jpg') AS sidecar, doc_id FROM files WHERE doc_id % 4 = 0)
SELECT f.path, CASE WHEN f.doc_id % 5 = 0 THEN 'thumbnail' WHEN j.sidecar IS NOT NULL THEN 'sidecar' WHEN lower(f.name) LIKE '%.arw' THEN 'embedded' END AS preview
FROM files AS f LEFT JOIN jpg AS j ON regexp_replace(f.path, '\\.[^./]+$', '.jpg') = j.sidecar""")
def preview_source(spark, d) -> DataFrame:
    f = s.files(spark, d).withColumn("sidecar", text.with_extension(F.col("path"), "jpg"))
    jpg = f.filter("doc_id % 4 = 0").select("sidecar", F.lit(True).alias("has_sidecar")).distinct()
    source = F.when(F.col("doc_id") % 5 == 0, "thumbnail").when(F.col("has_sidecar"), "sidecar").when(text.is_raw(F.col("name")), "embedded")
    return f.join(jpg, "sidecar", "left").select("path", source.alias("preview"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'warning' ELSE 'normal' END AS level FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 5242880000::BIGINT AS v FROM events
  UNION ALL SELECT f.user_id, e.n, CASE e.level WHEN 'warning' THEN floor(v * 0.6::DOUBLE)::BIGINT WHEN 'critical' THEN 52428800 ELSE v END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, arg_max(v, n) AS limit_bytes FROM f GROUP BY user_id""")
def pressure_fold(spark, d) -> DataFrame:
    k = F.col("event_id") % 7
    e = s.table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(k == 0, "critical").when(k <= 2, "warning").otherwise("normal").alias("level"))
    return cache.pressure_limit(e, "user_id", 5000 * text.MIB)
