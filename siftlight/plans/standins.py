"""The supplied tables in the roles of the review engine, as DataFrames and as SQL views with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    digits = F.col("doc_id").cast("string")
    ext = F.when(F.col("doc_id") % 10 == 0, ".jpg").when(F.col("doc_id") % 10 == 1, ".arw").otherwise(".ARW")
    d = d.select("doc_id", F.col("source").alias("catalog"), F.concat(F.lit("_DSC"), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0")), ext).alias("name"),
                 F.col("n_chars").alias("size"), F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))").alias("modified"))
    d = d.withColumn("path", F.concat(F.lit("/photos/"), F.col("catalog"), F.lit("/"), F.col("name")))
    return d.withColumn("file_key", F.md5("path"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when((F.col("quality") == 0) & (F.col("toxic") == 0), None).otherwise(F.col("quality") * 3 + F.col("doc_id") % 3).cast("int")
    return table(spark, sf_dir, "labels").join(files(spark, sf_dir), "doc_id").select("catalog", "name", F.col("doc_id").alias("position"), rating.alias("rating"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with microseconds and their rank per user by time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("n", F.row_number().over(w))


def tag_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = (F.when(F.col("event_type").isin("view", "click"), "toggle").when(F.col("event_type") == "purchase", "rate")
          .when((F.col("event_type") == "error") & (F.col("event_id") % 200 == 0), "reset"))
    return e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), (F.col("user_id") % 5).cast("string").alias("catalog"), F.col("user_id").cast("string").alias("name"),
                    op.alias("op"), F.when(op == "rate", 1 + F.col("event_id") % 5).cast("int").alias("rating")).filter("op is not null")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("event_type").isin("view", "click"), "ram").when(F.col("event_type") == "signup", "disk").otherwise("extract")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.md5(F.col("user_id").cast("string")).alias("file_key"), "user_id", tier.alias("tier"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("run"), "n", "micros", (F.count("*").over(Window.partitionBy("user_id")) + 25).alias("total"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image"), *[(F.col(c) % 256).alias(k) for c, k in (("l_orderkey", "r"), ("l_partkey", "g"), ("l_suppkey", "b"))])


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("idx"), F.col("p_size").alias("width"), (F.col("p_type") != "ECONOMY").alias("jpeg"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit("/"))).when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type"))
    return events(spark, sf_dir).select(F.col("user_id").alias("output"), F.col("n").alias("line_no"), record.alias("record"))


#: The same roles in SQL.
FILES = """files AS (SELECT md5(path) AS file_key, * FROM (SELECT '/photos/' || catalog || '/' || name AS path, * FROM (
  SELECT doc_id, source AS catalog, '_DSC' || lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0')
    || CASE doc_id % 10 WHEN 0 THEN '.jpg' WHEN 1 THEN '.arw' ELSE '.ARW' END AS name,
    n_chars AS size, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS modified FROM documents)))"""
RECORDS = FILES + """, records AS (SELECT f.catalog, f.name, l.doc_id AS position,
  CASE WHEN quality = 0 AND toxic = 0 THEN NULL ELSE quality * 3 + l.doc_id % 3 END::INT AS rating
  FROM labels AS l JOIN files AS f ON l.doc_id = f.doc_id),
first_records AS (SELECT catalog, name, arg_min_null(rating, position) AS rating, true AS tagged FROM records GROUP BY ALL),
rated AS (SELECT f.*, coalesce(r.rating, 0) AS rating, coalesce(r.tagged, false) AS tagged
  FROM files AS f LEFT JOIN first_records AS r ON f.catalog = r.catalog AND f.name = r.name)"""
EVENTS = """e AS (SELECT *, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""
REQUESTS = """requests AS (SELECT event_id AS seq, md5(user_id::VARCHAR) AS file_key, user_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'ram' WHEN event_type = 'signup' THEN 'disk' ELSE 'extract' END AS tier FROM events)"""
COMPLETIONS = EVENTS + """, c AS (SELECT user_id AS run, n, micros, count(*) OVER (PARTITION BY user_id) + 25 AS total FROM e),
d AS (SELECT *, micros - lag(micros) OVER (PARTITION BY run ORDER BY n) AS delta FROM c),
m AS (SELECT *, sum(delta) OVER w::DOUBLE / nullif(count(delta) OVER w, 0) AS mean_micros FROM d
  WINDOW w AS (PARTITION BY run ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, CASE WHEN n >= 10 THEN trunc(mean_micros * (total - n) / 1e6)::BIGINT END AS eta FROM m)"""
PIXELS = "p AS (SELECT l_returnflag AS image, l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem)"
HISTOGRAM = PIXELS + """, counted AS (SELECT image, trunc(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::INT AS bin, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT f.image, q.bin::INT AS bin, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT image FROM p) AS f CROSS JOIN range(256) AS q(bin)
  LEFT JOIN counted AS c ON c.image = f.image AND c.bin = q.bin)"""
LINES = EVENTS + """, lines AS (SELECT user_id AS output, n AS line_no, CASE WHEN event_id % 7 = 0 THEN event_type || '/' WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS record,
  count(*) OVER (PARTITION BY user_id) AS total FROM e)"""
TAG_OPS = """ops AS (SELECT * FROM (SELECT epoch_us(ts) AS seq, (user_id % 5)::VARCHAR AS catalog, user_id::VARCHAR AS name, event_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'toggle' WHEN event_type = 'purchase' THEN 'rate'
       WHEN event_type = 'error' AND event_id % 200 = 0 THEN 'reset' END AS op, CASE WHEN event_type = 'purchase' THEN 1 + event_id % 5 END::INT AS rating FROM events) WHERE op IS NOT NULL),
live AS (SELECT o.* FROM ops AS o LEFT JOIN (SELECT catalog, max(seq) AS at FROM ops WHERE op = 'reset' GROUP BY catalog) AS r ON o.catalog = r.catalog
  WHERE o.op <> 'reset' AND o.seq > coalesce(r.at, -1)),
counted AS (SELECT *, sum((op = 'toggle')::INT) OVER (PARTITION BY catalog, name ORDER BY seq) AS n FROM live),
ends AS (SELECT *, max(n) OVER (PARTITION BY catalog, name) AS final FROM counted),
store AS (SELECT catalog, name, coalesce(arg_max(rating, seq) FILTER (op = 'rate' AND n = final), 3)::INT AS rating FROM ends GROUP BY catalog, name HAVING max(final) % 2 = 1)"""
