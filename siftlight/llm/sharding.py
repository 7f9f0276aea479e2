"""Sharding by a k-d tree over document metadata: leaves of equal bytes.

The root holds all documents. A node that shall become k leaves is cut along its widest dimension, its extent measured
against the root's, at the weighted median: the point with floor(k/2) of k parts of its bytes before it. Documents stand
in the order of that dimension, ties by id and then by row, so a cut falls between any two documents, even if a third of
them have the same metadata; a document goes to the side on which its middle byte lies. Leaves are reached when a node
is one part, so their sizes differ from each other by less than a few documents. Rows are balanced by bytes and nothing
else: equal texts may part.

Medians are distributed: a round counts the bytes of each node in up to 2^BITS buckets of the dimension's next bits and
keeps the bucket that holds the cut, until it is one row; no sort, and no more rows than nodes x buckets leave a task's
count. All nodes of a level are cut in the same rounds. The tree (a row per cut) routes documents; a document's numeric
metadata, id and size are all that travels.

Defined results: a null text has no bytes and size 1, as an empty one; null metadata and null ids come first in their
dimensions; texts are placed in a dimension by their first seven bytes; ties and repeated rows are told apart by row;
a tree over fewer documents than leaves leaves leaves empty, an empty table gives an empty result; a text longer than a
leaf fills it alone; extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, parallelism, written

SHARDS = 8
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")
#: Buckets of a node in one round of its median: 2^BITS.
BITS = 12
#: Nodes that may be sent to every task beside the documents.
SHORT_LIST = 20_000
LEAST = -(1 << 63)


def place(name: str, kind: T.DataType) -> Column:
    """A column as a place in its dimension: numbers and times as whole numbers, other values by their first seven bytes; nulls first."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        at = c.cast("long")
    elif isinstance(kind, T.TimestampType):
        at = F.unix_micros(c)
    elif isinstance(kind, T.DateType):
        at = F.unix_date(c).cast("long")
    else:
        return F.coalesce(F.conv(F.rpad(F.substring(F.hex(F.encode(c.cast("string"), "utf-8")), 1, 14), 14, "0"), 16, 10).cast("long"), F.lit(-1))
    return F.coalesce(at, F.lit(LEAST))


def _value(n_dims: int) -> Column:
    return F.element_at(F.array(*[F.col(f"v{d}") for d in range(n_dims)]), F.col("dim") + 1)


def _beside(rows: DataFrame, nodes: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Rows with their node; the list of n nodes goes to every task while it is short."""
    return rows.join(F.broadcast(nodes) if n <= SHORT_LIST else nodes, "node", how)


def _searches(nodes: DataFrame, n_dims: int) -> DataFrame:
    """Nodes of several parts, their widest dimension and its extent: ``kl`` of ``k`` parts go to the left."""
    def width(d: int) -> Column:
        return F.when(F.col(f"root{d}") > 0, (F.col(f"hi{d}").cast("double") - F.col(f"lo{d}").cast("double")) / F.col(f"root{d}")).otherwise(F.lit(0.0))

    widths = F.array(*[width(d) for d in range(n_dims)])
    wide = nodes.filter("k > 1").withColumn("dim", (F.array_position(widths, F.array_max(widths)) - 1).cast("int"))
    pick = lambda side: F.element_at(F.array(*[F.col(f"{side}{d}") for d in range(n_dims)]), F.col("dim") + 1)
    return wide.select(
        "node", "dim", "bytes", "k", F.floor(F.col("k") / 2).cast("int").alias("kl"), F.lit(0).alias("part"), pick("lo").alias("lo"), pick("hi").alias("hi"),
        *[F.lit(None).cast("long").alias(f"at{i}") for i in range(3)], F.lit(0).cast("long").alias("below"), F.lit(False).alias("found"), F.lit(None).cast("boolean").alias("with_it"))


def _round(rows: DataFrame, searches: DataFrame, n: int, n_dims: int) -> DataFrame:
    """Every search narrowed to the bucket that holds its cut; one that is down to a row is found.

    ``part`` tells which key is searched: 0 the dimension, 1 the id, 2 the row; ``at0`` to ``at2`` are what is settled.
    """
    here = _beside(rows, searches, n).withColumn("value", _value(n_dims)).filter("(part = 0 OR value = at0) AND (part < 2 OR id = at1)")
    here = here.withColumn("x", F.expr("CASE part WHEN 0 THEN value WHEN 1 THEN id ELSE rid END")).filter("lo IS NULL OR x BETWEEN lo AND hi")
    # With the sign flipped, longs are ordered by their bits; the buckets are the BITS below those that lo and hi share.
    spread = F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi"))))
    shift = F.when(F.col("lo").isNull(), 64 - BITS).otherwise(F.greatest(F.lit(0), spread - BITS))
    bucket = F.call_function("shiftrightunsigned", F.col("x").bitwiseXOR(F.lit(LEAST)), shift.cast("int"))
    counted = here.groupBy("node", bucket.alias("bucket")).agg(F.sum("size").alias("held"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.count("*").alias("n"))
    run = counted.join(searches.drop("lo", "hi", "found", "with_it"), "node").withColumn("upto", F.col("below") + F.expr("sum(held) OVER (PARTITION BY node ORDER BY bucket)"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    passed = run.filter(big("upto") * F.col("k") > big("bytes") * F.col("kl"))
    at = passed.groupBy("node").agg(F.min_by(F.struct(*[c for c in run.columns if c != "node"]), "bucket").alias("r")).select("node", "r.*").withColumn("below", F.col("upto") - F.col("held"))
    single = F.col("x_lo") == F.col("x_hi")
    settled = [F.when(single & (F.col("part") == i), F.col("x_lo")).otherwise(F.col(f"at{i}")).alias(f"at{i}") for i in range(3)]
    return at.select(
        "node", "dim", "bytes", "k", "kl", F.when(single, F.col("part") + 1).otherwise(F.col("part")).alias("part"), F.when(~single, F.col("x_lo")).alias("lo"), F.when(~single, F.col("x_hi")).alias("hi"),
        *settled, "below", (F.col("n") == 1).alias("found"), ((2 * big("below") + F.col("held")) * F.col("k") <= 2 * big("bytes") * F.col("kl")).alias("with_it"))


CUT = ["node", "dim", "at0", "at1", "at2", "with_it"]


def _cuts(rows: DataFrame, nodes: DataFrame, n_dims: int) -> DataFrame:
    """For each node of several parts the document at its cut, by dimension (``at0``), id (``at1``) and row (``at2``), as
    far as it takes to tell it from others, and whether it goes left."""
    searches, found = _searches(nodes, n_dims), []
    while n := searches.count():
        found.append(written(_round(rows, searches, n, n_dims), "shard-search"))
        searches = found[-1].filter("NOT found")
    cuts = found[0].filter("found").select(*CUT)
    for f in found[1:]:
        cuts = cuts.union(f.filter("found").select(*CUT))
    cuts = written(cuts, "shard-cuts")
    for f in found:
        discard(f)
    return cuts


def route(rows: DataFrame, cuts: DataFrame, n: int, n_dims: int) -> DataFrame:
    """Rows moved one level (n cuts) down the tree: a node's children are 2 node + 1 and 2 node + 2; a leaf's only child is the first."""
    value, known = _value(n_dims), F.col("dim").isNotNull()
    same_id, here = F.col("at1").isNull() | (F.col("id") == F.col("at1")), F.col("at2").isNull() | (F.col("rid") == F.col("at2"))
    behind = (F.col("id") > F.col("at1")) | (same_id & ((F.col("rid") > F.col("at2")) | (here & ~F.col("with_it"))))
    right = known & ((value > F.col("at0")) | ((value == F.col("at0")) & F.coalesce(behind, F.lit(False))))
    kl = F.floor(F.col("k") / 2).cast("int")
    moved = _beside(rows, cuts, n, "left").withColumn("right", F.coalesce(right, F.lit(False)))
    return moved.select(
        *[c for c in rows.columns if c not in ("node", "k", "first")], (F.col("node") * 2 + F.when(F.col("right"), 2).otherwise(1)).alias("node"),
        F.when(F.col("k") == 1, 1).when(F.col("right"), F.col("k") - kl).otherwise(kl).alias("k"), F.when(F.col("right"), F.col("first") + kl).otherwise(F.col("first")).alias("first"))


def assign(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dimensions: Sequence[str] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, size, text_crc32, shard, slot, and the columns in ``carry``) and the tree (level, and a row per cut).

    ``target_bytes`` in place of ``shards`` asks for as many leaves as the bytes need. Slots count a shard's documents
    from 0 in the order of ids. Carried columns are written with the ids at once and moved once, to their slots.
    """
    n_dims = len(dimensions)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ids = F.col(f"`{id_col}`").cast("long")
    base = docs.select(
        ids.alias("doc_id"), F.coalesce(ids, F.lit(LEAST)).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        *[place(c, docs.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(dimensions)], *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    base = written(base.withColumns({"rid": F.monotonically_increasing_id(), "node": F.lit(0).cast("long"), "first": F.lit(0)}), "shard-rows")
    spans = [f(f"v{i}").alias(f"{side}{i}") for i in range(n_dims) for side, f in (("lo", F.min), ("hi", F.max))]
    whole = base.agg(F.sum("size").alias("bytes"), *spans).first()
    leaves = 1 if not whole.bytes else shards or max(1, -(-whole.bytes // max(1, target_bytes)))
    roots = {f"root{i}": F.lit(float(whole[f"hi{i}"]) - float(whole[f"lo{i}"]) if whole.bytes else 0.0) for i in range(n_dims)}
    levels: list[tuple[DataFrame, int]] = []
    rows, narrow = base.drop("carried").withColumn("k", F.lit(leaves)), None
    while True:
        nodes = written(rows.groupBy("node", "k").agg(F.sum("size").alias("bytes"), *spans).withColumns(roots), "shard-nodes")
        n = nodes.filter("k > 1").count()
        if not n:
            break
        levels.append((_cuts(rows, nodes, n_dims), n))
        moved = written(route(rows, *levels[-1], n_dims), "shard-rows")
        discard(nodes)
        if narrow is not None:
            discard(narrow)
        rows = narrow = moved
    if carry:
        rows = base.withColumn("k", F.lit(leaves))
        for cuts, n in levels:
            rows = route(rows, cuts, n, n_dims)
    tree = docs.sparkSession.createDataFrame([], "level int, node long, dim int, at0 long, at1 long, at2 long, with_it boolean")
    for level, (cuts, _) in enumerate(levels):
        tree = tree.union(cuts.select(F.lit(level).alias("level"), *CUT))
    return _numbered(rows, carry), tree


def _numbered(rows: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Slots: ranges of (shard, id, row) are sorted apart; what precedes a range in its shard is added to its own count."""
    placed = rows.select("doc_id", "size", "text_crc32", F.col("first").cast("int").alias("shard"), "id", "rid", *(["carried"] if carry else []))
    ranged = placed.repartitionByRange(parallelism(rows.sparkSession), "shard", "id", "rid").sortWithinPartitions("shard", "id", "rid")
    ordered = written(ranged.withColumns({"range": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), "shard-order")
    ends = ordered.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("line").alias("from"))
    before = ends.withColumn("before", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY range) - n")).select("shard", "range", (F.col("before") - F.col("from")).alias("shift"))
    before = written(before, "shard-shifts")  # ranges and shards at most
    slots = ordered.join(F.broadcast(before) if before.count() <= SHORT_LIST else before, ["shard", "range"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("line") + F.col("shift")).alias("slot"), *[F.col(f"carried.`{c}`") for c in carry])


def write_shards(assigned: DataFrame, path: str) -> None:
    """A folder for each shard, its documents in order of slot."""
    assigned.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    assigned, _ = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return assigned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    """The same tree by sorting: three levels of running bytes."""
    text = "coalesce(('0x' || rpad(substr(hex({c}), 1, 14), 14, '0'))::BIGINT, -1)"
    dims = [text.format(c="lang"), text.format(c="source"), "coalesce(n_chars, -9223372036854775808)", "coalesce(doc_id, -9223372036854775808)"]
    parts = [f"t0 AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text, {', '.join(f'{d} AS v{i}' for i, d in enumerate(dims))}, 0 AS node FROM documents)",
             f"r AS (SELECT {', '.join(f'max(v{i})::DOUBLE - min(v{i})::DOUBLE AS r{i}' for i in range(4))} FROM t0)"]
    for level in range(3):
        k = SHARDS >> level
        width = [f"(CASE WHEN r{i} > 0 THEN (hi{i}::DOUBLE - lo{i}::DOUBLE) / r{i} ELSE 0 END)" for i in range(4)]
        parts.append(f"n{level} AS (SELECT node, sum(size) AS bytes, {', '.join(f'max(v{i}) AS hi{i}, min(v{i}) AS lo{i}' for i in range(4))} FROM t{level} GROUP BY node)")
        parts.append(f"w{level} AS (SELECT node, bytes, list_position([{', '.join(width)}], greatest({', '.join(width)})) AS dim FROM n{level}, r)")
        parts.append(f"s{level} AS (SELECT t.*, bytes, [v0, v1, v2, v3][dim] AS v FROM t{level} AS t JOIN w{level} USING (node))")
        parts.append(f"b{level} AS (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY v, v3 ROWS UNBOUNDED PRECEDING) - size AS before FROM s{level})")
        parts.append(f"t{level + 1} AS (SELECT doc_id, size, text, v0, v1, v2, v3, 2 * node + ((2 * before + size) * {k} > 2 * bytes * {k // 2})::INT AS node FROM b{level})")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, size, 'bytes' AS law, node::INT AS shard, (row_number() OVER (PARTITION BY node ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS text_crc32 FROM t3"""


QUERIES = {"op12_sharding": op12_sharding}
ORACLE = {"op12_sharding": _oracle()}
