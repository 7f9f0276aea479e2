"""Centroid clustering with Elkan's bounds, in exact integers.

Vectors become integers (``floor(scale * x)``), so distances, sums and ties are exact and every order of adding gives
the same centroids. Each vector keeps an upper bound of the distance to its centroid and a lower bound for every
centroid, in a table that each round rewrites. Between rounds bounds follow the centroids' moves; a centroid is looked
at only if neither its lower bound nor half its distance from the vector's centroid shows that it is farther.

Bounds are single-precision and rounded against their use: upper bounds, moves and sums with them up, lower bounds,
their differences and half distances down. Pruning is strict (upper < lower), so a centroid at exactly the same distance
is always computed, and ties go to the smaller number. What decides in the end is the exact squared distance.

Centroids (k of them, k x components integers) travel with the tasks; sums are combined in the tasks and once more on
the map side, so a shuffle holds at most k x components rows a task, however large a cluster is.

Defined results: vectors that are null, of another length, or hold null or non-finite components have no row; equal
vectors are separate rows of the same cluster; null ids are assigned as any other and start a cluster only if too few
others are there; among rows that repeat an id the smaller vector starts first; with fewer than k vectors every one
starts a cluster; an empty table gives an empty result; other columns are not read. A component beyond ``MOST`` after
scaling raises, as an overflow does: squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .textkit import trimmed

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 16, 3, 64, 64, 1


def most(components: int) -> int:
    """The largest component whose squared distances fit 63 bits."""
    return int((((1 << 63) - 1) // components) ** 0.5 / 2) - 1


POINTS = "vec_id long, v binary"
BOUNDED = "vec_id long, v binary, cluster int, upper float, lower binary"
MOVED = "cluster int, at int, total long, n long"
FOUND = "vec_id long, cluster int, distance long"
#: Rows of a block that is compared at once.
BLOCK = 4096


def _scaled(components: int, scale: int):
    limit = most(components)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            lists = b.column("vector")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
            rows = np.flatnonzero(sizes == components)
            x = flat[(np.cumsum(sizes)[rows] - components)[:, None] + np.arange(components)] if len(rows) else np.empty((0, components))
            good = np.isfinite(x).all(1)
            x = np.floor(scale * x[good])
            if len(x) and np.abs(x).max() > limit:
                raise OverflowError(f"a component beyond {limit} after scaling: squared distances would not fit 64 bits")
            ints = x.astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows[good])), pa.array([r.tobytes() for r in ints], pa.binary())], names=["vec_id", "v"])

    return run


def up(x: np.ndarray) -> np.ndarray:
    """Single precision, never below x."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """Single precision, never above x nor below 0."""
    return np.maximum(np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x (int32) and c."""
    diff = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", diff, diff)


class Centres:
    """Centroids, half their distances from each other (rounded down) and how far they moved (rounded up)."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now.astype(np.int64)
        self.half = down(np.stack([np.sqrt(squared(self.now, c).astype(np.float64)) for c in self.now]) / 2) if len(now) else np.empty((0, 0), np.float32)
        self.moved = np.where((now == before).all(1), np.float32(0), up(np.sqrt(squared(self.now, before).astype(np.float64)))) if before is not None else None


def assign(x: np.ndarray, centres: Centres, cluster: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower for the rows of x, and how many distances were computed. Without bounds, from none."""
    n, k = len(x), len(centres.now)
    computed = 0
    if cluster is None:
        cluster, lower = np.zeros(n, np.int32), np.zeros((n, k), np.float32)
        best = squared(x, centres.now[0])
        exact = np.ones(n, bool)
        upper, lower[:, 0] = up(np.sqrt(best.astype(np.float64))), down(np.sqrt(best.astype(np.float64)))
        computed += n
    else:
        cluster, best, exact = cluster.copy(), np.zeros(n, np.int64), np.zeros(n, bool)
        upper = up(upper.astype(np.float64) + centres.moved[cluster])
        lower = down(lower.astype(np.float64) - centres.moved)
    for j in range(k):
        may = np.flatnonzero((cluster != j) & ~(upper < lower[:, j]) & ~(upper < centres.half[cluster, j]))
        loose = may[~exact[may]]
        if len(loose):  # first make the upper bound tight
            best[loose] = squared(x[loose], centres.now[cluster[loose]])
            root = np.sqrt(best[loose].astype(np.float64))
            upper[loose], lower[loose, cluster[loose]] = up(root), down(root)
            exact[loose] = True
            computed += len(loose)
            may = may[~(upper[may] < lower[may, j]) & ~(upper[may] < centres.half[cluster[may], j])]
        if not len(may):
            continue
        d = squared(x[may], centres.now[j])
        computed += len(may)
        root = np.sqrt(d.astype(np.float64))
        lower[may, j] = down(root)
        better = (d < best[may]) | ((d == best[may]) & (j < cluster[may]))
        won = may[better]
        cluster[won], best[won], upper[won] = j, d[better], up(root[better])
    return cluster, upper, lower, computed


def _vectors(b: pa.RecordBatch, components: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("v").to_pylist()), np.int32).reshape(-1, components)


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        for lo in range(0, b.num_rows, BLOCK):
            yield b.slice(lo, BLOCK)


def _bounded(centres: Centres, components: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres.now)
        for b in _blocks(parts):
            x = _vectors(b, components)
            if "upper" in b.schema.names:
                lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.float32).reshape(-1, k)
                cluster, upper, lower, _ = assign(x, centres, np.asarray(b.column("cluster")), np.asarray(b.column("upper")), lower)
            else:
                cluster, upper, lower, _ = assign(x, centres)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()), pa.array([r.tobytes() for r in lower], pa.binary())], names=[f.split()[0] for f in BOUNDED.split(", ")])

    return run


def _sums(k: int, components: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, components), np.int64), np.zeros(k, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(k, dtype=np.int32), components)), pa.array(np.tile(np.arange(components, dtype=np.int32), k)), pa.array(total.ravel()), pa.array(np.repeat(n, components))], names=["cluster", "at", "total", "n"])

        for b in _blocks(parts):
            x, cluster = _vectors(b, components), np.asarray(b.column("cluster"))
            for j in np.unique(cluster).tolist():
                mine = cluster == j
                total[j] += x[mine].astype(np.int64).sum(0)
                n[j] += int(mine.sum())
            if n.sum() > 1 << 31:  # sums stay far from 63 bits
                yield out()
                total[:], n[:] = 0, 0
        if n.any():
            yield out()

    return run


def _distances(centres: Centres, components: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(parts):
            cluster = np.asarray(b.column("cluster"))
            d = squared(_vectors(b, components), centres.now[cluster])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def starts(points: DataFrame, k: int, components: int, seed: int = SEED) -> np.ndarray:
    """The first k vectors by the hash of their ids (nulls last)."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(mark.asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.frombuffer(r.v, np.int32) for r in rows], np.int64).reshape(-1, components)


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for the kept vectors, and the final centroids."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    points = written(v.mapInArrow(trimmed(_scaled(components, scale)), POINTS), "centroid-points")
    now = starts(points, k, components, seed)
    if not len(now):
        return spark.createDataFrame([], FOUND), []
    centres = Centres(now)
    for _ in range(rounds):
        held = written(points.mapInArrow(trimmed(_bounded(centres, components)), BOUNDED), "centroid-bounds")
        discard(points)
        points = held
        moved = points.mapInArrow(trimmed(_sums(len(now), components)), MOVED).groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        after = now.copy()
        for r in moved.collect():  # k x components rows
            if r.n:
                after[r.cluster, r.at] = int(r.total) // r.n
        centres, now = Centres(after, now), after
    held = points.mapInArrow(trimmed(_bounded(centres, components)), BOUNDED)
    return written(held.mapInArrow(trimmed(_distances(centres, components)), FOUND), "centroid-found"), now.tolist()


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found, centroids = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    totals = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    of_cluster = [(i, n, sum(totals.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, n in totals.items()]
    known = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Every round spelled out: all distances, smallest first, sums floored."""
    floor = "(CASE WHEN s % n <> 0 AND s < 0 THEN s // n - 1 ELSE s // n END)"
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true))",
        "c0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS j, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h LIMIT 16))",
    ]
    for r in range(4):
        parts.append(f"d{r} AS MATERIALIZED (SELECT vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)")
        if r < 3:
            parts.append(f"s{r} AS (SELECT j, p, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, 65)) AS p FROM d{r}) GROUP BY j, p)")
            parts.append(f"m{r} AS (SELECT j, list({floor}::BIGINT ORDER BY p) AS c FROM s{r} GROUP BY j)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM d3 JOIN c3 USING (j)"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE = {"op13_centroid_clustering": _oracle()}
