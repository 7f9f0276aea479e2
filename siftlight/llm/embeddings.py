"""Embedding near-dedup: randomised-rotation binary codes with correction factors.

A unit vector x is rotated and its signs are kept as a code: c = sign(Rx) / sqrt(d), with the correction factor
f = <c, Rx>. For another vector y, <c, Ry> / f estimates <x, y> without bias; its error is about
sqrt((1 - f^2) / f^2 / (d - 1)), so ``SIGMAS`` times that bounds it. In place of Ry stand its values in 15 steps, rounded
up or down at random, so that the estimate stays unbiased; what the steps add to the error is in the bound. Code (a bit
for each dimension), factor and steps (four bits) are computed once and stored with the vector.

Which pairs are looked at: sign bits of independent rotations, cut into bands of ``k`` bits, bring vectors together;
k grows with the logarithm of the number of vectors, so a bucket keeps its size, and the number of bands follows from
the recall asked at the threshold (``recall``; a pair above it is found more surely). A bucket beyond ``TILE`` vectors is
dealt as pairs of blocks. Codes, factors and steps alone travel to the buckets. Where a bound reaches the threshold the
two vectors are open: open vectors, and no others, are fetched once for each bucket (or pair of blocks) they are open in,
and recomputed exactly there, in double precision. A pair is counted in the first band that its vectors share, so links
need no pair table.

Defined results: equal vectors are one class that is compared once and counted with its size; vectors of different
lengths never link; null, empty or zero vectors and vectors with null or non-finite components link with nothing; rows
that repeat an id share its component; null ids count as links and name a group only if no id is there (component
null, kept); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parallelism, written
from .components import components
from .grouped import by_group

COSINE = 0.9
RECALL = 0.997
BUCKET = 50
SIGMAS = 4.0
TILE = 1024
#: Rows of a bucket list that may be broadcast.
SHORT_LIST = 20_000
SEED = 8
#: Estimates are made in single precision; what that may cost is added to their bounds.
ROUNDING = 1e-4


def rotation(d: int, k: int, seed: int = SEED) -> np.ndarray:
    """The k-th random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d, k]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits in a band, bands) for n vectors."""
    same = 1 - math.acos(cosine) / math.pi
    k = min(62, max(4, round(math.log2(max(n, 1) / bucket)) if n > bucket else 4))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - same**k))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


KEYED = "rid long, dim int, keys array<long>"


def _keys(k: int, bands: int, kind: type):
    """The band keys of each vector, computed once: where a pair is counted must not hang on how products are rounded."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        for b in parts:
            vecs = [np.frombuffer(v.as_buffer(), kind) for v in b.column("vec")]
            dims = np.array([len(v) for v in vecs])
            keys = np.zeros((len(vecs), bands), np.int64)
            for d in np.unique(dims).tolist():
                if d not in turned:
                    turned[d] = np.concatenate([rotation(d, 1 + i) for i in range(-(-k * bands // d))])[:k * bands]
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), 256):
                    some = at[lo:lo + 256]
                    bits = unit(np.stack([vecs[i] for i in some])) @ turned[d].T > 0
                    keys[some] = (bits.reshape(len(some), bands, k).astype(np.int64) << np.arange(k)).sum(2)
            offsets = pa.array(np.arange(0, (len(vecs) + 1) * bands, bands), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(dims, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["rid", "dim", "keys"])

    return run


TILED = ["dim", "band", "key", "b1", "b2"]
OPEN = "dim int, band int, key long, b1 int, b2 int, rid long, side int"
LINKED = "rid long, other long, weight long"


def _open(cosine: float):
    """The vectors of whole buckets (or tiles) that are open: with some other, a bound reaches the threshold."""

    def run(b: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        side, dims = np.asarray(b.column("side")), np.asarray(b.column("dim"))
        factor, scale = (np.asarray(b.column(c)).astype(np.float32) for c in ("factor", "scale"))
        hit = np.zeros(b.num_rows, bool)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if z - a < 2:
                continue
            d = int(dims[a])
            packed = lambda c: np.frombuffer(b"".join(b.column(c).slice(a, z - a).to_pylist()), np.uint8).reshape(z - a, -1)  # noqa: E731, B023
            code = 2 * np.unpackbits(packed("code"), axis=1)[:, :d].astype(np.float32) - 1
            f, step = factor[a:z], scale[a:z]
            turned = unpacked(packed("steps"), d) * step[:, None]
            of_code = (1 - f * f) / (f * f) / max(1, d - 1)
            of_steps = step * step / (f * f)[:, None] / 4  # a step up or down: half of it at most, as a deviation
            error = SIGMAS * np.sqrt(np.maximum(0, of_code)[:, None] + of_steps) + ROUNDING
            near = code @ turned.T / (f[:, None] * math.sqrt(d)) + error >= cosine
            near |= near.T
            np.fill_diagonal(near, False)
            if side[a:z].any():  # a tile of two blocks: pairs inside one block belong to its own tile
                near &= side[a:z][:, None] != side[a:z][None, :]
            hit[a:z] = near.any(1)
        take = pa.array(np.flatnonzero(hit))
        yield b.select([f.split()[0] for f in OPEN.split(", ")]).take(take)

    return run


def _compare(cosine: float, kind_of: type):
    """Links of whole buckets (or tiles) between their open vectors: per vector one row with the summed weight, and one
    edge that keeps the tile's groups together."""

    def run(b: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        rid, weight, band, side = (np.asarray(b.column(c)) for c in ("rid", "weight", "band", "side"))
        dims = np.asarray(b.column("dim"))
        flat, ends = np.asarray(b.column("keys").flatten()), np.append(0, np.cumsum(np.asarray(b.column("keys").value_lengths())))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if z - a < 2:
                continue
            d, m, t = int(dims[a]), z - a, int(band[a])
            x = unit(np.frombuffer(b"".join(b.column("vec").slice(a, m).to_pylist()), kind_of).reshape(-1, d))
            keys = flat[ends[a]:ends[z]].reshape(m, -1)
            # A product of all with all is near enough to leave out what is clearly apart; the rest is summed pair by pair.
            i, j = np.nonzero(np.triu(x @ x.T >= cosine - ROUNDING, 1))
            if side[a:z].any():
                across = side[a:z][i] != side[a:z][j]
                i, j = i[across], j[across]
            for lo in range(0, len(i), 200_000):
                p, q = i[lo:lo + 200_000], j[lo:lo + 200_000]
                new = ~(keys[p, :t] == keys[q, :t]).any(1) if t else np.ones(len(p), bool)
                p, q = p[new], q[new]
                real = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[real], q[real]
                if not len(p):
                    continue
                w, ids = weight[a:z], rid[a:z]
                links = np.bincount(p, w[q], m) + np.bincount(q, w[p], m)
                label = np.arange(m)
                while True:  # smallest label among the linked, until nothing changes
                    nxt = label.copy()
                    np.minimum.at(nxt, p, label[q])
                    np.minimum.at(nxt, q, label[p])
                    nxt = nxt[nxt]
                    if (nxt == label).all():
                        break
                    label = nxt
                hit = np.flatnonzero(links)
                out.append((ids[hit], ids[label[hit]], links[hit].astype(np.int64)))
        cols = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else ([], [], []))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rid", "other", "weight"])

    return run


#: Steps on either side of zero, in four bits.
MOST_STEPS = 7


def stepped(turned: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows as whole steps from -7 to 7, two in a byte, and the size of a step; rounded at random, so right on average."""
    size = np.abs(turned).max(1) / MOST_STEPS
    steps = np.clip(np.floor(turned / size[:, None] + rng.random(turned.shape)), -MOST_STEPS, MOST_STEPS).astype(np.int64) + MOST_STEPS
    even = np.pad(steps, ((0, 0), (0, steps.shape[1] % 2))).astype(np.uint8)
    return even[:, ::2] << 4 | even[:, 1::2], size


def unpacked(packed: np.ndarray, d: int) -> np.ndarray:
    return np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)[:, :d].astype(np.float32) - MOST_STEPS


UNITS = "vec_id long, vec binary, name string, code binary, factor double, steps binary, scale double"


def _units(kind: type):
    """Rows with a usable vector get it as ``kind``, with the name of its direction, its code and its factor; others nulls."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for b in parts:
            lists = b.column("embedding")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            vec, name, code, factor, steps, scale = ([None] * len(sizes) for _ in range(6))
            for d in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == d)
                raw = values[(ends[rows] - d)[:, None] + np.arange(d)].astype(kind)
                most = np.abs(raw).max(1)
                good = np.isfinite(most) & (most > 0)
                raw = raw[good]
                x = unit(raw)
                if d not in turn:
                    turn[d] = rotation(d, 0)
                turned = x @ turn[d].T
                bits, f = np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(d)
                packed, size = stepped(turned, np.random.default_rng([SEED, d])) if len(turned) else ([], [])
                for j, i in enumerate(rows[good].tolist()):
                    vec[i], name[i], code[i], factor[i] = raw[j].tobytes(), hashlib.sha256(x[j].tobytes()).hexdigest(), bits[j].tobytes(), float(f[j])
                    steps[i], scale[i] = packed[j].tobytes(), float(size[j])
            cols = [pa.array(c, t) for c, t in ((vec, pa.binary()), (name, pa.string()), (code, pa.binary()), (factor, pa.float64()), (steps, pa.binary()), (scale, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), *cols], names=[f.split()[0] for f in UNITS.split(", ")])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.elementType == T.FloatType()
    kind = np.float32 if single else np.float64
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("embedding"))
    units = written(v.mapInArrow(_units(kind), UNITS), "embedding-units")
    classes = units.filter("vec is not null").groupBy("name").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"), F.first(F.struct("vec", "code", "factor", "steps", "scale")).alias("r")).select("name", "least_id", "size", "r.*")
    classes = written(classes.withColumn("rid", F.monotonically_increasing_id()), "embedding-classes")
    k, bands = plan(classes.count(), cosine, recall)
    keys = written(classes.select("rid", "vec").mapInArrow(_keys(k, bands, kind), KEYED), "embedding-keys")
    banded = keys.select("rid", "dim", F.posexplode("keys").alias("band", "key"))
    bucket = ["dim", "band", "key"]
    # Most buckets are one block. The list of the others is joined in: as a broadcast while it is short, else by key.
    large = written(banded.groupBy(*bucket).count().filter(F.col("count") > tile).select(*bucket, F.ceil(F.col("count") / tile).cast("int").alias("blocks")), "embedding-buckets")
    known = F.broadcast(large) if large.count() <= SHORT_LIST else large
    coded = keys.join(classes.select("rid", "code", "factor", "steps", "scale"), "rid").select("rid", "dim", "code", F.col("factor").cast("float").alias("factor"), "steps", F.col("scale").cast("float").alias("scale"), F.posexplode("keys").alias("band", "key"))
    dealt = coded.join(known, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("rid"), "blocks").cast("int")
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select(
        *bucket, F.least(mine, "k").alias("b1"), F.greatest(mine, "k").alias("b2"), "rid", "code", "factor", "steps", "scale",
        F.when(F.col("blocks") == 1, 0).when(F.col("k") == mine, 0).otherwise(F.when(mine > F.col("k"), 2).otherwise(1)).alias("side"))
    opened = written(by_group(dealt, parallelism(spark), TILED, OPEN, _open(cosine)), "embedding-open")
    full = opened.join(classes.select("rid", F.col("size").alias("weight"), "vec"), "rid").join(keys.select("rid", "keys"), "rid")
    found = written(by_group(full, parallelism(spark), TILED, LINKED, _compare(cosine, kind)), "embedding-links")
    links = found.groupBy("rid").agg(F.sum("weight").alias("links"))
    groups = components(found.select(F.col("rid").alias("u"), F.col("other").alias("v")))
    ids = groups.withColumnRenamed("node", "rid").join(classes.select("rid", "least_id"), "rid")
    group_ids = ids.groupBy("component").agg(F.min("least_id").alias("group_id"))
    of_class = classes.select("rid", "name", "size", "least_id").join(links, "rid", "left").join(ids.select("rid", "component"), "rid", "left").join(group_ids, "component", "left")
    of_class = of_class.select("name", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("group_id", "least_id").alias("component_id"))
    out = units.select("vec_id", "name").join(of_class, "name", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
ORACLE = {
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT a, w FROM reach JOIN links ON u = b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n ON u = vec_id""",
}
