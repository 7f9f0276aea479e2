"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, components.

1. Each text becomes its set of distinct word shingles (64-bit names), its minima and their band keys.
   Texts with equal sets (128-bit digest) are one class, represented by the smallest id.
2. Representatives that share a band key meet in a bucket. Signatures (8 bits of each mixed minimum) estimate the Jaccard
   similarity; inside a bucket a search from one document to the next links what may be similar (five standard
   deviations below the threshold) without forming all pairs. Buckets of more than ``TILE`` members never meet in one
   task: each member is tied to the bucket's smallest row id, which keeps them in one component, so step 3 decides.
3. Components of these candidates (large-star, small-star) are confirmed on full sets, fetched once per candidate:
   again a search, whose every link has the exact similarity. Candidates of more than ``TILE`` documents or
   ``TILE_BYTES`` of sets first meet their head, the smallest row of the group, each by itself. Those that link with it
   are one group by that, and need not meet each other; only the rest are dealt in blocks, with each other and with the
   blocks of the linked. So no task holds a whole hot group, no link between groups is lost, and a group of near copies
   of one text costs one comparison a document, however large it is.
4. Components of the confirmed links name the groups.

Bands follow from the threshold: a pair at exactly that similarity shares none with a probability of at most ``MISS``.
At 85 percent these are 24 bands of 5 minima, at 80 percent 35; low thresholds get shorter bands.

Defined results: ASCII letters are lower-cased; a null or blank text has an empty set and is linked with nothing; fewer
words than a shingle make one shingle; rows that repeat an id are separate rows with equal ids; null ids come last in
order and name their group only if no id is there (component null, kept); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import NULL_ID, Texts, id_column, pack, rows_of
from .common import parallelism, written
from .components import components
from .grouped import by_group
from .textkit import LOWER, U, Spans, mix, pad, squeeze, trimmed, unsqueeze, word_names, words

SHINGLE = 5
PERCENT = 85
MISS = 1e-6
#: Minima of a band, and the number of bands beyond which bands get shorter instead.
MOST_ROWS, MANY_BANDS = 5, 128
TILE = 1500
#: Bytes of sets in a block, on average; a tile holds two blocks.
TILE_BYTES = 8 << 20
_SALT = U(0x5EED0005)


def banding(percent: int) -> tuple[int, int]:
    """Minima of a band, and bands, that a pair at the similarity threshold shares but for ``MISS``."""
    if not 0 < percent <= 100:
        raise ValueError("percent: above 0, at most 100")
    for rows in range(MOST_ROWS, 0, -1):
        apart = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(MISS) / math.log(apart)) if apart else 1
        if bands <= MANY_BANDS:
            break
    return rows, bands


@functools.cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of n universal hashes."""
    rng = np.random.default_rng(85)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def shingle_sets(batch: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of every document end to end (sorted inside a document), and the documents' bounds."""
    padded, bounds = pad(LOWER[batch.data], batch.offsets)
    starts, ends = words(padded)
    first = np.searchsorted(starts, bounds)
    count = np.diff(first)
    spans = Spans(mix(word_names(padded, starts, ends) ^ _SALT))
    full = spans.fixed(size)
    sets, at = [], [0]
    for a, n in zip(first[:-1].tolist(), count.tolist(), strict=True):
        if n >= size:
            s = np.unique(full[a:a + n - size + 1])
        elif n:
            s = spans.of(np.array([a]), np.array([a + n]))
        else:
            s = np.empty(0, U)
        sets.append(s)
        at.append(at[-1] + len(s))
    return (np.concatenate(sets) if sets else np.empty(0, U)), np.array(at)


def signatures(names: np.ndarray, bounds: np.ndarray, n_hashes: int) -> np.ndarray:
    """Minima of the universal hashes a*x+b mod 2^64 over each (non-empty) set: one row per set."""
    factor, summand = _hashes(n_hashes)
    out = np.empty((len(bounds) - 1, n_hashes), U)
    lo = 0
    while lo < len(bounds) - 1:  # some documents at a time, so that the work stays in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 16384, "right")) - 1)
        hi = min(hi, len(bounds) - 1)
        x, cuts = names[bounds[lo]:bounds[hi]], bounds[lo:hi] - bounds[lo]
        y = np.empty_like(x)
        for k in range(n_hashes):
            np.multiply(x, factor[k], out=y)
            y += summand[k]
            out[lo:hi, k] = np.minimum.reduceat(y, cuts)
        lo = hi
    return out


SIGNED = "bid long, place long, doc_id long, n long, digest binary, sig binary, bands array<long>"


def _sign(size: int, percent: int):
    per_band, bands = banding(percent)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            batch = Texts(row)
            names, at = shingle_sets(batch, size)
            n = np.diff(at)
            full = np.flatnonzero(n)
            sig = np.zeros((len(n), per_band * bands), U)
            if len(full):
                sig[full] = signatures(names, np.append(at[:-1][full], at[-1]), per_band * bands)
            low = np.ascontiguousarray((mix(sig) >> U(56)).astype(np.uint8))  # minima of long sets are near 0: mixed first
            keys = mix(sig ^ U(0xBA4D)).reshape(len(n), bands, per_band)
            band = np.zeros((len(n), bands), U)
            for r in range(per_band):
                band = mix(band * U(31) + keys[:, :, r])
            band = mix(band + np.arange(bands, dtype=U))
            raw = memoryview(np.ascontiguousarray(names)).cast("B")
            digest = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            offsets = pa.array(np.arange(0, (len(n) + 1) * bands, bands), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), row["bid"])), pa.array(np.arange(len(n))), id_column(batch.ids), pa.array(n, pa.int64()),
                pa.array(digest, pa.binary()), pa.array([s.tobytes() for s in low], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(band.view(np.int64).ravel())),
            ], names=[f.split()[0] for f in SIGNED.split(", ")])
    return run


def _threshold(percent: int) -> float:
    """The lowest share of equal signature bytes that a pair at the similarity threshold may show."""
    s, n = percent / 100, math.prod(banding(percent))
    share = s + (1 - s) / 256
    return share - 5 * (share * (1 - share) / n) ** 0.5


def _search(m: int, linked) -> list[tuple[int, int]]:
    """Edges of a spanning forest of m documents: linked(i, rest) tells which of ``rest`` link with i."""
    rest, edges = np.arange(m), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            edges += [(i, int(j)) for j in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def _bucket_edges(percent: int):
    n_hashes = math.prod(banding(percent))
    least = _threshold(percent) * n_hashes

    def run(b: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        rid = np.asarray(b.column("rid"))
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, n_hashes)
        head = np.repeat(bounds[:-1], np.diff(bounds))
        near = np.concatenate([(sig[a:a + 8192] == sig[head[a:a + 8192]]).sum(1) for a in range(0, len(sig), 8192)]) >= least
        own = np.arange(len(head)) == head
        pairs = [np.stack([head[near & ~own], np.flatnonzero(near & ~own)])]
        odd = np.add.reduceat((~near).astype(np.int64), bounds[:-1]) > 0
        for g in np.flatnonzero(odd & (np.diff(bounds) > 2)):
            a, z = bounds[g], bounds[g + 1]
            s = sig[a:z]
            found = _search(z - a, lambda i, rest: (s[rest] == s[i]).sum(1) >= least)  # noqa: B023
            if found:
                pairs.append(np.array(found).T + a)
        u, v = np.concatenate(pairs, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(rid[u]), pa.array(rid[v])], names=["u", "v"])
    return run


def _fetch(size: int):
    """The full sets of the wanted places of a batch, each once; a batch never asks for more than its own documents."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            names, at = shingle_sets(Texts(row), size)
            want = row["wanted"]
            for k in range(0, len(want), 500):
                some = want[k:k + 500]
                yield pa.RecordBatch.from_arrays([
                    pa.array([w["rid"] for w in some], pa.int64()), pa.array([w["component"] for w in some], pa.int64()),
                    pa.array([squeeze(names[at[w["place"]]:at[w["place"] + 1]]) for w in some], pa.binary()),
                ], names=["rid", "component", "names"])
    return run


#: Bytes of heads that may be sent to every task.
HEAD_BYTES = 32 << 20


def _headed(sets: DataFrame, percent: int) -> DataFrame:
    """(rid, component, n, linked): the size of each set and whether it links with its component's head, the row that
    names the component."""
    heads = sets.filter("rid = component").select("component", F.col("names").alias("head"))
    held = heads.agg(F.sum(F.length("head"))).first()[0] or 0

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, np.ndarray] | None = None
        for b in parts:
            component, n, linked = b.column("component").to_pylist(), [], []
            for i, c in enumerate(component):
                if known is None or known[0] != c:
                    known = c, unsqueeze(b.column("head")[i].as_py(), np.uint64)
                head, own = known[1], unsqueeze(b.column("names")[i].as_py(), np.uint64)
                at = np.minimum(np.searchsorted(head, own), len(head) - 1)
                both = int((head[at] == own).sum())
                n.append(len(own))
                linked.append(100 * both >= percent * (len(own) + len(head) - both))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("component"), pa.array(n, pa.int64()), pa.array(linked, pa.bool_())], names=["rid", "component", "n", "linked"])

    joined = sets.join(F.broadcast(heads) if held <= HEAD_BYTES else heads, "component")
    return joined.mapInArrow(trimmed(run), "rid long, component long, n long, linked boolean")


def _rest_tiles(sets: DataFrame, headed: DataFrame, blocks_of) -> DataFrame:
    """(rid, component, names, tile) of components with sets that don't link with the head (the rest).

    Blocks of the rest meet each other and each block of the linked; a tile is a pair of blocks.
    """
    count = lambda which: blocks_of(F.count(F.when(which, 1)), F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)))
    sizes = headed.groupBy("component").agg(count(~F.col("linked")).alias("rest"), count(F.col("linked")).alias("others")).filter("rest > 0")
    dealt = headed.join(sizes, "component").withColumn("block", F.when(F.col("linked"), F.pmod(F.xxhash64("rid"), "others")).otherwise(F.pmod(F.xxhash64("rid"), "rest")).cast("long"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda x, y, kind: (x * (1 << 30) + y) * 2 + kind
    own = F.col("block")
    with_rest = F.transform(upto(F.col("rest")), lambda k: pair(F.least(own, k), F.greatest(own, k), 0))
    with_linked = F.transform(upto(F.col("others")), lambda k: pair(k, own, 1))
    of_linked = F.transform(upto(F.col("rest")), lambda k: pair(own, k, 1))
    tiles = dealt.select("rid", "component", F.explode(F.when(F.col("linked"), of_linked).otherwise(F.concat(with_rest, with_linked))).alias("tile"))
    return tiles.join(sets.select("rid", "names"), "rid").select("rid", "component", "names", "tile")


def _confirm(percent: int):
    def run(b: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        rid, bodies = np.asarray(b.column("rid")), b.column("names")
        us, vs = [], []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            sets = [unsqueeze(bodies[i].as_py(), np.uint64) for i in range(a, z)]
            size = np.array([len(s) for s in sets])
            vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.cumsum(size) - size
            mark = np.zeros(len(vocabulary), bool)

            def linked(i: int, rest: np.ndarray) -> np.ndarray:
                own = code[start[i]:start[i] + size[i]]  # noqa: B023
                mark[own] = True  # noqa: B023
                close = 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])  # noqa: B023
                hit = np.zeros(len(rest), bool)
                if close.any():
                    c = rest[close]
                    lengths = size[c]  # noqa: B023
                    flat = mark[code[np.repeat(start[c] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]]  # noqa: B023
                    both = np.add.reduceat(flat.astype(np.int64), np.cumsum(lengths) - lengths)
                    hit[close] = 100 * both >= percent * (lengths + size[i] - both)  # noqa: B023
                mark[own] = False  # noqa: B023
                return hit

            for i, j in _search(z - a, linked):
                us.append(rid[a + i])
                vs.append(rid[a + j])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of its group), kept (doc_id is that), one row per document."""
    spark = docs.sparkSession
    batches = pack(docs, id_col, text_col, name="minhash-batches")
    signed = written(batches.mapInArrow(trimmed(_sign(size, percent)), SIGNED), "minhash-signatures")
    order = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "bid", "place")
    # One representative per set; its row id is the rank of its place, unique and stable because the table is written.
    reps = signed.filter("digest is not null").groupBy("digest").agg(F.min_by(F.struct("bid", "place", "n", "sig", "bands"), order).alias("r"), F.min(order).alias("o"))
    reps = written(reps.select("digest", "r.*", F.col("o.doc_id").alias("least_id"), (F.shiftrightunsigned("r.bid", 32) * (1 << 40) + F.col("r.bid").bitwiseAND((1 << 32) - 1) * (1 << 16) + F.col("r.place")).alias("rid")), "minhash-representatives")
    keys = reps.select("rid", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("rid").alias("head")).filter("members > 1")
    shared = keys.join(buckets, "key")
    stars = shared.filter((F.col("members") > tile) & (F.col("rid") > F.col("head"))).select(F.col("rid").alias("u"), F.col("head").alias("v"))
    members = shared.filter(F.col("members") <= tile).select("rid", "key").join(reps.select("rid", "sig"), "rid")
    maybe = by_group(members, parallelism(spark), ["key"], "u long, v long", _bucket_edges(percent)).union(stars)
    candidates = components(maybe).join(reps.select(F.col("rid").alias("node"), "bid", "place", "n"), "node")
    blocks_of = lambda n, size: F.greatest(F.ceil(n / tile), F.ceil(size * 8 / tile_bytes)).cast("long")
    placed = candidates.join(candidates.groupBy("component").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks")), "component")

    def fetched(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy("bid").agg(F.collect_list(F.struct("place", F.col("node").alias("rid"), "component")).alias("wanted"))
        return batches.join(wanted, "bid").mapInArrow(trimmed(_fetch(size)), "rid long, component long, names binary")

    small = fetched(placed.filter("blocks <= 1")).withColumn("tile", F.lit(0).cast("long"))
    large = written(fetched(placed.filter("blocks > 1")), "minhash-hot-sets")
    headed = written(_headed(large, percent), "minhash-hot-heads")
    links = by_group(small.unionByName(_rest_tiles(large, headed, blocks_of)), parallelism(spark), ["component", "tile"], "u long, v long", _confirm(percent))
    links = links.union(headed.filter("linked AND rid <> component").select(F.col("component").alias("u"), F.col("rid").alias("v")))
    groups = components(links)
    ids = groups.join(reps.select(F.col("rid").alias("node"), "digest", "least_id"), "node")
    named = ids.join(ids.groupBy("component").agg(F.min("least_id").alias("group_id")), "component").select("digest", "group_id")
    classes = reps.select("digest", "least_id").join(named, "digest", "left").select("digest", F.coalesce("group_id", "least_id").alias("group_id"))
    classes = written(classes, "minhash-classes")  # beside a written table, a hot digest is a skewed side that can be split
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left")
    return out.select("doc_id", "n_shingles", F.nullif(F.coalesce("group_id", "doc_id"), F.lit(NULL_ID)).alias("component_id")).select(
        "*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_minhash_dedup": op9_minhash_dedup}
ORACLE = {
    "op9_minhash_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: md5(array_to_string(ws[k:k + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS name FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.name = b.name AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM both_ JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT a, v FROM reach JOIN links ON u = b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN least ON d.doc_id = least.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
}
