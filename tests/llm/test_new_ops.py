"""Filter audit, sharding and centroid clustering against literal versions; edge rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlight.llm import audit, centroids, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11 filter audit

def fails_of(rows):
    """Per row the letters of the filters it fails; rows: (doc_id, text)."""
    least = {}
    for d, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        out.append({
            *("A" * (len(w) < 200)), *("B" * (100 * len(set(w)) < 50 * len(w))), *("C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))),
            *("D" * bool(re.search("[#$%&*|]", t))), *("E" * (d is not None and least[t] < d))})
    return out


def literal_audit(rows, labels):
    """rows: (doc_id, text, lang); every order applied to the documents of each part, one filter after another."""
    good, toxic = ({d for d, q, x in labels if v(q, x) and d is not None} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    failed = fails_of([(d, t) for d, t, _ in rows])
    out = set()
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(d, f) for (d, _, lang), f in zip(rows, failed) if (lang or "") == part]
        steps, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                earlier = [x for x in mine if name in x[1] and set(order[:k - 1]) & x[1]]
                left = [x for x in left if name not in x[1]]
                total[name] += len(gone)
                steps.append(("".join(order), k, len(left), len(gone), len(earlier), sum(f == {name} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), name))
        out |= {(part, *s[:-1], total[s[-1]]) for s in steps}
    return out


def test_audit_equals_applying_every_order(spark):
    r = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)] + ["Big", "CAPS", "a#b", "x|y", "100%"]
    rows = []
    for i in range(150):
        n = int(r.integers(0, 420))
        rows.append((i, " ".join(r.choice(vocabulary[: int(r.integers(20, 405))], n)), ["de", "en", "", None][i % 4]))
    rows += [(1000 + i, rows[i][1], "en") for i in range(30)] + [(None, rows[3][1], "fr"), (None, None, None), (2000, None, "fr"), (2001, "", "fr"), (2002, " \t\n", "fr"), (5, rows[5][1], "fr"), (5, rows[5][1], "fr"), (3000, "A" * 90000, "fr"), (3001, "é Ä " * 60000, "fr")]
    labels = [(i, i % 3 and 1, int(i % 5 == 0)) for i in range(0, 1020, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None), (9999, 1, 1)]
    df = spark.createDataFrame([(*x, 1, "m", 2) for x in rows], "doc_id long, text string, lang string, n int, mask string, words int")
    lab = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(x) for x in audit.audit(audit.mask_counts(df, lab)).collect()]
    assert len(got) == len(set(got)) == 4 * 600
    assert set(got) == literal_audit(rows, labels)
    assert audit.audit(audit.mask_counts(df.filter("false"), lab)).count() == 0
    assert audit.audit(audit.mask_counts(df, lab.filter("false"))).filter("good_lost > 0 or toxic_lost > 0").count() == 0


def test_removal_polynomial():
    r = np.random.default_rng(2)
    counts = {m: int(n) for m, n in enumerate(r.integers(0, 9, 32))}
    f = audit.Removal(counts, 5)
    for s in range(32):
        removed = sum(n for m, n in counts.items() if m & s)
        assert f.corners[s] == removed == f.at([Fraction(s >> i & 1) for i in range(5)])
    marginal = [Fraction(0)] * 5
    for order in itertools.permutations(range(5)):
        s = 0
        for i in order:
            marginal[i] += f.corners[s | 1 << i] - f.corners[s]
            s |= 1 << i
    assert [f.shapley(i) * 120 for i in range(5)] == marginal
    assert sum(f.shapley(i) for i in range(5)) == f.corners[31]
    half = f.at([Fraction(1, 2)] * 5)  # each filter with probability one half: the mean over all sets
    assert half == Fraction(sum(f.corners), 32)


# 12 sharding

def place(v, text):
    if text:
        return -1 if v is None else int.from_bytes(v.encode()[:7].ljust(7, b"\0"), "big")
    return sharding.LEAST if v is None else v


def literal_tree(rows, k, first=0, roots=None):
    """rows: (index, doc_id, size, values); {index: leaf}."""
    spans = [(min(r[3][d] for r in rows), max(r[3][d] for r in rows)) for d in range(len(rows[0][3]))] if rows else []
    roots = roots or [float(b) - float(a) for a, b in spans]
    if k == 1 or not rows:
        return {r[0]: first for r in rows}
    width = [(float(b) - float(a)) / w if w > 0 else 0.0 for (a, b), w in zip(spans, roots)]
    dim, kl, total, before = width.index(max(width)), k // 2, sum(r[2] for r in rows), 0
    left, right = [], []
    for r in sorted(rows, key=lambda r: (r[3][dim], place(r[1], False), r[0])):
        (left if (2 * before + r[2]) * k <= 2 * total * kl else right).append(r)
        before += r[2]
    return literal_tree(left, kl, first, roots) | literal_tree(right, k - kl, first + kl, roots)


def placed(rows):
    """rows: (doc_id, text, lang, source, n_chars) in the order of the table."""
    return [(i, d, len((t or "").encode()) + 1, (place(lang, True), place(source, True), place(n, False), place(d, False))) for i, (d, t, lang, source, n) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def check_shards(got, rows, k):
    """Slots are gapless in the order of ids, sizes and checksums are right, leaves are the literal tree's."""
    by = defaultdict(list)
    for g in got:
        by[g.shard].append(g)
    for own in by.values():
        assert sorted(g.slot for g in own) == list(range(len(own)))
        in_order = [place(g.doc_id, False) for g in sorted(own, key=lambda g: g.slot)]
        assert in_order == sorted(in_order)
    facts = lambda d, t: (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    leaf = literal_tree(placed(rows), k)
    want = Counter((*facts(d, t), leaf[i]) for i, (d, t, *_) in enumerate(rows))
    assert Counter((g.doc_id, g.size, g.text_crc32, g.shard) for g in got) == want


@pytest.mark.parametrize("k", [8, 5])
def test_shards_equal_a_literal_tree(spark, k):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        n = int(r.integers(1, 3000)) if i % 50 else 20000
        rows.append((int(r.integers(-(1 << 62), 1 << 62)) if i % 7 == 0 else i, "é" * (n // 2), ["de", "en", "es", "fr"][min(3, int(r.exponential(1)))], f"source-number-{i % 9}" if i % 3 else "hot", n // 2))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, tree = sharding.assign(df, k)
    got = got.collect()
    check_shards(got, rows, k)
    sizes = Counter()
    for g in got:
        sizes[g.shard] += g.size
    assert len(sizes) == k and max(sizes.values()) - min(sizes.values()) <= 3 * 20001
    assert tree.count() == k - 1 and {x.level for x in tree.collect()} == {0, 1, 2}


def test_shards_of_alike_documents_are_still_equal(spark):
    """All metadata alike, ids alike for a third: rows are told apart by id and then by row."""
    rows = [(i if i % 3 else 7, "x" * 99, "en", "hot", 99) for i in range(801)]
    got, _ = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(3), 8)
    counts = Counter(g.shard for g in got.collect())
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 3


def test_shards_edges(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x" * 200000, "de", "", 200000), (3, "日本語", "日本語の長い名前", "s", 3), (4, "b", "en", "a", 1)]
    df = spark.createDataFrame([(*x, 5, "r", 6) for x in rows], SCHEMA + ", shard int, rid string, v0 int").coalesce(1)
    got, _ = sharding.assign(df, 8, carry=("text", "shard"))
    got = got.collect()
    assert len(got) == len(rows) and Counter(g.text for g in got) == Counter(x[1] for x in rows)
    plain, _ = sharding.assign(df, 8)
    check_shards(plain.collect(), rows, 8)
    for k, docs in ((8, df.filter("false")), (1, df)):
        out, tree = sharding.assign(docs, k)
        assert out.count() == docs.count() and tree.count() == 0
    assert sharding.assign(df.filter("doc_id = 4"), 8)[0].first().slot == 0
    # By target: 200,000 bytes in leaves of at most about 30,000 are as many leaves as bytes need; one long text fills its own.
    many = spark.createDataFrame([(i, "y" * 999, "en", "a", 999) for i in range(200)], SCHEMA)
    out, tree = sharding.assign(many, None, target_bytes=30000, carry=("text",))
    sizes = {r.shard: r.size for r in out.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    assert len(sizes) == 7 and max(sizes.values()) <= 30000 and tree.count() == 6
    sharding.write_shards(out, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((r.doc_id, r.shard, r.slot, r.text) for r in back.collect()) == Counter((r.doc_id, r.shard, r.slot, r.text) for r in out.collect())


# 13 centroid clustering

def literal_clusters(rows, k, rounds, scale=64):
    """rows: (vec_id, vector); [(vec_id, cluster, distance)] and the centroids, in Python integers."""
    pts = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]
    mark = lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), np.array(p[1], np.int32).tobytes())
    c = [p[1] for p in sorted(pts, key=mark)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in pts:
            of[near(v)[1]].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j])] if of[j] else w for j, w in enumerate(c)]
    return sorted((i is None, i, *near(v)[::-1]) if i is not None else (True, 0, *near(v)[::-1]) for i, v in pts), c


def as_sorted(found):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect())


def test_clusters_equal_all_distances(spark):
    r = np.random.default_rng(5)
    for n, d, k, spread in ((300, 8, 16, 1.0), (200, 3, 7, 0.05), (120, 2, 16, 0.0)):
        # Few distinct values: many exact ties between centroids, and centroids at the same place.
        rows = [(i, [float(x) for x in np.round(r.normal(size=d) * spread * 4) / 4 + (i % 3)]) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        found, got = centroids.clusters(df, k=k, components=d)
        want, centres = literal_clusters(rows, k, 3)
        assert got == centres and as_sorted(found) == want


def test_cluster_edges(spark):
    nan, inf = math.nan, math.inf
    good = [(i, [float(i % 5), -0.01 * i, 1e5]) for i in range(40)]
    odd = [(None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (3, [9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0])]
    bad = [(50, None), (51, []), (52, [1.0]), (53, [1.0, None, 2.0]), (54, [nan, 1.0, 1.0]), (55, [1.0, inf, 1.0])]
    schema = "vec_id long, embedding array<float>, cluster string, v int, upper int"
    df = spark.createDataFrame([(*x, "c", 1, 2) for x in good + odd + bad], schema)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in good + odd]
    found, got = centroids.clusters(df, components=3)
    want, centres = literal_clusters(rows, 16, 3)
    assert got == centres and as_sorted(found) == want
    few, got = centroids.clusters(df.filter("vec_id in (1, 2, 50)"), components=3)
    assert sorted((r.vec_id, r.distance) for r in few.collect()) == [(1, 0), (2, 0)] and len(got) == 2
    for empty in (df.filter("false"), df.filter("vec_id between 50 and 55")):
        out, got = centroids.clusters(empty, components=3)
        assert out.count() == 0 and got == []
    with pytest.raises(Exception, match="would not fit 64 bits"):
        centroids.clusters(spark.createDataFrame([(1, [1e30, 0.0, 0.0])], "vec_id long, embedding array<double>"), components=3)


def test_bounds_hold_and_spare_distances():
    r = np.random.default_rng(6)
    x = (np.repeat(r.normal(size=(10, 16)) * 500, 100, 0) + r.normal(size=(1000, 16)) * 20).astype(np.int32)
    now = x[::60][:16].astype(np.int64)
    cluster, upper, lower, computed = centroids.assign(x, centroids.Centres(now))
    for _ in range(3):
        exact = np.sqrt(np.stack([centroids.squared(x, c) for c in now], 1).astype(float))
        assert (cluster == exact.argmin(1)).all()
        assert (upper >= exact[np.arange(len(x)), cluster]).all() and (lower <= exact).all()
        after = np.stack([x[cluster == j].astype(np.int64).sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else now[j] for j in range(16)])
        cluster, upper, lower, computed = centroids.assign(x, centroids.Centres(after, now), cluster, upper, lower)
        now = after
    assert computed < 0.3 * 16 * len(x)
    values = np.array([0.0, 1e-30, 1.0, 1 / 3, 16777217.0, 1e18])
    assert (centroids.up(values) >= values).all() and (centroids.down(values) <= values).all()


def test_new_queries_agree_with_sql(spark):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import oracle_check

    for module in (audit, sharding, centroids):
        (name, query), = module.QUERIES.items()
        assert oracle_check.difference(spark, "/root/testdata/sf0.001", query, module.ORACLE[name]) == ([], [])
