"""Chat formatting, WARC and embeddings: round trips, damage, brute force, edge rows; components; the pipeline."""

import math
import random
import re

import brute
import numpy as np
from pyspark.sql import functions as F

from siftlight.llm import chat, components, embeddings, warc

SF = "/root/testdata/sf0.001"


# 6 chat

def test_chat_escapes_can_be_undone(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("\\<[]>/slbe \n") for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(x.t == x.u and not set("<[]") & set(x.e) for x in rows)


def test_chat_examples(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 2, "user", "c"), (1, 3, "assistant", ""), (2, 0, "user", "alone"), (None, None, None, "x"), (3, 0, "assistant", "t"), (3, 0, "assistant", "s")]
    e = chat.examples(spark.createDataFrame([(*x, 7) for x in rows], "conv_id long, turn long, role string, text string, turns int"))
    got = {(x.conv_id, x.position): x for x in e.select("*", chat.parsed(F.col("formatted")).alias("p"), chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("t")).collect()}
    assert set(got) == {(1, 2), (1, 4), (2, 1), (None, 1), (3, 1), (3, 2)}
    assert got[1, 2].t == "b</s>" and got[1, 4].t == "" and got[2, 1].t is None and got[None, 1].loss_chars is None
    assert [tuple(x) for x in got[1, 4].p] == [("user", ""), ("assistant", "b</s>"), ("user", "c"), ("assistant", "")]
    assert [got[3, 1].t, got[3, 2].t] == ["s", "t"]
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 7 WARC

def records(n=6):
    import hashlib

    out = []
    for k in range(n):
        body = (f"<html>{k} " + "é" * 50 * k + "WARC/1.1\r\n").encode()
        out.append(warc.record(k, f"http://e/{k} x", body, len(body), hashlib.sha256(body).hexdigest(), None))
    return out


def test_salvage_skips_damage_and_logs_the_gap():
    good = [warc.gzip_member(r) for r in records()]
    damaged = bytearray(good[2])
    damaged[len(damaged) // 2] ^= 0xFF
    data = good[0] + good[1] + bytes(damaged) + good[3] + b"junk" + records()[4] + warc.EMPTY_MEMBER + good[5][:-9]
    rows = list(warc.salvage(data))
    assert [r["page_id"] for r in rows if r["kind"] == "response"] == [0, 1, 3, 4, 5]  # of 5 only the member's end is lost
    gaps = [(r["start"], r["end"]) for r in rows if r["kind"] == "quarantined"]
    at = len(good[0]) + len(good[1])
    assert gaps[0] == (at, at + len(damaged)) and data[gaps[1][0]:gaps[1][1]] == b"junk" and gaps[2][1] == len(data)
    plain = bytearray(b"".join(records()))
    plain[plain.index(b"<html>3")] = 0
    assert [r["page_id"] for r in warc.salvage(bytes(plain)) if r["kind"] == "response"] == [0, 1, 2, 4, 5]
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_members():
    five = records(5)
    third = five[2].replace(b"<html>2", b"<html>X")
    ids = lambda data: [r["page_id"] for r in warc.salvage(data) if r["kind"] == "response"]
    data = warc.gzip_member(b"".join([*five[:2], third, *five[3:]])) + warc.gzip_member(records(6)[5])
    rows = list(warc.salvage(data))
    assert [r["page_id"] for r in rows if r["kind"] == "response"] == [0, 1, 3, 4, 5]
    gap, = (r for r in rows if r["kind"] == "quarantined")
    assert (gap["inside_start"], gap["inside_end"]) == (len(five[0] + five[1]), len(five[0] + five[1] + third))
    whole = warc.gzip_member(b"".join(five))
    assert set(ids(whole[:-12])) >= {0, 1, 2, 3}
    flipped = bytearray(whole)
    flipped[-3] ^= 1  # the member's own check fails after all content: the last record's digest vouches for it
    rows = list(warc.salvage(bytes(flipped) + warc.gzip_member(records(6)[5])))
    assert [r["page_id"] for r in rows if r["kind"] == "response"] == [0, 1, 2, 3, 4, 5]
    gap, = (r for r in rows if r["kind"] == "quarantined")
    assert (gap["reason"], gap["start"], gap["end"]) == ("broken member", 0, len(flipped))
    one = warc.gzip_member(five[2])[:-8]  # a member that lacks its trailer alone
    rows = list(warc.salvage(one))
    assert [r["kind"] for r in rows] == ["response", "quarantined"] and rows[0]["page_id"] == 2
    # Without a digest nothing vouches for the record at the fault.
    bare = re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", five[2])
    assert [r["kind"] for r in warc.salvage(warc.gzip_member(bare)[:-8])] == ["quarantined"]
    cut = list(warc.salvage(whole[:len(whole) // 2] + warc.gzip_member(records(6)[5])))
    assert cut[-1]["page_id"] == 5 and cut[-2]["kind"] == "quarantined" and cut[-2]["reason"] == "broken member"


def test_reader_takes_other_writers_records():
    import base64
    import hashlib

    def made(kind, block, *lines):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0f0f>", "WARC-Target-URI: http://e/", *lines, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    http = "Content-Type: application/http; msgtype=response"
    good = [
        made("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), made("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        made("response", block, http), made("response", block, http, f"WARC-Block-Digest: {sha1(block)}", f"WARC-Payload-Digest: {sha1(b'body')}", "X-Long: a\r\n b"),
        made("metadata", b"k: v"), made("response", block, http, "WARC-Payload-Digest: other:1"), made("revisit", block[:-4], http), made("resource", b"plain"),
    ]
    for data in (b"".join(good), b"".join(map(warc.gzip_member, good)), warc.gzip_member(b"".join(good))):
        rows = list(warc.salvage(data))
        assert [r["kind"] for r in rows] == ["warcinfo", "request", "response", "response", "metadata", "response", "revisit", "resource"]
        assert {r["record_id"] for r in rows} == {"<urn:uuid:0f0f>"} and [r["payload"] for r in rows if r["kind"] == "response"] == [b"body"] * 3
    for bad in (made("response", block, http, f"WARC-Block-Digest: {sha1(b'x')}"), made("response", block, http, f"WARC-Payload-Digest: {sha1(b'x')}")):
        assert [r["kind"] for r in warc.salvage(bad)] == ["quarantined"]


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    import os

    r = random.Random(3)
    pages = spark.createDataFrame([(i, "u", "".join(r.choices("abcdefgh", k=3000))) for i in range(40)] + [(99, "u", "".join(r.choices("abcdefgh", k=90000)))], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, f"file://{tmp_path}/b", bundle_bytes=4000, file_bundles=2)
    sizes = [f.stat().st_size for f in os.scandir(tmp_path / "b") if f.name.startswith("part")]
    assert len(sizes) > 5 and sorted(sizes)[-2] < 2 * 4100
    assert sorted(x.page_id for x in warc.read_archives(spark, path).collect()) == [*range(40), 99]


def test_warc_edges(spark, tmp_path):
    long, odd = "x" * 100, "\r\n\r\nWARC/1.1\r\n\x00é" * 20
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, "short"), (6, "short"), (None, long), (7, odd), (8, odd), (3, long), (9, "y" * 300000)]
    pages = spark.createDataFrame([(p, "http://e/\r\n", h, "q") for p, h in rows], "page_id long, url string, html string, digest string")
    got = warc.read_archives(spark, warc.write_archives(pages, f"file://{tmp_path}/w")).collect()
    assert sorted((str(r.page_id), r.kind, r.refers_to, r.payload_bytes) for r in got) == sorted([
        ("1", "response", None, 0), ("2", "response", None, 0), ("3", "response", None, 100), ("3", "response", None, 100), ("4", "revisit", 3, 100), ("5", "response", None, 5),
        ("6", "response", None, 5), ("None", "response", None, 100), ("7", "response", None, len(odd.encode())), ("8", "revisit", 7, len(odd.encode())), ("9", "response", None, 300000)], key=lambda x: (x[0], x[1], str(x[2])))
    assert {bytes(r.payload) for r in got if r.page_id == 7} == {odd.encode()}
    assert warc.read_archives(spark, warc.write_archives(pages.filter("false"), f"file://{tmp_path}/none")).count() == 0


# 8 embeddings

def linked(rows, cosine=0.9):
    x = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows}
    up = {i: i for i in x}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    n = dict.fromkeys(x, 0)
    for i in x:
        for j in x:
            if i < j and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (n[i], find(i), find(i) == i) for i in x}


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 32))
    rows = [(i, [float(v) for v in np.float32(centres[i % 8] + r.normal(size=32) * (0.25 if i % 3 else 0.02))]) for i in range(240)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000 + i, [float(x) for x in r.normal(size=16)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = linked(rows)
    for tile in (16, 1024):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(df, recall=0.999999, tile=tile).collect()}
        assert got == want


def test_embedding_recall_at_the_default_setting(spark):
    """Pairs just above the threshold; nothing below it is linked."""
    r = np.random.default_rng(5)
    d, n = 64, 600
    x = r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = r.normal(size=(n, d))
    y -= (y * x).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = np.concatenate([r.uniform(0.9002, 0.905, n // 2), r.uniform(0.89, 0.8998, n // 2)])[:, None]
    rows = [(2 * i + k, [float(v) for v in vec]) for i in range(n) for k, vec in enumerate((x[i], c[i] * x[i] + np.sqrt(1 - c[i] ** 2) * y[i]))]
    for kind in ("float", "double"):
        got = {q.vec_id: q.n_links for q in embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()}
        assert sum(got[2 * i] for i in range(n // 2)) >= 0.95 * (n // 2) and not any(got[2 * i] for i in range(n // 2, n))


def test_embedding_edges(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1e-30, 0.0]), (10, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (None, [3.0, 0.0]), (None, None)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, rid int, name string")
    got = sorted(((x.vec_id if x.vec_id is not None else 99), x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(df).collect() if x.vec_id is not None or x.n_links)
    assert got == [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)] + [(7, 4, 7, True), (7, 4, 7, True), (8, 4, 7, False), (9, 4, 7, False), (10, 0, 10, True), (99, 4, 7, False)]
    assert embeddings.near_duplicates(df.filter("false")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(4)
    d = 64
    x = r.normal(size=(300, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = x @ embeddings.rotation(d, 0).T
    code = np.where(t > 0, 1, -1) / math.sqrt(d)
    f = (code * t).sum(1)
    off = ~np.eye(len(x), dtype=bool)
    error = ((code @ t.T) / f[:, None] - x @ x.T)[off]
    bound = (embeddings.SIGMAS * np.sqrt((1 - f * f) / f**2 / (d - 1)))[:, None] * np.ones((1, len(x)))
    assert abs(error.mean()) < 0.005 and (np.abs(error) > bound[off]).mean() < 1e-3


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(path + star + [(7, 7), (39, 2)], "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# the pipeline

def test_pipeline_equals_brute_force(spark):
    import zlib

    import corpus_pipeline
    from siftlight.llm import language, packing, quality
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.keep_rows(docs)
    network = language.train(kept.filter(~language.held_out(F.col("doc_id"))))
    known = language.identify(kept, network).filter(f"lang_pred <> 'und' and score >= {corpus_pipeline.MIN_LANGUAGE_SCORE}").select("doc_id")
    rows = sorted((r.doc_id, r.text) for r in kept.join(known, "doc_id").collect())
    groups = brute.linked_shingles(rows, percent=80)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    data = [(d, t.encode()) for d, t in rows]
    seen, size = {}, 224
    for _, b in data:
        for i in range(len(b) - size + 1):
            seen[b[i:i + size]] = seen.get(b[i:i + size], 0) + 1
    tok, want = Tokenizer.from_file(packing.word_bpe()), []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = [True] * size
        text, at = "", 0
        for c in b.decode():
            n = len(c.encode())
            text += c if not any(gone[at:at + n]) else ""
            at += n
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        want += [(d, k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_on_an_empty_table(spark, docs):
    import corpus_pipeline

    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and out.columns == docs.columns


def test_pipeline_links_pairs_between_80_and_85_percent(spark):
    import corpus_pipeline

    r = np.random.default_rng(6)
    rows = []
    for i in range(40):
        w = [f"w{x}" for x in r.integers(0, 10**6, 200)]
        tail = [f"e{i}x{x}" for x in range(20)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[20:] + tail))]  # 176 of 216 shingles: 0.81
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(d for d, (_, c) in brute.linked_shingles(rows, percent=80).items() if c == d)
    assert want == list(range(0, 80, 2)) and len(brute.linked_shingles(rows)) == len({c for _, c in brute.linked_shingles(rows).values()})
    assert sorted(x.doc_id for x in corpus_pipeline.minhash_dedup(spark, df, SF).collect()) == want


def test_bands_follow_from_the_threshold():
    from siftlight.llm import minhash

    assert minhash.banding(85) == (5, 24)
    for percent in (100, 95, 85, 80, 70, 50, 20, 5):
        rows, bands = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Null and repeated ids and clashing names go through the last three stages; all but the last keep the columns."""
    import corpus_pipeline

    near = corpus_pipeline.minhash_dedup(spark, odd, SF)
    assert near.columns == odd.columns and {r.doc_id for r in near.collect()} == {1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, -1}
    left = corpus_pipeline.suffix_array_dedup(spark, odd.withColumn("n_chars", F.lit(1).cast("long")), SF)
    assert left.count() == odd.count() and all(r.n_chars == len(r.text) for r in left.collect())
    packed = corpus_pipeline.best_fit_packing(spark, odd, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in odd.collect()}
