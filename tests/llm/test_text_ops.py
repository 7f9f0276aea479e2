"""Operators over documents against SQL, brute force, round trips and edge rows."""

import zlib

import brute
import numpy as np
import oracle_check as oracle
import pytest
from pyspark.sql import functions as F

from siftlight.llm import language, lattice, minhash, packing, quality, recompression, registry, suffixes

SF = "/root/testdata/sf0.001"
LAST = 1 << 62


def by_id(rows):
    return sorted(rows, key=lambda r: (LAST if r[0] is None else r[0], *map(str, r[1:])))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert oracle.difference(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) == ([], [])


# 1 quality rules

def test_quality_edges(spark, odd):
    q = {(r.row.doc_id, r.n_words): r for r in quality.ledger(odd).collect()}
    assert q[(1, 0)].n_symbols == q[(2, 0)].n_lines == q[(3, 0)].word_chars == 0
    assert q[(9, 30000)].n_repeat_words == 30000 and q[(12, 240)].n_dup_lines == 59
    assert len(quality.ledger(odd).collect()) == odd.count()
    kept = quality.keep_rows(odd)
    assert kept.schema == odd.schema and {r.doc_id for r in kept.collect()} == {None, 5, 6, 13} - {13}
    assert quality.ledger(odd.filter("false")).count() == 0


def test_ablations_follow_the_ledger(spark, docs):
    entries = quality.ledger(docs)
    masks = [r.fail_bits for r in entries.select("fail_bits").collect()]
    for r in quality.ablations(entries).collect():
        bit = 1 << [x.name for x in quality.RULES].index(r.rule)
        assert (r.n_failed, r.n_only_this, r.n_kept_without) == (sum(bool(m & bit) for m in masks), masks.count(bit), sum(not m & ~bit for m in masks))


def test_policy_masks():
    assert quality.BASE.mask() == 3 and quality.STANDARD.mask() == 2 ** len(quality.RULES) - 1


# 2 packing

def test_packing_edges(spark, odd, odd_pairs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_bpe())
    want = []
    for d, t in odd_pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    rows = packing.pack(packing.pieces(odd, packing.word_bpe())).collect()
    assert by_id(tuple(r)[:5] for r in rows) == by_id(want)
    gapless(rows, 4096)
    assert packing.pack(packing.pieces(odd.filter("false"), packing.word_bpe())).count() == 0


def gapless(rows, capacity):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        place = 0
        for offset, length in sorted(spans):
            assert offset == place
            place += length
        assert place <= capacity
    return len(at)


def test_packing_is_tight(spark, docs):
    rows = packing.pack(packing.pieces(docs, packing.word_bpe())).collect()
    assert gapless(rows, 4096) <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


def test_best_fit_plan():
    for seed in range(20):
        r = np.random.default_rng(seed)
        lengths, counts = np.unique(r.integers(1, 101, r.integers(1, 400)), return_counts=True)
        plan, total = packing.best_fit(lengths, counts, 100)
        fill, placed = np.zeros(total, int), dict.fromkeys(lengths.tolist(), 0)
        for length, rank, n, first, offset in sorted(plan.tolist(), key=lambda x: x[4]):
            assert (fill[first:first + n] == offset).all()
            fill[first:first + n] += length
            placed[length] += n
        assert placed == dict(zip(lengths.tolist(), counts.tolist())) and fill.max() <= 100 and fill.min() > 0
        assert total <= 1.23 * -(-int((lengths * counts).sum()) // 100) + 1


def test_runs_of_words_give_the_tokenizer_s_ids(docs):
    from siftlight.llm.textkit import text_buffers
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_bpe())
    odd = ["It's don't ÀÉß ŸČ ı İ x1y22 a.b,c** '' 's <|endoftext|>x é\u0301 \u00b5 ﬁ 日本 ١ a\u00a0b", "", " \t ", "x" * 5000 + " END", "".join(map(chr, range(1, 0x250)))]
    texts = [r.text for r in docs.select("text").collect()] + odd
    data, offsets = text_buffers(pa.array(texts))
    ids, bounds = packing.WordTokenizer.at(packing.word_bpe()).encode(data, offsets)
    assert all(ids[a:b].tolist() == tok.encode(t or "", add_special_tokens=False).ids for t, a, b in zip(texts, bounds, bounds[1:]))


def test_sweeps_are_as_tight_as_a_plan_on_one_machine(spark, monkeypatch):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 50)
    for seed, most in ((0, 101), (1, 30), (2, 8)):
        r = np.random.default_rng(seed)
        lengths = r.integers(1, most, 300).tolist()
        cut = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)], packing.PIECES)
        rows = packing.pack(cut, 100).collect()
        assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
        assert gapless(rows, 100) <= 1.02 * packing.best_fit(*np.unique(lengths, return_counts=True), 100)[1] + 1


# 3 substring dedup

def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_different_words_are_never_one(spark, n):
    a, b = thue_morse(n)
    rest = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join([a] * 5)), (4, " ".join([b] * 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in recompression.remove_repeats(df).collect()] == [0] * 4
    assert all(r.kept for r in minhash.near_duplicates(df.filter("doc_id > 2")).collect())


def test_recompression_equals_brute_force(spark, docs, pairs):
    got = by_id(tuple(r) for r in recompression.remove_repeats(docs, texts=False).collect())
    assert got == brute.removed_windows(pairs, recompression.WINDOW)


def test_recompression_edges(spark, odd, odd_pairs):
    got = by_id(tuple(r)[:4] for r in recompression.remove_repeats(odd).collect())
    assert got == by_id(brute.removed_windows(by_id(odd_pairs), recompression.WINDOW))
    assert recompression.remove_repeats(odd.filter("false")).count() == 0


def test_recompression_of_periods(spark):
    r = np.random.default_rng(1)
    rows = [(i, " ".join("ab"[x] for x in np.tile(r.integers(0, 2, p), 60)[:r.integers(10, 90)])) for i, p in enumerate(r.integers(1, 25, 60).tolist())]
    for rounds in (0, 1, 3):
        got = by_id(tuple(x)[:4] for x in recompression.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds).collect())
        assert got == brute.removed_windows(rows, recompression.WINDOW)


# 4 SentencePiece

def test_lattice_equals_the_library(spark, docs, odd, pairs, odd_pairs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=lattice.default_model())
    for df, rows in ((docs, pairs), (odd, odd_pairs)):
        got = by_id((r.doc_id, r.ids) for r in lattice.encode(df, lattice.default_model()).collect())
        assert got == by_id((d, library.encode(t or "")) for d, t in rows)
    assert all(r.round_trip for r in lattice.encode(odd, lattice.default_model()).collect())
    assert lattice.encode(odd.filter("false"), lattice.default_model()).count() == 0
    assert all(r.round_trip for r in lattice.encode(docs, lattice.default_model(), ids=False).collect())
    model = lattice.Model(lattice.default_model())
    texts = lattice.encode(docs, lattice.default_model()).join(docs.select("doc_id", "text"), "doc_id").limit(20).collect()
    assert all(model.decode(np.array(r.ids, np.int64)).decode() == (r.text or "") for r in texts)
    assert model.decode(np.array(library.encode("a  b\nÉ日"))).decode() == "a  b\nÉ日"


def test_substrings_are_cut_at_lengths_that_pieces_have(spark):
    model = lattice.Model(lattice.default_model())
    lengths = {r["head"]: set(r["lengths"]) for r in model.reaches(spark).collect()}
    assert all(len(p) in lengths[p[:3]] for p in model.known if len(p) > 2)
    assert sum(map(len, lengths.values())) == len({(p[:3], len(p)) for p in model.known if len(p) > 2})


def test_lattice_cuts_words_where_no_piece_goes_on(spark, monkeypatch):
    import sentencepiece

    seen = []
    real = lattice.encode_units
    monkeypatch.setattr(lattice, "encode_units", lambda units, model: (seen.extend(r.block for r in units.collect()), real(units, model))[1])
    library = sentencepiece.SentencePieceProcessor(model_file=lattice.default_model())
    texts = [" ".join("abend" + a + b for a in ["", ",", "\n", "\u4e00"] for b in ["", "7", "\U0001f600", "\x00"]), "abend", "", "\n", "a \u2581  b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionAll(spark.sql("SELECT 9L, cast(unhex('41FF42') AS string)"))
    got = {r.doc_id: r for r in lattice.encode(df, lattice.default_model()).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == {i: library.encode(t) for i, t in [*enumerate(texts), (9, "A\ufffdB")]}
    assert all(r.round_trip for r in got.values())
    assert sum("abend" in u for u in seen) == 1


def test_lattice_stores_columns_of_numbers():
    columns = [np.arange(5) * 70_000_003, np.empty(0, np.int64), np.array([2**32 - 1])]
    found, rest = lattice._columns(lattice._numbers(*columns, rest=b"end"))
    assert [c.tolist() for c in found] == [c.tolist() for c in columns] and rest == b"end"
    assert [len(c) for c in lattice._columns(lattice._numbers([], []))[0]] == [0, 0]


def test_lattice_takes_long_units_without_spaces(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=lattice.default_model())
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("abcdefghilmnorstu"), 5000)), "日本語の文章" * 900, "ab" * 2500, "x" * 61, "x" * 62, "y" * 63, "".join(r.choice(list("aé日9"), 4000)), "  " * 40 + "a", "aaaa " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert by_id((x.doc_id, x.ids) for x in lattice.encode(df, lattice.default_model()).collect()) == [(i, library.encode(t)) for i, t in enumerate(texts)]


def test_lattice_takes_a_unit_beyond_two_million_characters(spark):
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=lattice.default_model())
    text = "".join(random.Random(1).choices(["ab", "the", "ing", "x", "qu", "é", "zz", "on"], k=1 << 20))[:(1 << 21) + 10].ljust((1 << 21) + 10, "z")
    got, = lattice.encode(spark.createDataFrame([(0, text)], "doc_id long, text string"), lattice.default_model()).collect()
    assert got.round_trip and got.ids == library.encode(text)


# 5 language ID

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.select("*", language.held_out(F.col("doc_id")).alias("h"))
    network = language.train(held.filter("not h"), max_docs=600)
    got = language.identify(held.filter("h"), network).join(docs.select("doc_id", "lang"), "doc_id")
    n, right = got.count(), got.filter("lang = lang_pred").count()
    assert n > 200 and right / n > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark, odd):
    network = language.Network(["aa", "bb"])
    got = {}
    for r in language.identify(odd, network).collect():
        got.setdefault(r.doc_id, r)
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 11} and got[1].score == 0
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.train(odd.filter("false")) is None
    assert language.identify(odd, network, carry=True).select("row.*").schema == odd.schema


def test_language_learns_from_short_texts(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(r.choice([["der", "und", "nicht", "ein"], ["the", "and", "not", "one"]][i % 2], 6)), ["de", "en"][i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows + [(7, "the und", "en")] * 50 + [(500, "", "xx"), (501, None, "yy"), (None, "nul", "zz")], "doc_id long, text string, lang string")
    assert df.agg(F.max(F.octet_length("text"))).first()[0] < 64
    network = language.train(df)
    assert network.languages == ["de", "en"]
    got = language.identify(df.filter("doc_id < 400 and doc_id <> 7"), network).join(df.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang = lang_pred").count() > 0.9 * got.count()
    assert language.train(df.filter("doc_id >= 500")) is None


def test_language_pools_every_text_by_itself():
    """Against a plain pass over one text at a time: gates, states and shares written out."""
    net = language.Network(["a", "b", "c"], hidden=4, seed=3)
    r = np.random.default_rng(1)
    texts = [r.integers(0, 256, n).astype(np.uint8) for n in (1, 5, 127, 128, 129, 300, 0)]
    got = net.pooled(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for t, g in zip(texts, got):
        total = np.zeros(3)
        for lo in range(0, len(t), language.STRETCH):
            part, h = t[lo:lo + language.STRETCH], {}
            for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
                s, h[d] = np.zeros(4), np.zeros((len(part), 4))
                for k in order:
                    a = p["w" + d][part[k]] + s @ p["u" + d]
                    z, c = (1 + np.tanh(a[:4])) / 2, np.tanh(a[4:])
                    s = s + z * (c - s)
                    h[d][k] = s
            y = np.exp(h["f"] @ p["vf"] + h["b"] @ p["vb"] + p["b"])
            total += (y / y.sum(1, keepdims=True)).sum(0)
        assert np.allclose(g, total / max(1, len(t)), atol=1e-5)


def test_language_gradients():
    net = language.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])

    def loss():
        p = net.shares(net.states(x, "f"), net.states(x, "b"))
        return -np.log(p[np.arange(len(p)), np.tile(y, 6)]).mean()

    g = net.gradients(x, y)
    for k in net.p:
        at = tuple(r.integers(0, s) for s in net.p[k].shape) if k[0] != "w" else (int(x[2, 1]), 1)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-2
        up = loss()
        net.p[k][at] = keep - 1e-2
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3


# 9 MinHash

def test_minhash_equals_brute_force(spark, docs, pairs):
    want = [(d, n, c, c == d) for d, (n, c) in sorted(brute.linked_shingles(pairs).items())]
    assert by_id(tuple(r) for r in minhash.near_duplicates(docs).collect()) == want


def test_minhash_tiles_lose_no_link(spark):
    r = np.random.default_rng(3)
    base = [f"w{x}" for x in r.integers(0, 5000, 200)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.integers(0, 200, 2):
            w[k] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"q{x}" for x in r.integers(0, 9999, 80))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(d, n, c, c == d) for d, (n, c) in sorted(brute.linked_shingles(rows).items())]
    for tile in (7, 1500):
        assert by_id(tuple(x) for x in minhash.near_duplicates(df, tile=tile).collect()) == want


def test_signatures_tell_unrelated_long_sets_apart():
    import pandas as pd
    import pyarrow as pa
    from siftlight.llm.textkit import squeeze

    r = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10**9, 1004)).encode() for _ in range(12)]
    near = texts[0].split(b" ")
    near[500:510] = [b"other"] * 10
    texts.append(b" ".join(near))
    row = {"bid": 0, "ids": squeeze(np.arange(13)), "offsets": squeeze(np.cumsum([0, *map(len, texts)])), "texts": squeeze(b"".join(texts))}
    out = next(minhash._sign(5, 85)(iter([pa.RecordBatch.from_pandas(pd.DataFrame([row]))])))
    assert out.column("n").to_pylist()[:12] == [1000] * 12
    sig = np.array([np.frombuffer(x, np.uint8) for x in out.column("sig").to_pylist()])
    share = (sig[:, None] == sig[None]).mean(2)
    assert share[:12, :12][~np.eye(12, dtype=bool)].max() < 0.1 and share[0, 12] >= minhash._threshold(85)


def hot_group(n=60):
    r = np.random.default_rng(3)
    base = [f"w{x}" for x in r.integers(0, 5000, 200)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in r.integers(0, 200, 2):
            w[k] = f"e{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_minhash_hands_no_hot_group_to_one_task(spark, monkeypatch):
    """Neither a band's members nor a component's sets reach Python as one group: bounded by count and by bytes."""
    rows = hot_group()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(d, n, c, c == d) for d, (n, c) in sorted(brute.linked_shingles(rows).items())]
    real = minhash.by_group
    for limits in ({"tile": 10}, {"tile_bytes": 12_000}):
        seen = []

        def spy(frame, n, keys, schema, fn):
            seen.append((frame, keys))  # noqa: B023
            return real(frame, n, keys, schema, fn)

        monkeypatch.setattr(minhash, "by_group", spy)
        assert by_id(tuple(x) for x in minhash.near_duplicates(df, **limits).collect()) == want
        sizes = [frame.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0 for frame, keys in seen]
        assert len(sizes) == 2 and sizes[1] < 45
        assert "tile" not in limits or sizes[0] <= limits["tile"]


def test_minhash_edges(spark, odd):
    got = by_id(tuple(r) for r in minhash.near_duplicates(odd).collect())
    of = {r[0]: r for r in got}
    assert of[1] == (1, 0, 1, True) and of[2] == (2, 0, 2, True) and of[4] == (4, 1, 4, True)
    assert of[6][2] == 5 and not of[6][3] and of[None][2:] == (5, False)
    assert [r for r in got if r[0] == 5] == [(5, 296, 5, True)] * 2
    assert minhash.near_duplicates(odd.filter("false")).count() == 0


# 10 suffix array

def test_suffixes_equal_brute_force(spark, docs, pairs):
    assert by_id(tuple(r) for r in suffixes.remove_repeats(docs).collect()) == brute.removed_bytes(pairs, suffixes.LENGTH)


def test_suffixes_kept_text(spark):
    passage = "".join(map(chr, range(200, 420)))
    rows = [(1, "A" + passage + "é!"), (2, "B" + passage + "è?"), (3, None), (4, "kept é")]  # é and è begin with one byte
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    assert {r.doc_id: r.kept_text for r in got} == {1: "A!", 2: "B?", 3: "", 4: "kept é"}


def test_suffix_edges(spark, odd, odd_pairs):
    some = odd.filter("doc_id is null or doc_id not in (9, 10)")
    rows = [r for r in odd_pairs if r[0] not in (9, 10)]
    assert by_id(tuple(r) for r in suffixes.remove_repeats(some).collect()) == by_id(brute.removed_bytes(rows, suffixes.LENGTH))
    long = {r.doc_id: r for r in suffixes.remove_repeats(odd).collect()}
    assert (long[9].n_removed, long[9].n_spans, long[10].n_removed) == (90000, 1, 100000)
    left = suffixes.without_repeats(odd)
    assert left.schema == odd.schema and left.count() == odd.count()
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[7] == "" and texts[8] == "z " and texts[4] == "word" and texts[1] == ""
    assert suffixes.remove_repeats(odd.filter("false")).count() == 0


def test_suffixes_of_random_overlaps(spark):
    r = np.random.default_rng(5)
    base = "".join(r.choice(list("abé \n"), 3000))
    rows = []
    for i in range(40):
        a = int(r.integers(0, 2000))
        rows.append((i, "".join(r.choice(list("xyz"), r.integers(0, 30))) + base[a:a + int(r.integers(150, 900))] + "".join(r.choice(list("uvw"), r.integers(0, 300)))))
    got = by_id(tuple(x) for x in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute.removed_bytes(rows, suffixes.LENGTH)


def test_messages_grow_with_the_input():
    from siftlight.llm import batches

    per_gb = []
    for gb in (30, 100, 300, 1000):
        n = int(gb * 1e9 * 0.04 / 1.2e6)
        per_gb.append(gb * 1e9 / batches.BATCH_BYTES / batches.group_size(n, 0.04) * n / gb)
    assert max(per_gb) < 1.5 * min(per_gb)


# 3 and 10: what one passage in many surroundings sends

def test_batches_of_a_group_share_messages():
    import pyarrow as pa
    from siftlight.llm import batches
    from siftlight.llm.textkit import squeeze, unsqueeze

    rows = pa.RecordBatch.from_pydict({"bid": [(1 << 32) | k for k in range(5)]})
    gather = lambda row: [(k, [np.array([row["bid"], k], np.uint64)]) for k in range(3)]
    sent = [r for b in batches.messages(iter([rows]), 4, gather, lambda a: squeeze(a)) for r in b.to_pylist()]
    assert [(r["bucket"], r["n"]) for r in sent] == [(0, 8), (1, 8), (2, 8), (0, 2), (1, 2), (2, 2)]
    assert np.frombuffer(sent[1]["segs"], np.int64).reshape(-1, 2).tolist() == [[(1 << 32) | k, 2] for k in range(4)]
    assert unsqueeze(sent[1]["body"], np.uint64).tolist() == [x for k in range(4) for x in ((1 << 32) | k, 1)]


def largest_share(spark, monkeypatch, module, run):
    """The result of run() and the largest bucket's share of the names sent in round two, of 32 buckets."""
    sent, real = [], module.exchange

    def spy(df, answer):
        sent.append(df)
        return real(df, answer)

    monkeypatch.setattr(module, "exchange", spy)
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = run()
        n = [r.n for r in sent[1].groupBy("bucket").agg(F.sum("n").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    return rows, max(n) / sum(n)


def test_a_common_passage_is_spread_over_the_buckets(spark, monkeypatch):
    r = np.random.default_rng(8)
    letters = list("abcdefghij")
    passage = "".join(r.choice(letters, 450))
    rows = [(i, "".join(r.choice(letters, 300)) + passage + "".join(r.choice(letters, 300))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, share = largest_share(spark, monkeypatch, suffixes, lambda: by_id(tuple(x) for x in suffixes.remove_repeats(df).collect()))
    assert got == brute.removed_bytes(rows, suffixes.LENGTH) and share < 0.1


def test_a_common_core_is_one_name_a_batch(spark, monkeypatch):
    """Round one: neither the pairs nor the cores of one passage in many surroundings fill a bucket."""
    r = np.random.default_rng(8)
    letters = list("abcdefghij")
    passage = "".join(r.choice(letters, 450))
    rows = [(i, "".join(r.choice(letters, 300)) + passage + "".join(r.choice(letters, 300))) for i in range(400)]
    sent, real = [], suffixes.exchange
    monkeypatch.setattr(suffixes, "exchange", lambda df, answer: (sent.append(df), real(df, answer))[1])
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).count()
        n = [x.n for x in sent[0].groupBy("bucket").agg(F.sum("n").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert max(n) < 0.1 * sum(n)


def test_a_common_phrase_is_spread_over_the_buckets(spark, monkeypatch):
    r = np.random.default_rng(9)
    phrase = " ".join(f"p{x}" for x in r.integers(0, 10**6, 18))
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    rows = [(i, f"{word(30)} {phrase} {word(30)}") for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, share = largest_share(spark, monkeypatch, recompression, lambda: by_id(tuple(x) for x in recompression.remove_repeats(df, texts=False).collect()))
    assert got == brute.removed_windows(rows, recompression.WINDOW) and share < 0.1


def test_suffixes_take_bytes_that_are_no_utf8(spark):
    import hashlib

    passage = bytes(range(256)) * 2
    rows = [(1, b"a" + passage + b"z"), (2, b"b" + passage), (3, b"\xc3\x28 \xff")]
    df = spark.createDataFrame(rows, "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    got = {r.doc_id: r for r in suffixes.remove_repeats(df, texts=True).collect()}
    assert {k: (r.n_bytes, r.n_removed) for k, r in got.items()} == {1: (514, 512), 2: (513, 512), 3: (4, 0)}
    assert got[3].kept_sha256 == hashlib.sha256(rows[2][1]).hexdigest() and got[3].kept_text == "\ufffd( \ufffd"
    assert got[1].kept_text == "az" and {r.text for r in suffixes.without_repeats(df).collect()} == {"az", "b", "\ufffd( \ufffd"}


def test_a_hot_group_of_near_copies_is_confirmed_in_proportion(spark, monkeypatch):
    """A third of all rows are near copies of one text, in tiles of 40: sets are compared once each, not once for each tile."""
    r = np.random.default_rng(12)
    base = [f"w{k}" for k in r.integers(0, 10**6, 300)]
    rows = []
    for i in range(900):
        w = list(base) if i % 3 == 0 else [f"v{k}" for k in r.integers(0, 10**6, 60)]
        w[int(r.integers(0, len(w)))] = f"e{i}"
        rows.append((i, " ".join(w)))
    # Some near copies of copies, which link with those but not with the head.
    far = rows[300 - 300 % 3][1].split()
    for j in range(12):
        far[20 * j + 7] = f"f{j}"
        rows.append((1000 + j, " ".join(far)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, by_group = [], minhash.by_group

    def counted(rows_of, n, keys, schema, fn):
        if keys == ["component", "tile"]:
            seen.append(rows_of.count())
        return by_group(rows_of, n, keys, schema, fn)

    monkeypatch.setattr(minhash, "by_group", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df, tile=40).collect()}
    assert got == brute.linked_shingles(rows)
    assert len({c for _, c in got.values()}) < 620 and seen[0] <= 2 * 320
