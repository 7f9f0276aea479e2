"""Edge rows of the review engine against literal simulations."""

import fractions
import random
import re

from pyspark.sql import functions as F

from siftlight.functions import dates, text
from siftlight.operators import cache, copyplan, images, progress, selection, tagging
from siftlight.plans import review
from siftlight.streaming import tags


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_capture_texts(spark):
    shutter = {0.0: "1/inf", 0.4: "1/2", 0.0005: "1/2000", 1.0: '1.0"', 1.3: '1.3"'}
    rows = spark.createDataFrame([(k,) for k in shutter], "t double").select("t", text.shutter_text(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == shutter
    assert one(spark, text.focal_text(F.lit(0.25))) == "0.2mm"
    assert one(spark, text.aperture_text(F.lit(2.8))) == "ƒ/2.8"
    assert one(spark, text.iso_text(F.lit(None).cast("double"))) is None


def test_byte_units(spark):
    n = [0, 1, 1023, 1024, 1024**2, 1024**3, 2 * 1024**4]
    df = spark.createDataFrame([(x,) for x in n], "n long").select("n", text.bytes_human(F.col("n")).alias("a"))
    assert [r.a for r in df.orderBy("n").collect()] == ["0 B", "1.0 B", "1023.0 B", "1.0 KB", "1.0 MB", "1.0 GB", "2.0 GB"]
    r = random.Random(1)
    n = [r.randint(1, 2 ** r.randint(1, 62)) for _ in range(300)] + [1024**k * m // 20 for k in range(1, 7) for m in range(20, 60)] + [2**63 - 1]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select("n", text.bytes_human(F.col("n")).alias("a")).collect()
    for x in rows:
        k = (x.n.bit_length() - 1) // 10
        tenths = round(fractions.Fraction(10 * x.n, 1024**k))  # ties to even
        assert x.a == f"{tenths // 10}.{tenths % 10} {['B', 'KB', 'MB', 'GB'][min(k, 3)]}"


def test_sizes_beyond_64_bits_and_beyond_doubles(spark):
    r = random.Random(2)
    n = [r.randint(1, 2 ** r.randint(50, 92)) for _ in range(300)] + [1024**k * m // 20 for k in range(6, 9) for m in range(20, 60)] + [2**30 * (2**25 + 1) - 1, 2**63 - 1, 2**63, (9 * 10**6) ** 3]
    df = spark.createDataFrame([(str(x),) for x in n], "t string").withColumn("n", F.col("t").cast("decimal(38,0)"))
    small = spark.createDataFrame([(x,) for x in n if x < 2**63], "n long")
    texts = [text.bytes_human(F.col("n")).alias("a"), text.gib_text(F.col("n")).alias("g"), text.file_size_text(F.col("n")).alias("d"), text.memory_text(F.col("n")).alias("m")]
    rows = df.select("n", *texts).collect()
    assert len(rows) == len(n)
    for x in [*rows, *small.select("n", *texts).collect()]:
        v = int(x.n)
        k = (v.bit_length() - 1) // 10
        tenths = round(fractions.Fraction(10 * v, 1024**k))
        assert (x.a, x.g) == (f"{tenths // 10}.{tenths % 10} GB", f"{v >> 30} GB") or v < 2**30
        assert v < 10**9 or (x.d, x.m) == ("%.1f GB" % (float(v) / 10**9), f"{round(float(v) / 2**30)} GB") or v < 2**30


def test_cubes_of_large_keys(spark, tmp_path):
    keys = [0, 7, 2_097_151, 2_097_152, 9_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {x.o_orderkey: (x.human, x.gib) for x in review.bytes_human(spark, str(tmp_path)).collect()}
    assert got == {0: ("0 B", "0 GB"), 7: ("343.0 B", "0 GB"), 2_097_151: ("8.0 GB", "8589922304 GB"), 2_097_152: ("8.0 GB", "8589934592 GB"), 9_000_000: ("632.3 GB", "678934156894 GB")}


def test_large_image_meets_its_size_by_bands(spark):
    r = random.Random(6)
    px = [("a", r.randrange(40), r.randrange(300), *(r.randrange(256) for _ in "rgb")) for _ in range(3000)] + [("a", 3, 299, 1, 2, 3)] * 5 + [("b", 0, 0, 9, 8, 7)]
    small = images.thumbnail(spark.createDataFrame(px, "image string, x int, y int, r int, g int, b int").repartition(3), 32)
    cells, side = {}, {k: max(max(p[1], p[2]) for p in px if p[0] == k) + 1 for k in "ab"}
    for k, x, y, *rgb in px:
        at = (k, x * 32 // side[k], y * 32 // side[k]) if side[k] > 32 else (k, x, y)
        cells.setdefault(at, []).append(rgb)
    assert {tuple(x) for x in small.collect()} == {(*at, *(sum(c) // len(v) for c in zip(*v))) for at, v in cells.items()}
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(\(image#\d+ = image#\d+\) AND \(band#", plan)


def test_costs_and_capacity(spark):
    reps = spark.createDataFrame([("a", 256, 256, 4, 256, 256), ("b", 0, 0, 4, 10, 10)], "image string, width long, height long, bpp int, logical_width long, logical_height long")
    assert {r.image: r.cost for r in cache.total_cost(reps, "image").collect()} == {"a": 288358, "b": 440}
    assert one(spark, text.image_capacity(F.lit(5000), F.lit(1024).cast("long"), F.lit(4))) == 1250
    assert [one(spark, text.size_kilobytes(F.lit(s).cast("long"), F.lit(4))) for s in (100, 1024, 8700)] == [39, 4096, 295664]


def test_pressure(spark):
    df = spark.createDataFrame(list(zip(range(5), ["warning", "warning", "normal", "critical", "warning"])), "seq long, level string").withColumn("k", F.lit(1))
    assert cache.pressure_limit(df, "k", 5242880000).first().limit_bytes == 31457280


def test_search_is_accent_sensitive(spark):
    df = spark.createDataFrame([("É1",), ("é2",), ("e3",)], "name string")
    found = lambda q: {r.name for r in df.filter(selection.matches(F.col("name"), q)).collect()}
    assert found("é") == {"É1", "é2"} and found("E") == {"e3"} and len(found("")) == 3


def test_first_record_wins_and_missing_ratings_are_zero(spark):
    files = spark.createDataFrame([("c", n) for n in "abcd"], "catalog string, name string")
    records = spark.createDataFrame([("c", "a", 2, 0), ("c", "a", 5, 1), ("c", "b", None, 2)], "catalog string, name string, rating int, position long")
    got = {r.name: (r.rating, r.tagged) for r in selection.with_rating(files, records).collect()}
    assert got == {"a": (2, True), "b": (0, True), "c": (0, False), "d": (0, False)}


def test_the_whole_table_is_sorted_and_numbered(spark, tmp_path):
    from siftlight.plans import registry

    r = random.Random(4)
    rows = [(f"k{i:04}", r.choice([None, 7, 7, r.randint(0, 99)])) for i in range(700)]  # one size is hot
    df = spark.createDataFrame(rows, "file_key string, size long").repartition(5)
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    got = selection.numbered(df, str(tmp_path / "n"), F.col("size").desc()).collect()
    assert [(x.file_key, x.size) for x in got] == want and [x.place for x in got] == list(range(1, 701))
    assert selection.numbered(df.filter("false"), str(tmp_path / "none"), F.col("size").desc()).count() == 0
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert files > 100 and registry.queries()["sort_by_size_desc_all"](spark, "/root/testdata/sf0.001").count() == files


def log(n, seed):
    r = random.Random(seed)
    ops = r.choices(["toggle", "rate", "reset", "reset_all"], [60, 30, 3, 0.3], k=n)
    return [(i, None if op == "reset_all" else r.choice("xy"), None if op.startswith("reset") else r.choice("abcde"), op, r.randint(0, 5) if op == "rate" else None) for i, op in enumerate(ops)]


def test_tag_fold_equals_a_literal_fold(spark):
    for seed in range(3):
        ops = log(400, seed)
        store = {"x": {}, "y": {}}
        for _, catalog, name, op, rating in ops:
            if op == "reset_all":
                store["x"].clear(), store["y"].clear()
            else:
                tags.step(store[catalog], name, op, rating)
        df = spark.createDataFrame(ops, "seq long, catalog string, name string, op string, rating int")
        got = {(r.catalog, r.name): r.rating for r in tagging.fold(df).collect()}
        assert got == {(c, n): v for c, names in store.items() for n, v in names.items()}


def test_store_keeps_dates_and_reset_catalogs(spark, tmp_path):
    from siftlight.sources import store

    ops = [(1, "a", "p", "toggle", None), (2, "a", "q", "toggle", None), (3, "b", "p", "toggle", None), (4, "b", None, "reset", None), (5, "c", "p", "toggle", None), (6, "c", "p", "toggle", None), (7, "a", "p", "rate", 5), (8, "d", None, "reset", None)]
    df = spark.createDataFrame(ops, "seq long, catalog string, name string, op string, rating int")
    entries = tagging.entries(df)
    assert {(r.catalog, r.started_seq, r.has_records) for r in entries.collect()} == {("a", 1, True), ("b", 3, False), ("c", 5, True)}
    records = tagging.records(df).withColumn("dateTagged", F.concat(F.lit("day "), "tagged_seq"))
    nested = store.nested(records, entries.withColumn("dateStart", F.concat(F.lit("day "), "started_seq")))
    store.write_store(nested, str(tmp_path / "s"))
    got = {r.catalog: r for r in store.read_store(spark, str(tmp_path / "s")).collect()}
    assert [(x.fileName, x.dateTagged, x.rating) for x in got["a"].filerecords] == [("p", "day 1", 5), ("q", "day 2", 3)]
    assert got["b"].filerecords is None and got["b"].dateStart == "day 3" and got["c"].filerecords == []
    stored = spark.createDataFrame([("a", "p", "1 Jan", "2 Jan", 4), ("a", "q", "3 Jan", None, None), ("b", "p", "4 Jan", None, 1)], "catalog string, name string, dateTagged string, dateCopied string, rating int")
    ops = [(0, "a", "q", "toggle", None), (1, "a", "q", "toggle", None), (2, "b", None, "reset", None), (3, "b", "r", "toggle", None)]
    after = tagging.records(spark.createDataFrame(ops, df.schema), store=stored).collect()
    assert sorted((r.catalog, r.name, r.rating, r.tagged_seq, r.dateTagged, r.dateCopied) for r in after) == [("a", "p", 4, None, "1 Jan", "2 Jan"), ("a", "q", 3, 1, None, None), ("b", "r", 3, 3, None, None)]
    everything = spark.createDataFrame([(9, None, None, "reset_all", None)], df.schema).union(df)
    assert tagging.entries(everything).count() == 0 and tagging.records(everything, store=stored).count() == 0


def test_status_texts(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 30)], "n long, b long").select(copyplan.status_text(F.col("n"), F.col("b")).alias("t"))
    assert [r.t for r in df.collect()] == ["No data to synchronize", "1 file changed\nbyte for transfer", "2 files changed\n30 bytes for transfer"]


def test_eta_equals_a_literal_simulation(spark):
    for seed, items in ((1, 9), (2, 10), (3, 11), (4, 120)):
        r = random.Random(seed)
        at, t = [], 0
        for _ in range(items):
            t += r.randint(1, 5_000_000)
            at.append(t)
        total, shown, deltas = items + 7, [], []
        for n in range(1, items + 1):
            if n > 1:
                deltas.append(at[n - 1] - at[n - 2])
            if n >= 10:
                last = deltas[-10:] if n > 10 else deltas
                eta = int(sum(last) / len(last) * (total - n) / 1e6)
                if not shown or eta <= shown[-1][1]:
                    shown.append((n, eta))
        df = spark.createDataFrame([("r", k + 1, x, total) for k, x in enumerate(at)], "run string, n int, micros long, total int")
        got = progress.monotone_eta(progress.eta(df)).orderBy("n").collect()
        assert [(x.n, x.eta) for x in got] == shown


def test_output_lines(spark):
    for n in (0, 11, 12, 20, 21):
        df = spark.createDataFrame([("o", k + 1, "x/" if k % 5 == 0 else "") for k in range(n)], "output string, line_no int, record string")
        assert sorted(r.line_no for r in copyplan.tail(df, "output").collect()) == list(range(1, n + 1))[-20:]
        assert sorted(r.line_no for r in copyplan.drop_last(df, "output").collect()) == list(range(1, n + 1))[:max(0, n - 11)]
        assert copyplan.without_directories(df).count() == n - len(range(0, n, 5))


def test_histogram_edges(spark):
    df = spark.createDataFrame([("i", 0, 0, 0), ("i", 255, 255, 255), ("i", 255, 255, 255)], "image string, r int, g int, b int")
    h = images.histogram(df)
    got = {r.bin: r.n for r in h.collect()}
    assert len(got) == 256 and got[0] == 1 and got[255] == 2
    assert {r.bin: r.norm for r in images.normalised(h).collect()}[0] == 0.5
    assert images.normalised(images.histogram(df.filter("false"))).count() == 0


def test_largest_preview_ties(spark):
    df = spark.createDataFrame([("f", 0, 100, False), ("f", 1, 90, True), ("f", 2, 90, True), ("g", 0, 5, False), ("h", 0, 0, True)], "file string, idx int, width int, jpeg boolean")
    assert [(r.file, r.idx) for r in images.largest_preview(df).collect()] == [("f", 1)]
    assert one(spark, images.width(F.lit(None).cast("double"), F.lit(7.9), F.lit(3.0))) == 7


def test_retention_is_strict(spark):
    df = spark.sql("select * from values (1, timestamp '2024-01-01 00:00:00'), (2, timestamp '2023-12-31 23:59:59'), (3, null) as t(k, modified)")
    now = F.expr("timestamp '2024-01-31 00:00:00'")
    assert [r.k for r in copyplan.prune_candidates(df, now, 30).collect()] == [2]
    assert sorted(r.k for r in copyplan.retained(df, now, 30).collect()) == [1, 3]


def test_calendar(spark):
    d = F.lit("2024-02-10").cast("date")
    days = one(spark, dates.grid_days(d))
    assert str(days[0]) == "2024-01-29" and str(days[-1]) == "2024-02-29" and len(days) == 32
    assert one(spark, dates.parse_store(F.lit("no date"))) is None
    assert one(spark, dates.store_text(dates.parse_store(F.lit("16 Feb 2026 10:59")))) == "16 Feb 2026 10:59"
