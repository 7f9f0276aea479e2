"""Process output that grows, completion that may be repeated, and the statistics in it; remaining time and pressure."""

import random

import pytest
from pyspark.sql import functions as F

from siftlight.operators import cache, copyplan, progress
from siftlight.sources import processout
from siftlight.streaming import completion, eta, tagstate


def drained(spark, tmp_path):
    reader = processout.output_lines(spark, str(tmp_path / "out"))
    q = reader.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "lines"))
    q.awaitTermination()
    rows = spark.read.schema(processout.SCHEMA).parquet(str(tmp_path / "lines")).collect()
    return sorted(((r.output, r.line_no, r.record, r.done) for r in rows), key=str)


def test_lines_come_once_whole_and_numbered(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.txt").write_text("one\n\ntw")
    (out / "b.txt").write_bytes("é\nbad \xff".encode("latin-1") + b"\n")
    (out / "c.log").write_text("no output\n")
    assert drained(spark, tmp_path) == [("a.txt", 1, "one", False), ("a.txt", 2, "", False), ("b.txt", 1, "�", False), ("b.txt", 2, "bad �", False)]
    with open(out / "a.txt", "a") as f:
        f.write("o\nthree\nfour without an end")
    assert drained(spark, tmp_path)[2:4] == [("a.txt", 3, "two", False), ("a.txt", 4, "three", False)]
    (out / "a.txt.done").touch()
    (out / "empty.txt").touch()
    (out / "empty.txt.done").touch()
    rows = drained(spark, tmp_path)
    assert ("a.txt", 5, "four without an end", False) in rows and ("a.txt", 5, None, True) in rows and ("empty.txt", 0, None, True) in rows
    assert drained(spark, tmp_path) == rows  # nothing new


def test_pieces_of_a_file_hold_its_lines(tmp_path):
    r = random.Random(2)
    text = b"".join(bytes(r.choices(b"abc", k=r.randrange(0, 9))) + b"\n" for _ in range(200))
    for tail, ends in ((b"", False), (b"last", True)):
        (tmp_path / "x.txt").write_bytes(text + tail)
        if ends:
            (tmp_path / "x.txt.done").touch()
        for split in (1, 3, 7, 64, 10**6):
            for since in (0, text.index(b"\n", 300) + 1):
                reader = processout.OutputReader({"path": str(tmp_path), "split": str(split)})
                pieces = reader.partitions({"x.txt": since}, reader.latestOffset())
                rows = [t for p in pieces for b in reader.read(p) for t in zip(*(c.to_pylist() for c in b.columns))]
                lines = (text + tail).decode().split("\n")[: None if tail else -1]
                first = text[:since].count(b"\n")
                want = [("x.txt", k + 1, line, False) for k, line in enumerate(lines)][first:] + [("x.txt", len(lines), None, True)] * ends
                assert rows == want
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_small_outputs_share_a_task(tmp_path):
    for i in range(1200):
        (tmp_path / f"{i}.txt").write_text(f"{i}\n" * (i % 3))
        if i % 2:
            (tmp_path / f"{i}.txt.done").touch()
    reader = processout.OutputReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) <= 4 and len(end) == 1200
    rows = [t for p in parts for b in reader.read(p) for t in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(r for r in rows if not r[3]) == sorted((f"{i}.txt", k + 1, str(i), False) for i in range(1200) for k in range(i % 3))
    assert sorted(r[:2] for r in rows if r[3]) == sorted((f"{i}.txt", i % 3) for i in range(1, 1200, 2))


STATS = ["Number of files: 3,956 (reg: 3,197, dir: 758, link: 1)", "Number of created files: 12 (reg: 11, dir: 1)", "Number of deleted files: 2", "Number of regular files transferred: 1,011", "Total file size: 1,016,382,148 bytes",
         "Total transferred file size: 97,145,000 bytes", "Literal data: 0 bytes", "sent 97,145 bytes  received 771 bytes  48,958.00 bytes/sec", "total size is 1,016,382,148  speedup is 10,380.14"]


def test_statistics_are_parsed_from_the_last_lines(spark):
    old = ["Number of files: 8", "Number of files transferred: 0", "Total file size: 10 B", "Total transferred file size: 0 B"]
    outputs = {"new": ["x/", "y"] * 30 + STATS, "old": old, "early": STATS + ["later"] * 20, "none": ["boom"], "half": STATS[:4]}
    lines = spark.createDataFrame([(k, i + 1, t) for k, v in outputs.items() for i, t in enumerate(v)], "output string, line_no long, record string").repartition(3)
    got = {r.output: r for r in copyplan.parsed_summary(lines, "output").collect()}
    assert ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in copyplan.parsed_summary(lines, "output").schema) == copyplan.SUMMARY
    n = got["new"]
    assert (n.n_lines, n.n_files, n.n_directories, n.n_created, n.n_deleted, n.n_transferred, n.total_bytes, n.transferred_bytes) == (69, 3197, 758, 12, 2, 1011, 1016382148, 97145000)
    assert n.parsed and n.data_to_synchronize and n.stats == "1011 files : 97.14 MB in 2.00 seconds"
    assert (got["old"].n_files, got["old"].total_bytes, got["old"].data_to_synchronize, got["old"].stats) == (8, 10, False, "0 files : 0.00 MB in 0.00 seconds")
    for k in ("early", "none", "half"):
        r = got[k]
        assert not r.parsed and r.data_to_synchronize and r.stats == copyplan.NO_STATISTICS and r.n_files == r.total_bytes == r.n_transferred == 0 and r.n_lines == len(outputs[k])


def test_printed_statistics_parse_back(spark):
    plan = spark.createDataFrame([("a", 10**9 * (i % 3), ["create", "update", "skip"][i % 3]) for i in range(30)] + [("b", None, "skip")], "catalog string, size long, action string")
    summary = copyplan.copy_summary(plan, "catalog")
    lines = copyplan.summary_lines(summary, "catalog").select(F.col("catalog").alias("output"), (F.col("k") + 1).cast("long").alias("line_no"), "record")
    got = {r.output: r for r in copyplan.parsed_summary(lines, "output").collect()}
    for r in summary.collect():
        assert (got[r.catalog].n_files, got[r.catalog].total_bytes, got[r.catalog].n_transferred, got[r.catalog].transferred_bytes, got[r.catalog].n_created) == (r.n_files, r.total_bytes, r.n_transferred, r.transferred_bytes, r.n_created)


def test_completion_is_safe_to_repeat(spark, tmp_path):
    run = completion.Completions(spark, str(tmp_path / "copies"))
    schema = processout.SCHEMA
    first = spark.createDataFrame([("a", i + 1, t, False) for i, t in enumerate(STATS[:5])] + [("b", 1, "x", False)], schema)
    second = spark.createDataFrame([("a", 6 + i, t, False) for i, t in enumerate(STATS[5:])] + [("a", 9, None, True)], schema)
    third = spark.createDataFrame([("b", 1, None, True)], schema)
    for epoch, df in ((0, first), (0, first), (1, second), (1, second), (2, third), (1, second)):
        run.batch(df, epoch)
    assert sorted((r.output, r.n_lines, r.parsed) for r in run.summaries().collect()) == [("a", 9, True), ("b", 1, False)]
    assert run.lines().count() == 10


def test_completion_runs_on_the_source(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a.txt").write_text("\n".join(STATS[:3]) + "\n")
    run = completion.Completions(spark, str(tmp_path / "copies"))
    stream = lambda: processout.output_lines(spark, str(tmp_path / "out"))
    run.start(stream()).awaitTermination()
    assert run.summaries().count() == 0 and run.lines().count() == 3
    with open(tmp_path / "out/a.txt", "a") as f:
        f.write("\n".join(STATS[3:]))
    (tmp_path / "out/a.txt.done").touch()
    run.start(stream()).awaitTermination()
    run.start(stream()).awaitTermination()
    assert [(r.output, r.n_lines, r.n_transferred) for r in run.summaries().collect()] == [("a.txt", 9, 1011)]


@pytest.mark.parametrize("cuts", [(7, 8, 60), (0, 0, 0), (12, 40, 100)])
def test_remaining_time_as_a_stream_equals_the_batch(spark, tmp_path, cuts):
    r = random.Random(9)
    rows = []
    for run, n in (("a", 130), ("b", 9), ("c", 10), ("d", 40)):
        at = 0
        for i in range(1, n + 1):
            at += r.choice([1, 5, 50]) * 100_000
            rows.append((run, i, at, n + 5))
    schema = "run string, n long, micros long, total long"
    want = sorted((x.run, x.n, x.eta) for x in progress.monotone_eta(progress.eta(spark.createDataFrame(rows, schema))).select("run", "n", "eta").collect())
    with tagstate.state_store(spark):
        for lo, hi in zip((0, *cuts), (*cuts, 10**9)):
            part = [x for x in rows if lo < x[1] <= hi]
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
                source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
                eta.remaining(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "shown")).awaitTermination()
    assert sorted(tuple(x) for x in spark.read.schema(eta.SHOWN).parquet(str(tmp_path / "shown")).collect()) == want


def test_pressure_equals_a_literal_fold(spark):
    r = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 40}", i // 2, r.choice(["warning"] * 6 + ["normal", "critical"] + ["warning"] * 12)) for i in range(2000)] + [("calm", 1, "normal"), ("many", 5, "critical"), *[("many", 9 + i, "warning") for i in range(200)]]
    df = spark.createDataFrame(rows, "k string, seq long, level string").repartition(5)
    for strict in (True, False):
        want = {}
        for k, _, level in sorted(rows):
            v = want.setdefault(k, 5000 * 1024**2)
            want[k] = int(v * 0.6) if level == "warning" else cache.CRITICAL_LIMIT if level == "critical" else v if strict else 5000 * 1024**2
        assert {x.k: x.limit_bytes for x in cache.pressure_limit(df, "k", 5000 * 1024**2, strict).collect()} == want
    v, n = (1 << 63) - 1, 0
    while v:
        v, n = int(v * 0.6), n + 1
    assert n <= cache.MOST_WARNINGS


def test_counters_come_with_the_pass(spark, tmp_path):
    df = spark.createDataFrame([("ram",), ("ram",), ("disk",), ("extract",)], "tier string")
    rows, seen = cache.observed(df)
    rows.write.parquet(str(tmp_path / "r"))
    assert cache.counters(seen) == {"hits": 2, "misses": 1, "extractions": 1, "hit_rate": 200 / 3}
    rows, seen = cache.observed(df.filter("false"), "none")
    rows.write.parquet(str(tmp_path / "n"))
    assert cache.counters(seen)["hit_rate"] == 0.0


def test_destination_that_lists_a_file_twice(spark):
    f = spark.createDataFrame([("a", "x", 3), ("b", "x", 3)], "catalog string, name string, modified int")
    there = spark.createDataFrame([("a", "x", 1), ("a", "x", 5)], "catalog string, name string, modified int")
    by_name = copyplan.copy_plan(f, f, there.drop("catalog"))
    assert sorted((r.catalog, r.action) for r in by_name.collect()) == [("a", "skip"), ("b", "skip")]
    apart = copyplan.copy_plan(f, f, there, by=("catalog", "name"))
    assert sorted((r.catalog, r.action) for r in apart.collect()) == [("a", "skip"), ("b", "create")]


def test_cache_contents_against_a_literal_cache(spark):
    r = random.Random(11)
    log = [(i, r.choice(["a", "b", None]), f"k{r.randrange(9)}", r.randrange(100), r.random() < 0.05) for i in range(300)]
    held = {}
    for _, by, key, cost, clear in log:
        held.setdefault(by, {})
        if clear:
            held[by].clear()
        else:
            held[by][key] = cost
    df = spark.createDataFrame(log, "seq long, session string, file_key string, cost long, clear boolean").repartition(3)
    got = cache.contents(df.filter("NOT clear"), df.filter("clear"), "session")
    assert {(x.session, x.file_key, x.cost) for x in got.collect()} == {(by, k, c) for by, keys in held.items() for k, c in keys.items()}
    o = {x.session: (x.n_entries, x.cost, x.over_cost, x.over_count) for x in cache.occupancy(got, "session", 150, 3).collect()}
    assert o == {by: (len(k), sum(k.values()), max(0, sum(k.values()) - 150), max(0, len(k) - 3)) for by, k in held.items() if k}
