"""The tag store as stream state and as snapshot with log, against the fold of the whole history."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlight.operators import tagging
from siftlight.sources import store
from siftlight.streaming import taglog, tagstate
from test_review import log

OPS = "seq long, catalog string, name string, op string, rating int"


def fed(spark, path, parts, **options):
    """Each part is a file; every list of parts is a run of the stream, the later ones from the checkpoint."""
    with tagstate.state_store(spark):
        for files in parts:
            for rows in files:
                spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(f"{path}/ops")
            source = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"{path}/ops")
            q = tagstate.changes(source, **options).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/changes")
            q.awaitTermination()
            assert q.exception() is None
        stored = sorted(tagstate.store_of_state(spark, f"{path}/state").collect())
        state = spark.read.format("statestore").option("stateVarName", "names").load(f"{path}/state").collect()
    return stored, state


def folded(spark, ops):
    return sorted(tagging.fold(spark.createDataFrame(ops, OPS)).collect())


def test_state_equals_the_fold_over_batches_restarts_and_late_resets(spark, tmp_path):
    ops = [x for x in log(260, 21) if x[0] != 90]
    late = [(90, "x", None, "reset", None)]  # older than much of what is folded when it comes
    got, state = fed(spark, tmp_path, [[ops[130:200], ops[:130]], [ops[200:], late]], buckets=5)
    assert got == folded(spark, ops + late)
    names = {(c, n) for _, c, n, o, _ in ops if o in ("toggle", "rate") and n is not None}
    assert len(state) == len(names) and {(r.user_map_key.catalog, r.user_map_key.name) for r in state} == names


def test_a_large_catalog_is_dealt_to_many_keys(spark, tmp_path):
    r = random.Random(4)
    ops = [(i, "hot", f"n{r.randrange(60)}", r.choice(["toggle", "toggle", "rate"]), r.randint(0, 5)) for i in range(400)]
    got, state = fed(spark, tmp_path, [[ops[:200], ops[200:]]], buckets=8)
    assert got == folded(spark, ops)
    assert len({row.key.bucket for row in state}) == 8 and max(len(row.user_map_value.seqs) for row in state) < 30


class CountedMap(dict):
    """A map state that counts its calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value


@pytest.mark.parametrize("together", [7, 10**6])
def test_a_row_is_read_and_written_once_for_many_frames(spark, monkeypatch, together):
    monkeypatch.setattr(tagstate, "TOGETHER", together)
    r = random.Random(7)
    ops = [(90, "c", None, "reset", None)] + [(i, "c", f"n{r.randrange(5)}", r.choice(["toggle", "rate"]), r.randint(0, 5)) for i in range(200) if i != 90]
    frames = [pd.DataFrame(ops[k:k + 10], columns=["seq", "catalog", "name", "op", "rating"]) for k in range(0, len(ops), 10)]
    held = tagstate.TagStore()
    held.names, held.epochs = CountedMap(), CountedMap()
    out = pd.concat(held.handleInputRows(("c",), iter(frames), None))
    assert sorted((x.catalog, x.name, x.rating) for x in out[out.tagged].itertuples()) == [tuple(x) for x in folded(spark, ops)]
    assert together < 10**6 or held.names.calls == 2 * 5


def test_lateness_bounds_what_a_row_holds(spark, tmp_path):
    r = random.Random(5)
    ops = [(i, "c", f"n{r.randrange(4)}", r.choice(["toggle", "rate", "toggle"]), r.randint(0, 5)) for i in range(300)]
    got, state = fed(spark, tmp_path / "a", [[ops[:100], ops[100:]]], buckets=2, lateness=20)
    assert got == folded(spark, ops)
    assert max(len(row.user_map_value.seqs) for row in state) <= 21
    # What comes later than that is left out and counted.
    too_late = [(1_000, "c", "n0", "toggle", None)]
    fed(spark, tmp_path / "b", [[[(2_000, "c", "n0", "toggle", None), (3_000, "c", "n0", "rate", 5)], too_late]], buckets=2, lateness=20)
    feed = spark.read.parquet(f"{tmp_path}/b/changes")
    assert feed.agg(F.sum("late")).first()[0] == 1


def test_change_feed_ends_in_the_store(spark, tmp_path):
    ops = [x for x in log(150, 8) if x[3] in ("toggle", "rate")]
    fed(spark, tmp_path, [[ops]], buckets=3)
    feed = spark.read.parquet(f"{tmp_path}/changes").filter("tagged").select("catalog", "name", "rating")
    assert sorted(feed.collect()) == folded(spark, ops)


def flat(nested):
    e = sorted((x.catalog, x.dateStart, x.has_records) for x in store.entries(nested).collect())
    return e, sorted((x.catalog, x.name, x.dateTagged, x.rating) for x in store.flat_records(nested).collect())


@pytest.mark.parametrize("seed", [3, 14])
def test_snapshot_and_tail_equal_the_whole_log(spark, tmp_path, seed):
    ops = [(s * 60_000_000, *rest) for s, *rest in log(300, seed)]
    whole = taglog.TagLog(spark, f"file://{tmp_path}/whole", span=3_600_000_000)
    whole.append(spark.createDataFrame(ops, OPS))
    cut = taglog.TagLog(spark, f"file://{tmp_path}/cut", span=3_600_000_000)
    assert cut.snapshots() == [] and cut.read().count() == 0
    for lo, hi in ((0, 120), (120, 210), (210, 300)):
        cut.append(spark.createDataFrame(ops[lo:hi], OPS))
        if hi < 300:
            cut.compact(ops[hi - 1][0])
    assert flat(cut.read()) == flat(whole.read()) and len(cut.snapshots()) == 2
    # Only the folders behind the snapshot are read.
    newest = cut.snapshots()[-1]
    plan = cut.tail(newest)._jdf.queryExecution().executedPlan().toString()
    assert "(span#" in plan and f">= {(newest + 1) // cut.span})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    # A snapshot that was not committed is not read; old ones and covered folders may go.
    (tmp_path / f"cut/snapshot-{newest + 5}").mkdir()
    assert cut.snapshots()[-1] == newest
    cut.compact(newest - 1)  # nothing older than what is there
    cut.vacuum()
    assert cut.snapshots() == [newest] and flat(cut.read()) == flat(whole.read())


def test_log_takes_a_stream(spark, tmp_path):
    ops = [x for x in log(120, 6) if x[3] != "reset_all"]
    spark.createDataFrame(ops, OPS).repartition(3).write.parquet(f"{tmp_path}/in")
    held = taglog.TagLog(spark, f"file://{tmp_path}/log", span=50)
    for _ in range(2):  # the second run has nothing new
        held.appending(spark.readStream.schema(OPS).parquet(f"{tmp_path}/in")).trigger(availableNow=True).start().awaitTermination()
    got = store.flat_records(held.read()).select("catalog", "name", "rating")
    assert sorted(got.collect()) == folded(spark, ops)
