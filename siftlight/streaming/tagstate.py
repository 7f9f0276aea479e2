"""The tag store as state of a stream: a row per (catalog, name) in map states that many keys share.

Names are dealt to ``buckets`` state keys by hash, so no state row and no group holds a catalog, and a large catalog is
folded by many tasks. A reset of a catalog (or of everything) goes to all buckets, where it is one number, the epoch of
that catalog: what is older is dead, and is compared when its row is next touched or read, not looked for.

Operations may arrive in any order of seq. A row holds what is settled (the record as it stood at ``settled_to``) and the
operations after it, so a late toggle, rating or reset gives what it would have given in time. ``lateness`` bounds how
long operations are kept apart: those older than the newest of their name by more are settled, and what arrives later
than that is left out (and counted in the change feed as ``late``). Without it nothing settles but by resets.

Needs the RocksDB state store (``state_store``), as map states do.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import tagging
from ..operators.tagging import NEW_RATING
from .tags import tag_changes

BUCKETS = 64
NAME, RECORD = "catalog string, name string", "tagged_seq long, rating int, settled_to long, seqs array<long>, ratings array<int>"
EPOCH_OF, EPOCH = "catalog string, everything boolean", "seq long"
CHANGES = "catalog string, name string, tagged boolean, rating int, tagged_seq long, late int"
#: A rating of this value in ``ratings`` stands for a toggle.
TOGGLE = -1
#: Operations of a key that are put together before its rows are read and written: each costs a call to the state store.
TOGETHER = 200_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession, partitions: int = BUCKETS):
    """While a stream is started or its state read, the session uses the state store that map states need, and no more
    partitions than there are keys: a stream keeps the number it was started with."""
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": str(min(partitions, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def apply(record: tuple[int | None, int | None], ops: list[tuple[int, int]], new_rating: int = NEW_RATING) -> tuple[int | None, int | None]:
    """(tagged_seq, rating) after operations (seq, rating or TOGGLE) in order of seq; tagged_seq is null for an untagged name."""
    tagged, rating = record
    for seq, what in ops:
        if what == TOGGLE:
            tagged, rating = (seq, new_rating) if tagged is None else (None, None)
        elif tagged is not None:
            rating = what
    return tagged, rating


class TagStore(StatefulProcessor):
    def __init__(self, lateness: int | None = None, new_rating: int = NEW_RATING):
        self.lateness, self.new_rating = lateness, new_rating

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", NAME, RECORD)
        self.epochs = handle.getMapState("epochs", EPOCH_OF, EPOCH)

    def close(self) -> None:
        pass

    def _epoch(self, catalog: str | None) -> int:
        known = [v[0] for k in ((catalog, False), (None, True)) if (v := self.epochs.getValue(k)) is not None]
        return max(known, default=-1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[tuple, tuple] = {}
        ops: dict[tuple, list] = {}
        n = 0
        for frame in rows:
            resets = frame[frame["op"].isin(["reset", "reset_all"])]
            for catalog, everything, seq in zip(resets["catalog"], resets["op"] == "reset_all", resets["seq"], strict=True):
                at = (None, True) if everything else (catalog, False)
                was = self.epochs.getValue(at)
                if was is None or was[0] < seq:
                    self.epochs.updateValue(at, (int(seq),))
            one = frame[frame["op"].isin(["toggle", "rate"])]
            for catalog, name, op, rating, seq in zip(one["catalog"], one["name"], one["op"], one["rating"], one["seq"], strict=True):
                ops.setdefault((catalog, name), []).append((int(seq), TOGGLE if op == "toggle" else int(rating)))
            n += len(one)
            if n >= TOGETHER:
                self._take(ops, changed)
                ops, n = {}, 0
        self._take(ops, changed)
        if changed:
            yield pd.DataFrame(
                {"catalog": pd.Series([k[0] for k in changed], dtype=object), "name": pd.Series([k[1] for k in changed], dtype=object), "tagged": [v[0] is not None for v in changed.values()],
                 "rating": pd.array([v[1] for v in changed.values()], "Int32"), "tagged_seq": pd.array([v[0] for v in changed.values()], "Int64"), "late": [v[3] for v in changed.values()]})

    def _take(self, ops: dict[tuple, list], changed: dict[tuple, tuple]) -> None:
        """Operations by name into the state, a row read and written once for all of them."""
        epochs: dict[str | None, int] = {}
        for at, new in ops.items():
            if at[0] not in epochs:
                epochs[at[0]] = self._epoch(at[0])
            changed[at] = self._merged(at, new, epochs[at[0]], changed.get(at, (0,) * 4)[3])

    def _merged(self, at: tuple, new: list, epoch: int, late: int) -> tuple:
        tagged, rating, settled_to, seqs, ratings = self.names.getValue(at) or (None, None, -1, [], [])
        held = list(zip(seqs or [], ratings or [], strict=True))
        late += sum(seq <= settled_to for seq, _ in new)
        if epoch >= settled_to:  # the settled record is dead as a whole
            tagged, rating, settled_to = None, None, epoch
        held = sorted((x for x in [*held, *new] if x[0] > settled_to), key=lambda x: x[0])
        if self.lateness is not None and held:
            old = [x for x in held if x[0] <= held[-1][0] - self.lateness]
            if old:
                tagged, rating = apply((tagged, rating), old, self.new_rating)
                settled_to, held = old[-1][0], held[len(old):]
        self.names.updateValue(at, (tagged, rating, settled_to, [s for s, _ in held], [r for _, r in held]))
        return (*apply((tagged, rating), held, self.new_rating), settled_to, late)


def changes(ops: DataFrame, buckets: int = BUCKETS, lateness: int | None = None) -> DataFrame:
    """The stream of changed records (see ``CHANGES``): what each batch made of the names it touched.

    A reset is no change of a name: who follows the feed drops records that are older than a catalog's reset. Seqs of
    one name are distinct and 0 or more; ratings are 0 or more, and a rating operation without one is none.
    """
    c = tag_changes(ops).filter("op <> 'rate' OR rating IS NOT NULL")
    everywhere = F.sequence(F.lit(0), F.lit(buckets - 1))
    bucket = F.when(F.col("op").isin("reset", "reset_all"), everywhere).otherwise(F.array(F.pmod(F.xxhash64("catalog", "name"), F.lit(buckets)).cast("int")))
    dealt = c.select(F.explode(bucket).alias("bucket"), "catalog", "name", "op", "rating", F.col("seq").cast("long").alias("seq"))
    return dealt.groupBy("bucket").transformWithStateInPandas(TagStore(lateness), CHANGES, "Append", "None")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def stored(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(settled records, operations after them) that are alive in the state of a stopped or running stream.

    Both are what ``tagging.records(operations, store=settled)`` takes; epochs are compared here, on read.
    """
    names = _state(spark, checkpoint, "names").select("user_map_key.*", "user_map_value.*")
    epochs = _state(spark, checkpoint, "epochs").select("user_map_key.*", F.col("user_map_value.seq").alias("epoch"))
    of = epochs.filter("NOT everything").groupBy(F.col("catalog").alias("of")).agg(F.max("epoch").alias("own"))  # equal in all buckets
    everything = epochs.filter("everything").agg(F.max("epoch").alias("epoch")).scalar()
    epoch = F.coalesce(F.greatest(F.col("own"), everything), F.lit(-1))
    alive = names.join(of, F.col("catalog").eqNullSafe(F.col("of")), "left").withColumn("epoch", epoch)
    settled = alive.filter("tagged_seq IS NOT NULL AND settled_to > epoch")
    settled = settled.select("catalog", "name", F.lit(None).cast("string").alias("dateTagged"), F.lit(None).cast("string").alias("dateCopied"), "rating")
    ops = alive.select("catalog", "name", "epoch", F.inline(F.arrays_zip("seqs", "ratings"))).filter("seqs > epoch")
    return settled, ops.select("catalog", "name", F.when(F.col("ratings") == TOGGLE, "toggle").otherwise("rate").alias("op"), F.when(F.col("ratings") != TOGGLE, F.col("ratings")).alias("rating"), F.col("seqs").alias("seq"))


def store_of_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(catalog, name, rating): the store as the stream's state has it."""
    settled, ops = stored(spark, checkpoint)
    return tagging.records(ops, store=settled).select("catalog", "name", "rating")
