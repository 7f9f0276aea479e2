"""Remaining time while a run goes: the last deltas and the least estimate of each run as state of a stream.

A row comes out for each completion whose estimate does not exceed an earlier one, as soon as its batch is there; how
completions are cut into batches makes no difference. Completions of a run come in order of n from batch to batch; in a
batch they may stand in any order. State is one value a run: the last time, the last deltas (``LOOK_BACK`` at most) and
the least estimate. Needs the RocksDB state store (``tagstate.state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.progress import LOOK_BACK, MIN_ITEMS

STATE = "micros long, deltas array<long>, least long"
SHOWN = "run string, n long, eta long"


class RemainingTime(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, deltas, least = self.run.get() if self.run.exists() else (None, [], None)
        deltas, shown = list(deltas or []), []
        for frame in sorted(rows, key=lambda f: f["n"].min()):
            frame = frame.sort_values("n")
            for n, micros, total in zip(frame["n"].tolist(), frame["micros"].tolist(), frame["total"].tolist(), strict=True):
                if before is not None:
                    deltas = [*deltas, micros - before][-LOOK_BACK:]
                before = micros
                if n < MIN_ITEMS or not deltas:
                    continue
                eta = int(sum(deltas) / len(deltas) * (total - n) / 1e6)
                if least is None or eta <= least:
                    least = eta
                    shown.append((n, eta))
        self.run.update((before, deltas, least))
        if shown:
            yield pd.DataFrame({"run": pd.Series([key[0]] * len(shown), dtype=object), "n": [s[0] for s in shown], "eta": [s[1] for s in shown]})


def remaining(completions: DataFrame) -> DataFrame:
    """(run, n, eta) as it may be shown, from a stream of completions (run, n, micros, total)."""
    c = completions.selectExpr("cast(run as string) as run", "cast(n as long) as n", "cast(micros as long) as micros", "cast(total as long) as total")
    return c.groupBy("run").transformWithStateInPandas(RemainingTime(), SHOWN, "Append", "None")
