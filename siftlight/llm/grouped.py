"""Groups handed to numpy code one after another, without a Python call per Spark group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import trimmed


def by_group(df: DataFrame, n: int, keys: list[str], schema: str, fn: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``fn`` gets record batches that hold whole groups, and the bounds of the groups in them.

    Rows are partitioned and sorted by the keys; a group cut by the end of a record batch is carried into the next.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def bounds_of(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for k in keys:
                c = np.asarray(t.column(k).combine_chunks())
                new[1:] |= c[1:] != c[:-1]
            return np.append(np.flatnonzero(new), t.num_rows)

        def emit(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            for b in t.combine_chunks().to_batches():
                yield from fn(b, bounds)

        for b in parts:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            bounds = bounds_of(held)
            if len(bounds) > 2:
                yield from emit(held.slice(0, bounds[-2]), bounds[:-1])
                held = held.slice(bounds[-2])
        if held is not None and held.num_rows:
            yield from emit(held, bounds_of(held))

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), schema)
