"""Scans of runs in order that carry a small state from row to row."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def scan_runs(df: DataFrame, run: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows of each run in ``order``; ``step(state, columns)`` gets the Arrow columns of consecutive rows of one run and gives (state, record batch).

    Rows stream past: a task holds one Arrow batch and the state, however long a run is.  A run is one task's,
    since what happens to a row depends on all rows before it.
    """

    def scan(batches):
        have, state = None, None
        for batch in batches:
            keys = batch.column(run)
            at = 0
            ends = [i + 1 for i in range(len(batch) - 1) if keys[i] != keys[i + 1]] if keys[0] != keys[-1] else []
            for end in [*ends, len(batch)]:
                part = batch.slice(at, end - at)
                key = part.column(run)[0]
                if have is None or key != have:
                    have, state = key, start()
                state, out = step(state, part)
                yield out
                at = end

    return df.repartition(run).sortWithinPartitions(run, *order).mapInArrow(lambda b: scan(x for x in b if len(x)), schema)


def kept(batch: pa.RecordBatch, rows: list[int]) -> pa.RecordBatch:
    return batch.take(pa.array(rows, pa.int64()))
