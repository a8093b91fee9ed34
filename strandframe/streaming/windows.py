"""Tumbling windows and transitions over unbounded event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def time_windows(events: DataFrame, time: str, key: str, value: str, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(key, from_at, to_at, n, total): tumbling windows per key; rows later than
    ``late`` are dropped by the watermark, which also bounds the state."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "n", "total")


def count_windows(events: DataFrame, key: str, order: str, value: str, size: int = 8, late: str = "30 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """(key, idx, n, total) of each chunk of ``size`` rows of a key, in the order of
    arrival and, within a batch, of the time ``order``.

    The state of a key is its unfinished chunk: fewer than ``size`` values and two
    counters.  When the watermark (``late`` behind the newest row) is ``idle_ms``
    past a key's last row, its unfinished chunk comes as its last, short one and its
    state leaves, so the state holds the keys of that time only; should the key come
    back, its chunks are numbered from 0 again.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, n, total, last = state.get if state.exists else (0, 0, 0.0, 0)
        out = []
        if state.hasTimedOut:
            out = [(k[0], idx, n, total)] if n else []
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(order)
            for v in rows[value]:
                n, total = n + 1, total + (0.0 if pd.isna(v) else float(v))
                if n == size:
                    out.append((k[0], idx, n, total))
                    idx, n, total = idx + 1, 0, 0.0
            last = max(last, int(rows[order].max().timestamp() * 1000))
            state.update((idx, n, total, last))
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "idx", "n", "total"])

    kind = dict(events.dtypes)[key]
    return events.withWatermark(order, late).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, idx int, n int, total double", "idx int, n int, total double, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
