"""Rate windows anchored at a client's first request, and event counts by minute."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_MS = 60_000
OUT = "user_id long, event_id long, ms long, accepted boolean, retry_after long"


def decided(ms: np.ndarray, state: tuple[int, int], limit: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(accepted, seconds to wait, state) of a client's requests in order, one step for each window; state is a window's begin and its requests so far."""
    begin, n = state
    start, nth = np.empty(len(ms), dtype=np.int64), np.empty(len(ms), dtype=np.int64)
    at = 0
    while at < len(ms):
        if begin < 0 or ms[at] - begin >= WINDOW_MS:
            begin, n = int(ms[at]), 0
        end = int(np.searchsorted(ms, begin + WINDOW_MS, side="left"))
        start[at:end], nth[at:end] = begin, n + 1 + np.arange(end - at)
        n, at = n + end - at, end
    accepted = nth <= limit
    return accepted, np.where(accepted, 0, np.maximum(1, -((ms - start - WINDOW_MS) // 1000))), (begin, n)


def fold(rows: pd.DataFrame, state: tuple[int, int], limit: int) -> tuple[pd.DataFrame, tuple[int, int]]:
    out = rows.sort_values(["ms", "event_id"])[["user_id", "event_id", "ms"]].reset_index(drop=True)
    ok, wait, state = decided(out["ms"].to_numpy(dtype=np.int64), state, limit)
    return out.assign(accepted=ok, retry_after=wait), state


def rate_limited(events: DataFrame, limit: int = 120) -> DataFrame:
    """Batch: every event (event_id, user_id, ts) with the decision.

    A client's windows depend on each other, so its requests are read in order by
    one task, in Arrow batches; only the window's begin and count are kept.
    """
    rows = events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, (-1, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            who, ms = batch.column("user_id").to_numpy(zero_copy_only=False), batch.column("ms").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            oks, waits = [], []
            for a, b in zip(first.tolist(), np.append(first[1:], len(who)).tolist(), strict=True):
                if who[a] != user:
                    user, state = who[a], (-1, 0)
                ok, wait, state = decided(ms[a:b], state, limit)
                oks.append(ok)
                waits.append(wait)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(oks)), pa.array(np.concatenate(waits))], names=["user_id", "event_id", "ms", "accepted", "retry_after"])

    return rows.filter("user_id is not null and ms is not null").mapInArrow(of, OUT)


def rate_limited_stream(events: DataFrame, limit: int = 120) -> DataFrame:
    """Streaming: the same decisions, state by client, forgotten a window after the last request."""

    def of(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get if state.exists else (-1, 0)
        out, kept = fold(pd.concat(list(parts)), tuple(kept), limit)
        state.update(kept)
        state.setTimeoutDuration(WINDOW_MS)
        yield out

    rows = events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return rows.groupBy("user_id").applyInPandasWithState(of, OUT, "start long, count long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling_counts(events: DataFrame, seconds: int = 60, late: str | None = None) -> DataFrame:
    """Events by minute and type; with ``late`` a watermark for streams."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", f"{seconds} seconds"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
