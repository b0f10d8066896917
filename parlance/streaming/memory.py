"""Ids that a stream has seen, remembered for a time that every repeat renews."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = timedelta(hours=24)
#: Groups of ids that share a state: one Python call a group and trigger. A checkpoint holds on to it.
GROUPS = 1024
#: A time before all others, from which any span can be taken.
NEVER = -(1 << 61)


def _renewed(ttl: timedelta):
    """Lets a row through if its id was not seen within ``ttl`` before. The state of a group of ids has
    24 bytes an id: two hashes and the last time. Times are microseconds, which no time zone shifts."""
    span = ttl // timedelta(microseconds=1)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()  # the newest of its ids is forgotten
            return
        parts = list(frames)
        frame = parts[0] if len(parts) == 1 else pd.concat(parts)
        known = np.frombuffer(state.get[0] if state.exists else b"", np.int64).reshape(3, -1)
        rows = np.stack([frame[c].to_numpy(np.int64) for c in ("_one", "_two", "_micros")])
        old = known.shape[1]
        one, two, at = np.concatenate([known, rows], axis=1)
        order = np.lexsort((at, np.arange(len(at)) >= old, two, one))  # what is known of an id comes first
        one, two, at = one[order], two[order], at[order]
        first = np.ones(len(at), bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        starts = np.flatnonzero(first)
        fresh = order >= old
        # the newest arrival before each row may be that of the state
        before = np.repeat(np.where(fresh[starts], NEVER, at[starts]), np.diff(starts, append=len(at)))
        kept = fresh & (at - before > span)
        follows = ~first
        follows[1:] &= fresh[:-1]
        kept[1:] &= ~follows[1:] | (np.diff(at) > span)
        last = np.maximum.reduceat(at, starts)
        # an id is forgotten once the watermark is at the first millisecond in which it is no repeat any more
        held = (last + span) // 1000 + 1 > state.getCurrentWatermarkMs()
        held[np.argmax(last)] = True
        state.update((np.stack([one[starts], two[starts], last])[:, held].tobytes(),))
        end = int(last.max() + span) // 1000 + 1
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if kept.any():
            yield frame.iloc[order[kept] - old].drop(columns=["_one", "_two", "_micros", "_group"])

    return step


def dedup_renewed(
    events: DataFrame, key: str = "id", time: str | None = None, ttl: timedelta = DAY, late: str = "0 seconds"
) -> DataFrame:
    """Each id once, as long as its arrivals are no more than ``ttl`` apart: every arrival, also one
    that is dropped, renews the memory. A row passes if no row of its id arrived in the ``ttl`` up
    to it, both ends included. Rows are told apart by ``time``, that of processing where it is None;
    with a time of their own, rows that come more than ``late`` after newer ones may be dropped.
    Rows without a time are left out: nothing says what they repeat. A null id is one id.
    An id may be forgotten once the watermark has passed its last arrival by ``ttl``. The session may
    keep its state in any store. Ids are told apart by hashes of 128 bits; GROUPS groups of them have
    a state each, which a trigger with rows of the group reads and writes.
    """
    column = time or "_arrived_at"
    if time is None:
        events = events.withColumn(column, F.current_timestamp())
    names = [c for c in events.columns if c != "_arrived_at"]
    found = (
        events.where(F.col(column).isNotNull())
        .withWatermark(column, late)
        .withColumns(
            {
                "_micros": F.unix_micros(column), "_one": F.xxhash64(key), "_two": F.xxhash64(F.lit(7), key),
                "_group": F.pmod(F.xxhash64(F.lit(9), key), F.lit(GROUPS)).cast("int"),
            }
        )
        .groupBy("_group")
        .applyInPandasWithState(
            _renewed(ttl), events.schema, "ids binary", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    return found.select(*names)


def first_arrivals(events: DataFrame, key: str = "id", time: str = "received_at", ttl: timedelta = DAY) -> DataFrame:
    """The rule of ``dedup_renewed`` over rows that are all there."""
    from pyspark.sql import Window

    last = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    return events.withColumn("_last", last).where(
        F.col("_last").isNull() | (F.col(time) > F.col("_last") + F.lit(ttl))
    ).drop("_last")
