"""Segment clocks over an event stream; the batch twin is ``ordering.segment_clock``."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CLOCK_SCHEMA = (
    "segment string, events bigint, active_micros bigint, paused_micros bigint, "
    "exhausted_micros bigint, limit_micros bigint, rejected bigint, released boolean"
)
#: Of each segment of a bucket: its clock, rejected events, events that wait and the next timer.
STATE_SCHEMA = "segments binary"
#: Buckets of segments; a call of the stream's function costs milliseconds, so it serves a bucket's segments at once.
BUCKETS = 2048
#: Rows this much older than the watermark still come to be counted as rejected; Spark drops still older ones.
COUNTED_DAYS = 3650


class Clock(NamedTuple):
    """A segment up to its last event: its time, whether it paused, events, charged time and when the limit was met."""

    last: int | None = None
    mode: bool = False
    events: int = 0
    active: int = 0
    paused: int = 0
    exhausted: int | None = None
    reached: int | None = None

    def advance(self, rows: np.ndarray, limit: int) -> Clock:
        """Charge the gaps before ``rows`` (micros, tie, paused; in order) up to the first event at or over the limit."""
        if not len(rows):
            return self
        at = rows[:, 0]
        gap = np.diff(at, prepend=at[0] if self.last is None else self.last)
        still = np.concatenate([[self.mode], rows[:-1, 2]]) != 0
        active, paused, exhausted, reached = self.active, self.paused, self.exhausted, self.reached
        if exhausted is None:
            spent = active + np.cumsum(np.where(still, 0, gap))
            over = int(np.searchsorted(spent, limit))  # spent never falls
            end = min(over, len(at) - 1)
            paused += int(gap[: end + 1][still[: end + 1]].sum())
            active = int(spent[end])
            if over < len(at):
                exhausted = int(at[over])
                reached = exhausted - (active - limit)
        return Clock(int(at[-1]), bool(rows[-1, 2]), self.events + len(at), active, paused, exhausted, reached)


def stream_segment_time(
    events: DataFrame, *, paused_state: str, hard_seconds: float, watermark: str = "10 minutes", idle_seconds: float | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Running clock of each segment, one row per segment and micro-batch that changes it (update mode).

    ``events``: segment string, at timestamp, tie bigint, state string.  Events wait in the state (24 bytes each) until
    the watermark passes them, so any order within the watermark gives the clock of the batch operator; a row shows
    the waiting ones too.  An event behind the watermark is counted as rejected and never charged.

    ``limit_micros`` is the moment at which active time meets the hard limit.  It is told by the next event, or by a
    timer once the watermark has passed it without one.  ``exhausted_micros`` is the first event at or after it; from
    then on events are only counted and none waits.  With ``idle_seconds`` a segment whose last event is that far
    behind the watermark gets a last row, ``released``, and its state is given up; a later event opens a new clock.

    Segments share the state of one of ``buckets`` buckets, which a task reads and writes as a whole; the number stays
    as it is while the stream keeps its checkpoint.
    """
    limit = int(hard_seconds * 1_000_000)
    idle = None if idle_seconds is None else int(idle_seconds * 1_000_000)
    names = [c.split()[0] for c in CLOCK_SCHEMA.split(", ")]

    def one(held: tuple, arrived: np.ndarray, mark: int) -> tuple[tuple, tuple | None]:
        """(row shown, what is held) of a segment after ``arrived``; nothing is held of one that is released."""
        kept, rejected, waiting, _ = held
        clock = Clock(*kept)
        late = arrived[:, 0] // 1000 < mark
        rejected += int(late.sum())
        rows = np.concatenate([np.frombuffer(waiting, dtype=np.int64).reshape(-1, 3), arrived[~late]])
        rows = rows[np.lexsort(rows.T[::-1])]
        settled = len(rows) if clock.exhausted is not None else int(np.searchsorted(rows[:, 0] // 1000, mark))
        clock = clock.advance(rows[:settled], limit)
        rows = rows[settled:]
        shown = clock.advance(rows, limit)
        timers = []
        if shown.reached is None and shown.last is not None and not shown.mode:
            moment = shown.last + limit - shown.active
            if -(-moment // 1000) < mark:  # the watermark is past every event, so nothing waits
                clock = shown = shown._replace(reached=moment)
            else:
                timers.append(-(-moment // 1000))
        released = False
        if idle is not None and shown.last is not None:
            end = -(-(shown.last + idle) // 1000)
            released = end < mark
            timers.append(end)
        row = (shown.events, shown.active, shown.paused, shown.exhausted, shown.reached, rejected, released)
        return row, None if released else (tuple(clock), rejected, rows.tobytes(), min(timers, default=None))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = pickle.loads(bytes(state.get[0])) if state.exists else {}
        nothing = np.empty((0, 3), dtype=np.int64)
        changed = dict.fromkeys((s for s, (*_, timer) in held.items() if timer is not None and timer < mark), nothing)
        for part in batches:
            codes, segments = pd.factorize(part["segment"])
            rows = np.column_stack([part[c].to_numpy(dtype=np.int64) for c in ("micros", "tie", "paused")])
            ends = np.cumsum(np.bincount(codes, minlength=len(segments)))[:-1]
            for segment, own in zip(segments, np.split(rows[np.argsort(codes, kind="stable")], ends)):
                changed[segment] = np.concatenate([changed.get(segment, nothing), own])
        shown = []
        for segment, arrived in changed.items():
            row, kept = one(held.pop(segment, (Clock(), 0, b"", None)), arrived, mark)
            shown.append((segment, *row))
            if kept is not None:
                held[segment] = kept
        if held:
            state.update((pickle.dumps(held),))
            timers = [timer for *_, timer in held.values() if timer is not None]
            if timers:
                state.setTimeoutTimestamp(max(min(timers), mark + 1))
        elif state.exists:
            state.remove()
        if shown:
            yield pd.DataFrame(
                {n: pd.array(c, dtype="Int64") if n in ("exhausted_micros", "limit_micros") else list(c) for n, c in zip(names, zip(*shown))}
            )

    # The watermark stands on a column moved ahead: rows behind the real one still reach ``fold``.
    ahead = F.col("at") + F.expr(f"interval {COUNTED_DAYS} days")
    return (
        events.select(
            F.pmod(F.xxhash64("segment"), F.lit(buckets)).cast("int").alias("bucket"), "segment", ahead.alias("ahead"), F.unix_micros("at").alias("micros"), F.col("tie").cast("long").alias("tie"),
            F.coalesce(F.col("state") == paused_state, F.lit(False)).cast("long").alias("paused"),
        )
        .where("segment is not null and micros is not null and tie is not null")
        .withWatermark("ahead", f"{watermark} {COUNTED_DAYS} days")
        .groupBy("bucket")
        .applyInPandasWithState(fold, CLOCK_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.EventTimeTimeout)
    )
