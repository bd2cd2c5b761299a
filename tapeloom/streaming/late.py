"""The late-row operator as a stream: ordered state per key and period, checkpoints, replay of the suffix."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, period_ms bigint, revision int, events bigint, qty double, notional double, low double, high double, open double, close double, replayed int, refused bigint"
STATE = "ts array<bigint>, ord array<bigint>, same array<bigint>, price array<double>, qty array<double>, marks array<double>, refused array<bigint>, revision int"
NAN = math.nan


def fold(state: tuple, event: tuple) -> tuple:
    """Count, quantity, notional, low, high, open, close after one more event (ts, ordinal, hash, price, quantity) in order; NaN stands for none."""
    n, q, v, lo, hi, first, last = state
    p, x = event[3], event[4]
    if x == x:
        q += x
        v += p * x if p == p else 0.0
    if p == p:
        lo, hi, first, last = (p, p, p, p) if lo != lo else (min(lo, p), max(hi, p), first, p)
    return n + 1, q, v, lo, hi, first, last


EMPTY = (0, 0.0, 0.0, NAN, NAN, NAN, NAN)


def replay(events: list[tuple], marks: list[tuple], start: int, every: int) -> tuple[tuple, int]:
    """Restores the checkpoint at or before `start`, folds the events from there on and renews the checkpoints behind it: the state and the events folded.

    marks: the state before events 0, every, 2 every, ...; those up to `start` stand.
    """
    kept = min(start // every, max(len(marks) - 1, 0))
    del marks[kept + 1 :]
    state, at = (marks[kept] if marks else EMPTY), kept * every
    if not marks:
        marks.append(EMPTY)
    for k in range(at, len(events)):
        if k == len(marks) * every:
            marks.append(state)
        state = fold(state, events[k])
    return state, len(events) - at


def late_stream(events: DataFrame, key: str, ts: str, arrival: str, price: str, qty: str, ordinal: str, period_ms: int = 60_000, close_after_ms: int = 65_000, cutoff_ms: int = 600_000, every: int = 64) -> DataFrame:
    """Corrections as they come: one row per micro-batch for each period that it changed, replacing its row before.

    The state of a period holds its events in order and a checkpoint before every `every`-th of them. New rows are sorted in; the last
    checkpoint before the first of them is restored and the suffix is replayed (`replayed` says how many events), whatever order they came in. The
    rules are those of the batch form: rows equal in all columns but ordinal and arrival are one event; those that arrive cutoff_ms or more
    after the close are only counted as refused; a null or NaN price or qty counts as an event only; null key or ts: ignored. The
    watermark follows the event time by close and cut-off, and with it the state of a period goes.
    """
    t = F.col(ts)
    other = [F.col(c) for c in sorted(events.columns) if c not in (arrival, ordinal)]
    same = F.xxhash64(*[x for c in other for x in (c.isNull(), c)])
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(NAN))
    e = events.where(F.col(key).isNotNull() & t.isNotNull()).select(
        F.col(key).cast("string").alias("key"), (t - F.pmod(t, F.lit(period_ms))).alias("period_ms"), t.alias("t"), F.coalesce(F.col(arrival), t).alias("a"), F.col(ordinal).alias("o"), same.alias("h"), number(price).alias("p"), number(qty).alias("q"), F.timestamp_millis(t).alias("event_time"),
    )
    e = e.withWatermark("event_time", f"{(close_after_ms + cutoff_ms) // 1000 + 1} seconds")

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        have, marks, refused, revision = [], [], set(), -1
        if state.exists:
            *columns, flat, refused_, revision = state.get
            have = list(zip(*columns, strict=True))
            marks = [tuple(flat[i : i + len(EMPTY)]) for i in range(0, len(flat), len(EMPTY))]
            refused = set(refused_)
        seen = {x[2] for x in have}
        close = k[1] + close_after_ms
        first, before = len(have), (len(have), len(refused))
        for f in frames:
            for x in f.itertuples(index=False):
                if x.h in seen:
                    refused.discard(x.h)
                elif x.a - close >= cutoff_ms:
                    refused.add(int(x.h))
                else:
                    seen.add(x.h)
                    refused.discard(x.h)
                    row = (int(x.t), int(x.o), int(x.h), float(x.p), float(x.q))
                    at = bisect_left(have, row[:2], key=lambda y: y[:2])
                    have.insert(at, row)
                    first = min(first, at)
        if (len(have), len(refused)) == before and revision >= 0:
            return
        total, n = replay(have, marks, first, every)
        revision += 1
        columns = [list(c) for c in zip(*have, strict=True)] or [[]] * 5
        state.update((*columns, [float(v) for m in marks for v in m], sorted(refused), revision))
        state.setTimeoutTimestamp(int(max(state.getCurrentWatermarkMs() + 1, close + cutoff_ms)))
        shown = [total[0], *[None if v != v else v for v in total[1:]]]
        yield pd.DataFrame([[k[0], k[1], revision, *shown, n, len(refused)]], columns=["key", "period_ms", "revision", "events", "qty", "notional", "low", "high", "open", "close", "replayed", "refused"])

    return e.groupBy("key", "period_ms").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
