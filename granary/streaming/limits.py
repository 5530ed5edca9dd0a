"""Rate limit, running mean and dwell on streams: the rules of the batch forms in `granary.operators.events` and `tracking`,
with a key's few numbers kept as state between micro-batches, until the watermark has passed its last row by long enough.

Rows of a key must come in time order from batch to batch; within a batch they are sorted. Rows older than the watermark,
forget_after seconds behind the latest row, are dropped."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: From a key's state (None: a new key) and its sorted rows to the state after them and the rows to emit.
Fold = Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def keyed_fold(rows: DataFrame, by: Sequence[str], order: Sequence[str], fold: Fold, out: str, state: str, forget_after: float) -> DataFrame:
    """`fold` over each key's rows in order; `ts` is the time column. out and state: DDL of the emitted rows and the state."""
    names = [f.split()[0] for f in out.split(", ")]

    def work(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        own = pd.concat(list(parts)).sort_values(list(order), kind="stable")
        new, found = fold(held.get if held.exists else None, own)
        held.update(new)
        held.setTimeoutTimestamp(int(own["ts"].max().timestamp() * 1000 + 1000 * forget_after))
        yield found[names]

    timed = rows.withWatermark("ts", f"{int(forget_after)} seconds").groupBy(*by)
    return timed.applyInPandasWithState(work, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def _ddl(rows: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)


def _micros(ts: Any) -> int:
    return ts.value // 1000


def rate_limit_stream(events: DataFrame, by: Sequence[str], seconds: float, forget_after: float = 3600.0) -> DataFrame:
    """Events at least `seconds` after the last one of their key that passed: by, event_id, ts. A silence of forget_after
    must be no shorter than `seconds`: then a forgotten key's next event would have passed anyway."""
    if forget_after < seconds:
        raise ValueError("a key must be remembered for as long as it is limited")
    gap = round(seconds * 1e6)

    def fold(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        last, keep = state[0] if state else None, []
        for ts in rows["ts"]:
            ok = last is None or _micros(ts) - last >= gap
            last = _micros(ts) if ok else last
            keep.append(ok)
        return (last,), rows[keep]

    cols = [*by, "event_id", "ts"]
    return keyed_fold(events.select(*cols), by, ("ts", "event_id"), fold, _ddl(events, cols), "last long", forget_after)


def smoothed_stream(events: DataFrame, value: str, by: Sequence[str], new: float = 0.2, low: float = 0.2, high: float = 3.0, start: float = 1.0, forget_after: float = 3600.0) -> DataFrame:
    """by, event_id, ts and smoothed: the running mean that takes a share `new` of each value and is clamped after each. A
    key that was silent for longer than forget_after starts anew."""

    def fold(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        mean, out = state[0] if state else start, []
        for v in rows["__v"]:
            if not pd.isna(v):
                mean = max(low, min(high, (1 - new) * mean + new * v))
            out.append(mean)
        return (mean,), rows.assign(smoothed=out)

    cols = [*by, "event_id", "ts"]
    rows = events.select(*cols, F.col(value).cast("double").alias("__v"))
    return keyed_fold(rows, by, ("ts", "event_id"), fold, _ddl(events, cols) + ", smoothed double", "mean double", forget_after)


def dwell_stream(positions: DataFrame, radius: float, timeout: float, by: Sequence[str] = ("key", "id"), forget_after: float = 3600.0) -> DataFrame:
    """by, fire_at: the first time (seconds) that each target has stayed within the radius of where it came to rest for the
    timeout. positions: by, ts, x, y. A fired target is remembered until it is silent for forget_after."""

    def fold(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        t0, x0, y0, fired = state or (None, None, None, False)
        fire = None
        for ts, x, y in zip(rows["ts"], rows["x"], rows["y"], strict=True):
            t = _micros(ts) / 1e6
            if t0 is None or math.hypot(x - x0, y - y0) > radius:
                t0, x0, y0 = t, float(x), float(y)
            elif not fired and t - t0 >= timeout:
                fire, fired = t, True
        found = rows.head(0 if fire is None else 1).assign(fire_at=fire if fire is not None else 0.0)
        return (t0, x0, y0, fired), found

    rows = positions.select(*by, "ts", "x", "y")
    return keyed_fold(rows, by, ("ts", "x", "y"), fold, _ddl(positions, by) + ", fire_at double", "t double, x double, y double, fired boolean", forget_after)
