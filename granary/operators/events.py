"""Event streams as tables: windows, running averages, changes, sessions, limits, ranking. All work on batch relations
(event_id, event_type, source, ts, ...); the window and session ones also on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def route(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events with every subscriber (subscriber, event_type; `*` for all) of their type, each once. Events meet
    subscriptions by equal types, as their own and as `*`, so tables of any size join by their keys; one subscriber of
    both is one."""
    subs = subscriptions.select("subscriber", F.col("event_type").alias("wanted")).distinct()
    both = subs.filter("wanted = '*'").select("subscriber", F.lit(True).alias("all"))
    subs = subs.join(both, "subscriber", "left").filter("wanted = '*' or all is null").select("subscriber", "wanted")
    rows = events.withColumn("wanted", F.explode(F.array(F.col("event_type"), F.lit("*"))))
    return rows.join(subs, "wanted").drop("wanted")


def tumbling_summary(events: DataFrame, types: Sequence[str], width: str = "2 seconds", latency: str = "value") -> DataFrame:
    """Per window: events, a count per type, the mean of latencies that are not 0. Windows without events have no row."""
    mean = F.avg(F.nullif(F.col(latency), F.lit(0.0)))
    counts = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types]
    out = events.groupBy(F.window("ts", width)).agg(F.count("*").alias("events"), *counts, mean.alias("avg_latency"))
    return out.select(F.col("window.start").alias("window_start"), *out.columns[1:])


def first_of_window(events: DataFrame, width: str = "2 seconds", most: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """The first `most` events of each window, by time and id; later ones are dropped."""
    w = F.window("ts", width)["start"]
    nth = F.row_number().over(W.partitionBy(*by, "__w").orderBy("ts", "event_id"))
    return events.withColumn("__w", w).withColumn("__n", nth).filter(F.col("__n") <= most).drop("__w", "__n")


def sliding_average(events: DataFrame, value: str, by: Sequence[str], n: int = 100) -> DataFrame:
    """avg_last: the mean of the last n values up to each event."""
    return events.withColumn("avg_last", F.avg(value).over(W.partitionBy(*by).orderBy("ts", "event_id").rowsBetween(1 - n, 0)))


def sessions(events: DataFrame, by: Sequence[str], gap: str = "500 milliseconds") -> DataFrame:
    """Heartbeat sessions: a silence of the gap or more ends one."""
    out = events.groupBy(*by, F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return out.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def changes(events: DataFrame, state: str, by: Sequence[str]) -> DataFrame:
    """Rows whose state is not that of the row before (the first counts): with old_state."""
    order = W.partitionBy(*by).orderBy("ts", "event_id")
    rows = events.withColumn("old_state", F.lag(state).over(order)).withColumn("__n", F.row_number().over(order))
    return rows.filter((F.col("__n") == 1) | ~F.col("old_state").eqNullSafe(F.col(state))).drop("__n")


# Switches in order of priority, with the mode that each turns on.
MODES = (("SwC", "SWC"), ("SwD", "SWD"), ("SwA", "SWA"), ("SwB", "SWB"))


def mode(switches: Column, threshold: int = 1800) -> Column:
    """The mode of the first switch over the threshold, IDLE if none is; null without switches."""
    out = F.lit("IDLE")
    for switch, name in reversed(MODES):
        out = F.when(F.element_at(switches, switch) > threshold, name).otherwise(out)
    return F.when(F.size(switches) > 0, out)


def rate_limit(events: DataFrame, by: Sequence[str], seconds: float) -> DataFrame:
    """Events at least `seconds` after the last one that passed: by, event_id, ts. A key's events come to one task in time
    order and are read as they come; what is held of a key is the time of its last event that passed."""
    rows = events.select(*by, "event_id", "ts").repartition(*by).sortWithinPartitions(*by, "ts", "event_id")
    schema, us = rows.schema, round(seconds * 1e6)
    n = len(by)
    timed = rows.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(n)), strict=True) if n else [()] * len(batch)
            keep = []
            for own, t in zip(keys, batch.column("__us").to_pylist(), strict=True):
                ok = own != key or last is None or (t is not None and t - last >= us)
                key, last = own, (t if ok else last)
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_())).select([f.name for f in schema])

    return timed.mapInArrow(work, schema)


def smoothed(events: DataFrame, value: str, by: Sequence[str], new: float = 0.2, low: float = 0.2, high: float = 3.0, start: float = 1.0) -> DataFrame:
    """smoothed: a running mean that takes a share `new` of each value and is clamped after each, from `start`. A key's
    events come to one task in time order and are read as they come; only the mean so far is held."""
    rows = events.repartition(*by).sortWithinPartitions(*by, "ts", "event_id")
    n, names = len(by), rows.columns
    rows = rows.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(by)], F.col(value).cast("double").alias("__v"), *names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mean = None, start
        for batch in batches:
            out = []
            for own, v in zip(zip(*(batch.column(k).to_pylist() for k in range(n)), strict=True), batch.column(n).to_pylist(), strict=True):
                mean = mean if own == key else start
                key = own
                if v is not None:
                    mean = max(low, min(high, (1 - new) * mean + new * v))
                out.append(mean)
            yield pa.RecordBatch.from_arrays([*batch.columns[n + 1 :], pa.array(out, pa.float64())], names=[*names, "smoothed"])

    return rows.mapInArrow(work, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema], "smoothed double"]))


def addressed(updates: DataFrame, agent: str, target: str = "target_agent") -> DataFrame:
    """Updates for one agent."""
    return updates.filter(F.col(target) == agent)


def suggestions(averages: DataFrame, by: Sequence[str], latency: float = 100.0, detections: float = 20.0, seconds: float = 10.0) -> DataFrame:
    """Rules over running averages (avg_latency, avg_detections): lower the confidence where detection is slow, raise it
    where it finds too much; of each key at most one look in `seconds`. by, event_id, ts, direction."""
    looks = rate_limit(averages, by, seconds).select(*by, "event_id")
    rows = averages.join(looks, [*by, "event_id"])
    rules = F.array_compact(F.array(F.when(F.col("avg_latency") > latency, "decrease"), F.when(F.col("avg_detections") > detections, "increase")))
    return rows.select(*by, "event_id", "ts", F.explode(rules).alias("direction"))


def progress(elapsed: Column, total: Column) -> Column:
    return F.least(F.lit(1.0), elapsed / total)


def last_n(events: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The last n events (of each key), newest last."""
    if not by:
        return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("__n", nth).filter(F.col("__n") <= n).drop("__n")


def velocity(positions: DataFrame, by: Sequence[str], least_move: float = 2.0) -> DataFrame:
    """vx and vy by finite differences of (x, y) in time order, 0 for moves of up to least_move; null for the first."""
    order = W.partitionBy(*by).orderBy("ts", "event_id")
    dt = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))) / 1e6
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    rows = positions.withColumn("__dt", dt).withColumn("__dx", dx).withColumn("__dy", dy)
    still = F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy")) <= least_move
    v = lambda d: F.when(F.col("__dt") > 0, F.when(still, 0.0).otherwise(F.col(d) / F.col("__dt")))
    return rows.withColumn("vx", v("__dx")).withColumn("vy", v("__dy")).drop("__dt", "__dx", "__dy")


def rank_targets(candidates: DataFrame, now: str = "now", observe: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """The best target (of each key): candidates that are not targeted and were observed long enough, by speed *
    consistency * confidence * least(1, t / 3) if moving, else confidence * least(1, t / observe). Ties: the smaller id."""
    t = F.col(now) - F.col("first_seen")
    moving = F.col("speed") * F.col("consistency") * F.col("confidence") * F.least(F.lit(1.0), t / 3.0)
    still = F.col("confidence") * F.least(F.lit(1.0), t / observe)
    rows = candidates.filter(~F.col("targeted") & (t >= observe)).withColumn("priority", F.when(F.col("is_moving"), moving).otherwise(still))
    best = F.max_by(F.struct("id", "priority"), F.struct("priority", (-F.col("id")).alias("o"))).alias("b")
    return rows.groupBy(*by).agg(best).select(*by, "b.id", "b.priority").filter("id is not null")


def param_changes(updates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys of the params map whose value is not that of the update before, with both values."""
    order = W.partitionBy(*by).orderBy("ts", "event_id")
    rows = updates.withColumn("__old", F.lag("params").over(order)).select(*by, "event_id", "__old", F.explode("params").alias("param", "value"))
    rows = rows.withColumn("old_value", F.element_at("__old", F.col("param"))).drop("__old")
    return rows.filter(~F.col("value").eqNullSafe(F.col("old_value")))


def latest_state(log: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The last row of each key, by time and id."""
    s = F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("s")
    return log.groupBy(key).agg(s).select(key, *[F.col(f"s.{c}").alias(c) for c in columns])
