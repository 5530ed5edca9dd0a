"""Memory of struck targets: which sights of a target are of one that has been dealt with already.

Rows: key (a vehicle), t (seconds), event_id, kind (`strike` or `sight`), id, x, y, vx, vy (null or 0: no motion known).
Within a key they go by t, then event_id. A sight is known by the first that holds:

  id          the id was struck before (a null id is none);
  zone        a place struck less than LIFETIME seconds before is nearer than RADIUS;
  trajectory  another id, at its last strike with motion, moved alike: cosine over COSINE, speeds less than SPEED_GAP apart;
  baseline    it is near the strip across the way of the key's first strike: AHEAD before it, or level without motion.

The batch form is made of joins, each with a key that spreads: no key's rows are ever brought together. The streaming form
keeps the three memories of a key as state, each with a life of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.functions.geometry import distance
from granary.operators.joins import cone_cells, own_cone

#: The zone's radius and life, when trajectories are alike, and the strip's place, depth and length.
RADIUS, LIFETIME, COSINE, SPEED_GAP, AHEAD, TOLERANCE, LENGTH = 150.0, 20.0, 0.85, 15.0, 20.0, 80.0, 200.0
REASONS = ("id", "zone", "trajectory", "baseline")


def _before(a: str, b: str):
    """Whether the row with a's t and event_id comes before b's."""
    return (F.col(f"{a}t") < F.col(f"{b}t")) | ((F.col(f"{a}t") == F.col(f"{b}t")) & (F.col(f"{a}event_id") < F.col(f"{b}event_id")))


def struck_before(rows: DataFrame, radius: float = RADIUS, lifetime: float = LIFETIME) -> DataFrame:
    """Every sight with its reason: event_id, key, id, reason (null: a new target). Rows without key, t, event_id, x or y
    take no part."""
    rows = rows.dropna(subset=["key", "t", "event_id", "x", "y"])
    sights, strikes = rows.filter("kind = 'sight'").drop("kind"), rows.filter("kind = 'strike'").drop("kind")
    s = strikes.select(*[F.col(c).alias(f"s_{c}") for c in strikes.columns])
    same_key = F.col("key") == F.col("s_key")
    moves = lambda p="": F.coalesce(F.col(f"{p}vx") * F.col(f"{p}vx") + F.col(f"{p}vy") * F.col(f"{p}vy"), F.lit(0.0)) > 0

    by_id = s.groupBy("s_key", "s_id").agg(F.min(F.struct("s_t", "s_event_id")).alias("m")).select("s_key", "s_id", "m.s_t", "m.s_event_id")
    ids = sights.join(by_id, [same_key, F.col("id") == F.col("s_id"), _before("s_", "")], "left_semi")

    # Places and times meet by cells as wide as the radius and the life.
    cell = lambda c: F.floor(F.col(c) / radius)
    places = F.array(*[F.struct((F.floor(F.col("s_t") / lifetime) + w).alias("w"), (cell("s_x") + i).alias("i"), (cell("s_y") + j).alias("j")) for w in (0, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    zones = s.select("*", F.explode(places).alias("p"))
    on = [same_key, F.floor(F.col("t") / lifetime) == F.col("p.w"), cell("x") == F.col("p.i"), cell("y") == F.col("p.j")]
    near = distance(F.col("x"), F.col("y"), F.col("s_x"), F.col("s_y")) < radius
    in_zone = sights.join(zones, [*on, _before("s_", ""), F.col("t") - F.col("s_t") < lifetime, near], "left_semi")

    # A strike's trajectory is remembered until the id's next strike with motion.
    order = W.partitionBy("s_key", "s_id").orderBy("s_t", "s_event_id")
    moved = s.filter(moves("s_") & F.col("s_id").isNotNull()).withColumn("n_t", F.lead("s_t").over(order)).withColumn("n_event_id", F.lead("s_event_id").over(order))
    moved = moved.withColumn("s_speed", F.sqrt(F.col("s_vx") * F.col("s_vx") + F.col("s_vy") * F.col("s_vy"))).withColumn("c", F.explode(cone_cells("s_vx", "s_vy", COSINE, SPEED_GAP)))
    moving = sights.filter(moves()).withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).withColumn("own", own_cone("vx", "vy", COSINE, SPEED_GAP))
    cosine = (F.col("vx") * F.col("s_vx") + F.col("vy") * F.col("s_vy")) / (F.col("speed") * F.col("s_speed"))
    alike = (cosine > COSINE) & (F.abs(F.col("speed") - F.col("s_speed")) < SPEED_GAP) & ~F.col("id").eqNullSafe(F.col("s_id"))
    replaced = F.coalesce(_before("n_", ""), F.lit(False))
    on_way = moving.join(moved, [same_key, F.col("own.a") == F.col("c.a"), F.col("own.s") == F.col("c.s"), _before("s_", ""), ~replaced, alike], "left_semi")

    first = s.groupBy("s_key").agg(F.min(F.struct("s_t", "s_event_id", "s_x", "s_y", "s_vx", "s_vy")).alias("m")).select("s_key", "m.*")
    size = F.sqrt(F.col("s_vx") * F.col("s_vx") + F.col("s_vy") * F.col("s_vy"))
    dx, dy = (F.when(moves("s_"), F.col(c) / size) for c in ("s_vx", "s_vy"))
    first = first.select("*", F.coalesce(-dy, F.lit(1.0)).alias("b_x"), F.coalesce(dx, F.lit(0.0)).alias("b_y"))
    first = first.withColumn("p_x", F.col("s_x") + F.coalesce(dx * AHEAD, F.lit(0.0))).withColumn("p_y", F.col("s_y") + F.coalesce(dy * AHEAD, F.lit(0.0)))
    ox, oy = F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y")
    strip = (F.abs(oy * F.col("b_x") - ox * F.col("b_y")) < TOLERANCE) & (F.abs(ox * F.col("b_x") + oy * F.col("b_y")) < LENGTH / 2)
    on_strip = sights.join(first, [same_key, _before("s_", ""), strip], "left_semi")

    found = None
    for n, part in enumerate((ids, in_zone, on_way, on_strip)):
        part = part.select(F.col("event_id").alias("__e"), F.lit(n).alias("__n"))
        found = part if found is None else found.unionByName(part)
    why = found.groupBy("__e").agg(F.min("__n").alias("__n"))
    reason = F.get(F.array(*map(F.lit, REASONS)), F.col("__n"))
    return sights.join(why, F.col("event_id") == F.col("__e"), "left").select("event_id", "key", "id", reason.alias("reason"))


class StruckMemory(StatefulProcessor):
    """Per key: struck ids and trajectories, which stay as long as the key does, zones, which go when they are LIFETIME old by
    the events' own clock, and the strip. A timer drops a key whose last row is forget_after seconds behind the watermark."""

    def __init__(self, radius: float, lifetime: float, forget_after: float) -> None:
        self.radius, self.lifetime, self.forget_after = radius, lifetime, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "id long", "t double")
        self.zones = handle.getMapState("zones", "event_id long", "t double, x double, y double")
        self.ways = handle.getMapState("ways", "id long", "vx double, vy double")
        self.strip = handle.getValueState("strip", "px double, py double, bx double, by double")
        self.last = handle.getValueState("last", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["t", "event_id"], kind="stable")
        zones = {k[0]: v for k, v in self.zones.iterator()}
        ways = {k[0]: v for k, v in self.ways.iterator()}
        ids = {k[0] for k in self.ids.keys()}  # noqa: SIM118
        strip = self.strip.get() if self.strip.exists() else None
        out = []
        for r in rows.itertuples(index=False):
            own = None if pd.isna(r.id) else int(r.id)
            vx, vy = (0.0, 0.0) if pd.isna(r.vx) or pd.isna(r.vy) else (r.vx, r.vy)
            size = math.sqrt(vx * vx + vy * vy)
            if r.kind == "sight":
                out.append((int(r.event_id), own, self.reason(r, own, vx, vy, size, ids, zones, ways, strip)))
            elif r.kind == "strike":
                if own is not None and own not in ids:
                    ids.add(own)
                    self.ids.updateValue((own,), (float(r.t),))
                zones[int(r.event_id)] = (float(r.t), float(r.x), float(r.y))
                self.zones.updateValue((int(r.event_id),), zones[int(r.event_id)])
                if size > 0:
                    if own is not None:
                        ways[own] = (vx, vy)
                        self.ways.updateValue((own,), ways[own])
                if strip is None:
                    dx, dy = (vx / size, vy / size) if size > 0 else (0.0, 0.0)
                    strip = (r.x + dx * AHEAD, r.y + dy * AHEAD, -dy if size > 0 else 1.0, dx)
                    self.strip.update(strip)
        newest = float(rows["t"].max())
        for k, z in zones.items():
            if newest - z[0] >= self.lifetime:
                self.zones.removeKey((k,))
        if self.last.exists():
            self.handle.deleteTimer(self.last.get()[0])
        until = int(1000 * (newest + self.forget_after))
        self.handle.registerTimer(until)
        self.last.update((until,))
        yield pd.DataFrame({"event_id": [o[0] for o in out], "key": key[0], "id": pd.array([o[1] for o in out], "Int64"), "reason": pd.array([o[2] for o in out], "object")})

    def reason(self, r, own, vx, vy, size, ids, zones, ways, strip) -> str | None:
        if own in ids:
            return "id"
        if any(r.t - t < self.lifetime and math.hypot(r.x - x, r.y - y) < self.radius for t, x, y in zones.values()):
            return "zone"
        if size > 0:
            for other, (ox, oy) in ways.items():
                long = math.sqrt(ox * ox + oy * oy)
                if other != own and (vx * ox + vy * oy) / (size * long) > COSINE and abs(size - long) < SPEED_GAP:
                    return "trajectory"
        if strip is not None:
            px, py, bx, by = strip
            dx, dy = r.x - px, r.y - py
            if abs(dy * bx - dx * by) < TOLERANCE and abs(dx * bx + dy * by) < LENGTH / 2:
                return "baseline"
        return None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.ids, self.zones, self.ways, self.strip, self.last):
            state.clear()
        yield pd.DataFrame({"event_id": pd.array([], "int64"), "key": pd.array([], "int64"), "id": pd.array([], "Int64"), "reason": pd.array([], "object")})

    def close(self) -> None:
        pass


def struck_stream(rows: DataFrame, radius: float = RADIUS, lifetime: float = LIFETIME, forget_after: float = 3600.0) -> DataFrame:
    """The same on a stream of rows with long keys and ids. Rows of a key must come in order from batch to batch; within one
    they are sorted; rows older than the watermark, forget_after seconds behind the latest, are dropped. Map states need
    the RocksDB state store: spark.sql.streaming.stateStore.providerClass."""
    timed = rows.dropna(subset=["key", "t", "event_id", "x", "y"]).withColumn("__ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    keyed = timed.withWatermark("__ts", f"{int(forget_after)} seconds").groupBy("key")
    return keyed.transformWithStateInPandas(StruckMemory(radius, lifetime, forget_after), "event_id long, key long, id long, reason string", "Append", "EventTime")
