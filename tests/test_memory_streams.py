"""Streaming forms against batch forms, over several micro-batches; the push sink when a batch is run again."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import events as E
from granary.streaming import limits, push, struck, tracking

ROW = "key long, t double, event_id long, kind string, id long, x double, y double, vx double, vy double"


def seen(rng, n):
    for k in range(n):
        still = rng.random() < 0.3
        yield rng.randrange(4), k / 4 + rng.random() / 8, k, rng.choice(["sight", "sight", "strike", "other"]), rng.choice([None, *range(9)]), rng.uniform(0, 900), rng.uniform(0, 700), None if still else rng.uniform(-40, 40), None if still else rng.uniform(-40, 40)


def by_hand(rows):
    out, keys = {}, {}
    for key, t, e, kind, i, x, y, vx, vy in sorted(rows, key=lambda r: (r[1], r[2])):
        ids, zones, ways, base = keys.setdefault(key, ([], [], {}, []))
        size = (vx**2 + vy**2) ** 0.5 if vx is not None else 0
        if kind == "sight":
            why = None
            if i in ids:
                why = "id"
            elif any(t - zt < 20 and ((x - zx) ** 2 + (y - zy) ** 2) ** 0.5 < 150 for zt, zx, zy in zones):
                why = "zone"
            elif size > 0 and any(m != i and (vx * a + vy * b) / (size * (a * a + b * b) ** 0.5) > 0.85 and abs(size - (a * a + b * b) ** 0.5) < 15 for m, (a, b) in ways.items()):
                why = "trajectory"
            elif base:
                px, py, bx, by = base
                why = "baseline" if abs((y - py) * bx - (x - px) * by) < 80 and abs((x - px) * bx + (y - py) * by) < 100 else None
            out[e] = why
        elif kind == "strike":
            zones.append((t, x, y))
            if i is not None:
                ids.append(i)
                if size > 0:
                    ways[i] = (vx, vy)
            if not base:
                base += [x + vx / size * 20, y + vy / size * 20, -vy / size, vx / size] if size > 0 else [x, y, 1.0, 0.0]
    return out


def run(spark, tmp_path, batches, schema, build, name):
    """Runs the stream that `build` makes of the batches, one file each."""
    src = tmp_path / f"{name}-in"
    src.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(str(tmp_path / f"{name}-{k}"))
        part = next((tmp_path / f"{name}-{k}").glob("part-*"))
        (src / f"{k:03d}.json").write_bytes(part.read_bytes())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name).collect()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_struck_targets(spark, tmp_path, rocks):
    rows = list(seen(random.Random(3), 400))
    want = by_hand(rows)
    assert {*want.values()} == {None, "id", "zone", "trajectory", "baseline"}
    batch = {r.event_id: r.reason for r in struck.struck_before(spark.createDataFrame(rows, ROW)).collect()}
    assert batch == want
    got = run(spark, tmp_path, [rows[k : k + 100] for k in range(0, 400, 100)], ROW, struck.struck_stream, "struck")
    assert {r.event_id: r.reason for r in got} == want
    odd = spark.createDataFrame([(None, 1.0, 1, "sight", 1, 0.0, 0.0, None, None), (1, 1.0, 2, "sight", None, 0.0, 0.0, None, None)], ROW)
    assert [tuple(r) for r in struck.struck_before(odd).collect()] == [(2, 1, None, None)] and struck.struck_before(odd.limit(0)).count() == 0


def test_rate_mean_and_dwell(spark, tmp_path):
    rng, schema = random.Random(4), "key long, event_id long, ts timestamp, v double, x double, y double"
    rows = [(rng.randrange(5), k, 1_000_000 + k * 100 + rng.randrange(100), rng.choice([None, rng.uniform(0, 5)]), rng.choice([1.0, 2.0, 30.0]), 0.0) for k in range(300)]
    df = spark.createDataFrame(rows, "key long, event_id long, ms long, v double, x double, y double").select("key", "event_id", F.timestamp_millis("ms").alias("ts"), "v", "x", "y")
    typed = [r for r in df.collect()]
    batches = [typed[k : k + 60] for k in range(0, 300, 60)]
    want = {r.event_id for r in E.rate_limit(df, ("key",), 1.5).collect()}
    got = run(spark, tmp_path, batches, schema, lambda s: limits.rate_limit_stream(s, ("key",), 1.5), "rates")
    assert len(want) < 200 and {r.event_id for r in got} == want
    want = {r.event_id: r.smoothed for r in E.smoothed(df, "v", ("key",)).collect()}
    got = run(spark, tmp_path, batches, schema, lambda s: limits.smoothed_stream(s, "v", ("key",)), "means")
    assert {r.event_id: r.smoothed for r in got} == want
    places = df.withColumn("id", F.lit(1).cast("long"))
    want = {(r.key, round(r.fire_at, 3)) for r in tracking.dwell(places.withColumn("t", F.unix_micros("ts") / 1e6), 5.0, 0.8).collect()}
    got = run(spark, tmp_path, batches, schema, lambda s: limits.dwell_stream(s.withColumn("id", F.lit(1).cast("long")), 5.0, 0.8), "dwells")
    assert want and {(r.key, round(r.fire_at, 3)) for r in got} == want
    with pytest.raises(ValueError):
        limits.rate_limit_stream(df, ("key",), 10.0, 5.0)


def test_a_replayed_batch_delivers_nothing(spark, tmp_path):
    subs = spark.createDataFrame([("a", "click"), ("b", "*"), ("b", "click")], "subscriber string, event_type string")
    events = lambda ids: spark.createDataFrame([(i, "click" if i % 2 else "view") for i in ids], "event_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id"))
    told, fail = [], [False]

    def callback(batch, sent):
        if fail[0]:
            raise RuntimeError("no link")
        told.append((batch, sent.count()))

    sink = push.Push(f"file://{tmp_path}/out", subs, most=3)
    sink.on_delivery(callback)
    sink(events([1, 2, 3, 3, 4, 5]), 0)
    sink(events([1, 2, 3, 3, 4, 5]), 0)
    assert told == [(0, 6)]
    fail[0] = True
    with pytest.raises(RuntimeError):
        sink(events([6, 7]), 1)
    assert push.inbox(spark, f"file://{tmp_path}/out").count() == 6
    fail[0] = False
    sink(events([6, 7]), 1)
    assert told == [(0, 6), (1, 3)]
    got = push.inbox(spark, f"file://{tmp_path}/out", "b")
    assert sorted(r.event_id for r in got.collect()) == [3, 4, 5, 6, 7]
    # As the sink of a stream that starts again from its checkpoint.
    src = tmp_path / "in"
    events([10, 11]).coalesce(1).write.json(str(src))
    stream = lambda: spark.readStream.schema("event_id long, event_type string, ts timestamp").json(str(src)).writeStream.foreachBatch(push.Push(f"file://{tmp_path}/out2", subs)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    stream()
    stream()
    assert push.inbox(spark, f"file://{tmp_path}/out2").count() == 3
