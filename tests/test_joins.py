import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import corpus, joins, metrics
from granary.operators import events as E
from granary.sources import labels


def brute(queries, points, k):
    out = {}
    for q, x, y in queries:
        near = sorted((math.sqrt((x - px) * (x - px) + (y - py) * (y - py)), p) for p, px, py in points)[:k]
        out[q] = [(p, d) for d, p in near]
    return out


def frames(spark, queries, points):
    return spark.createDataFrame(queries, "qid long, qx double, qy double"), spark.createDataFrame(points, "pid long, px double, py double")


@pytest.mark.parametrize("k", [1, 4, 30])
def test_nearest_equals_brute_force(spark, k):
    """A tight cluster, one place that many points share, a few far away; queries in all of these and outside."""
    rng = random.Random(k)
    points = [(n, rng.gauss(50, 0.5), rng.gauss(50, 0.5)) for n in range(300)] + [(1000 + n, 7.0, 7.0) for n in range(100)]
    points += [(2000 + n, rng.uniform(0, 1000), rng.uniform(0, 1000)) for n in range(40)]
    queries = [(n, rng.gauss(50, 1), rng.gauss(50, 1)) for n in range(60)] + [(100, 7.0, 7.0), (101, 0.0, 0.0), (102, -5000.0, 20.0), (103, 400.0, 9000.0), (104, 1000.0, 1000.0)]
    queries += [(200 + n, rng.uniform(0, 1000), rng.uniform(0, 1000)) for n in range(60)]
    got = {}
    for r in joins.nearest(*frames(spark, queries, points), k).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.pid, r.dist))
    assert got == brute(queries, points, k)


def test_nearest_with_few_points(spark):
    q, p = frames(spark, [(1, 0.0, 0.0), (2, 5.0, 5.0)], [(7, 1.0, 1.0), (8, 1.0, 1.0)])
    assert [tuple(r)[:2] for r in joins.nearest(q, p, 5).orderBy("qid", "rank").collect()] == [(1, 7), (1, 8), (2, 7), (2, 8)]
    assert joins.nearest(q, p.limit(0), 5).count() == 0 and joins.nearest(q.limit(0), p, 5).count() == 0


def test_nearest_makes_no_product(spark, capsys):
    ids = spark.range(10_001)
    p = ids.select(F.col("id").alias("pid"), (F.col("id") * 37 % 1000).cast("double").alias("px"), (F.col("id") * 91 % 1000).cast("double").alias("py"))
    q = ids.select(F.col("id").alias("qid"), (F.col("id") * 11 % 1000).cast("double").alias("qx"), (F.col("id") * 7 % 1000).cast("double").alias("qy"))
    joins.nearest(q, p, 3).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "collect_list" not in plan


def test_numbers_run_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1000), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    got = {r.k: r.nth for r in corpus.numbered(df, ["g"], ["v", "k"]).collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {k: n for n, (_, k) in enumerate(sorted((v, k) for x, v, k in rows if x == g))}
    assert got == want


def test_first_existing_and_label_places(spark):
    images = spark.createDataFrame([("r/train/images/a.jpg",), ("r/b.png",), ("r/x/y/c.jpg",), ("none.jpg",)], "image string")
    files = spark.createDataFrame([("r/train/labels/a.txt",), ("r/train/images/a.txt",), ("r/b.txt",), ("r/labels/c.txt",), ("r/labels/b.txt",)], "path string")
    got = {r.image: r.found for r in joins.first_existing(images, files, joins.label_candidates(F.col("image"))).collect()}
    assert got == {"r/train/images/a.jpg": "r/train/labels/a.txt", "r/b.png": "r/b.txt", "r/x/y/c.jpg": "r/labels/c.txt", "none.jpg": None}


def test_smoothed_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0), (2, 1, 1, 100.0), (3, 1, 2, None), (4, 2, 0, 0.0)], "event_id long, key int, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.smoothed for r in E.smoothed(df, "v", ("key",)).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 3.0, 4: 0.8}


def test_suggestions_are_rare(spark):
    rows = [(k, 1, k, 120.0, 25.0 if k == 12 else 1.0) for k in (0, 5, 12)]
    df = spark.createDataFrame(rows, "event_id long, key int, s int, avg_latency double, avg_detections double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.event_id, r.direction) for r in E.suggestions(df, ("key",)).collect()) == [(0, "decrease"), (12, "decrease"), (12, "increase")]


def test_summary_of_a_perfect_detector(spark):
    rows = [(img, k, k % 2, 0.2 + 0.2 * k, 0.5, 0.1, 0.1) for img in range(3) for k in range(4)]
    gt = spark.createDataFrame(rows, "img int, gt_idx int, cls int, cx double, cy double, w double, h double")
    pred = gt.withColumnRenamed("gt_idx", "pred_idx").withColumn("conf", F.lit(0.9) - F.col("pred_idx") * 0.1)
    r = metrics.coco_summary(pred, gt).first()
    assert r.ap == pytest.approx(1) and r.ap75 == pytest.approx(1) and r.ar1 == pytest.approx(0.5) and r.ar100 == pytest.approx(1)


def summary_by_hand(pred, gt, side):
    """The twelve numbers from the rules of the usual evaluation: ignored truths are matched last and count for nothing."""

    def iou(a, b):
        ax, ay, bx, by = a[0] - a[2] / 2, a[1] - a[3] / 2, b[0] - b[2] / 2, b[1] - b[3] / 2
        i = max(0.0, min(ax + a[2], bx + b[2]) - max(ax, bx)) * max(0.0, min(ay + a[3], by + b[3]) - max(ay, by))
        return i / (a[2] * a[3] + b[2] * b[3] - i)

    out, classes = {}, sorted({g[2] for g in gt})
    for size, (low, high) in metrics.SIZES.items():
        odd = lambda b: not low <= b[2] * side * b[3] * side <= high
        aps, recalls = [], {1: [], 10: [], 100: []}
        for cls in classes:
            n = sum(not odd(g[3:]) for g in gt if g[2] == cls)
            if not n:
                continue
            for t in metrics.TEN:
                marks = []
                for img in {g[0] for g in gt} | {p[0] for p in pred}:
                    truths = sorted([(odd(g[3:]), g[1], g[3:]) for g in gt if g[0] == img and g[2] == cls], key=lambda x: x[:2])
                    free = set(range(len(truths)))
                    for place, p in enumerate(sorted((p for p in pred if p[0] == img and p[2] == cls), key=lambda p: (-p[7], p[1]))[:100]):
                        best = None
                        for k, (ig, _, box) in enumerate(truths):
                            o = iou(p[3:7], box)
                            if k in free and o >= t and not (best is not None and not truths[best[1]][0] and ig) and (best is None or o >= best[0]):
                                best = (o, k)
                        if best is not None:
                            free.remove(best[1])
                        if not (truths[best[1]][0] if best is not None else odd(p[3:7])):
                            marks.append((-p[7], img, p[1], best is not None, place))
                marks.sort()
                tp, curve = 0, []
                for k, m in enumerate(marks, 1):
                    tp += m[3]
                    curve.append((tp / n, tp / k))
                aps.append((t, sum(max((y for x, y in curve if x >= r / 100 - 1e-9), default=0.0) for r in range(101)) / 101))
                for d in recalls:
                    recalls[d].append(sum(m[3] and m[4] < d for m in marks) / n)
        mean = lambda v: sum(v) / len(v) if v else -1.0
        if size == "all":
            out |= {"ap": mean([a for _, a in aps]), "ap50": mean([a for t, a in aps if t == 0.5]), "ap75": mean([a for t, a in aps if t == 0.75])} | {f"ar{d}": mean(v) for d, v in recalls.items()}
        else:
            out |= {f"ap_{size}": mean([a for _, a in aps]), f"ar_{size}": mean(recalls[100])}
    return out


@pytest.mark.parametrize("side", [60.0, 200.0, 400.0])
def test_summary_by_size(spark, side):
    rng = random.Random(int(side))
    gt, pred = [], []
    for img in range(6):
        for k in range(rng.randrange(1, 9)):
            gt.append((img, k, rng.randrange(3), rng.uniform(0.2, 0.8), rng.uniform(0.2, 0.8), rng.uniform(0.05, 0.5), rng.uniform(0.05, 0.5)))
        own = [g for g in gt if g[0] == img]
        for k in range(rng.randrange(14)):
            g = rng.choice(own)
            pred.append((img, k, g[2], *[v * rng.uniform(0.85, 1.15) for v in g[3:]], rng.randrange(10) / 10))
    p = spark.createDataFrame(pred, "img int, pred_idx int, cls int, cx double, cy double, w double, h double, conf double")
    g = spark.createDataFrame(gt, "img int, gt_idx int, cls int, cx double, cy double, w double, h double")
    assert metrics.coco_summary(p, g, side).first().asDict() == pytest.approx(summary_by_hand(pred, gt, side))


def test_bootstrap_draws_as_many_as_there_are(spark):
    rows = [(k, k % 4, k % 3, (k * 7) % 5) for k in range(301)]
    df = spark.createDataFrame(rows, "img int, tp int, fp int, fn int")
    got = metrics.bootstrap(df, rounds=40, seed=3).first()
    kinds, f1 = sorted((r[1], r[2], r[3]) for r in rows), []
    for n in range(1, 41):
        drawn = [kinds[int(hashlib.md5(f"3|{n}|{k // 2}".encode()).hexdigest()[16 * (k % 2) :][:13], 16) * 301 >> 52] for k in range(301)]
        tp, fp, fn = (sum(c) for c in zip(*drawn, strict=True))
        f1.append(2 * tp / (2 * tp + fp + fn))
    assert got.mean == pytest.approx(sum(f1) / 40) and got.std == pytest.approx(np.std(f1)) and got.lo == pytest.approx(np.quantile(f1, 0.025)) and got.hi == pytest.approx(np.quantile(f1, 0.975))
    split = metrics.bootstrap(df, rounds=400, exact=False).first()
    assert split.mean == pytest.approx(got.mean, abs=0.01) and split.std == pytest.approx(got.std, rel=0.5)
    once = metrics.bootstrap(df, rounds=40, faithful=True).first()
    assert once.std < got.std and metrics.bootstrap(df.limit(0), rounds=5).first().mean == 0


def test_nearest_bears_an_outlier(spark):
    """20 000 points and one far away: the pairs looked at are about as many as without it."""
    rng = random.Random(1)
    points = [(n, rng.uniform(0, 1000), rng.uniform(0, 1000)) for n in range(20_000)]
    queries = [(n, rng.uniform(0, 1000), rng.uniform(0, 1000)) for n in range(500)]
    took = []
    for far in ((500.0, 500.0), (1e7, 1e7), (1e7, 1e7)):
        q, p = frames(spark, queries, [*points[:-1], (20_000, *far)])
        began = time.time()
        got = joins.nearest(q, p, 5).collect()
        took.append(time.time() - began)
        assert len(got) == 2500
    assert min(took[1:]) < 3 * took[0] + 5
    near = {(r.qid, r.pid) for r in got}
    assert all({(n, i) for i, _ in own} <= near for n, own in brute(queries[:10], [*points[:-1], (20_000, 1e7, 1e7)], 5).items())


def test_similar_tracks_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(n, rng.uniform(-60, 60), rng.uniform(-60, 60)) for n in range(150)] + [(900, 0.0, 0.0), (901, -50.0, 0.0), (902, -50.0, -1e-9)]
    t, m = spark.createDataFrame(rows[:100] + rows[-3:], "id int, vx double, vy double"), spark.createDataFrame(rows[60:], "id int, vx double, vy double")
    for cosine, gap in ((0.85, 15.0), (-0.5, 4.0), (0.999, 100.0)):
        size = lambda r: math.hypot(r[1], r[2])
        like = lambda a, b, c=cosine, g=gap: a[0] != b[0] and size(a) > 0 and size(b) > 0 and abs(size(a) - size(b)) < g and (a[1] * b[1] + a[2] * b[2]) / (size(a) * size(b)) > c
        want = {a[0] for a in rows[:100] + rows[-3:] if any(like(a, b) for b in rows[60:])}
        assert {r.id for r in joins.similar_tracks(t, m, cosine, gap).collect()} == want


def test_yaml_names(spark):
    texts = ["names: [a, 'b c']", 'nc: 2\nnames:\n- x\n- "y"\n', "names:\n  0: x\n  1: y z\nval: v", "train: a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(labels.yaml_names(F.col("t"))).collect()] == [["a", "b c"], ["x", "y"], ["x", "y z"], None, None]
    many = spark.createDataFrame([('{"a": {"b": 1}} } trailing {',), ("x {no} {\"k\": 2} {",), ("{",), (None,)], "t string")
    assert [r[0] for r in many.select(labels.first_json(F.col("t"))).collect()] == ['{"a": {"b": 1}}', '{"k": 2}', None, None]
