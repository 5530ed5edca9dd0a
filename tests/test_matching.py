"""Folds against plain Python on random boxes, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions.geometry import hflip_xyxy
from granary.operators import fusion, matching, metrics

GT, PRED = "img long, gt_idx long, cls int, cx double, cy double, w double, h double", "img long, pred_idx long, cls int, cx double, cy double, w double, h double, conf double"


def box(rng):
    return rng.choice([0.3, 0.4, 0.5, 0.6]), rng.choice([0.3, 0.4, 0.5]), rng.choice([0.2, 0.3, 0.4]), rng.choice([0.2, 0.3])


def iou(a, b):
    """In the engine's order of operations, so that equal overlaps tie here as they do there."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = ((x - w / 2, y - h / 2, x + w / 2, y + h / 2) for x, y, w, h in (a, b))
    i = max(0.0, min(ax2, bx2) - max(ax1, bx1)) * max(0.0, min(ay2, by2) - max(ay1, by1))
    u = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - i
    return i / u if u > 0 else 0.0


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    gt = [(i, k, rng.randrange(3), *box(rng)) for i in range(40) for k in range(rng.randrange(6))]
    pred = [(i, k, rng.randrange(3), *box(rng), rng.choice([0.2, 0.5, 0.5, 0.9])) for i in range(40) for k in range(rng.randrange(8))]
    return spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED), gt, pred


def greedy(gt, pred, t):
    out = {}
    for img in {p[0] for p in pred}:
        used = set()
        for p in sorted((p for p in pred if p[0] == img), key=lambda p: (-p[7], p[1])):
            free = [(g[1], iou(p[3:7], g[3:7])) for g in gt if g[0] == img and g[1] not in used]
            best = max(free, key=lambda x: (x[1], -x[0]), default=None)
            hit = best[0] if best and best[1] >= t else None
            used.add(hit)
            out[img, p[1]] = hit
    return out


@pytest.mark.parametrize("t", [0.31, 0.52])
def test_greedy_equals_a_plain_loop(data, t):
    gt, pred, g, p = data
    rows = matching.greedy_match(pred, gt, (t, 0.9)).filter(F.abs(F.col("threshold") - t) < 1e-9).collect()
    assert {(r.img, r.pred_idx): r.gt_idx for r in rows} == greedy(g, p, t)
    hits = [(r.img, r.gt_idx) for r in rows if r.gt_idx is not None]
    assert len(hits) == len(set(hits)) and len(rows) == len(p)


def test_counts_add_up(data):
    gt, pred, g, p = data
    r = metrics.evaluate(matching.greedy_match(pred, gt, (0.5,)), gt).first()
    assert r.tp + r.fn == len(g) and r.tp + r.fp == len(p) and 0 <= r.f1 <= 1


def test_published_counts_give_published_ratios(spark):
    # Published counts of two evaluations and their rounded ratios.
    rows = [(1340, 293, 124, 0.8206, 0.9153, 0.8654), (481, 336, 290, 0.5887, 0.6239, 0.6058)]
    df = spark.createDataFrame(rows, "tp long, fp long, fn long, p double, r double, f double")
    for x in df.select("*", *metrics.prf(F.col("tp"), F.col("fp"), F.col("fn"))).collect():
        assert (round(x.precision, 4), round(x.recall, 4), round(x.f1, 4)) == (x.p, x.r, x.f)


def test_star_clusters_are_not_transitive(spark):
    # 0 overlaps 1 and 1 overlaps 2, but 0 does not overlap 2: two clusters.
    rows = [(1, k, 0, 0.3 + 0.08 * k, 0.5, 0.2, 0.2, 0.5) for k in range(3)]
    df = spark.createDataFrame(rows, PRED).withColumnRenamed("pred_idx", "box_idx")
    got = {r.box_idx: r.seed_idx for r in matching.star_cluster(df, 0.4).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_fusion_edge_images(spark):
    first = spark.createDataFrame([(1, 0, 0, 0.5, 0.5, 0.2, 0.2, 0.8)], PRED).withColumnRenamed("pred_idx", "box_idx")
    second = spark.createDataFrame([(2, 0, 0, 0.5, 0.5, 0.2, 0.2, 0.9)], PRED).withColumnRenamed("pred_idx", "box_idx")
    assert {(r.img, r.conf) for r in fusion.fuse(first, second, "weighted").collect()} == {(1, 0.8)}
    assert fusion.fuse(first, second, "filter").count() == 0
    assert {r.img for r in fusion.fuse(first, second, "supplement").collect()} == {1, 2}


def test_weighted_fusion_averages(spark):
    rows = [(1, 0, 0, 0.5, 0.5, 0.2, 0.2, 0.9), (1, 1, 0, 0.52, 0.5, 0.2, 0.2, 0.3), (1, 2, 0, 0.9, 0.9, 0.1, 0.1, 0.5)]
    df = spark.createDataFrame(rows, PRED).withColumnRenamed("pred_idx", "box_idx").withColumn("src", F.col("box_idx") % 2)
    got = sorted((r.members, round(r.cx, 4), round(r.conf, 4)) for r in matching.weighted_boxes_fusion(df).collect())
    assert got == [(1, 0.9, 0.25), (2, 0.505, 0.6)]


def test_average_precision_of_a_perfect_ranking(spark):
    gt = spark.createDataFrame([(k, 0, 0, 0.5, 0.5, 0.2, 0.2) for k in range(5)], GT)
    pred = spark.createDataFrame([(k, 0, 0, 0.5, 0.5, 0.2, 0.2, 0.9 - k / 10) for k in range(5)], PRED)
    curve = metrics.pr_curve(matching.greedy_match(pred, gt, (0.5,)), gt.agg(F.count("*").alias("n_gt")))
    assert metrics.ap_all_points(curve).first().ap == 1.0
    assert abs(metrics.ap_points(curve, 11).first().ap - 1) < 1e-12 and abs(metrics.ap_points(curve, 101).first().ap - 1) < 1e-12


def test_flip_is_its_own_inverse(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.4, 0.6)], "a double, b double, c double, d double")
    once = hflip_xyxy(tuple(F.col(c) for c in "abcd"))
    r = df.select(*[F.round(x, 9) for x in hflip_xyxy(once)]).first()
    assert tuple(r) == (0.1, 0.2, 0.4, 0.6)


def _mixed(spark, n=900, seed=5):
    """Boxes of both roles, up to some twenty in an image, with ties in all that orders them, and a few nulls."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        img, box = rng.choice([0, *range(90)]) if k % 50 else None, [rng.choice([0.4, 0.45, 0.5]), rng.choice([0.4, 0.45, 0.5]), rng.choice([0.2, 0.3]), rng.choice([0.2, 0.25])]
        if k % 40 == 7:
            box[k % 4] = None
        rows.append((img, k, k * 7 % 2, k % 5, *box, rng.randrange(5) / 5))
    return spark.createDataFrame(rows, "img int, idx long, role int, src int, cx double, cy double, w double, h double, conf double")


@pytest.mark.parametrize("batch", [3, 10_000])
def test_rounds_at_once_are_those_one_by_one(spark, monkeypatch, batch):
    b = _mixed(spark)
    gt, pred = b.filter("role = 1").withColumnRenamed("idx", "gt_idx"), b.filter("role = 0").withColumnRenamed("idx", "pred_idx")
    rounds = [(None, 0.5), (F.col("src") < 2, 0.3), (F.col("src") >= 2, 0.3), (None, 0.9)]
    if batch == 3:
        monkeypatch.setattr(matching, "PAIRS", 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        hits = {r.idx: r.bits for r in matching.matched_bits(b, rounds).collect()}
        found = {r.idx: (r.src, r.bits) for r in matching.matched_bits(b, rounds, carry=("src",), truths=True).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(hits) == {r.pred_idx for r in pred.collect()} and {k: s for k, (s, _) in found.items()} == {r.gt_idx: r.src for r in gt.collect()}
    for k, (on, t) in enumerate(rounds):
        want = matching.greedy_match(pred if on is None else pred.filter(on), gt, (t,)).filter("gt_idx is not null").collect()
        assert want and {i for i, v in hits.items() if v >> k & 1} == {r.pred_idx for r in want}
        assert {i for i, (_, v) in found.items() if v >> k & 1} == {r.gt_idx for r in want}


def test_aps_of_marks_are_those_of_curves(spark):
    b, steps = _mixed(spark), (0.3, 0.5, 0.9, 1.0)
    gt, pred = b.filter("role = 1").withColumnRenamed("idx", "gt_idx"), b.filter("role = 0").withColumnRenamed("idx", "pred_idx")
    n = gt.agg(F.count("*").alias("n_gt"))
    got = {r.threshold: r.ap for r in metrics.ap_of_marks(matching.matched_bits(b, [(None, t) for t in steps], carry=("conf",)), n, steps).collect()}
    for t in steps:
        want = metrics.ap_all_points(metrics.pr_curve(matching.greedy_match(pred, gt, (t,)), n)).first().ap
        assert (t not in got) if want is None else abs(got[t] - want) < 1e-12
    assert metrics.ap_of_marks(matching.matched_bits(b.filter("role = 1"), [(None, 0.5)], carry=("conf",)), n, (0.5,)).count() == 0
