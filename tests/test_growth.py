"""What grows with the input: rows that are kept and shuffles that are planned."""

import hashlib
import random

from pyspark.sql import functions as F

from granary.operators import fusion, joins, matching, metrics

BOXES = "cls int, cx double, cy double, w double, h double"


def boxes(spark, name, n=60, more=""):
    rng = random.Random(n)
    rows = [(k // 4, k % 4, k % 2, rng.uniform(0.3, 0.7), rng.uniform(0.3, 0.7), 0.3, 0.3, rng.randrange(5) / 5) for k in range(n)]
    return spark.createDataFrame(rows, f"img int, {name} int, {BOXES}, conf double")


def exchanges(df):
    """Shuffles of the plan, before any is dropped or used twice."""
    spark = df.sparkSession
    kept = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[1])
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_summary_keeps_one_row_a_prediction(spark):
    pred, gt = boxes(spark, "pred_idx", 80), boxes(spark, "gt_idx").drop("conf")
    area = F.col("w") * 640 * (F.col("h") * 640)
    marks = metrics._summary_marks(pred.withColumn("area", area), gt.withColumn("area", area))
    assert marks.count() == 80 and marks.filter("hits <> 0").count() > 0


def test_draws_are_those_of_md5():
    """Blocks of numbers give what md5 gives one by one, at ends and in between."""
    for seed, number, n in ((1, 7, 45_001), (123, 1000, 20_001)):
        got = [int(v) for part in metrics.md5_draws(seed, number, n) for v in part]
        digests = [hashlib.md5(f"{seed}|{number}|{k}".encode()).hexdigest() for k in range((n + 1) // 2)]
        assert got == [int(d[h : h + 13], 16) for d in digests for h in (0, 16)][:n]


def test_queries_of_one_place_are_asked_once(spark):
    q = spark.range(4000).select(F.col("id").alias("qid"), (F.col("id") % 3 * 10).cast("double").alias("qx"), F.lit(5.0).alias("qy"))
    p = spark.range(300).select(F.col("id").alias("pid"), (F.col("id") % 20).cast("double").alias("px"), F.floor(F.col("id") / 20).cast("double").alias("py"))
    points = [(r.pid, r.px, r.py) for r in p.collect()]
    want = {x: sorted((((x - px) ** 2 + (5.0 - py) ** 2) ** 0.5, pid) for pid, px, py in points)[:4] for x in (0.0, 10.0, 20.0)}
    rows = joins.nearest(q, p, 4).collect()
    assert len(rows) == 16_000 and all((r.dist, r.pid) == want[float(r.qid % 3 * 10)][r.rank - 1] for r in rows)
    own = joins._tree(p, (0.0, 0.0, 19.0), 32)
    assert joins._boxed(q.select("qx", "qy").distinct(), own, (0.0, 0.0, 19.0), own.agg(F.max("level")).first()[0]).count() == 3


def test_fits_need_no_frame_for_each_key(spark):
    """Rows of many keys, across batches, give what the step gives; nulls in the key take no part."""
    from granary.streaming import tracking

    rng = random.Random(3)
    rows = [(k, rng.choice([1, 2, 3, None]), float(k) / 7, rng.uniform(0, 90), rng.uniform(0, 90)) for k in range(300)]
    out = tracking.batch(spark.createDataFrame(rows, "event_id long, key long, t double, x double, y double"), "fit")
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    want, states = {}, {}
    for e, key, t, x, y in rows:
        if key is not None:
            want[e] = tracking.fit_step(states.setdefault(key, {}), t, x, y)
    assert {r.event_id: {c: r[c] for c in want[r.event_id]} for r in out.collect()} == want


def test_patterns_are_dealt_to_tasks(spark, tmp_path):
    from granary.plans.more_queries import pattern_points

    spark.range(40).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    plan = pattern_points(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and pattern_points(spark, str(tmp_path)).count() == 40


def test_votes_need_one_shuffle(spark):
    """Detectors that are present are counted with the clusters, not from the boxes once more."""
    b = boxes(spark, "box_idx").withColumn("src", F.col("cls"))
    out = fusion.consensus(b)
    assert exchanges(out) == 1 and out.filter("box_idx <> seed_idx").count() == 0


def test_fusion_and_agreement_go_by_image(spark):
    """Boxes that are at their image's place are not sent again by single boxes."""
    a, b, c = (boxes(spark, "box_idx", n) for n in (60, 64, 68))
    assert exchanges(fusion.fuse_two_stage(a, b, c)) <= 4
    gt = b.withColumnRenamed("box_idx", "gt_idx")
    found = [matching.greedy_match(x.withColumnRenamed("box_idx", "pred_idx"), gt, (0.3,)).filter("gt_idx is not null") for x in (a, c)]
    assert exchanges(metrics.complementarity(*found, gt)) <= 8


def test_lines_are_split_once(spark, tmp_path):
    from granary.sources import labels

    (tmp_path / "a.txt").write_text("1 0.5 0.5 0.2 0.2\nx\n2 0.5 0.5 1.5 0.2")
    read = labels.yolo(spark, str(tmp_path), sane=True)
    assert [(r.cls, r.box_idx) for r in read.collect()] == [(1, 0)]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("split(trim(") == 1


def test_coco_documents_are_not_put_in_four_files(spark, monkeypatch):
    from granary.plans.more_queries import coco_round_trip

    frame, real = type(spark.range(1)), type(spark.range(1)).repartition
    seen = []
    monkeypatch.setattr(frame, "repartition", lambda self, *by: (seen.append(by), real(self, *by))[1])
    coco_round_trip(spark, "/root/testdata/sf0.001")
    assert (4,) not in seen


def test_mean_ap_keeps_one_row_a_prediction(spark, monkeypatch):
    """Ten overlaps are bits of a prediction's row, and boxes are sent once."""
    from granary.plans import more_queries
    from granary.plans.views import boxes as view

    d, real, written = "/root/testdata/sf0.001", metrics.stored, []

    def kept(df, *more):
        out = real(df, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(metrics, "stored", kept)
    assert more_queries.map_coco(spark, d).count() == 1
    assert written and max(written) <= view(spark, d).filter("role = 0").count()
    assert exchanges(matching.matched_bits(view(spark, d), [(None, t) for t in metrics.TEN])) == 1


def test_boxes_are_sent_once_for_two_detectors(spark):
    """One shuffle brings an image's boxes together, and one adds up; the view says where its rows lie."""
    from granary.plans.queries import QUERIES
    from granary.plans.views import boxes as view
    from granary.plans.views import true_boxes

    d = "/root/testdata/sf0.001"
    assert exchanges(true_boxes(view(spark, d)).groupBy("img").agg(F.max("gt_idx"))) == 1
    assert exchanges(QUERIES["complementarity"](spark, d)) <= 2
