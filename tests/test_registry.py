import json

from pyspark.sql import functions as F

from granary.functions import models
from granary.sources import registry as R


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"datasets": {"a": {"status": "downloaded", "annotation": "yolo", "local_images": 5, "classes": "multi"}, "b": {"status": "found", "annotation": "none"}}}))
    reg = R.read(spark, str(tmp_path / "r.json"))
    assert {r.slug: r.classes for r in reg.collect()} == {"a": "multi", "b": None}
    s = R.summary(reg).first()
    assert (s.datasets, s.downloaded, s.images, s.box_datasets) == (2, 1, 5, 1)
    found = spark.createDataFrame([("b", "downloaded", 7), ("c", "downloaded", 1)], "slug string, status string, local_images long")
    both = R.merged(reg, found)
    assert {r.slug: r.local_images for r in both.collect()} == {"a": 5, "b": 7, "c": 1}
    flags = spark.createDataFrame([("a", "garbage", 1), ("a", "fine", 2), ("c", "garbage", 1)], "slug string, flag string, ts int")
    assert {r.slug for r in R.unused(both, flags).collect()} == {"a", "b"}
    assert spark.read.parquet(R.snapshot(both, str(tmp_path / "snap"), 1)).count() == 3


def test_harvest(spark):
    c = spark.createDataFrame([("plant__a", "leaf boxes", 0), ("plant__a", "again", 1), ("cars", "street", 2), ("plant__b", "medical leaf", 3), ("plant__c", "leaf", 4)], "slug string, description string, ord int")
    known = spark.createDataFrame([("plant__c",)], "slug string")
    assert [r.slug for r in R.harvest(c, known, ("medical",), ("plant",), 5).collect()] == ["plant__a"]


def test_small_files(spark, tmp_path):
    R.write_json({"k": 1}, str(tmp_path / "m.json"))
    R.write_json({"k": 2}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"k": 2} and len(list(tmp_path.iterdir())) == 1
    assert "nc: 2" in R.data_yaml(["a", "b"])
    (tmp_path / "c.json").write_text(json.dumps({"calibration_points": [{"camera_x": 1, "camera_y": 2, "laser_x": 3, "laser_y": 4}]}))
    assert R.calibration(spark, str(tmp_path / "c.json")).first().laser_y == 4


def test_models(spark):
    def load():
        def model(batch):
            if len(batch) > 1:
                raise MemoryError
            return [[(1, 0.5, 0.5, 0.1, 0.1, 0.9)] if b == b"yes" else [] for b in batch]

        return model

    df = spark.createDataFrame([("a", b"yes"), ("b", b"no")], "img string, content binary")
    assert {(r.img, r.cls) for r in models.detect(df, load).collect()} == {("a", 1)}
    assert {(r.img, r.conf) for r in models.detect(df, load, whole_image=True).collect()} == {("a", 0.9), ("b", 0.1)}
    values = models.measure(df, lambda b: 1 / (len(b) - 2), "v")
    assert {r.img: r.v for r in values.collect()} == {"a": 1.0, "b": None}
    assert [r.img for r in models.keep_measured(df, values, "v", 0.2).collect()] == ["a"]
    box = models.Toolbox()
    box.register("count", lambda d: d.groupBy().count())
    assert box.run("count", df).first()[0] == 2 and box.stats()["count"][0] == 1


def test_event_routing_and_state(spark):
    from granary.operators import events as E

    ev = spark.createDataFrame([(1, "a", 0.0), (2, "b", 1.0), (3, "a", 2.0)], "event_id long, event_type string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    subs = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "*")], "subscriber string, event_type string")
    got = sorted((r.subscriber, r.event_id) for r in E.route(ev, subs).collect())
    assert got == [("x", 1), ("x", 3), ("y", 1), ("y", 2), ("y", 3)]
    assert [r.event_id for r in E.first_of_window(ev, "10 seconds", 2).orderBy("event_id").collect()] == [1, 2]
    assert E.latest_state(ev.withColumn("k", F.lit(1)), "k", ["event_type"]).first().event_type == "a"
