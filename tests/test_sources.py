import json

from pyspark.sql import functions as F

from granary.sources import labels, sinks


def test_yolo_round_trip(spark, tmp_path):
    d = tmp_path / "l"
    d.mkdir()
    (d / "a.txt").write_text("0 0.5 0.5 0.2 0.2 0.7\nbad line\n1 0.25 0.25 0.1 0.1\n2 x 0.1 0.1 0.1\n")
    (d / "b.txt").write_text("")
    rows = labels.yolo(spark, str(d), source="m").orderBy("box_idx").collect()
    assert [(r.img, r.cls, r.conf, r.src) for r in rows] == [("a", 0, 0.7, "m"), ("a", 1, 0.9, "m")]
    assert {r.img: r.lines for r in labels.label_files(spark, str(d)).collect()} == {"a": 4, "b": 0}
    images = spark.createDataFrame([("a",), ("b",)], "img string")
    texts = {r.img: r.text for r in sinks.yolo_lines(labels.yolo(spark, str(d)), images).collect()}
    assert texts["b"] == "" and texts["a"].splitlines()[0] == "0 0.500000 0.500000 0.200000 0.200000"


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 5, "file_name": "x.jpg", "width": 100, "height": 50}], "annotations": [{"id": 1, "image_id": 5, "category_id": 2, "bbox": [10, 10, 20, 20], "area": 400, "iscrowd": 0}], "categories": [{"id": 2, "name": "w"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    images, ann, cats = labels.coco(spark, str(tmp_path / "c.json"))
    assert images.first().width == 100 and ann.first().bbox == [10, 10, 20, 20] and cats.first().name == "w"
    im = spark.createDataFrame([("b", 100.0, 50.0), ("a", 100.0, 50.0)], "img string, width double, height double")
    boxes = spark.createDataFrame([("b", 0, 2, 0.5, 0.5, 0.2, 0.4, 0.9)], "img string, box_idx int, cls int, cx double, cy double, w double, h double, conf double")
    ids, out = sinks.coco_tables(boxes, im)
    assert {r.file_name: r.id for r in ids.collect()} == {"a": 1, "b": 2}
    assert [round(x, 6) for x in out.first().bbox] == [40, 15, 20, 20]
    assert sinks.coco_results(boxes, im).first().score == 0.9


def test_labelme_and_voc(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"imageWidth": 100, "imageHeight": 100, "shapes": [{"label": "w", "points": [[10, 10], [30, 50]]}, {"label": "flat", "points": [[5, 5], [5, 9]]}]}))
    rows = labels.labelme(spark, str(tmp_path / "m.json")).collect()
    assert [(r.label, round(r.cx, 6), round(r.h, 6)) for r in rows] == [("w", 0.2, 0.4)]
    (tmp_path / "v.xml").write_text("<annotation><filename>p.jpg</filename><size><width>200</width><height>100</height></size><object><name>w</name><bndbox><xmin>20</xmin><ymin>10</ymin><xmax>60</xmax><ymax>50</ymax></bndbox></object></annotation>")
    r = labels.voc(spark, str(tmp_path / "v.xml")).first()
    assert (r.img, r.label, round(r.cx, 6), round(r.w, 6)) == ("p", "w", 0.2, 0.2)


def test_prediction_documents(spark):
    docs = [("a.jpg", 1.0, None, ["0 0.5 0.5 0.1 0.1"]), ("b.jpg", 1.0, '[{"label": "w", "confidence": "high", "bbox": [10, 10, 50, 50]}]', []), ("c.jpg", 1.0, "not a list", None), ("d.jpg", 1.0, '[{"box": {"x1": 0.1, "y1": 0.1, "x2": 0.3, "y2": 0.3}}]', None)]
    got = {r.img: (round(r.cx, 6), r.conf) for r in labels.predictions(spark.createDataFrame(docs, labels.DETECTIONS)).collect()}
    assert got == {"a": (0.5, 0.5), "b": (0.3, 0.9), "d": (0.2, 0.5)}


def test_result_files_with_trailing_bytes(spark, tmp_path):
    (tmp_path / "phase").mkdir()
    (tmp_path / "phase" / "e.json").write_text('{"f1": 0.5}\n\x1b[0m')
    (tmp_path / "ok.json").write_text('{"f1": 0.7}')
    (tmp_path / "bad.json").write_text("nothing")
    rows = {r.name: r.f1 for r in labels.results(spark, str(tmp_path)).select("name", F.get_json_object("json", "$.f1").alias("f1")).collect()}
    assert rows == {"phase_e": "0.5", "ok": "0.7"}


def test_action_log(spark):
    lines = ["Action: scan", "noise", "Reasoning: why one", "Action: stop", "Reasoning: why two"]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(lines)], "source string, line_no int, value string")
    assert [(r.action, r.reasoning) for r in labels.action_log(df).orderBy("n").collect()] == [("scan", "why one"), ("stop", "why two")]


def test_metrics_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("epoch, metrics/mAP50-95(B)\n1,0.2\n2,0.4\n")
    r = labels.metrics_csv(spark, str(tmp_path / "m.csv")).first()
    assert (r.epoch, r.value) == (2, 0.4)
