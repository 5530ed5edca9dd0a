import hashlib

from pyspark.sql import functions as F

from granary.functions import geometry as G
from granary.functions import text as X
from granary.operators import corpus, experiments, joins


def one(spark, *cols, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(*cols).first()


def test_confidence_and_classes(spark):
    df = spark.createDataFrame([("0.7",), ("HIGH",), ("low",), ("?",), (None,)], "v string")
    assert [r[0] for r in df.select(X.confidence(F.col("v"))).collect()] == [0.7, 0.9, 0.3, 0.5, 0.5]
    assert df.select(X.confidence(F.col("v"), ignore_case=False)).collect()[1][0] == 0.5
    names = spark.createDataFrame([("Class 3: Crop",), ("weed",), (None,), (" cotton ",)], "v string")
    assert [r[0] for r in names.select(X.class_binary(F.col("v"))).collect()] == [1, 0, 0, 1]
    assert names.select(X.class_name(F.col("v"))).collect()[2][0] == "unknown"


def test_md5_slot_equals_big_integers(spark):
    names = ["a", "weeds__v1", "gh_x_y", "ünïcode", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(X.md5_slot(F.col("n"))).collect()] == [int(hashlib.md5(n.encode()).hexdigest(), 16) % 88 + 12 for n in names]


def test_json_in_answers(spark):
    rows = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', '```\n{"a": 3}\n```', 'so {"a": 4} it is', "none", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(F.get_json_object(X.extract_json(F.col("t")), "$.a")).collect()]
    assert got == ["1", "2", "3", "4", None, None]


def test_paths(spark):
    r = one(spark, X.path_stem(F.col("p")), X.path_suffix(F.col("p")), X.label_path(F.col("p")), p="/d/images/a.b.jpg")
    assert tuple(r) == ("a.b", ".jpg", "/d/labels/a.b.txt")
    assert one(spark, X.slugify(F.col("s"), "gh_"), s="Org/My-Set")[0] == "gh_org__my_set"


def test_hash_bits_are_unsigned(spark):
    r = spark.range(1).select(X.hash_bits(F.array_repeat(F.lit(1), 64))).first()
    assert int(r[0]) == 2**64 - 1


def test_polygon_edges_are_inside(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (10.0, 5.0), (11.0, 5.0)], "x double, y double")
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert [r[0] for r in df.select(G.inside_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, True, True, False]
    assert df.filter(G.inside_polygon(F.col("x"), F.col("y"), [(0, 0), (1, 1)])).count() == 4


def test_patterns_and_frames(spark):
    c = (F.lit(2048), F.lit(2048))
    for kind in ("zigzag", "circle", "cross", "other"):
        pts = spark.range(1).select(G.pattern(F.lit(kind), *c).alias("p")).first()[0]
        assert all(abs(p.x - 2048) <= 80 and abs(p.y - 2048) <= 80 for p in pts)
        assert len(pts) == 1 if kind == "other" else len(pts) >= 8
    few = spark.range(1).select(G.fill_frame(G.zigzag(*c, density=0.3)).alias("f")).first()[0]
    assert len(few) == 1000


def test_coordinate_systems(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],), ([10.0, 20.0, 30.0, 40.0],), ([500.0, 2.0, 3.0, 4.0],)], "v array<double>")
    a = [r[0] for r in df.select(G.detect_without_size(F.col("v"))).collect()]
    assert a[0] == [0.1, 0.2, 0.3, 0.4] and a[1] == [0.1, 0.2, 0.3, 0.4] and a[2] is None
    b = [r[0] for r in df.select(G.detect_with_size(F.col("v"), F.lit(1920.0), F.lit(1080.0))).collect()]
    assert b[2] == [0.5, 0.002, 0.003, 0.004]


def test_first_wins_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "o int, h string")
    assert sorted(r.o for r in corpus.first_wins(df, "h", ("o",)).collect()) == [1, 3, 4]


def test_every_tenth(spark):
    df = spark.range(35).select((F.col("id") % 2).alias("dataset"), F.col("id").alias("img_ord"))
    got = [r.img_ord for r in corpus.every_nth_to_valid(df).filter("split = 'valid'").orderBy("img_ord").collect()]
    assert got == [0, 1, 20, 21]


def test_hash_split_has_exact_sizes(spark):
    got = {r.split: r["count"] for r in corpus.hash_split(spark.range(103), "id", (("a", 0.65), ("b", 0.2), ("c", 0.15))).groupBy("split").count().collect()}
    assert got == {"a": 66, "b": 20, "c": 17}


def test_knn_and_idw(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 960.0, 540.0, 2048), (3, 1920.0, 1080.0, 4095)], "pid int, px double, py double, lx int")
    q = spark.createDataFrame([(7, 960.0, 540.0)], "qid int, qx double, qy double")
    near = joins.nearest(q, pts.drop("lx"), 3)
    assert [r.pid for r in near.orderBy("rank").collect()] == [2, 1, 3]
    assert abs(joins.inverse_distance(near, pts.select("pid", "lx"), ("lx",)).first().lx - 2048) < 2


def test_radius_exclusion(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 149.0, 0.0), (3, 151.0, 0.0)], "id int, x double, y double")
    struck = spark.createDataFrame([(9, 0.0, 0.0)], "id int, x double, y double")
    assert [r.id for r in joins.radius_exclusion(t, struck, 150.0).collect()] == [3]
    assert {r.id for r in joins.radius_exclusion(t, struck.limit(0), 150.0).collect()} == {1, 2, 3}


def test_upsert_and_pivot(spark):
    old, new = spark.createDataFrame([(1, "a", 5)], "k int, v string, n int"), spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    assert {tuple(r) for r in joins.upsert(old, new, ["k"]).collect()} == {(1, "a", 5), (2, "b", None)}
    rows = spark.createDataFrame([("m", "x", 1.0, 0), ("m", "x", 2.0, 1)], "model string, ds string, v double, o int")
    r = experiments.pivot_table(rows, "model", "ds", ("x", "y"), "v", "o").first()
    assert (r.ds_x, r.ds_y) == ("1.0", "--")
