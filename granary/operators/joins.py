"""Joins beyond equality: overlap, nearest neighbours, as-of, radius, request and response, upsert."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions.geometry import box_columns, distance, iou
from granary.operators.matching import BOX
from granary.storage import stored


def overlap_filter(left: DataFrame, right: DataFrame, threshold: float, keep_overlapping: bool, strict: bool = True, key: str = "img", exempt: Column | None = None) -> DataFrame:
    """Rows of `left` that (do not) overlap any row of `right` in the same image; rows that `exempt` holds for stay."""
    r = right.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in BOX])
    value = iou(box_columns(), box_columns("__"))
    on = [F.col(key) == F.col("__k"), value > threshold if strict else value >= threshold]
    how = "left_semi" if keep_overlapping else "left_anti"
    if exempt is None:
        return left.join(r, on, how)
    safe = F.coalesce(exempt, F.lit(False))
    return left.filter(~safe).join(r, on, how).unionByName(left.filter(safe))


def consensus_or_unique(first: DataFrame, second: DataFrame, confirm: float = 0.3, apart: float = 0.5) -> DataFrame:
    """Boxes of the first that the second confirms, and those others of the first that overlap no confirmed one."""
    kept = overlap_filter(first, second, confirm, True, strict=False)
    others = overlap_filter(first, second, confirm, False, strict=False)
    return kept.unionByName(overlap_filter(others, kept, apart, False))


#: Cells of a grid cell's next finer grid along each side, and grids below the whole frame at most.
FAN, DEEPEST = 8, 16


def _cells(points: DataFrame, x0: float, y0: float, side: float, first: int, last: int) -> DataFrame:
    """Points (px, py) with the cells that hold them on the grids first..last: level, gx, gy. Grid l has FAN^l cells a side."""
    at = lambda c, low: F.least(F.floor((F.col(c) - low) / side * F.pow(F.lit(float(FAN)), F.col("level"))), F.pow(F.lit(float(FAN)), F.col("level")) - 1).cast("long")
    rows = points.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return rows.withColumn("gx", at("px", x0)).withColumn("gy", at("py", y0))


def _tree(points: DataFrame, frame: tuple[float, float, float], full: int) -> DataFrame:
    """level, gx, gy, n, heavy of the cells that a grid tree has: a cell with more than `full` points is heavy and has its
    parts on the next grid. Only as many grids are counted as the densest places need, a few at a time, and below the first few
    only the points in heavy cells."""
    step, first, left, tree = 3, 0, points, None
    while True:
        last = min(DEEPEST, first + step)
        counts = _cells(left, *frame, first, last).groupBy("level", "gx", "gy").agg(F.count("*").alias("n"))
        counts = stored(counts.withColumn("heavy", (F.col("n") > full) & (F.col("level") < DEEPEST)))
        tree = counts if tree is None else tree.unionByName(counts)
        deep = counts.filter(F.col("heavy") & (F.col("level") == last))
        if last == DEEPEST or not deep.limit(1).count():
            return tree
        left = _cells(left, *frame, last, last).join(deep.select("gx", "gy"), ["gx", "gy"], "left_semi").drop("level", "gx", "gy")
        first = last + 1


def nearest(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """The k nearest points (pid, px, py) of each query (qid, qx, qy): qid, pid, dist, rank; ties to the smaller pid. Rows
    with a null among these columns take no part; qids are unique.

    Exact. Points are filed in a tree of grids that splits where they are dense, however uneven they lie. Queries of one
    place are asked once, and places of one cell go down the tree together, as the box around them (a place outside the
    frame by itself): of the cells that a box still looks into, the counts of those that lie wholly within a distance of
    all of it tell how far a k-th neighbour can be at most, and cells beyond that are left. A box's points, those of a
    few cells of few points each, then meet each of its places as one row. So neither a product of both sides nor a
    list of all points is made, and what travels is a row per query and one per place and level, whatever is looked into. Of points
    in one place the k smallest ids are enough. A place far outside the frame looks into the cells along one side of it.
    """
    points, queries = points.dropna(subset=["pid", "px", "py"]), queries.dropna(subset=["qid", "qx", "qy"])
    frame = points.agg(F.min("px").cast("double").alias("x0"), F.min("py").cast("double").alias("y0"), F.max("px").cast("double").alias("x1"), F.max("py").cast("double").alias("y1")).first()
    if frame["x0"] is None:
        return queries.select("qid", F.lit(None).cast(points.schema["pid"].dataType).alias("pid"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).filter("false")
    x0, y0 = frame["x0"], frame["y0"]
    side = max(frame["x1"] - x0, frame["y1"] - y0) or 1.0
    some = F.row_number().over(W.partitionBy("px", "py").orderBy("pid"))
    own = points.select("pid", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).withColumn("__n", some).filter(F.col("__n") <= k).drop("__n")
    own = stored(own)
    tree = _tree(own, (x0, y0, side), max(32, 2 * k))
    levels = [r["level"] for r in tree.select("level").distinct().collect()]

    q = queries.select("qid", F.col("qx").cast("double").alias("qx"), F.col("qy").cast("double").alias("qy"))
    places = _boxed(q.select("qx", "qy").distinct(), tree, (x0, y0, side), max(levels))
    boxes = places.groupBy("box").agg(F.min("qx").alias("bx0"), F.max("qx").alias("bx1"), F.min("qy").alias("by0"), F.max("qy").alias("by1"))
    held = [c for c in boxes.columns if c != "box"]

    parts = tree.select((F.col("level") - 1).alias("level"), F.floor(F.col("gx") / FAN).alias("gx"), F.floor(F.col("gy") / FAN).alias("gy"), F.struct("gx", "gy", "n", "heavy").alias("part"))
    looks = boxes.crossJoin(F.broadcast(tree.filter("level = 0").select("level", "gx", "gy", "n", "heavy")))  # one row
    within = W.partitionBy("box").orderBy("far").rangeBetween(W.unboundedPreceding, 0)
    for level in range(max(levels)):
        below = parts.filter(F.col("level") == level)
        down = looks.filter(F.col("heavy") & (F.col("level") == level)).drop("n", "heavy")
        down = down.join(F.broadcast(below) if level == 0 else below, ["level", "gx", "gy"])  # at most FAN^2 rows below the first
        down = down.select("box", *held, (F.col("level") + 1).alias("level"), "part.*")
        looks = down.unionByName(looks.filter(~F.col("heavy")).select(*down.columns))
        width = side / F.pow(F.lit(float(FAN)), F.col("level"))
        low_x, low_y = x0 + F.col("gx") * width, y0 + F.col("gy") * width
        away = lambda c, low, w=width: F.greatest(F.lit(0.0), low - F.col(f"{c}1"), F.col(f"{c}0") - low - w)
        most = lambda c, low, w=width: F.greatest(F.abs(F.col(f"{c}1") - low), F.abs(low + w - F.col(f"{c}0")))
        looks = looks.withColumn("near", F.sqrt(F.pow(away("bx", low_x), 2) + F.pow(away("by", low_y), 2))).withColumn("far", F.sqrt(F.pow(most("bx", low_x), 2) + F.pow(most("by", low_y), 2)))
        looks = looks.withColumn("upto", F.sum("n").over(within))
        looks = looks.withColumn("bound", F.min(F.when(F.col("upto") >= k, F.col("far"))).over(W.partitionBy("box")))
        # A trifle more, for cells' edges are rounded.
        looks = looks.filter(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-9) + side * 1e-9)).drop("near", "far", "upto", "bound")
        looks = stored(looks) if level % 3 == 2 else looks
    filed = _cells(own, x0, y0, side, 0, max(levels)).join(tree.filter(~F.col("heavy")).select("level", "gx", "gy"), ["level", "gx", "gy"], "left_semi")
    # A box's points: its few cells of few points. Written, so their size on disk decides how they reach the places.
    held_points = stored(looks.select("box", "level", "gx", "gy").join(filed, ["level", "gx", "gy"]).groupBy("box").agg(F.collect_list(F.struct("pid", "px", "py")).alias("pts")))
    d = lambda p: distance(F.col("qx"), F.col("qy"), p["px"], p["py"])
    best = F.slice(F.sort_array(F.transform("pts", lambda p: F.struct(d(p).alias("dist"), p["pid"].alias("pid")))), 1, k)
    found = places.join(held_points, "box").select("qx", "qy", best.alias("best"))
    rows = q.join(found, ["qx", "qy"]).select("qid", F.posexplode("best").alias("at", "b"))
    return rows.select("qid", "b.pid", "b.dist", (F.col("at") + 1).alias("rank"))


def _boxed(places: DataFrame, tree: DataFrame, frame: tuple[float, float, float], deepest: int) -> DataFrame:
    """Places (qx, qy) with the box they belong to: the cell below the deepest heavy one that holds them, or themselves if
    they are outside the frame."""
    x0, y0, side = frame
    inside = F.col("qx").between(x0, x0 + side) & F.col("qy").between(y0, y0 + side)
    heavy = tree.filter("heavy").select("level", "gx", "gy", F.lit(True).alias("full"))
    at = _cells(places.filter(inside).select("qx", "qy", F.col("qx").alias("px"), F.col("qy").alias("py")), x0, y0, side, 0, deepest + 1)
    at = at.join(heavy, ["level", "gx", "gy"], "left")
    last = F.coalesce(F.max(F.when(F.col("full"), F.col("level"))), F.lit(-1)) + 1
    cells = at.groupBy("qx", "qy").agg(last.alias("last"), F.collect_list(F.struct("level", "gx", "gy")).alias("cells"))
    cell = F.filter("cells", lambda c: c["level"] == F.col("last"))[0]
    name = lambda *parts: F.concat_ws(" ", *[p.cast("string") for p in parts])
    boxed = cells.select("qx", "qy", name(cell["level"], cell["gx"], cell["gy"]).alias("box"))
    # Two numbers, where a cell has three.
    return stored(boxed.unionByName(places.filter(~inside).select("qx", "qy", name(F.col("qx"), F.col("qy")).alias("box"))))


def inverse_distance(neighbours: DataFrame, values: DataFrame, columns: Sequence[str], top: int = 4095, truncate: bool = True) -> DataFrame:
    """Values of neighbours weighted by 1 / max(d, 1e-9)^2, cut off (truncate) or rounded to whole numbers and, cut off,
    clamped to 0..top. `values`: pid and columns. A billionth is added before cutting off, so that the order in which
    weights are added never shows."""
    w = 1 / F.pow(F.greatest("dist", F.lit(1e-9)), 2)
    rows = neighbours.join(values, "pid").withColumn("__w", w)
    mean = lambda c: F.sum(F.col("__w") * F.col(c)) / F.sum("__w")
    if truncate:
        return rows.groupBy("qid").agg(*[F.greatest(F.lit(0), F.least(F.lit(top), (mean(c) + 1e-9).cast("int"))).alias(c) for c in columns])
    return rows.groupBy("qid").agg(*[F.round(mean(c)).cast("int").alias(c) for c in columns])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, carry: Sequence[str]) -> DataFrame:
    """For each left row, the carried columns of the right row with the largest time not after its own (ties: the
    largest carried values). One union and one window over the keys: a sort, not a product of both sides."""
    l = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"))
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(right_time).alias("t"), *carry).alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("__t", "__side", "__r")
    both = both.withColumn("__last", F.last("__r", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).filter("__side = 1")
    return both.select(*left.columns, F.col("__last.t").alias(f"asof_{right_time}"), *[F.col(f"__last.{c}").alias(f"asof_{c}") for c in carry])


def radius_exclusion(left: DataFrame, struck: DataFrame, radius: float, id_col: str = "id") -> DataFrame:
    """Left rows (id, x, y) with neither the id nor a place within the radius of a struck row (id, x, y).

    Places meet by grid cells as wide as the radius (each struck place is filed in its own and the eight cells around),
    so the join has an equality to go by however many places there are."""
    by_id = left.join(struck.select(F.col(id_col)).distinct(), id_col, "left_anti")
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(*[F.struct((cell("x") + i).alias("gx"), (cell("y") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    s = struck.select(F.col("x").alias("sx"), F.col("y").alias("sy"), near.alias("g")).select("sx", "sy", F.col("g.gx").alias("sgx"), F.col("g.gy").alias("sgy"))
    rows = by_id.withColumn("__gx", cell("x")).withColumn("__gy", cell("y"))
    on = (F.col("__gx") == F.col("sgx")) & (F.col("__gy") == F.col("sgy")) & (distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")) < radius)
    return rows.join(s, on, "left_anti").drop("__gx", "__gy")


def _cone(vx: str, vy: str, least_cosine: float, speed_gap: float) -> tuple[Column, Column, int]:
    """The direction's and the speed's cell, and how many directions there are: none narrower than the angle of the
    least cosine, so that what moves alike is in the same or a neighbouring cell of both."""
    n = max(1, int(2 * math.pi / math.acos(least_cosine) * (1 - 1e-9))) if least_cosine > -1 else 1
    turn = F.atan2(F.col(vy), F.col(vx)) / (2 * math.pi) + 0.5
    speed = F.sqrt(F.col(vx) * F.col(vx) + F.col(vy) * F.col(vy))
    return F.pmod(F.floor(turn * n), F.lit(n)), F.floor(speed / speed_gap), n


def own_cone(vx: str, vy: str, least_cosine: float, speed_gap: float) -> Column:
    """The cone (direction a, speed s) that a velocity lies in."""
    a, s, _ = _cone(vx, vy, least_cosine, speed_gap)
    return F.struct(a.cast("long").alias("a"), s.cast("long").alias("s"))


def cone_cells(vx: str, vy: str, least_cosine: float, speed_gap: float) -> Column:
    """The cones (an array of a, s) of all velocities like this one: its own and those around."""
    a, s, n = _cone(vx, vy, least_cosine, speed_gap)
    near = [F.struct(F.pmod(a + i, F.lit(n)).cast("long").alias("a"), (s + j).cast("long").alias("s")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return F.array_distinct(F.array(*near))


def similar_tracks(tracks: DataFrame, memory: DataFrame, least_cosine: float = 0.85, speed_gap: float = 15.0) -> DataFrame:
    """Tracks (id, vx, vy) that move like a remembered one: cosine over least_cosine, speeds less than speed_gap apart, of
    another id. Both meet in cones of direction and speed, no narrower than what counts as alike, so the pairs looked at are a
    few times those that match, and of these a track needs only its first."""
    speed = lambda df: F.sqrt(df["vx"] * df["vx"] + df["vy"] * df["vy"])
    t = tracks.withColumn("speed", speed(tracks)).withColumn("__own", own_cone("vx", "vy", least_cosine, speed_gap))
    m = memory.select(F.col("id").alias("m_id"), F.col("vx").alias("m_vx"), F.col("vy").alias("m_vy"), speed(memory).alias("m_speed"))
    m = m.withColumn("__m", F.explode(cone_cells("m_vx", "m_vy", least_cosine, speed_gap)))
    cos = (F.col("vx") * F.col("m_vx") + F.col("vy") * F.col("m_vy")) / (F.col("speed") * F.col("m_speed"))
    on = [F.col("__own.a") == F.col("__m.a"), F.col("__own.s") == F.col("__m.s"), F.col("id") != F.col("m_id"), F.abs(F.col("speed") - F.col("m_speed")) < speed_gap, F.col("speed") > 0, F.col("m_speed") > 0, cos > least_cosine]
    return t.join(m, on, "left_semi").drop("__own", "speed")


def correlate(requests: DataFrame, responses: DataFrame, timeout: str = "5 seconds") -> DataFrame:
    """Requests (request_id, ts) with the first response (request_id, ts, data) within the timeout, null if none. On
    streams, give both a watermark: the condition is an interval join."""
    r = responses.select(F.col("request_id").alias("r_id"), F.col("ts").alias("r_ts"), F.col("data"))
    on = F.expr(f"request_id = r_id and r_ts >= ts and r_ts <= ts + interval {timeout}")
    joined = requests.join(r, on, "left")
    return joined.groupBy("request_id", "ts").agg(F.min("r_ts").alias("response_ts"), F.min_by("data", "r_ts").alias("data"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New values where they are not null, else the old ones."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in cols if c in new.columns])
    pick = lambda c: F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c)
    return old.join(n, list(keys), "full").select(*keys, *[pick(c) for c in cols])


def remaining(models: DataFrame, datasets: DataFrame, done: DataFrame) -> DataFrame:
    """The matrix of experiments that are not done yet. Both sides are dimension tables."""
    return models.crossJoin(datasets).join(done, [*models.columns, *datasets.columns], "left_anti")


def first_existing(rows: DataFrame, files: DataFrame, candidates: Column, name: str = "found") -> DataFrame:
    """Rows with the first of their candidate paths (an array) that is among the files (path), null if none is. One equi
    join on the path."""
    tries = rows.select(candidates.alias("__c")).distinct().select("__c", F.posexplode("__c").alias("__n", "path")).join(files.select("path").distinct(), "path")
    hits = tries.groupBy("__c").agg(F.min_by("path", "__n").alias(name))
    return rows.withColumn("__c", candidates).join(hits, "__c", "left").drop("__c")


def label_candidates(image: Column, levels: int = 6) -> Column:
    """Where the labels of an image may be, in order: the labels folder beside its images folder, the same folder, and
    labels folders beside it and up to `levels` folders above."""
    text = F.regexp_replace(image, r"\.[^./]*$", ".txt")
    folders = F.split(image, "/")
    stem = F.element_at(F.split(text, "/"), -1)
    up = [F.concat(F.array_join(F.slice(folders, 1, F.greatest(F.lit(0), F.size(folders) - k)), "/"), F.lit("/labels/"), stem) for k in range(1, levels + 1)]
    beside = F.when(F.contains(image, F.lit("/images/")), F.replace(text, F.lit("/images/"), F.lit("/labels/")))
    return F.array_compact(F.array(beside, text, *[F.when(F.size(folders) > k, u) for k, u in enumerate(up)]))


def annotated(images: DataFrame, files: DataFrame, suffixes: Sequence[str] = ("json", "xml")) -> DataFrame:
    """Images (image: a path) with the annotation beside them that has their name and the first of the suffixes that
    is among the files (path): image, annotation and ann_type (its suffix, both null if there is none), stem."""
    bare = F.regexp_replace("image", r"\.[^./]*$", "")
    tries = F.array(*[F.concat(bare, F.lit(f".{s}")) for s in suffixes])
    found = first_existing(images.select("image"), files, tries, "annotation")
    return found.select("image", "annotation", F.regexp_extract("annotation", r"([^.]*)$", 1).alias("ann_type"), F.regexp_extract(bare, r"([^/]*)$", 1).alias("stem"))


def class_map_by_name(source: DataFrame, target: DataFrame) -> DataFrame:
    """dataset, src_cls, dst_cls of source classes (dataset, cls, name) that a target class (cls, name) shares the name of;
    others have none and are dropped by the strict remap."""
    t = target.groupBy("name").agg(F.min("cls").alias("dst_cls"))
    return source.join(t, "name").select("dataset", F.col("cls").alias("src_cls"), "dst_cls")
