"""Readers of label and annotation formats. Every reader gives fixed columns and keeps files without boxes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from granary.functions.geometry import detect_without_size, polygon_box, xyxy_to_yolo
from granary.functions.text import confidence, path_stem

BOX_SCHEMA = "img string, box_idx int, cls int, cx double, cy double, w double, h double, conf double"


def yolo(spark: SparkSession, path: str, default_conf: float = 0.9, source: str | None = None, sane: bool = False) -> DataFrame:
    """YOLO label files: `class cx cy w h [conf]` per line. Lines with fewer than 5 numbers are skipped; a missing
    confidence is default_conf. sane keeps boxes with all of 0 < cx, cy, w, h < 1. A whole file is a row, so lines keep
    their order. Columns of BOX_SCHEMA, and src if `source` is given."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select(path_stem(F.col("_metadata.file_path")).alias("img"), "value")
    rows = files.select("img", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    # A column of its own, which no filter below can be moved across: a line is split once.
    rows = rows.select("img", "line_no", F.explode(F.array(F.split(F.trim("line"), r"\s+"))).alias("parts"))
    num = [F.try_element_at("parts", F.lit(k + 1)).try_cast("double") for k in range(6)]
    rows = rows.select("img", F.col("line_no").alias("box_idx"), num[0].cast("int").alias("cls"), num[1].alias("cx"), num[2].alias("cy"), num[3].alias("w"), num[4].alias("h"), F.coalesce(num[5], F.lit(default_conf)).alias("conf"))
    rows = rows.dropna(subset=["cls", "cx", "cy", "w", "h"])
    if sane:
        for c in ("cx", "cy", "w", "h"):
            rows = rows.filter((F.col(c) > 0) & (F.col(c) < 1))
    return rows.withColumn("src", F.lit(source)) if source is not None else rows


def images(spark: SparkSession, path: str, suffixes=("jpg", "jpeg", "png", "bmp", "webp")) -> DataFrame:
    """Image files under a path (content is not read): img, path, size, modified."""
    glob = "*.{" + ",".join([*suffixes, *[s.upper() for s in suffixes]]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(path_stem(F.col("path")).alias("img"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path and size of all files under a path whose names end so, empty ones included, which Spark's own file sources
    leave out. Tasks list the folders under the path, one row each, and their names never pass through the driver."""
    schema = "path string, size long, folder boolean"
    top = path if ":/" in path else f"file://{path}"

    def listed(folders: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in folders:
            for own, is_folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                system, root = fs.FileSystem.from_uri(own)
                if deep and not is_folder:
                    yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([system.get_file_info(root).size], pa.int64()), pa.array([False])], names=["path", "size", "folder"])
                    continue
                head, found = own[: len(own) - len(root)], system.get_file_info(fs.FileSelector(root, recursive=deep))
                for at in range(0, len(found), 10_000):
                    rows = [(head + f.path, f.size, f.type == fs.FileType.Directory) for f in found[at : at + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "size", "folder"])

    first = spark.createDataFrame([(top, None, True)], schema).mapInArrow(lambda b: listed(b, False), schema)
    files = first.repartition("path").mapInArrow(lambda b: listed(b, True), schema)
    return files.filter(~F.col("folder") & F.endswith("path", F.lit(suffix))).select("path", "size")


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """Label files with their number of lines, empty ones included: img, path, lines."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    text = F.btrim("value", F.lit(" \n\r\t"))
    counts = rows.select(path_stem(F.col("_metadata.file_path")).alias("img"), F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).alias("lines"))
    files = listing(spark, path, ".txt").select(path_stem(F.col("path")).alias("img"), "path")
    return files.join(counts, "img", "left").select("img", "path", F.coalesce("lines", F.lit(0)).alias("lines"))


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations (bbox as x, y, w, h in pixels) and categories of COCO files."""
    schema = (
        "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
        "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:int,name:string,supercategory:string>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return tuple(doc.select(F.inline(part)) for part in ("images", "annotations", "categories"))


def labelme(spark: SparkSession, path: str) -> DataFrame:
    """LabelMe files: img, label, box_idx and the box around each polygon, clamped; shapes without area are dropped."""
    schema = "imageWidth double, imageHeight double, shapes array<struct<label:string,points:array<array<double>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(path_stem(F.col("_metadata.file_path")).alias("img"), "imageWidth", "imageHeight", F.posexplode("shapes").alias("box_idx", "s"))
    box = polygon_box(F.col("s.points"), F.col("imageWidth"), F.col("imageHeight"))
    return _spread(rows.select("img", "box_idx", F.col("s.label").alias("label"), box.alias("b")))


def voc(spark: SparkSession, path: str) -> DataFrame:
    """Pascal VOC files: img, label, box_idx and the centre-normalised box, clamped."""
    schema = "filename string, size struct<width:double,height:double>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "annotation").load(path).select(path_stem(F.col("filename")).alias("img"), "size", F.posexplode("object").alias("box_idx", "o"))
    points = F.array(F.array("o.bndbox.xmin", "o.bndbox.ymin"), F.array("o.bndbox.xmax", "o.bndbox.ymax"))
    return _spread(rows.select("img", "box_idx", F.col("o.name").alias("label"), polygon_box(points, F.col("size.width"), F.col("size.height")).alias("b")))


def _spread(rows: DataFrame) -> DataFrame:
    # Exploded, so that the filter does not work the box out a second time.
    rows = rows.select(*[c for c in rows.columns if c != "b"], F.explode(F.array("b")).alias("b"))
    return rows.filter("b is not null").select(*[c for c in rows.columns if c != "b"], *[F.col("b")[k].alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))])


DETECTIONS = "image string, time_s double, detections string, yolo_labels array<string>"


def predictions(docs: DataFrame) -> DataFrame:
    """Boxes of detection documents (image, detections as JSON text, yolo_labels): YOLO lines, with confidence 0.5, where
    there are some, else the detections' corners, whose unit is found out. Detections that are no list are skipped."""
    lines = F.posexplode("yolo_labels").alias("box_idx", "line")
    p = F.split(F.trim("line"), r"\s+")
    with_lines = docs.filter(F.size("yolo_labels") > 0).select(path_stem(F.col("image")).alias("img"), lines)
    with_lines = with_lines.select("img", "box_idx", *[F.try_element_at(p, F.lit(k + 2)).try_cast("double").alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))], F.lit(0.5).alias("conf")).dropna()
    rest = docs.filter(F.coalesce(F.size("yolo_labels"), F.lit(0)) <= 0)
    parsed = F.from_json("detections", "array<struct<label:string,confidence:string,bbox:array<double>,box:struct<x1:double,y1:double,x2:double,y2:double>>>")
    rest = rest.select(path_stem(F.col("image")).alias("img"), F.posexplode(parsed).alias("box_idx", "d"))
    v = detect_without_size(F.coalesce("d.bbox", F.array("d.box.x1", "d.box.y1", "d.box.x2", "d.box.y2")))
    rest = rest.select("img", "box_idx", v.alias("v"), confidence(F.col("d.confidence")).alias("conf")).filter("v is not null")
    box = xyxy_to_yolo(tuple(F.col("v")[k] for k in range(4)))
    rest = rest.select("img", "box_idx", *[b.alias(c) for b, c in zip(box, ("cx", "cy", "w", "h"), strict=True)], "conf")
    return with_lines.unionByName(rest)


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """A text that is JSON, or else the first balanced JSON object in it: some result files have more after it, braces
    included. Null if there is none."""
    read = json.JSONDecoder().raw_decode

    def first(t: str | None) -> str | None:
        if not isinstance(t, str):
            return None
        try:
            json.loads(t)
            return t
        except (ValueError, RecursionError):
            at = t.find("{")
        while at >= 0:
            try:
                return t[at : read(t, at)[1]]
            except (ValueError, RecursionError):
                at = t.find("{", at + 1)
        return None

    return pd.Series([first(t) for t in text], dtype=object)


def results(spark: SparkSession, path: str) -> DataFrame:
    """All JSON files under a path: name (relative path, / as _) and json; unparsable ones are skipped."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    name = F.regexp_replace(F.regexp_replace(F.substring_index("_metadata.file_path", path.rstrip("/") + "/", -1), r"\.json$", ""), "/", "_")
    return rows.select(name.alias("name"), first_json(F.col("value")).alias("json")).filter("json is not null")


def action_log(lines: DataFrame) -> DataFrame:
    """Actions of a log (source, line_no, value): `Action: x` lines, each with the `Reasoning:` line that follows it."""
    act = F.regexp_extract("value", r"Action:\s*(\S+)", 1)
    why = F.regexp_extract("value", r"Reasoning:\s*(.*)", 1)
    rows = lines.select("source", "line_no", F.nullif(act, F.lit("")).alias("action"), F.nullif(why, F.lit("")).alias("why")).filter("action is not null or why is not null")
    from pyspark.sql import Window as W

    group = F.sum(F.when(F.col("action").isNotNull(), 1).otherwise(0)).over(W.partitionBy("source").orderBy("line_no"))
    return rows.withColumn("n", group).filter("n > 0").groupBy("source", "n").agg(F.max("action").alias("action"), F.min_by("why", F.when(F.col("why").isNotNull(), F.col("line_no"))).alias("reasoning"))


def metrics_csv(spark: SparkSession, path: str, contains: str = "mAP50-95") -> DataFrame:
    """The last row's value of the first column whose name holds `contains`: file, epoch, value."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    name = next(c for c in rows.columns if contains in c)
    return rows.withColumn("file", F.input_file_name()).groupBy("file").agg(F.max("epoch").alias("epoch"), F.max_by(F.col(f"`{name}`"), "epoch").alias("value"))


def yaml_names(text: Column) -> Column:
    """Class names of a data.yaml, as an array: `names` as a list in brackets, as indented `- name` lines or as indented
    `0: name` lines; null if there are none."""
    flow = F.regexp_extract(text, r"(?m)^names:\s*\[([^\]]*)\]", 1)
    block = F.regexp_extract(text, r"(?m)^names:[ \t]*\r?\n((?:[ \t]*(?:-|\d+:)[^\r\n]*\r?\n?)+)", 1)
    plain = lambda c: F.regexp_replace(F.trim(c), r"^['\"]|['\"]$", "")
    of_flow = F.transform(F.split(flow, ","), plain)
    of_block = F.transform(F.filter(F.split(block, r"\r?\n"), lambda line: F.trim(line) != ""), lambda line: plain(F.regexp_replace(line, r"^\s*(?:-|\d+:)\s*", "")))
    return F.when(F.trim(flow) != "", of_flow).when(block != "", of_block)


def class_names(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """dataset (the folder of a data.yaml) and its class names; where a file names none, those of `known` (dataset,
    names), else `weed` alone."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="data.yaml")
    rows = files.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("dataset"), yaml_names(F.col("value")).alias("own"))
    rows = rows if known is None else rows.join(known.select("dataset", F.col("names").alias("__known")), "dataset", "left")
    instead = F.array(F.lit("weed"))
    return rows.select("dataset", F.coalesce("own", instead if known is None else F.coalesce("__known", instead)).alias("names"))


def split_info(files: DataFrame) -> DataFrame:
    """Per dataset and split of paths `<dataset>/<split>/images|labels/<file>`: images and labels."""
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -4).alias("dataset"), F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("kind"), F.lower(F.element_at(parts, -1)).alias("name"))
    rows = rows.filter(F.col("split").isin("train", "valid", "test"))
    return rows.groupBy("dataset", "split").agg(
        F.count_if((F.col("kind") == "images") & F.col("name").rlike(r"\.(jpg|jpeg|png)$")).alias("images"), F.count_if((F.col("kind") == "labels") & F.endswith("name", F.lit(".txt"))).alias("labels")
    )


def dataset_roots(files: DataFrame, least: int = 10) -> DataFrame:
    """Folders that look like a dataset, from files (path, and text for YAML files): those of a data.yaml, those of another
    .yaml whose first 2000 characters hold `train:` and `names:` or `nc:`, and those with an images folder and a labels
    folder of at least `least` .txt files under it."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"/[^/]*$", "")
    head = F.lower(F.left("text", F.lit(2000)))
    sniffed = F.contains(head, F.lit("train:")) & (F.contains(head, F.lit("names:")) | F.contains(head, F.lit("nc:")))
    by_yaml = files.filter((name == "data.yaml") | (F.endswith("path", F.lit(".yaml")) & F.coalesce(sniffed, F.lit(False)))).select(folder.alias("root"))
    # Every folder above a file that holds it through images or labels.
    parts = F.split("path", "/")
    at = F.explode(F.filter(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.element_at(parts, k).isin("images", "labels")))
    above = files.filter(F.size(parts) > 2).withColumn("k", at).select(F.array_join(F.slice(parts, 1, F.col("k") - 1), "/").alias("root"), F.element_at(parts, F.col("k")).alias("kind"), F.endswith("path", F.lit(".txt")).alias("txt"))
    both = above.groupBy("root").agg(F.count_if(F.col("kind") == "images").alias("i"), F.count_if((F.col("kind") == "labels") & F.col("txt")).alias("l"))
    return by_yaml.unionByName(both.filter((F.col("i") > 0) & (F.col("l") >= least)).select("root")).distinct()
