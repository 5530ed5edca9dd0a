"""Writers of label and annotation formats."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.corpus import numbered


def yolo_lines(boxes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """img and the text of its YOLO label file, empty for images without boxes."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls").cast("int"), "cx", "cy", "w", "h")
    texts = boxes.groupBy("img").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("box_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    if images is None:
        return texts
    return images.select("img").join(texts, "img", "left").select("img", F.coalesce("text", F.lit("")).alias("text"))


def write_yolo(boxes: DataFrame, path: str, images: DataFrame | None = None) -> None:
    """One file <img>.txt for each image under the path, empty for images without boxes."""
    write_texts(yolo_lines(boxes, images), path, ".txt")


def write_texts(rows: DataFrame, path: str, suffix: str) -> None:
    """One file <img><suffix> for each row (img, which may name folders, and text). Tasks write the files of their own rows; a task that runs again
    writes the same files once more."""

    def work(part: Iterator) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        system.create_dir(root, recursive=True)
        made = {""}
        for row in part:
            folder = row["img"].rpartition("/")[0]
            if folder not in made:
                system.create_dir(f"{root.rstrip('/')}/{folder}", recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{root.rstrip('/')}/{row['img']}{suffix}") as out:
                out.write(row["text"].encode())

    rows.select("img", "text").foreachPartition(work)


def coco_tables(boxes: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """COCO images (id from 1 in order of img) and annotations (bbox in pixels)."""
    width, height = F.col("width"), F.col("height")
    ids = numbered(images.withColumn("__all", F.lit(0)), ["__all"], ["img"], "__nth").withColumn("id", (F.col("__nth") + 1).cast("long")).drop("__all", "__nth")
    bbox = F.array((F.col("cx") - F.col("w") / 2) * width, (F.col("cy") - F.col("h") / 2) * height, F.col("w") * width, F.col("h") * height)
    ann = boxes.join(ids.select("img", "id", "width", "height"), "img").select(F.col("id").alias("image_id"), "box_idx", F.col("cls").alias("category_id"), bbox.alias("bbox"), (F.col("w") * width * F.col("h") * height).alias("area"), F.lit(0).alias("iscrowd"))
    return ids.select("id", F.col("img").alias("file_name"), "width", "height"), ann


def coco_results(pred: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, category_id, bbox (pixels) and score of predictions."""
    ids, ann = coco_tables(pred, images)
    scores = pred.select("img", "box_idx", F.col("conf").alias("score"))
    ids = ids.select(F.col("id").alias("image_id"), F.col("file_name").alias("img"))
    return ann.join(ids, "image_id").join(scores, ["img", "box_idx"]).select("image_id", "category_id", "bbox", "score")


def split_by_detection(images: DataFrame, boxes: DataFrame, path: str) -> None:
    """Images partitioned by whether they have a box."""
    has = boxes.select("img").distinct().withColumn("detected", F.lit(True))
    images.join(has, "img", "left").withColumn("detected", F.coalesce("detected", F.lit(False))).write.mode("overwrite").partitionBy("detected").parquet(path)


def manifest(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of img, path and split instead of linked folders."""
    out = None
    for name, df in parts.items():
        rows = df.select("img", "path", F.lit(name).alias("split"))
        out = rows if out is None else out.unionByName(rows)
    return out
