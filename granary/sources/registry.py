"""The dataset registry as a table: reading, merging, snapshots, summaries; and small metadata files."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.joins import upsert

SCHEMA = "slug string, source string, hf_id string, images bigint, annotation string, format string, status string, local_path string, local_images bigint, classes string, class_names array<string>, used_for_training boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A registry file {"datasets": {slug: {...}}} as one row per slug; an empty table if it does not parse."""
    entry = "struct<" + ", ".join(f"{c.split()[0]}:{c.split(' ', 1)[1]}" for c in SCHEMA.split(", ")[1:]) + ">"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"datasets map<string,{entry}>").alias("d"))
    return doc.select(F.explode("d.datasets").alias("slug", "e")).select("slug", "e.*")


def merged(known: DataFrame, found: DataFrame) -> DataFrame:
    """Entries found on disk merged into the known ones; values that are there win over nulls."""
    return upsert(known, found, ["slug"])


def snapshot(registry: DataFrame, folder: str, version: int) -> str:
    """A frozen copy under the folder; readers of a version never see a later one."""
    path = f"{folder.rstrip('/')}/v={version}"
    registry.write.mode("errorifexists").parquet(path)
    return path


def summary(registry: DataFrame, boxed: Sequence[str] = ("bbox", "yolo", "coco")) -> DataFrame:
    """datasets, downloaded, images, box datasets and their images."""
    has = F.col("annotation").isin(*boxed)
    return registry.agg(
        F.count("*").alias("datasets"), F.count_if(F.col("status") == "downloaded").alias("downloaded"), F.coalesce(F.sum("local_images"), F.lit(0)).alias("images"),
        F.count_if(has).alias("box_datasets"), F.coalesce(F.sum(F.when(has, F.col("local_images"))), F.lit(0)).alias("box_images"),
    )


def unused(registry: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Downloaded entries not trained on yet; those with a garbage flag (slug, flag, ts; the latest counts) are left out."""
    rows = registry.filter((F.col("status") == "downloaded") & ~F.coalesce("used_for_training", F.lit(False)))
    if flags is None:
        return rows
    last = flags.groupBy("slug").agg(F.max_by("flag", "ts").alias("flag")).filter("flag = 'garbage'")
    return rows.join(last, "slug", "left_anti")


def harvest(candidates: DataFrame, known: DataFrame, reject: Sequence[str], accept: Sequence[str], most: int) -> DataFrame:
    """New relevant candidates (slug, description, ord): relevance, first of each slug, not known, at most `most`."""
    from granary.operators.corpus import first_wins, relevant

    blob = F.concat_ws(" ", "slug", "description")
    rows = first_wins(candidates.filter(relevant(blob, reject, accept)), "slug", ("ord",))
    return rows.join(known.select("slug"), "slug", "left_anti").orderBy("ord").limit(most)


def write_json(value: object, path: str) -> None:
    """A small metadata file, replaced at once: readers see the old or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, part = tempfile.mkstemp(dir=folder, suffix=".part")
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def data_yaml(names: Sequence[str], train: str = "train/images", valid: str = "valid/images") -> str:
    lines = [f"train: {train}", f"val: {valid}", f"nc: {len(names)}", "names:"]
    return "\n".join([*lines, *[f"  {k}: {json.dumps(n, ensure_ascii=False)}" for k, n in enumerate(names)]]) + "\n"


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration points of either layout (points or calibration_points): camera_x, camera_y, laser_x, laser_y."""
    point = "array<struct<camera_x:double,camera_y:double,laser_x:int,laser_y:int>>"
    doc = spark.read.schema(f"points {point}, calibration_points {point}").json(path, multiLine=True)
    return doc.select(F.inline(F.coalesce("points", "calibration_points")))
