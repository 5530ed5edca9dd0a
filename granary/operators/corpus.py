"""Building an image corpus: relevance, leakage, class maps, first-wins dedup, splits, oversampling, and all in one merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.storage import stored


def relevant(blob: Column, reject: Sequence[str], accept: Sequence[str]) -> Column:
    """No reject word and at least one accept word as substring of the lower-cased text."""
    low = F.lower(F.coalesce(blob, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if words else F.lit(False)
    return ~has(reject) & has(accept)


def box_hint(task: Column, tags: Column, files: Column) -> Column:
    """The first reason to expect boxes: task, tag, file; null if none."""
    # Tags that announce boxes, and files that hold them.
    known = F.array(*map(F.lit, ("object-detection", "yolo", "bbox", "bounding-box")))
    file = F.exists(files, lambda f: F.lower(f).rlike(r"(^|/)labels?/|annotations?.*\.(json|xml)$|data\.ya?ml$|_annotations\.coco\.json$"))
    return F.when(F.contains(F.lower(task), F.lit("detection")), "task").when(F.arrays_overlap(F.transform(tags, F.lower), known), "tag").when(file, "file")


def first_wins(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Per key, the first row in order; rows with a null key all stay. The winner of a key is found with map-side partial
    aggregation, so a key that very many rows share is no burden."""
    names = [f"__w{k}" for k in range(len(order))]
    best = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(*[F.col(o).alias(n) for o, n in zip(order, names, strict=True)])).alias("__best"))
    mine = F.struct(*[F.col(o).alias(n) for o, n in zip(order, names, strict=True)])
    joined = rows.join(best, F.col(key) == F.col("__k"), "left")
    return joined.filter(F.col("__k").isNull() | (mine == F.col("__best"))).drop("__k", "__best")


def without_holdout(images: DataFrame, holdout: DataFrame, stem: str = "stem") -> DataFrame:
    return images.join(holdout.select(stem).distinct(), stem, "left_anti")


def remap_strict(boxes: DataFrame, class_map: DataFrame, wildcard: DataFrame | None = None) -> DataFrame:
    """Boxes (dataset, cls, ...) with the class of class_map (dataset, src_cls, dst_cls); datasets of `wildcard` (dataset,
    slot) have all their classes put in one slot; other boxes are dropped."""
    m = class_map.select("dataset", F.col("src_cls").alias("cls"), "dst_cls")
    out = boxes.join(m, ["dataset", "cls"], "left")
    if wildcard is not None:
        out = out.join(wildcard.select("dataset", "slot"), "dataset", "left").withColumn("dst_cls", F.coalesce("dst_cls", "slot")).drop("slot")
    return out.filter("dst_cls is not null").withColumn("cls", F.col("dst_cls")).drop("dst_cls")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "nth") -> DataFrame:
    """Rows with their number from 0 in the order within each group. Sorted by ranges, which are counted first: no group
    is ordered by one task, however large it is."""
    # Written once: bounds of ranges come from a sample, so a second reading could cut them elsewhere.
    spread = stored(rows.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))
    sizes = spread.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(by)], F.col("__p").alias("__part"), F.coalesce(upto, F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy(*by, "__p").orderBy(*order)) - 1
    on = [F.col("__p") == F.col("__part"), *[F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(by)]]
    out = spread.withColumn("__place", place).join(sizes, on)
    return out.withColumn(name, F.col("__before") + F.col("__place")).drop("__p", "__part", "__before", "__place", *[f"__k{k}" for k in range(len(by))])


def every_nth_to_valid(images: DataFrame, share: float = 0.1, dataset: str = "dataset", order: Sequence[str] = ("img_ord",)) -> DataFrame:
    """split: valid for every int(1 / share)-th image of each dataset, from the first; train else."""
    rows = numbered(images, [dataset], order, "__nth")
    return rows.withColumn("split", F.when(F.col("__nth") % int(1 / share) == 0, "valid").otherwise("train")).drop("__nth")


def hash_split(rows: DataFrame, id_col: str, shares: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """A split of exact sizes: names in order get int(share * n) rows each by hash rank, the last gets the rest."""
    n = rows.count()
    upto, choice = 0, None
    for name, share in shares[:-1]:
        upto += int(n * share)
        choice = F.when(F.col("__nth") < upto, name) if choice is None else choice.when(F.col("__nth") < upto, name)
    split = choice.otherwise(shares[-1][0]) if choice is not None else F.lit(shares[0][0])
    ranked = rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))).withColumn("__all", F.lit(0))
    return numbered(ranked, ["__all"], ["__h", id_col], "__nth").withColumn("split", split).drop("__h", "__nth", "__all")


def _lot(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def sample_n(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, by hash: a bounded heap in each task, no shuffle of all rows."""
    return rows.orderBy(_lot(id_col, seed), id_col).limit(n)


def sample_each(rows: DataFrame, by: Sequence[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group without replacement, by hash. A group's first rows are found within parts of it before they meet,
    so a large group is no burden."""
    lot, part = F.struct(_lot(id_col, seed), F.col(id_col)), F.pmod(F.xxhash64(id_col), F.lit(64))
    own = rows.withColumn("__lot", lot).withColumn("__part", part)
    for keys in ((*by, "__part"), by):
        own = own.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("__lot"))).filter(F.col("__n") <= n)
    return own.drop("__lot", "__part", "__n")


def new_texts(new: DataFrame, known: DataFrame, text: str, order: str) -> DataFrame:
    """Rows of `new` whose exact text is not in `known`, the first of each text; null texts are none."""
    return first_wins(new.filter(F.col(text).isNotNull()), text, (order,)).join(known.select(text), text, "left_anti")


def replay_size(n_new: Column | int, share: float) -> Column:
    return (F.lit(n_new) * share / max(1 - share, 0.01)).cast("long")


def oversample_plan(boxes: DataFrame, target: int | None = 500, most: int = 10) -> DataFrame:
    """Copies of each file that holds a class with fewer than target boxes (None: than the largest class): cls, instances,
    files, copies = least(most, int(need / greatest(boxes per file * files, 1)) + 1)."""
    per = boxes.groupBy("cls").agg(F.count("*").alias("instances"), F.count_distinct("img").alias("files"))
    if target is None:
        per = per.crossJoin(F.broadcast(per.agg(F.max("instances").alias("__target"))))
    need = (F.col("__target") if target is None else F.lit(target)) - F.col("instances")
    rate = F.greatest(F.col("instances") / F.col("files") * F.col("files"), F.lit(1.0))
    return per.filter(need > 0).withColumn("copies", F.least(F.lit(most), (need / rate).cast("int") + 1)).drop("__target")


def oversample(images: DataFrame, boxes: DataFrame, target: int = 500, most: int = 10) -> DataFrame:
    """Images with copy numbers from 0 (the original) to the largest number that a class in it asks for."""
    plan = oversample_plan(boxes, target, most)
    times = boxes.select("img", "cls").distinct().join(plan.select("cls", "copies"), "cls").groupBy("img").agg(F.max("copies").alias("__c"))
    rows = images.join(times, "img", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("__c", F.lit(0)))))
    return rows.drop("__c")


def leave_classes_out(boxes: DataFrame, held: Sequence[int], train: Sequence[int]) -> DataFrame:
    """Splits images: any held-out class sends an image to holdout with all its boxes; images with training classes alone
    go to train, remapped to 0..n-1 in the order given; images with neither are dropped. img, box_idx, cls, split."""
    images = boxes.groupBy("img").agg(F.bool_or(F.col("cls").isin(*held)).alias("h"), F.bool_or(F.col("cls").isin(*train)).alias("t"))
    split = F.when(F.col("h"), "holdout").when(F.col("t"), "train")
    rows = boxes.join(images.select("img", split.alias("split")).filter("split is not null"), "img")
    place = F.create_map(*[F.lit(x) for pair in ((c, k) for k, c in enumerate(train)) for x in pair])
    mapped = F.when(F.col("split") == "train", F.element_at(place, F.col("cls").cast("int"))).otherwise(F.col("cls").cast("int"))
    return rows.withColumn("cls", mapped).filter("cls is not null")


def merge_reasons(images: DataFrame, boxes: DataFrame, datasets: DataFrame, holdout: DataFrame, class_map: DataFrame, annotations: Sequence[str] = ("yolo",)) -> DataFrame:
    """What becomes of every image in the merge of all datasets into one corpus: dataset, img, img_ord, reason.

    datasets: dataset, ds_ord, annotation, never_train, garbage. images: dataset, img, img_ord, stem, hash. Each image ends
    for the first reason that holds: never_train, garbage, annotation, no_label, holdout, duplicate (an earlier image,
    in order of ds_ord and img_ord, has the same hash; null hashes never match), unmapped (no box survives the strict
    class map; its hash still counts as seen), kept.
    """
    labelled = boxes.select("dataset", "img").distinct().withColumn("__lab", F.lit(True))
    mapped = remap_strict(boxes, class_map).select("dataset", "img").distinct().withColumn("__map", F.lit(True))
    held = holdout.select("stem").distinct().withColumn("__held", F.lit(True))
    rows = images.join(datasets, "dataset").join(labelled, ["dataset", "img"], "left").join(held, "stem", "left")
    early = (
        F.when(F.col("never_train"), "never_train").when(F.col("garbage"), "garbage").when(~F.col("annotation").isin(*annotations), "annotation")
        .when(F.col("__lab").isNull(), "no_label").when(F.col("__held").isNotNull(), "holdout")
    )
    rows = rows.withColumn("early", early)
    open_ = rows.filter("early is null")
    winners = first_wins(open_, "hash", ("ds_ord", "img_ord")).select("dataset", "img").withColumn("__first", F.lit(True))
    rows = rows.join(winners, ["dataset", "img"], "left").join(mapped, ["dataset", "img"], "left")
    reason = F.coalesce("early", F.when(F.col("__first").isNull(), "duplicate").when(F.col("__map").isNull(), "unmapped").otherwise("kept"))
    return rows.select("dataset", "img", "img_ord", reason.alias("reason"))


def merge_counters(reasons: DataFrame) -> DataFrame:
    """How many images ended for each reason: reason, n."""
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def merged(reasons: DataFrame) -> DataFrame:
    """The corpus: dataset, img, split of the images kept. Every tenth kept image of a dataset goes to valid."""
    return every_nth_to_valid(reasons.filter("reason = 'kept'")).select("dataset", "img", "split")


def merge_datasets(images: DataFrame, boxes: DataFrame, datasets: DataFrame, holdout: DataFrame, class_map: DataFrame, annotations: Sequence[str] = ("yolo",)) -> tuple[DataFrame, DataFrame]:
    """The merge, both as `merged` and as `merge_counters` tell it. The reasons are written once for both."""
    reasons = stored(merge_reasons(images, boxes, datasets, holdout, class_map, annotations))
    return merged(reasons), merge_counters(reasons)
