"""Combining detectors: pairwise fusion of a precise and a broad one, best-match fusion, votes over many.

`first` and `second` are relations (img, box_idx, cls, cx, cy, w, h, conf); the first is the trusted detector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.matching import BOX, any_met, chosen, iou_pairs, meetings, ordered, star_cluster


def as_pred(boxes: DataFrame) -> DataFrame:
    return boxes.withColumnRenamed("box_idx", "pred_idx")


def as_gt(boxes: DataFrame) -> DataFrame:
    return boxes.withColumnRenamed("box_idx", "gt_idx")


def fuse(first: DataFrame, second: DataFrame, strategy: str, match_iou: float = 0.3, second_conf: float = 0.0) -> DataFrame:
    """supplement: all of the first, and unmatched boxes of the second with at least second_conf.
    filter: boxes of the first that the second confirms.
    weighted: confirmed ones get least(1, 0.7 conf + 0.3), others 0.9 conf, unmatched ones of the second with at least
    second_conf 0.5 conf; images where the second has no box keep the first as it is, images where the first has none
    give nothing.
    Returns img, src (first or second), box_idx, cls, the box and conf.
    """
    if strategy not in ("supplement", "filter", "weighted"):
        raise ValueError(f"unknown strategy {strategy}")
    return _fused(first, second, strategy, match_iou, second_conf)


def _fused(first: DataFrame, second: DataFrame, strategy: str, match_iou: float, second_conf: float, carry: Sequence[str] = ()) -> DataFrame:
    """`fuse`, with columns of the first to carry (strategy filter). Greedy one-to-one pairs in the first detector's file
    order; an image is one row throughout, so neither side is joined by single boxes."""
    cols, more = ["cls", *BOX, "conf"], list(carry)
    met = meetings(as_pred(first), as_gt(second), match_iou, by_confidence=False, carry=[*cols, *more], gt_carry=cols, how="left" if strategy == "filter" else "full")
    wanted = lambda p: F.struct(p["pred_idx"].alias("pred_idx"), *[p[f"p_{c}"].alias(c) for c in (*cols, *more)], ordered(p).alias("cands"))
    met = met.select("img", F.transform("preds", wanted).alias("preds"), "gts")
    gid, idx = second.schema["box_idx"].dataType.simpleString(), first.schema["box_idx"].dataType.simpleString()
    kinds = "".join(f",{c}:{first.schema[c].dataType.simpleString()}" for c in (*cols, *more))
    row = lambda p, got: F.struct(p["pred_idx"].alias("box_idx"), *[p[c].alias(c) for c in (*cols, *more)], got.alias("other_idx"))
    none = F.transform("preds", lambda p: row(p, F.lit(None).cast(gid)))
    pairs = F.when(any_met(F.col("preds")), chosen(F.col("preds"), match_iou, gid, lambda p, got: row(p, got["gt_idx"]), f"array<struct<box_idx:{idx}{kinds},other_idx:{gid}>>")).otherwise(none)
    met = met.select("img", pairs.alias("pairs"), "gts")
    hit = lambda p: p["other_idx"].isNotNull()
    if strategy == "filter":
        rows = met.select("img", F.explode(F.filter("pairs", hit)).alias("p"))
        return rows.select("img", F.lit("first").alias("src"), "p.box_idx", *[F.col(f"p.{c}").alias(c) for c in (*cols, *more)])
    taken = F.transform("pairs", lambda p: p["other_idx"])
    rest = F.filter("gts", lambda g: (g["g_conf"] >= second_conf) & ~F.coalesce(F.array_contains(taken, g["gt_idx"]), F.lit(False)))
    own_conf, rest_conf = lambda p: p["conf"], lambda g: g["g_conf"]
    if strategy == "weighted":
        own_conf = lambda p: F.when(F.col("gts").isNull(), p["conf"]).when(hit(p), F.least(F.lit(1.0), 0.7 * p["conf"] + 0.3)).otherwise(0.9 * p["conf"])
        rest, rest_conf = F.when(F.col("pairs").isNotNull(), rest), lambda g: 0.5 * g["g_conf"]
    out = lambda src, i, b, conf, at="": F.struct(F.lit(src).alias("src"), i.alias("box_idx"), *[b[f"{at}{c}"].alias(c) for c in ("cls", *BOX)], conf.alias("conf"))
    mine, others = F.transform("pairs", lambda p: out("first", p["box_idx"], p, own_conf(p))), F.transform(rest, lambda g: out("second", g["gt_idx"], g, rest_conf(g), "g_"))
    rows = met.select("img", F.explode(F.when(mine.isNull(), others).when(others.isNull(), mine).otherwise(F.concat(mine, others))).alias("b"))
    return rows.select("img", "b.src", "b.box_idx", "b.cls", *[F.col(f"b.{c}").alias(c) for c in (*BOX, "conf")])


def source_counts(fused: DataFrame) -> DataFrame:
    """How many boxes of a fusion came from each detector: src, n."""
    return fused.groupBy("src").agg(F.count("*").alias("n"))


def fuse_two_stage(first: DataFrame, broad: DataFrame, precise: DataFrame, match_iou: float = 0.3, filter_iou: float = 0.2) -> DataFrame:
    """Supplement with a broad detector, then keep what a precise one confirms."""
    from pyspark.sql import Window as W

    some = fuse(first, broad, "supplement", match_iou)
    order = W.partitionBy("img").orderBy("src", "box_idx")
    some = some.withColumn("old_idx", F.col("box_idx")).withColumn("box_idx", F.row_number().over(order) - 1)
    kept = _fused(some.withColumnRenamed("src", "__src"), precise, "filter", filter_iou, 0.0, carry=("__src", "old_idx"))
    return kept.select("img", F.col("__src").alias("src"), F.col("old_idx").alias("box_idx"), "cls", *BOX, "conf")


def fuse_rich(first: DataFrame, second: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Best-match fusion with provenance: each box of the first takes the box of the second that it overlaps most, if by
    more than the threshold (one may serve several); boxes of the second that serve none follow.

    Returns img, source (fused, first_only, second_only), first_idx, second_idx, iou, agreement (agree, disagree, null),
    needs_review.
    """
    pairs = iou_pairs(as_pred(first), as_gt(second), threshold, strict=True)
    best = pairs.groupBy("img", "pred_idx").agg(F.max_by(F.struct("gt_idx", "iou"), F.struct("iou", (-F.col("gt_idx")).alias("o"))).alias("b"))
    best = best.select("img", F.col("pred_idx").alias("box_idx"), F.col("b.gt_idx").alias("second_idx"), F.col("b.iou").alias("iou"))
    names = second.select("img", F.col("box_idx").alias("second_idx"), F.col("cls").alias("second_cls"))
    own = first.select("img", "box_idx", "cls").join(best, ["img", "box_idx"], "left").join(names, ["img", "second_idx"], "left")
    agreement = F.when(F.col("second_idx").isNotNull(), F.when(F.col("cls") == F.col("second_cls"), "agree").otherwise("disagree"))
    source = F.when(F.col("second_idx").isNotNull(), "fused").otherwise("first_only")
    rows = own.select("img", source.alias("source"), F.col("box_idx").alias("first_idx"), "second_idx", "iou", agreement.alias("agreement"), (agreement == "disagree").alias("r"))
    rows = rows.withColumn("needs_review", F.coalesce("r", F.lit(False))).drop("r")
    served = best.select("img", F.col("second_idx").alias("box_idx")).distinct()
    rest = second.join(served, ["img", "box_idx"], "left_anti")
    idx = first.schema["box_idx"].dataType
    rest = rest.select(
        "img", F.lit("second_only").alias("source"), F.lit(None).cast(idx).alias("first_idx"), F.col("box_idx").alias("second_idx"), F.lit(None).cast("double").alias("iou"), F.lit(None).cast("string").alias("agreement"), F.lit(True).alias("needs_review")
    )
    return rows.unionByName(rest)


def consensus(boxes: DataFrame, precision: DataFrame | None = None, min_votes: int = 2, threshold: float = 0.5, capped: bool = True) -> DataFrame:
    """Clusters that enough detectors agree on: img, seed_idx, votes, box_idx (the representative).

    boxes: img, box_idx (their order), src and the box. A cluster needs votes from `min_votes` detectors (capped: or all
    that are present in the image, if fewer). The representative is the member of the detector with the largest
    precision (relation src, precision; unknown is 0), the first of equal ones; without precisions, the seed.
    """
    present = lambda all_: F.size(F.array_distinct(F.filter(F.transform(all_, lambda b: b["src"]), lambda src: src.isNotNull())))
    members = star_cluster(boxes, threshold, carry=("src",), of_all={"present": present} if capped else None)
    group = ["img", "seed_idx", *(["present"] if capped else [])]
    votes = F.count_distinct("src").alias("votes")
    if precision is None:
        out = members.groupBy(*group).agg(votes).withColumn("box_idx", F.col("seed_idx"))  # the seed is the first of its cluster
    else:
        members = members.join(precision.select("src", F.col("precision").alias("quality")), "src", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
        out = members.groupBy(*group).agg(votes, F.max_by("box_idx", F.struct("quality", (-F.col("box_idx")).alias("o"))).alias("box_idx"))
    if not capped:
        return out.filter(F.col("votes") >= min_votes)
    return out.filter(F.col("votes") >= F.least(F.lit(min_votes), F.greatest("present", F.lit(1)))).drop("present")


def merge_labels(old: DataFrame, new: DataFrame, first_new: int = 8) -> DataFrame:
    """Old-class boxes (cls under first_new) of one relation with all boxes of another."""
    return old.filter(F.col("cls") < first_new).unionByName(new)


def flip_fused(boxes: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Boxes of a mirrored view in the unmirrored image: cx becomes 1 - cx."""
    return boxes.withColumn("cx", 1 - F.col("cx"))
