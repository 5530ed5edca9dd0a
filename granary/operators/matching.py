"""Set-valued operators on the boxes of one image: greedy matching, seeded clusters, suppression, weighted fusion.

The rules depend on order, so each is a fold over a sorted array. One shuffle on the image brings its boxes together;
everything else is a JVM expression, but for `matched_bits`, which matches many images at once in numpy. An image's boxes are
bounded by the detector, so arrays stay small.

Relations: gt(img, gt_idx, cls, cx, cy, w, h), pred(img, pred_idx, cls, cx, cy, w, h, conf). `keys` names the columns that
must agree, by default the image alone; with the class among them, matching is class-aware.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions.geometry import box_columns, corners, iou, iou_corners

BOX = ("cx", "cy", "w", "h")
CORNERS = ("x1", "y1", "x2", "y2")


def iou_pairs(pred: DataFrame, gt: DataFrame, threshold: float, keys: Sequence[str] = ("img",), strict: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """All pairs of one image with an overlap of at least (strict: over) the threshold, and columns of gt to carry. An equi
    join with the overlap as residual condition, so never a nested loop."""
    p = pred.select(*keys, "pred_idx", "conf", *[F.col(c).alias(f"p_{c}") for c in BOX])
    g = gt.select(*[F.col(k).alias(f"g_{k}") for k in keys], "gt_idx", *[F.col(c).alias(f"g_{c}") for c in BOX], *carry)
    overlap = iou(box_columns("p_"), box_columns("g_"))
    same = [F.col(k) == F.col(f"g_{k}") for k in keys]
    joined = p.join(g, [*same, overlap > threshold if strict else overlap >= threshold])
    return joined.select(*keys, "pred_idx", "conf", "gt_idx", overlap.alias("iou"), *carry)


def meetings(pred: DataFrame, gt: DataFrame, least: float, keys: Sequence[str] = ("img",), by_confidence: bool = True, carry: Sequence[str] = (), gt_carry: Sequence[str] = (), how: str = "left") -> DataFrame:
    """A row per group of keys: preds, in the order in which they choose, each with pred_idx, conf, the columns `carry` and
    cands (gt_idx, gt_carry and iou of the boxes that it overlaps by at least `least`), and gts (gt_idx and gt_carry; null if
    there are none). how: full keeps groups without predictions as well, with preds null.

    Both sides are brought together by the keys alone, as arrays, so what is partitioned by them already stays where it is,
    and nothing is joined by single boxes afterwards."""
    corner = [c.alias(n) for c, n in zip(_corners(), CORNERS, strict=True)]
    rank = -F.col("conf") if by_confidence else F.lit(0.0)
    p = pred.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "pred_idx", "conf", *corner, *[F.col(c).alias(f"p_{c}") for c in carry]))).alias("preds"))
    g = gt.groupBy(*keys).agg(F.collect_list(F.struct("gt_idx", *corner, *[F.col(c).alias(f"g_{c}") for c in gt_carry])).alias("gts"))
    of = lambda x: tuple(x[c] for c in CORNERS)
    more = [f"g_{c}" for c in gt_carry]

    def met(p: Column) -> Column:
        every = F.transform(F.coalesce("gts", F.array().cast(g.schema["gts"].dataType)), lambda b: F.struct(b["gt_idx"].alias("gt_idx"), iou_corners(of(p), of(b)).alias("iou"), *[b[c].alias(c) for c in more]))
        return F.struct(p["pred_idx"].alias("pred_idx"), p["conf"].alias("conf"), *[p[f"p_{c}"].alias(f"p_{c}") for c in carry], F.filter(every, lambda c: c["iou"] >= least).alias("cands"))

    return p.join(g, list(keys), how).select(*keys, F.transform("preds", met).alias("preds"), F.transform("gts", lambda b: F.struct(b["gt_idx"].alias("gt_idx"), *[b[c].alias(c) for c in more])).alias("gts"))


def chosen(preds: Column, threshold: float, idx: str, result: Callable[[Column, Column], Column], empty: str) -> Column:
    """result(prediction, box or null) for each of preds in turn: a prediction takes the first of its cands (gt_idx, iou) that
    is still free and overlaps it by at least the threshold. idx: the type of gt_idx; empty: that of the array of results."""
    start = F.struct(F.array().cast(f"array<{idx}>").alias("used"), F.array().cast(empty).alias("out"))

    def take(acc: Column, p: Column) -> Column:
        got = F.get(F.filter(p["cands"], lambda c: (c["iou"] >= threshold) & ~F.array_contains(acc["used"], c["gt_idx"])), F.lit(0))
        used = F.when(got.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(got["gt_idx"])))
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(result(p, got))).alias("out"))

    return F.aggregate(preds, start, take)["out"]


def ordered(p: Column, last_of_ties: bool = False, ignored: Callable[[Column], Column] | None = None) -> Column:
    """The cands of a prediction in the order in which it wants them: gt_idx and iou."""
    wish = lambda c: F.struct((ignored(c) if ignored else F.lit(False)).alias("g"), (-c["iou"]).alias("o"), (-c["gt_idx"] if last_of_ties else c["gt_idx"]).alias("t"), c["gt_idx"].alias("gt_idx"), c["iou"].alias("iou"))
    return F.sort_array(F.transform(p["cands"], wish))


def greedy_match(
    pred: DataFrame, gt: DataFrame, thresholds: Sequence[float] = (0.5,), keys: Sequence[str] = ("img",), by_confidence: bool = True, last_of_ties: bool = False
) -> DataFrame:
    """Every prediction with the box it gets: keys, pred_idx, conf, threshold, gt_idx (null: a false positive).

    Predictions go by falling confidence, ties by pred_idx (by_confidence=False: by pred_idx alone); each takes the free
    box that it overlaps most, ties to the smaller gt_idx (last_of_ties: the larger), if that is at least the threshold.
    If gt has a column `ignored`, boxes with it are taken only by predictions that no other free box is overlapped by enough.
    Overlaps are worked out once, down to the lowest threshold, for all thresholds; where no box meets another, nothing is
    folded.
    """
    steps, has = sorted(set(thresholds)), "ignored" in gt.columns
    met = meetings(pred, gt, steps[0], keys, by_confidence, gt_carry=("ignored",) if has else ())
    wanted = lambda p: F.struct(p["pred_idx"].alias("pred_idx"), p["conf"].cast("double").alias("conf"), ordered(p, last_of_ties, (lambda c: c["g_ignored"]) if has else None).alias("cands"))
    met = met.select(*keys, F.transform("preds", wanted).alias("preds"))
    gid = gt.schema["gt_idx"].dataType.simpleString()
    kind = f"array<struct<threshold:double,pred_idx:{pred.schema['pred_idx'].dataType.simpleString()},conf:double,gt_idx:{gid}>>"

    def fold(threshold: float) -> Column:
        row = lambda p, got: F.struct(F.lit(float(threshold)).alias("threshold"), p["pred_idx"].alias("pred_idx"), p["conf"].alias("conf"), got.alias("gt_idx"))
        none = F.transform("preds", lambda p: row(p, F.lit(None).cast(gid)))
        return F.when(any_met(F.col("preds")), chosen(F.col("preds"), threshold, gid, lambda p, got: row(p, got["gt_idx"]), kind)).otherwise(none)

    rows = met.select(*keys, F.explode(F.concat(*[fold(t) for t in steps])).alias("m"))
    return rows.select(*keys, "m.pred_idx", "m.conf", "m.threshold", "m.gt_idx")


def any_met(preds: Column) -> Column:
    return F.exists(preds, lambda p: F.size(p["cands"]) > 0)


#: Pairs of boxes whose overlaps are worked out at once in a task.
PAIRS = 1_000_000


def _met_pairs(image: np.ndarray, preds: np.ndarray, truths: np.ndarray, box: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of predictions and true boxes of one image that overlap by at least `least`, and the overlaps, in the order of
    operations that `iou_corners` has. image: numbers from 0 that do not fall; preds and truths: places in order."""
    x1, y1, x2, y2 = box
    many = np.bincount(image[truths], minlength=image[-1] + 1)
    start, each = np.cumsum(many) - many, many[image[preds]]
    upto = np.cumsum(each)
    found, low = [], 0
    while low < len(preds):
        done = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        n = each[low:high]
        p = np.repeat(preds[low:high], n)
        nth = np.arange(len(p)) - np.repeat(upto[low:high] - n - done, n)
        t = truths[np.repeat(start[image[preds[low:high]]], n) + nth]
        # As in SQL, a number that is none is the largest.
        iw = np.maximum(0.0, np.fmin(x2[p], x2[t]) - np.maximum(x1[p], x1[t]))
        ih = np.maximum(0.0, np.fmin(y2[p], y2[t]) - np.maximum(y1[p], y1[t]))
        inter = iw * ih
        union = (x2[p] - x1[p]) * (y2[p] - y1[p]) + (x2[t] - x1[t]) * (y2[t] - y1[t]) - inter
        iou = np.where(union <= 0, 0.0, inter / np.where(union == 0, 1.0, union))
        on = ~(iou < least)
        found.append((p[on], t[on], iou[on]))
        low = high
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (preds[:0], truths[:0], np.empty(0))


def _bits(image: np.ndarray, idx: np.ndarray, truth: np.ndarray, asked: np.ndarray, box: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """The rounds in which each box is matched. Predictions stand in the order in which they choose; the nth ones of all images
    choose at once, as an image's boxes are its own."""
    bits = np.zeros(len(image), np.int64)
    p, t, iou = _met_pairs(image, np.flatnonzero(~truth & (asked != 0)), np.flatnonzero(truth & (asked != 0)), box, min(thresholds))
    order = np.lexsort((idx[t], np.where(np.isnan(iou), -np.inf, -iou), p))
    p, t, iou = p[order], t[order], iou[order]
    for k, least in enumerate(thresholds):
        on = ((asked[p] >> k) & 1 == 1) & ~(iou < least)
        pk, tk = p[on], t[on]
        if not len(pk):
            continue
        head = np.r_[True, pk[1:] != pk[:-1]]
        own = image[pk[head]]
        at = np.arange(len(own))
        nth = (at - np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], at, 0)))[np.cumsum(head) - 1]
        turn = np.argsort(nth, kind="stable")
        pk, tk, used, low = pk[turn], tk[turn], np.zeros(len(image), bool), 0
        for high in np.cumsum(np.bincount(nth)):
            free = ~used[tk[low:high]]
            pf, tf = pk[low:high][free], tk[low:high][free]
            first = np.r_[True, pf[1:] != pf[:-1]][: len(pf)]
            used[tf[first]] = True
            bits[pf[first]] |= 1 << k
            bits[tf[first]] |= 1 << k
            low = high
    return bits


def matched_bits(boxes: DataFrame, rounds: Sequence[tuple[Column | None, float]], keys: Sequence[str] = ("img",), carry: Sequence[str] = (), truths: bool = False) -> DataFrame:
    """`greedy_match` in several rounds at once, of predictions and true boxes that are rows of one relation (role 0 and 1; idx, a
    whole number): a row per prediction (truths: per true box) with keys, idx, the columns `carry` and bits, whose bit k tells
    that it is matched in round k. A round is a condition on predictions (None: all) and a threshold above 0; at most 62.

    Boxes go once to the place of their keys, and stay if they are there; true boxes are not sent for each round, nor are rows
    multiplied by rounds. Sorted rows are read as Arrow, some thousand images at once; an image that a batch cuts waits for its
    rest. Null keys meet nothing, nor do boxes with a null."""
    if not 0 < len(rounds) < 63 or min(t for _, t in rounds) <= 0:
        raise ValueError("1 to 62 rounds with thresholds above 0")
    thresholds = [float(t) for _, t in rounds]
    whole = " and ".join(f"`{c}` is not null" for c in (*keys, *BOX))
    takes = sum((F.when(F.lit(True) if on is None else on, F.lit(1 << k)).otherwise(F.lit(0)) for k, (on, _) in enumerate(rounds)), F.lit(0)).cast("long")
    order = (F.col("conf").desc_nulls_last(), F.col("idx"))
    keep = list(dict.fromkeys((*keys, "idx", *carry)))
    corner = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__{n}") for c, n in zip(_corners(), CORNERS, strict=True)]
    asked = F.when(F.expr(whole), F.when(F.col("role") == 1, F.lit(1).cast("long")).otherwise(takes)).otherwise(F.lit(0).cast("long"))
    rows = boxes.filter("role in (0, 1)").select("*", asked.alias("__asked"), F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("__nth"))
    rows = rows.sortWithinPartitions(*keys, *order)  # they are so by the window
    rows = rows.select(*keep, (F.col("role") == 1).alias("__truth"), "__asked", "__nth", *corner)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if not some:
            return
        truth = some.column("__truth").to_numpy()
        image = np.cumsum(some.column("__nth").to_numpy() == 1) - 1
        box = [some.column(f"__{n}").to_numpy() for n in CORNERS]
        bits = _bits(image, some.column("idx").to_numpy(), truth, some.column("__asked").to_numpy(), box, thresholds)
        yield from some.select(keep).append_column("bits", pa.array(bits)).filter(pa.array(truth == truths)).to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            first = np.flatnonzero(batch.column("__nth").to_numpy() == 1)
            cut = int(first[-1]) if len(first) else 0
            if len(first):
                yield from done([*waiting, batch.slice(0, cut)])
                waiting = []
            waiting.append(batch.slice(cut))
        yield from done(waiting)

    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    return rows.mapInArrow(work, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "bits long"]))


def star_cluster(
    boxes: DataFrame, threshold: float, keys: Sequence[str] = ("img",), order: Sequence[Column] | None = None, carry: Sequence[str] = (), of_all: dict[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """Seeded clusters: in order (box_idx unless `order` is given), the first free box seeds a cluster and takes every
    later free box that overlaps it by at least the threshold. Clusters are stars around their seed, not components.

    Returns keys, box_idx, seed_idx, the columns `carry`, and those of `of_all`, each worked out from the array of all boxes
    with the same keys.
    """
    ranks = [o.alias(f"o{k}") for k, o in enumerate(order or [])]
    item = F.struct(*ranks, "box_idx", *[c.alias(n) for c, n in zip(_corners(), CORNERS, strict=True)], *carry)
    lists = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("boxes"))
    kind = lists.schema["boxes"].dataType.elementType.simpleString()
    idx = boxes.schema["box_idx"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("seeds"), F.array().cast(f"array<struct<box:{kind},seed_idx:{idx}>>").alias("out"))

    def place(acc: Column, b: Column) -> Column:
        # Seeds are in order, so the first that overlaps is the one that would have taken this box.
        seed = F.get(F.filter(acc["seeds"], lambda s: iou_corners(tuple(s[c] for c in CORNERS), tuple(b[c] for c in CORNERS)) >= threshold), F.lit(0))
        seeds = F.when(seed.isNull(), F.concat(acc["seeds"], F.array(b))).otherwise(acc["seeds"])
        row = F.struct(b.alias("box"), F.coalesce(seed["box_idx"], b["box_idx"]).alias("seed_idx"))
        return F.struct(seeds.alias("seeds"), F.concat(acc["out"], F.array(row)).alias("out"))

    whole = {name: f(F.col("boxes")).alias(name) for name, f in (of_all or {}).items()}
    rows = lists.select(*keys, *whole.values(), F.explode(F.aggregate("boxes", start, place)["out"]).alias("m"))
    return rows.select(*keys, "m.box.box_idx", "m.seed_idx", *[F.col(f"m.box.{c}").alias(c) for c in carry], *whole)


def nms(boxes: DataFrame, threshold: float, keys: Sequence[str] = ("img",), most: int | None = 100) -> DataFrame:
    """Non-maximum suppression: the seeds of clusters in order of falling confidence, at most `most` of an image."""
    from pyspark.sql import Window as W

    seeds = star_cluster(boxes, threshold, keys, order=[-F.col("conf")], carry=("conf",)).filter("box_idx = seed_idx")
    if most is not None:
        nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("conf"), "box_idx"))
        seeds = seeds.withColumn("nth", nth).filter(F.col("nth") <= most)
    return seeds.select(*keys, "box_idx", "conf")


def weighted_boxes_fusion(boxes: DataFrame, threshold: float = 0.55, skip: float = 0.001, keys: Sequence[str] = ("img", "cls")) -> DataFrame:
    """Weighted boxes fusion (Solovyev, Wang and Gabruseva, arXiv:1910.13302), all sources with equal weight.

    Boxes under `skip` are left out. In order of falling confidence, a box joins the first of the clusters whose running
    mean box it overlaps most, if by more than the threshold, else it starts one. A cluster's box is the mean of its
    corners weighted by confidence; its confidence is the mean, scaled by least(members, sources) / sources.
    Returns keys, cx, cy, w, h, conf, members. `boxes` has src besides the box columns; sources are counted per group of
    keys' image, so give `src` values of all present sources.
    """
    sources = boxes.select("src").distinct().count() or 1  # the number of detectors: a handful
    item = F.struct((-F.col("conf")).alias("o"), "box_idx", "conf", *[c.alias(n) for c, n in zip(_corners(), ("x1", "y1", "x2", "y2"), strict=True)])
    lists = boxes.filter(F.col("conf") >= skip).groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("boxes"))
    cluster = "struct<n:int,c:double,x1:double,y1:double,x2:double,y2:double>"  # sums weighted by confidence
    start = F.array().cast(f"array<{cluster}>")
    xy = ("x1", "y1", "x2", "y2")

    def overlap(s: Column, b: Column) -> Column:
        return iou_corners(tuple(s[k] / s["c"] for k in xy), tuple(b[k] for k in xy))

    def add(acc: Column, b: Column) -> Column:
        scored = F.transform(acc, lambda s, k: F.struct(overlap(s, b).alias("v"), (-k).alias("k")))
        best = F.array_max(scored)
        at = F.when(best["v"] > threshold, -best["k"])
        c = b["conf"].cast("double")
        alone = F.struct(F.lit(1).alias("n"), c.alias("c"), *[(b[k] * c).alias(k) for k in xy])
        grown = F.transform(
            acc, lambda s, k: F.when(k == at, F.struct((s["n"] + 1).alias("n"), (s["c"] + c).alias("c"), *[(s[x] + b[x] * c).alias(x) for x in xy])).otherwise(s)
        )
        return F.when(at.isNull(), F.concat(acc, F.array(alone))).otherwise(grown)

    rows = lists.select(*keys, F.explode(F.aggregate("boxes", start, add)).alias("s"))
    mean = {k: F.col(f"s.{k}") / F.col("s.c") for k in xy}
    conf = F.col("s.c") / F.col("s.n") * F.least(F.col("s.n"), F.lit(sources)) / sources
    return rows.select(
        *keys, ((mean["x1"] + mean["x2"]) / 2).alias("cx"), ((mean["y1"] + mean["y2"]) / 2).alias("cy"), (mean["x2"] - mean["x1"]).alias("w"), (mean["y2"] - mean["y1"]).alias("h"), conf.alias("conf"), F.col("s.n").alias("members")
    )


def _corners() -> tuple[Column, ...]:
    return corners(box_columns())
