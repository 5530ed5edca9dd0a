"""Detection metrics over matched predictions: counts, precision and recall, average precision, agreement, bootstrap."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from granary.operators.matching import any_met, chosen, iou_pairs, meetings, ordered
from granary.storage import stored


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1, not rounded; zero denominators give 0."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def evaluate(matches: DataFrame, gt: DataFrame, faithful_empty: bool = False) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per threshold. `matches` is greedy_match's result. faithful_empty: with no true
    boxes at all, false positives are reported as 0."""
    total = gt.agg(F.count("*").alias("n_gt"))
    counts = matches.groupBy("threshold").agg(F.count("gt_idx").alias("tp"), F.count_if(F.col("gt_idx").isNull()).alias("fp"))
    rows = counts.crossJoin(F.broadcast(total))  # one row
    if faithful_empty:
        rows = rows.withColumn("fp", F.when(F.col("n_gt") > 0, F.col("fp")).otherwise(F.lit(0)))
    rows = rows.withColumn("fn", F.col("n_gt") - F.col("tp"))
    return rows.select("threshold", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def evaluate_or_zero(matches: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`evaluate`, with a row where there are no matches: without predictions or without true boxes all is 0 but fn, the
    number of true boxes; false positives are not counted then."""
    total = gt.agg(F.count("*").alias("n_gt"))
    counts = matches.filter(F.col("threshold") == threshold).agg(F.count("gt_idx").alias("tp"), F.count_if(F.col("gt_idx").isNull()).alias("fp"))
    rows = counts.crossJoin(F.broadcast(total))  # one row each
    fp = F.when(F.col("n_gt") > 0, F.col("fp")).otherwise(F.lit(0))
    rows = rows.select(F.lit(float(threshold)).alias("threshold"), "tp", fp.alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))
    return rows.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def collapsed(boxes: DataFrame, negative: Sequence[int] = ()) -> DataFrame:
    """Boxes of one class, 0; those of negative classes are left out before."""
    rows = boxes.filter(~F.col("cls").isin(*negative)) if negative else boxes
    return rows.withColumn("cls", F.lit(0))


def confident(boxes: DataFrame, least: float) -> DataFrame:
    return boxes.filter(F.col("conf") >= least)


def class_counts(boxes: DataFrame, names: DataFrame) -> DataFrame:
    """Per class of `names` (cls, name): boxes and images, 0 where there are none. Boxes of other classes are left out."""
    per = boxes.groupBy("cls").agg(F.count("*").alias("boxes"), F.count_distinct("img").alias("images"))
    return names.join(per, "cls", "left").select("cls", "name", F.coalesce("boxes", F.lit(0)).alias("boxes"), F.coalesce("images", F.lit(0)).alias("images"))


def evaluate_by_class(matches: DataFrame, gt: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Overall (cls null) and per true class: n_gt, tp, fn, recall. A hit counts for the class of the box that was found,
    whatever class was predicted."""
    found = matches.filter(F.col("gt_idx").isNotNull()).select(*keys, "gt_idx", F.lit(1).alias("hit"))
    rows = gt.select(*keys, "gt_idx", "cls").join(found, [*keys, "gt_idx"], "left")
    out = rows.groupingSets([[], [F.col("cls")]], "cls").agg(F.count("*").alias("n_gt"), F.count("hit").alias("tp"))
    return out.select("cls", "n_gt", "tp", (F.col("n_gt") - F.col("tp")).alias("fn"), ratio(F.col("tp"), F.col("n_gt")).alias("recall"))


def pr_curve(matches: DataFrame, n_gt: DataFrame, keys: Sequence[str] = (), ordinal: Sequence[str] = ("img", "pred_idx"), written: bool = False) -> DataFrame:
    """Running precision and recall along the ranking by confidence, ties by `ordinal`.

    The ranking is global. It is cut into runs of one confidence (with `keys`), whose sums are cumulated over the few
    distinct confidences; inside a run rows are numbered by themselves. So no window sees all rows: the largest
    partition is the largest set of predictions that tie. Matches are written once for both (written: they are already).
    """
    matches = matches if written else stored(matches)
    runs = matches.groupBy(*keys, "conf").agg(F.count("*").alias("rows"), F.count("gt_idx").alias("hits"))
    before = W.partitionBy(*keys).orderBy(F.desc("conf")).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*keys, "conf", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits_before"))
    within = W.partitionBy(*keys, "conf").orderBy(*ordinal)
    hit = F.when(F.col("gt_idx").isNotNull(), 1).otherwise(0)
    rows = matches.withColumn("hit", hit).withColumn("n", F.row_number().over(within)).withColumn("t", F.sum("hit").over(within.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(runs, [*keys, "conf"])
    rank, tp = F.col("rows_before") + F.col("n"), F.col("hits_before") + F.col("t")
    rows = rows.select(*keys, "conf", "hit", rank.alias("rank"), tp.alias("tp"), (tp / rank).alias("precision"))
    return (rows.join(n_gt, list(keys)) if keys else rows.crossJoin(F.broadcast(n_gt))).withColumn("recall", ratio(F.col("tp"), F.col("n_gt")))


def ap_all_points(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the precision envelope. Recall moves on hits alone, so only hits are kept: one row each, by tp; the
    envelope at a hit is the largest precision from there on."""
    hits = curve.filter("hit = 1")
    # The largest precision from each hit on, in blocks of hits so that no window holds all of them.
    size = 4096
    hits = hits.withColumn("blk", F.floor((F.col("tp") - 1) / size))
    tops = hits.groupBy(*keys, "blk").agg(F.max("precision").alias("top"))
    after = W.partitionBy(*keys).orderBy("blk").rowsBetween(1, W.unboundedFollowing)
    tops = tops.select(*keys, "blk", F.max("top").over(after).alias("later"))
    inside = W.partitionBy(*keys, "blk").orderBy("tp").rowsBetween(0, W.unboundedFollowing)
    hits = hits.withColumn("own", F.max("precision").over(inside)).join(tops, [*keys, "blk"])
    env = F.greatest("own", "later")
    return hits.groupBy(*keys).agg((F.sum(env) / F.max("n_gt")).alias("ap"))


def ap_points(curve: DataFrame, points: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over `points` evenly spaced recalls of the largest precision at that recall or more, 0 where there is none.
    11 and 101 are the usual numbers."""
    last = points - 1
    # The recalls that a row counts for: all up to its own; a row is kept for the highest, then carried down.
    reach = F.floor(F.col("recall") * last + 1e-9).cast("int")
    return _area_of_tops(curve.groupBy(*keys, reach.alias("k")).agg(F.max("precision").alias("top")), points, keys)


def _area_of_tops(tops: DataFrame, points: int, keys: Sequence[str]) -> DataFrame:
    """Mean over `points` recalls of the largest precision there or later, from keys, k and top."""
    below = W.partitionBy(*keys).orderBy("k").rowsBetween(0, W.unboundedFollowing)
    prior = F.lag("k", 1, -1).over(W.partitionBy(*keys).orderBy("k"))
    env = tops.withColumn("best", F.max("top").over(below)).withColumn("steps", F.col("k") - prior)
    return env.groupBy(*keys).agg((F.sum(F.col("best") * F.col("steps")) / points).alias("ap"))


def mean_ap(ap: DataFrame, n_gt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over the groups that have true boxes; groups without predictions count 0."""
    rows = n_gt.filter("n_gt > 0").join(ap, list(keys), "left")
    return rows.agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("map"))


def map_over_thresholds(ap: DataFrame) -> DataFrame:
    """Mean of the APs of all thresholds, each rounded to 4 decimals before, as published tables do."""
    return ap.agg(F.avg(F.round("ap", 4)).alias("map"))


def ap_of_marks(marks: DataFrame, n_gt: DataFrame, thresholds: Sequence[float], ordinal: Sequence[str] = ("img", "idx")) -> DataFrame:
    """`ap_all_points` at several thresholds at once (threshold, ap), of predictions with bits, whose bit k tells a hit at
    threshold k, ranked by confidence, ties by `ordinal`. n_gt: one row. A threshold without hits has no row.

    A prediction is one row throughout, and past the ranking only hits are kept. The ranking is cut into sorted ranges; a hit is
    written with its place in the range, and the driver gets, of each range, its rows, and its hits and largest precision for
    each threshold. A range is then read backwards, from the largest precision of those after it."""
    order = (F.col("conf").desc_nulls_last(), *map(F.col, ordinal))
    kept = ["part", "place", "bits"]

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hits with their place from 1, and after them a row without bits, whose place is the number of rows."""
        seen, part = 0, None
        for batch in batches:
            if batch.num_rows:
                part, bits = batch.column("part")[0].as_py(), batch.column("bits").to_numpy()
                at = np.flatnonzero(bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(seen + at + 1), pa.array(bits[at])], names=kept)
                seen += len(bits)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([0], pa.int64())], names=kept)

    # Written before they are ranked: bounds of ranges come from a sample, and matching should not be done for it again.
    marks = stored(marks.select("conf", *ordinal, "bits"))
    ranked = marks.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "bits")
    hits = stored(ranked.mapInArrow(hits_of, "part int, place long, bits long"))
    bit = lambda k: F.shiftright("bits", k).bitwiseAND(F.lit(1))
    sums = hits.groupBy("part").agg(F.max("place").alias("rows"), F.array(*[F.sum(bit(k)) for k in range(len(thresholds))]).alias("hits"))
    bounds, rows, tp = {}, 0, np.zeros(len(thresholds), np.int64)  # rows before a range, hits up to its end
    for r in sums.orderBy("part").collect():
        tp = tp + np.array(r["hits"], np.int64)
        bounds[r["part"]] = rows, tp
        rows += r["rows"]

    def precisions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Part, threshold's number, and precision at its hits from the last one back, batch by batch."""
        part, rows, tp = None, 0, np.zeros(len(thresholds), np.int64)
        for batch in batches:
            parts, place, bits = (batch.column(c).to_numpy() for c in kept)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if parts[low] != part:
                    part = int(parts[low])
                    rows, tp = bounds[part][0], bounds[part][1].copy()
                for k in range(len(thresholds)):
                    at = place[low:high][(bits[low:high] >> k) & 1 == 1]
                    if len(at):
                        yield part, k, (tp[k] - np.arange(len(at))) / (rows + at)
                        tp[k] -= len(at)

    backwards = hits.filter("bits <> 0").repartition("part").sortWithinPartitions("part", F.desc("place"))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[tuple[int, int], float] = {}
        for part, k, p in precisions(batches):
            top[part, k] = max(top.get((part, k), 0.0), float(p.max()))
        yield pa.RecordBatch.from_pylist([{"part": part, "k": k, "top": v} for (part, k), v in top.items()], pa.schema([("part", pa.int32()), ("k", pa.int32()), ("top", pa.float64())]))

    later, top = {}, np.zeros(len(thresholds))
    found = {(r["part"], r["k"]): r["top"] for r in backwards.mapInArrow(largest, "part int, k int, top double").collect()}
    for part in sorted(bounds, reverse=True):
        later[part] = top
        top = np.maximum(top, [found.get((part, k), 0.0) for k in range(len(thresholds))])

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, best, at = np.zeros(len(thresholds)), np.zeros(len(thresholds)), None
        for part, k, p in precisions(batches):
            if part != at:
                best, at = later[part].copy(), part
            env = np.maximum(np.maximum.accumulate(p), best[k])
            sums[k], best[k] = sums[k] + env.sum(), env[-1]
        k = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(thresholds, float)[k]), pa.array(sums[k])], names=["threshold", "area"])

    area = backwards.mapInArrow(areas, "threshold double, area double").groupBy("threshold").agg(F.sum("area").alias("area"))
    return area.crossJoin(F.broadcast(n_gt)).select("threshold", ratio(F.col("area"), F.col("n_gt")).alias("ap"))


def complementarity_of_bits(found: DataFrame) -> DataFrame:
    """`complementarity` of true boxes with cls and bits, whose bits 0 and 1 tell that a and b found them."""
    a, b = (F.col("bits").bitwiseAND(F.lit(1 << k)) != 0 for k in (0, 1))
    return _agreement(found.select("cls", a.alias("in_a"), b.alias("in_b")))


def complementarity(found_a: DataFrame, found_b: DataFrame, gt: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Overall (cls null) and per class: true boxes found by both, by one alone, by none, and the share that b rescues."""
    # Per group of keys as arrays, which stay where the keys have put them; a join by single boxes would send all of them again.
    lists = gt.groupBy(*keys).agg(F.collect_list(F.struct("gt_idx", "cls")).alias("g"))
    for found, name in ((found_a, "in_a"), (found_b, "in_b")):
        lists = lists.join(found.groupBy(*keys).agg(F.collect_set("gt_idx").alias(name)), list(keys), "left")
    rows = lists.select("in_a", "in_b", F.explode("g").alias("g")).select("g.cls", *[F.coalesce(F.array_contains(c, F.col("g.gt_idx")), F.lit(False)).alias(c) for c in ("in_a", "in_b")])
    return _agreement(rows)


def _agreement(rows: DataFrame) -> DataFrame:
    a, b = F.col("in_a"), F.col("in_b")
    out = rows.groupingSets([[], [F.col("cls")]], "cls").agg(
        F.count("*").alias("total"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither")
    )
    return out.withColumn("rescue_rate", ratio(F.col("b_only"), F.col("total")))


def best_threshold(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The row with the largest f1 of each group; the smaller threshold of equal ones."""
    order = F.struct("f1", (-F.col("threshold")).alias("t"))
    return rows.groupBy(*by).agg(F.max_by("threshold", order).alias("threshold"), F.max("f1").alias("f1"))


def box_quality(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes per image (mean, most), images without boxes, area of boxes (mean, median)."""
    per = images.select("img").join(boxes.groupBy("img").agg(F.count("*").alias("n")), "img", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    a = per.agg(F.avg("n").alias("mean_boxes"), F.max("n").alias("max_boxes"), F.count_if(F.col("n") == 0).alias("empty_images"))
    area = F.col("w") * F.col("h")
    return a.crossJoin(boxes.agg(F.avg(area).alias("mean_area"), F.median(area).alias("median_area")))


def first_hits(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("img",)) -> DataFrame:
    """True boxes (keys, gt_idx) that are some prediction's first one, by gt_idx, with an overlap of at least the threshold.
    Nothing is exclusive: several predictions may have one box. For `complementarity` across data sets."""
    pairs = iou_pairs(pred, gt, threshold, keys)
    return pairs.groupBy(*keys, "pred_idx").agg(F.min("gt_idx").alias("gt_idx")).select(*keys, "gt_idx").distinct()


#: Numbers of a round whose md5 is worked out at once: they share all digits but the last four.
BLOCK = 10_000

_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_TAILS = np.array([f"{k:04d}".encode() for k in range(BLOCK)]).view(np.uint8).reshape(BLOCK, 4).astype(np.uint32)


def md5_block(head: str) -> np.ndarray:
    """The md5 of head + 0000 to head + 9999, as two big-endian 64-bit numbers each; head has at most 51 characters. Words
    that all share stay single numbers; only those with the last digits are columns."""
    text = head.encode()
    whole = text + b"0000\x80" + bytes(51 - len(text)) + (8 * (len(text) + 4)).to_bytes(8, "little")
    words: list = list(np.frombuffer(whole, "<u4"))
    for k in range(4):
        at, shift = divmod(len(text) + k, 4)
        words[at] = words[at] + ((_TAILS[:, k] - np.uint32(48)) << np.uint32(8 * shift))
    a, b, c, d = start = [np.full(BLOCK, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    f, low = np.empty(BLOCK, np.uint32), np.empty(BLOCK, np.uint32)
    for k in range(64):
        turn, own = k // 16, (k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[own]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            f += np.uint32(_SINES[k])
        else:
            f += np.uint32((int(word) + _SINES[k]) & 0xFFFFFFFF)
        by = int(_SHIFTS[turn, k % 4])
        np.right_shift(f, np.uint32(32 - by), out=low), np.left_shift(f, np.uint32(by), out=f)
        f |= low
        new = f + b
        a, b, c, d = d, new, b, c
    out = np.stack([x + y for x, y in zip((a, b, c, d), start, strict=True)], axis=1).astype("<u4")
    return out.view(np.uint8).view(">u8").astype(np.uint64)


def md5_draws(seed: int, number: int, n: int) -> Iterator[np.ndarray]:
    """The first n draws of a round, of 52 bits each, two from every md5(seed|round|k), some at once."""
    head, halves = f"{seed}|{number}|", (n + 1) // 2
    for at in range(0, halves, BLOCK):
        if at and len(head) + len(str(at)) <= 55:
            digits = md5_block(f"{head}{at // BLOCK}").ravel()
        else:
            text = "".join(hashlib.md5(f"{head}{k}".encode()).hexdigest() for k in range(at, min(halves, at + BLOCK)))
            digits = np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)
        yield digits[: n - 2 * at] >> np.uint64(12)


def bootstrap(per_image: DataFrame, rounds: int = 1000, seed: int = 1, faithful: bool = False, exact: bool = True) -> DataFrame:
    """Mean, population deviation and the 2.5 and 97.5 percentiles of F1 over resampled images: as many draws with
    replacement in each round as there are images.

    per_image: img, tp, fp, fn. Images with the same three numbers are one kind, and a sample is told by how many images of
    each kind it has, so neither images nor copies travel: rounds are dealt to tasks, each with the kinds and their sizes.
    There are as many kinds as the boxes of one image allow, however many images.

    exact: draws are read off md5(seed|round|number), two of 52 bits from each, so SQL can repeat them; the work grows with
    images times rounds. Else the kinds' numbers are split off one after the other, each a binomial share of the draws that are
    left: the same law, work that grows with kinds times rounds. faithful: repeats of an image count once, which needs
    exact, and a bit for each image in a task. No images, or none with boxes: F1 is 0.
    """
    spark = per_image.sparkSession
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    kinds = per_image.select(*sums).groupBy("tp", "fp", "fn").agg(F.count("*").alias("n")).orderBy("tp", "fp", "fn").toArrow()
    size, values = kinds.column("n").to_numpy(), np.stack([kinds.column(c).to_numpy() for c in ("tp", "fp", "fn")], axis=1)
    if faithful and not exact:
        raise ValueError("images that count once must be drawn one by one")
    n, upto = int(size.sum()), np.cumsum(size)
    # A draw u of 52 bits is image u * n >> 52, so a kind that ends at image e ends at the first u with u * n >= e << 52.
    ends = np.array([-(-(int(e) << 52) // n) for e in upto], np.uint64)
    split = np.zeros(1 << 13, bool)
    split[(ends[:-1] >> np.uint64(39)).astype(np.int64)] = True
    table = np.searchsorted(ends, np.arange(len(split), dtype=np.uint64) << np.uint64(39), side="right")

    def drawn(number: int) -> np.ndarray:
        """How many images of each kind the round has."""
        if not exact or not n:
            return np.random.default_rng([seed, number]).multinomial(n, size / n) if n else size
        held, seen = np.zeros(len(size), np.int64), np.zeros(n if faithful else 0, bool)
        heads = np.zeros(len(split), np.int64)
        for parts in md5_draws(seed, number, n):
            if not faithful:
                # Most draws are told by their first bits; only those in a part that a kind ends in are looked up.
                first = (parts >> np.uint64(39)).astype(np.int64)
                heads += np.bincount(first, minlength=len(split))
                held += np.bincount(np.searchsorted(ends, parts[split[first]], side="right"), minlength=len(size))
                continue
            # Of 52 bits times n, what is above 52 bits; in two halves, as the product may pass 64.
            high, low = (parts >> np.uint64(26)) * np.uint64(n), (parts & np.uint64(2**26 - 1)) * np.uint64(n)
            seen[((high + (low >> np.uint64(26))) >> np.uint64(26)).astype(np.int64)] = True
        np.add.at(held, table[~split], heads[~split])
        return np.diff(np.concatenate([[0], np.cumsum(seen)[upto - 1]])) if faithful else held

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [drawn(r) @ values for r in batch.column("round").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(f[k]) for f in found], pa.int64()) for k in range(3)], names=["tp", "fp", "fn"])

    tasks = min(rounds, 4 * spark.sparkContext.defaultParallelism)
    f1 = spark.range(1, rounds + 1, 1, tasks).select(F.col("id").alias("round")).mapInArrow(work, "tp long, fp long, fn long").select(prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    q = F.percentile("f1", F.array(F.lit(0.025), F.lit(0.975)))
    return f1.agg(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"), q.alias("q")).select("mean", "std", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def dataset_summary(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Images with true boxes, with predictions, with both; and numbers of boxes."""
    count = lambda df, n, i: df.groupBy("img").agg(F.count("*").alias(n)).withColumn(i, F.lit(1))
    both = count(gt, "g", "has_g").join(count(pred, "p", "has_p"), "img", "full")
    return both.agg(
        F.count("has_g").alias("images_gt"), F.count("has_p").alias("images_pred"), F.count_if(F.col("has_g").isNotNull() & F.col("has_p").isNotNull()).alias("images_both"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("boxes_gt"), F.coalesce(F.sum("p"), F.lit(0)).alias("boxes_pred"),
    )


#: The ten overlaps of the summary, and the numbers of predictions per image and class that recall is taken at.
TEN = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
DEPTHS = (1, 10, 100)


#: Sizes by area in pixels, from and to, both included.
SIZES = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


#: What is marked of a prediction: a bit for each overlap of each size.
BITS = [(t, s) for s in SIZES for t in TEN]


def _summary_marks(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """A row per prediction that counts (the 100 most confident ones of an image and class): cls, conf, img, pred_idx, place,
    and in bits, as BITS has them, hits (it takes a true box of that size) and counted (it is a hit or a false positive).
    Matching is per image and class, for all overlaps and sizes at once, and folded only where boxes meet."""
    met = meetings(pred, gt, TEN[0], ("img", "cls"), carry=("area",), gt_carry=("area",))
    met = met.select("img", "cls", F.slice("preds", 1, max(DEPTHS)).alias("preds"))
    gid = gt.schema["gt_idx"].dataType.simpleString()
    out = lambda a, size: (a < SIZES[size][0]) | (a > SIZES[size][1])
    bits = lambda on: sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in on), F.lit(0)).cast("long")

    def wish(p: Column) -> Column:
        sized = {s: F.transform(ordered(p, True, lambda c, s=s: out(c["g_area"], s)), lambda c: F.struct(c["gt_idx"].alias("gt_idx"), c["iou"].alias("iou"), c["g"].alias("g"))) for s in SIZES}
        return F.struct(*[v.alias(s) for s, v in sized.items()], F.size(p["cands"]).alias("n"))

    # 0: takes nothing, 1: a box of that size, 2: an ignored one.
    code = lambda p, got: F.when(got.isNull(), 0).when(got["g"], 2).otherwise(1)
    wishes = met.select("img", "cls", "preds", F.when(any_met(F.col("preds")), F.transform("preds", wish)).alias("wishes"))
    of_size = lambda s: F.transform("wishes", lambda w: F.struct(w[s].alias("cands")))
    codes = F.array(*[chosen(of_size(s), t, gid, code, "array<int>") for t, s in BITS])
    rows = wishes.select("img", "cls", "preds", F.when(F.col("wishes").isNotNull(), codes).alias("codes"))
    rows = rows.select("img", "cls", "codes", F.posexplode("preds").alias("at", "p")).select("img", "cls", "at", "codes", "p.pred_idx", F.col("p.conf").cast("double").alias("conf"), F.col("p.p_area").alias("area"))
    of = F.transform("codes", lambda c: F.get(c, F.col("at")))
    rows = rows.select("cls", "conf", "img", "pred_idx", (F.col("at") + 1).alias("place"), "area", F.when(F.col("codes").isNotNull(), of).alias("of"))
    own = F.coalesce(bits((k, ~out(F.col("area"), s)) for k, (_, s) in enumerate(BITS)), F.lit(0))
    put = lambda which: F.aggregate(F.sequence(F.lit(0), F.lit(len(BITS) - 1)), F.lit(0).cast("long"), lambda acc, k: F.when(F.get("of", k) == which, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))).otherwise(acc))
    rows = rows.select("cls", "conf", "img", "pred_idx", "place", own.alias("own"), *[F.when(F.col("of").isNotNull(), put(k)).otherwise(0).alias(n) for k, n in ((1, "hits"), (2, "lost"))])
    return rows.select("cls", "conf", "img", "pred_idx", "place", "hits", F.col("own").bitwiseOR(F.col("hits")).bitwiseAND(F.bitwise_not("lost")).alias("counted"))


def _summary_curves(marks: DataFrame, n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of marks, ranked by confidence, ties by img and pred_idx: the largest precision at each hundredth of recall (threshold,
    cls, size, k, top), and hits among the first 1, 10 and 100 (hit1, ...). n: cls, size and n_gt.

    The ranking is cut into ranges, written once, whose sums are found first; each range is then read in order, all overlaps
    and sizes at once. A prediction is one row throughout. The driver gets 40 sums of each class in each range; ranges follow
    the classes, so these are as many as ranges and classes together."""
    order = ("cls", F.desc("conf"), "img", "pred_idx")
    spread = stored(marks.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    name = f"cls {marks.schema['cls'].dataType.simpleString()}"
    shifts, sizes = np.arange(len(BITS)), list(SIZES)
    depths = [f"hit{d}" for d in DEPTHS]

    def table(batch: pa.RecordBatch, column: str) -> np.ndarray:
        return (batch.column(column).to_numpy()[:, None] >> shifts) & 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, counted, place = table(batch, "hits"), table(batch, "counted"), batch.column("place").to_numpy()
            part, cls = batch.column("part").to_numpy(), batch.column("cls")
            codes, kinds = cls.dictionary_encode().indices.to_numpy(), cls.dictionary_encode().dictionary
            for p in np.unique(part):
                for c in np.unique(codes[part == p]):
                    own = (part == p) & (codes == c)
                    sums = [counted[own].sum(0), hits[own].sum(0), *[hits[own & (place <= d)].sum(0) for d in DEPTHS]]
                    rows = [pa.array([int(p)] * len(BITS), pa.int32()), kinds.take(pa.array([int(c)] * len(BITS))), pa.array(shifts, pa.int32()), *[pa.array(v, pa.int64()) for v in sums]]
                    yield pa.RecordBatch.from_arrays(rows, names=["part", "cls", "bit", "counted", "hits", *depths])

    sums = spread.filter("cls is not null").mapInArrow(summed, f"part int, {name}, bit int, counted long, hits long, {', '.join(f'{d} long' for d in depths)}")
    sums = stored(sums.groupBy("part", "cls", "bit").agg(*[F.sum(c).alias(c) for c in ("counted", "hits", *depths)]))
    totals = {(r["cls"], r["size"]): r["n_gt"] for r in n.collect()}
    before, running = {}, {}
    for r in sums.select("part", "cls", "bit", "counted", "hits").orderBy("part").toLocalIterator():
        at = running.setdefault(r["cls"], np.zeros((2, len(BITS)), np.int64))
        before.setdefault((r["part"], r["cls"]), np.zeros((2, len(BITS)), np.int64))[:, r["bit"]] = at[:, r["bit"]]
        at[:, r["bit"]] += (r["counted"], r["hits"])
    of_class = {c: np.array([totals.get((c, s), 0) for _, s in BITS]) for c in {c for c, _ in totals}}

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, tops = {}, {}
        for batch in batches:
            hits, counted, part = table(batch, "hits"), table(batch, "counted"), batch.column("part").to_numpy()
            cls = batch.column("cls").to_pylist()
            if not cls:
                continue
            cuts = [0, *[k for k in range(1, len(cls)) if cls[k] != cls[k - 1] or part[k] != part[k - 1]], len(cls)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                key = (int(part[low]), cls[low])
                if cls[low] not in of_class:
                    continue
                at = state[key] if key in state else before[key]
                rank, tp = at[0] + np.cumsum(counted[low:high], 0), at[1] + np.cumsum(hits[low:high], 0)
                state = {key: np.stack([rank[-1], tp[-1]])}
                total, best = of_class[cls[low]], tops.setdefault(cls[low], np.full((len(BITS), 102), -1.0))
                r, b = np.nonzero(hits[low:high] & (total > 0))
                reach = np.floor(tp[r, b] / total[b] * 100 + 1e-9).astype(np.int64)
                np.maximum.at(best, (b, reach), tp[r, b] / rank[r, b])
        for c, best in tops.items():
            b, k = np.nonzero(best >= 0)
            yield pa.RecordBatch.from_arrays([pa.array([TEN[x % len(TEN)] for x in b], pa.float64()), pa.array([c] * len(b), kind), pa.array([sizes[x // len(TEN)] for x in b], pa.string()), pa.array(k, pa.int32()), pa.array(best[b, k], pa.float64())], names=["threshold", "cls", "size", "k", "top"])

    kind = to_arrow_type(marks.schema["cls"].dataType)
    ordered_rows = spread.filter("cls is not null").repartition("part").sortWithinPartitions("part", *order)
    tops = ordered_rows.mapInArrow(ranked, f"threshold double, {name}, size string, k int, top double")
    tops = tops.groupBy("threshold", "cls", "size", "k").agg(F.max("top").alias("top"))
    bit = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("size")) for t, s in BITS])[F.col("bit")].alias("b")
    found = sums.groupBy("cls", "bit").agg(*[F.sum(d).alias(d) for d in depths]).select("cls", bit, *depths)
    return tops, found.select("b.threshold", "cls", "b.size", *depths)


def coco_summary(pred: DataFrame, gt: DataFrame, side: float = 640.0) -> DataFrame:
    """The class-aware summary over ten overlaps, 12 numbers: ap (mean of 101-point APs over overlaps and classes with true
    boxes), ap50, ap75, ap_small, ap_medium, ap_large, ar1, ar10, ar100 (mean over both of the recall with so many
    predictions per image and class), ar_small, ar_medium, ar_large. At most 100 predictions per image and class count, the
    most confident ones. Sizes are in pixels of images of img_w by img_h (columns on both sides), or of
    `side` by `side`.

    For a size, true boxes of other sizes are ignored: they are taken last and count for nothing, nor do the predictions
    that take them, nor predictions of other sizes that take none. A size without true boxes has -1. Of equal overlaps
    the box listed last is taken.
    """
    if "img_w" not in gt.columns:
        pred, gt = (x.withColumn("img_w", F.lit(side)).withColumn("img_h", F.lit(side)) for x in (pred, gt))
    area = F.col("w") * F.col("img_w") * (F.col("h") * F.col("img_h"))
    pred, gt = pred.withColumn("area", area), gt.withColumn("area", area)
    marks = _summary_marks(pred, gt)
    per = gt.groupBy("cls").agg(*[F.count_if((F.col("area") >= low) & (F.col("area") <= high)).alias(s) for s, (low, high) in SIZES.items()])
    n = per.select("cls", F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.col(s).alias("n_gt")) for s in SIZES])).alias("n")).select("cls", "n.*").filter("n_gt > 0")
    n = stored(n)  # a few rows a class
    keys = ("threshold", "cls", "size")
    tops, found = _summary_curves(marks, n)
    classes = n.withColumn("threshold", F.explode(F.array(*map(F.lit, TEN))))
    ap = _area_of_tops(tops, 101, keys)
    rows = classes.join(ap, list(keys), "left").join(found, list(keys), "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
    mean = lambda what, size, extra=F.lit(True): F.coalesce(F.avg(F.when((F.col("size") == size) & extra, what)), F.lit(-1.0))
    recall = lambda d: F.coalesce(f"hit{d}", F.lit(0)) / F.col("n_gt")
    at = lambda t: F.col("threshold") == t
    return rows.agg(
        mean(F.col("ap"), "all").alias("ap"), mean(F.col("ap"), "all", at(0.5)).alias("ap50"), mean(F.col("ap"), "all", at(0.75)).alias("ap75"), *[mean(F.col("ap"), s).alias(f"ap_{s}") for s in ("small", "medium", "large")],
        *[mean(recall(d), "all").alias(f"ar{d}") for d in DEPTHS], *[mean(recall(100), s).alias(f"ar_{s}") for s in ("small", "medium", "large")],
    )


def model_stats(results: DataFrame) -> DataFrame:
    """Per model, over rows (model, success, num_detections, num_weeds, time_s, json_valid, has_bbox) that succeeded: rows,
    means, and the shares with valid JSON and with a box."""
    flag = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)))
    return results.filter("success").groupBy("model").agg(
        F.count("*").alias("total"), mean("num_detections").alias("avg_detections"), mean("num_weeds").alias("avg_weeds"), mean("time_s").alias("avg_time"), flag("json_valid").alias("json_rate"), flag("has_bbox").alias("bbox_rate"),
    )


def consolidated(checkpoints: DataFrame, column: str = "doc") -> DataFrame:
    """A row per finished experiment of checkpoint documents (JSON text) that has an evaluation: exp_id, model, dataset,
    map50, map50_95, precision, recall, f1, time."""
    schema = "completed map<string,struct<model:string,dataset:string,total_time_s:double,evaluation:map<string,double>>>"
    rows = checkpoints.select(F.explode(F.from_json(column, schema)["completed"]).alias("exp_id", "r")).filter(F.size("r.evaluation") > 0)
    # Names of the measures in the documents.
    names = {"map50": "mAP@0.5", "map50_95": "mAP@0.5:0.95", "precision": "precision@0.5", "recall": "recall@0.5", "f1": "f1@0.5"}
    values = [F.coalesce(F.element_at("r.evaluation", key), F.lit(0.0)).alias(name) for name, key in names.items()]
    return rows.select("exp_id", "r.model", "r.dataset", *values, F.coalesce("r.total_time_s", F.lit(0.0)).alias("time"))


def keep_report(images: DataFrame, keep: Column, by: str = "slug", sample: int = 50, order: str = "path") -> DataFrame:
    """Per slug: kept, dropped, keep_rate, mostly_dropped (under a fifth kept) and the first `sample` dropped paths."""
    rows = images.withColumn("__keep", F.coalesce(keep, F.lit(False)))
    totals = rows.groupBy(by).agg(F.count_if("__keep").alias("kept"), F.count_if(~F.col("__keep")).alias("dropped"))
    first = F.row_number().over(W.partitionBy(by).orderBy(order))
    some = rows.filter(~F.col("__keep")).withColumn("__n", first).filter(F.col("__n") <= sample)
    some = some.groupBy(F.col(by).alias("__by")).agg(F.sort_array(F.collect_list(order)).alias("dropped_sample"))
    out = totals.join(some, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by").withColumn("keep_rate", F.col("kept") / (F.col("kept") + F.col("dropped")))
    return out.withColumn("mostly_dropped", F.col("keep_rate") < 0.2).withColumn("dropped_sample", F.coalesce("dropped_sample", F.array().cast("array<string>")))


def harvest_totals(results: DataFrame, before: Column, after: Column) -> DataFrame:
    """downloaded, new_images, new_labeled of a batch (status, images, labeled), and what it added to the number of boxed
    images."""
    out = results.agg(F.count_if(F.col("status") == "downloaded").alias("downloaded"), F.coalesce(F.sum("images"), F.lit(0)).alias("new_images"), F.coalesce(F.sum("labeled"), F.lit(0)).alias("new_labeled"))
    return out.withColumn("bbox_delta", after - before)


def top_by_precision(rows: DataFrame, most: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """The sources (src) with the best precision, at most `most` of each group; ties to the smaller source."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("precision"), "src"))
    return rows.withColumn("rank", n).filter(F.col("rank") <= most)
