"""Registered queries of readers and writers, scalar functions, reports and state, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions import geometry as G
from granary.functions import text as X
from granary.operators import corpus, experiments, fusion, joins, matching, metrics
from granary.operators import events as E
from granary.plans.queries import FUSE, ORACLE, PG, POINTS, QUERIES, RUNS, STAR, _points, both, query, runs
from granary.plans.views import BOX_SQL, EVENT_SQL, boxes, detector, events, greedy_sql, iou_sql, table, true_boxes
from granary.sources import labels, registry, sinks
from granary.storage import fresh
from granary.streaming import tracking

__all__ = ["ORACLE", "QUERIES"]


# --- metrics over ten overlaps ----------------------------------------------------------------------------------------

TEN_KEYS = {t: f"m{int(round(t * 100))}" for t in metrics.TEN}


def _ten(keys: str) -> str:
    return ", ".join(greedy_sql(n, "p", "g", t, "conf desc, pred_idx", keys) for t, n in TEN_KEYS.items())


def _all_ten(cols: str) -> str:
    return " union all ".join(f"select {t}::double as threshold, {cols} from {n}" for t, n in TEN_KEYS.items())


SIZED = "z as (select * from (values ('all', 0, 1e10), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10)) v(size, lo, hi))"
OUT = "(w * (100 + 50 * (img % 3)) * (h * (100 + 50 * (img % 3))) < lo or w * (100 + 50 * (img % 3)) * (h * (100 + 50 * (img % 3))) > hi)"


@query(
    f"""with recursive {BOX_SQL}, {PG}, {SIZED}, g0 as (select g.*, size, {OUT} as ig from g, z), pl as (select *, row_number() over (partition by img, cls order by conf desc, pred_idx) as place from p), p0 as (select pl.*, size, {OUT} as odd from pl, z where place <= 100),
{', '.join(greedy_sql(n, "p0", "g0", t, "conf desc, pred_idx", "img, cls, size", f"g.ig, {iou_sql('p', 'g')} desc, g.gt_idx desc") for t, n in TEN_KEYS.items())}, m0 as ({_all_ten('img, cls, size, pred_idx, conf, gt_idx')}),
m as (select m0.*, p0.place from m0 join p0 using (img, cls, size, pred_idx) left join g0 on g0.img = m0.img and g0.cls = m0.cls and g0.size = m0.size and g0.gt_idx = m0.gt_idx where not coalesce(g0.ig, false) and not (m0.gt_idx is null and p0.odd)),
n as (select cls, size, count(*) as n_gt from g0 where not ig group by 1, 2),
v as (select m.*, n_gt, row_number() over o as rank, sum((gt_idx is not null)::int) over o as tp from m join n using (cls, size) window o as (partition by threshold, m.cls, m.size order by conf desc, img, pred_idx)),
k as (select threshold, cls, size, floor(tp / n_gt * 100 + 1e-9) as k, max(tp / rank) as top from v group by all),
a as (select threshold, cls, size, sum((select coalesce(max(top), 0) from k where k.threshold = c.threshold and k.cls = c.cls and k.size = c.size and k.k >= j)) / 101 as ap from (select distinct threshold, cls, size from v) c, range(0, 101) j(j) group by all),
h as (select threshold, cls, size, count(*) filter (place <= 1) as h1, count(*) filter (place <= 10) as h10, count(*) as h100 from m where gt_idx is not null group by all),
r as (select t.threshold, n.cls, n.size, n_gt, coalesce(ap, 0) as ap, coalesce(h1, 0) as h1, coalesce(h10, 0) as h10, coalesce(h100, 0) as h100 from n cross join (select distinct threshold from m0) t left join a on a.threshold = t.threshold and a.cls = n.cls and a.size = n.size left join h on h.threshold = t.threshold and h.cls = n.cls and h.size = n.size)
select {', '.join(f"round(coalesce(avg({what}) filter (size = '{size}'{more}), -1), 9) as {name}" for name, what, size, more in (
    ('ap', 'ap', 'all', ''), ('ap50', 'ap', 'all', ' and threshold = 0.5::double'), ('ap75', 'ap', 'all', ' and threshold = 0.75::double'), *((f'ap_{s}', 'ap', s, '') for s in ('small', 'medium', 'large')),
    ('ar1', 'h1 / n_gt', 'all', ''), ('ar10', 'h10 / n_gt', 'all', ''), ('ar100', 'h100 / n_gt', 'all', ''), *((f'ar_{s}', 'h100 / n_gt', s, '') for s in ('small', 'medium', 'large'))))} from r"""
)
def coco_summary(spark, d):
    """Images of 100, 150 and 200 pixels a side, so that boxes of all sizes are there."""
    side = 100 + 50 * (F.col("img") % 3)
    p, g = (x.withColumn("img_w", side).withColumn("img_h", side) for x in both(spark, d))
    out = metrics.coco_summary(p, g)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    f"""with recursive {BOX_SQL}, {PG}, {_ten('img')}, m as ({_all_ten('img, pred_idx, conf, gt_idx')}),
v as (select threshold, gt_idx is not null as hit, row_number() over o as rank, sum((gt_idx is not null)::int) over o as tp from m window o as (partition by threshold order by conf desc, img, pred_idx)),
e as (select *, max(tp / rank) over (partition by threshold order by rank rows between current row and unbounded following) as env from v), a as (select threshold, sum(env) / (select count(*) from g) as ap from e where hit group by 1)
select round(avg(round(ap, 4)), 6) as map from a"""
)
def map_coco(spark, d):
    b = boxes(spark, d)
    marks = matching.matched_bits(b, [(None, t) for t in metrics.TEN], carry=("conf",))
    ap = metrics.ap_of_marks(marks, true_boxes(b).agg(F.count("*").alias("n_gt")), metrics.TEN)
    return metrics.map_over_thresholds(ap).select(F.round("map", 6).alias("map"))


@query(f"with {BOX_SQL}, {PG}, x as (select img, count(*) as n from g group by 1), y as (select img, count(*) as n from p group by 1) select count(x.img) as images_gt, count(y.img) as images_pred, count(*) filter (x.img is not null and y.img is not null) as images_both, sum(x.n)::bigint as boxes_gt, sum(y.n)::bigint as boxes_pred from x full join y on x.img = y.img")
def dataset_summary(spark, d):
    p, g = both(spark, d)
    return metrics.dataset_summary(g, p)


@query("with r as (select s_nationkey as llm, (s_suppkey % 10) / 1e1 as threshold, (s_suppkey * 37 % 101) / 1e2 as f1 from supplier), x as (select *, row_number() over (partition by llm order by f1 desc, threshold) as n from r) select llm, threshold, f1 from x where n = 1")
def best_threshold(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("llm"), ((k % 10) / F.lit(10.0)).alias("threshold"), ((k * 37 % 101) / F.lit(100.0)).alias("f1"))
    return metrics.best_threshold(rows, ("llm",))


def _results(spark, d):
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("model"), (F.col("l_linenumber") < 6).alias("success"), F.when(F.col("l_linenumber") != 2, q).alias("num_detections"), (q % 5).alias("num_weeds"),
        q.cast("double").alias("time_s"), (F.col("l_returnflag") == "A").alias("json_valid"), F.when(F.col("l_linenumber") != 3, F.col("l_linestatus") == "O").alias("has_bbox"),
    )


@query("select l_suppkey % 7 as model, count(*) as total, avg(case when l_linenumber <> 2 then l_quantity::int else 0 end) as avg_detections, avg(l_quantity::int % 5) as avg_weeds, avg(l_quantity::int::double) as avg_time, avg((l_returnflag = 'A')::int) as json_rate, avg((l_linenumber <> 3 and l_linestatus = 'O')::int) as bbox_rate from lineitem where l_linenumber < 6 group by 1")
def model_stats(spark, d):
    return metrics.model_stats(_results(spark, d))


@query("select 'e' || s_suppkey as exp_id, 'm' || s_nationkey as model, 'd' || (s_suppkey % 3) as dataset, (s_suppkey % 100) / 1e2 as map50, 0e0 as map50_95, 0.5::double as precision, 0e0 as recall, (s_suppkey % 7) / 7e0 as f1, case when s_suppkey % 2 = 0 then s_suppkey::double else 0e0 end as time from supplier where s_suppkey % 5 <> 0")
def consolidated(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    ev = F.when(k % 5 != 0, F.create_map(F.lit("mAP@0.5"), (k % 100) / F.lit(100.0), F.lit("precision@0.5"), F.lit(0.5), F.lit("f1@0.5"), (k % 7) / F.lit(7.0)))
    one = F.struct(F.concat(F.lit("m"), "s_nationkey").alias("model"), F.concat(F.lit("d"), k % 3).alias("dataset"), F.when(k % 2 == 0, k.cast("double")).alias("total_time_s"), ev.alias("evaluation"))
    docs = s.select(F.to_json(F.struct(F.create_map(F.concat(F.lit("e"), k), one).alias("completed"))).alias("doc"))
    return metrics.consolidated(docs)


@query("with k as (select source as slug, lpad(doc_id::varchar, 12, '0') as path, coalesce(length(text) > 400, false) as keep from documents), n as (select *, row_number() over (partition by slug, keep order by path) as n from k) select slug, count(*) filter (keep) as kept, count(*) filter (not keep) as dropped, (count(*) filter (keep)) / count(*) as keep_rate, (count(*) filter (keep)) / count(*) < 0.2 as mostly_dropped, coalesce(string_agg(path, ',' order by path) filter (not keep and n <= 50), '') as sample from n group by 1")
def keep_report(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("slug"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.length("text").alias("n"))
    out = metrics.keep_report(rows, F.col("n") > 400)
    return out.select("slug", "kept", "dropped", "keep_rate", "mostly_dropped", F.array_join("dropped_sample", ",").alias("sample"))


@query("select count(*) filter (o_orderstatus = 'F') as downloaded, sum(o_orderkey % 100)::bigint as new_images, sum(case when o_orderkey % 3 = 0 then o_orderkey % 7 end)::bigint as new_labeled, 25 as bbox_delta from orders")
def harvest_totals(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "downloaded").otherwise("failed").alias("status"), (k % 100).alias("images"), F.when(k % 3 == 0, k % 7).alias("labeled"))
    return metrics.harvest_totals(rows, F.lit(17), F.lit(42))


@query(f"with {BOX_SQL}, s as (select (img % 5)::int as dataset, src, count(*) filter (cls < 6) / count(*) as precision from box group by 1, 2), r as (select *, row_number() over (partition by dataset order by precision desc, src) as rank from s) select dataset, src, precision, rank::int as rank from r where rank <= 4")
def top_by_precision(spark, d):
    rows = boxes(spark, d).groupBy((F.col("img") % 5).cast("int").alias("dataset"), "src").agg((F.count_if(F.col("cls") < 6) / F.count("*")).alias("precision"))
    return metrics.top_by_precision(rows, 4, ("dataset",))


# --- fusion and matching variants -------------------------------------------------------------------------------------


@query(
    f"""{FUSE}, s as (select img, 'first' as src, pred_idx as old_idx, cx, cy, w, h, conf from p union all select img, 'second', gt_idx, cx, cy, w, h, conf from g where not exists (select 1 from m where m.img = g.img and m.gt_idx = g.gt_idx)),
sp as (select *, row_number() over (partition by img order by src, old_idx) - 1 as pred_idx from s), sg as (select img, idx as gt_idx, cx, cy, w, h from box where src in (5, 6)), {greedy_sql('z', 'sp', 'sg', 0.2, 'pred_idx')}
select sp.img, src, old_idx as box_idx, sp.conf from sp join z on z.img = sp.img and z.pred_idx = sp.pred_idx where z.gt_idx is not null""".replace("src in (3, 4, 5)", "src in (3, 4)")
)
def fuse_two_stage(spark, d):
    b = boxes(spark, d)
    return fusion.fuse_two_stage(*[detector(b, *s).drop("src") for s in ((0, 1, 2), (3, 4), (5, 6))]).select("img", "src", "box_idx", "conf")


@query(
    f"""with recursive {BOX_SQL}, o as (select *, row_number() over (partition by img order by conf desc, idx) as n from box),
r as (select img, n, [n] as kept, true as seed from o where n = 1
  union all select o.img, o.n, case when hit then kept else list_append(kept, o.n) end, not hit
  from (select r.*, coalesce((select bool_or({iou_sql('z', 'y')} >= 0.5) from o z join o y on y.img = r.img and y.n = r.n + 1 where z.img = r.img and list_contains(r.kept, z.n)), false) as hit from r) r join o on o.img = r.img and o.n = r.n + 1)
select o.img, o.idx as box_idx, o.conf from r join o on o.img = r.img and o.n = r.n where seed"""
)
def nms(spark, d):
    return matching.nms(boxes(spark, d).withColumnRenamed("idx", "box_idx"), 0.5)


def _mean_iou(s: str, b: str) -> str:
    """The overlap of cluster s, whose corners are sums weighted by s.c, with box b, as the Spark side works it out."""
    x1, y1, x2, y2 = (f"({s}.{k} / {s}.c)" for k in ("x1", "y1", "x2", "y2"))
    i = f"(greatest(0e0, least({x2}, {b}.x2) - greatest({x1}, {b}.x1)) * greatest(0e0, least({y2}, {b}.y2) - greatest({y1}, {b}.y1)))"
    union = f"(({x2} - {x1}) * ({y2} - {y1}) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {i})"
    return f"(case when {union} > 0 then {i} / {union} else 0e0 end)"


@query(
    f"""with recursive {BOX_SQL}, o as (select img, cls, row_number() over (partition by img, cls order by conf desc, idx) as n, {{'c': conf, 'x1': cx - w / 2, 'y1': cy - h / 2, 'x2': cx + w / 2, 'y2': cy + h / 2}} as b from box where conf >= 0.001),
r as (select img, cls, n, [{{'n': 1, 'c': b.c, 'x1': b.x1 * b.c, 'y1': b.y1 * b.c, 'x2': b.x2 * b.c, 'y2': b.y2 * b.c}}] as acc from o where n = 1
  union all
  select img, cls, n, case when list_max(v) > 0.55 then list_transform(acc, lambda s, i: case when i = list_position(v, list_max(v)) then {{'n': s.n + 1, 'c': s.c + b.c, 'x1': s.x1 + b.x1 * b.c, 'y1': s.y1 + b.y1 * b.c, 'x2': s.x2 + b.x2 * b.c, 'y2': s.y2 + b.y2 * b.c}} else s end)
    else list_append(acc, {{'n': 1, 'c': b.c, 'x1': b.x1 * b.c, 'y1': b.y1 * b.c, 'x2': b.x2 * b.c, 'y2': b.y2 * b.c}}) end
  from (select o.*, r.acc, list_transform(r.acc, lambda s: {_mean_iou('s', 'o.b')}) as v from r join o on o.img = r.img and o.cls = r.cls and o.n = r.n + 1)),
l as (select img, cls, unnest(arg_max(acc, n)) as s from r group by 1, 2), k as (select count(distinct src) as k from box)
select img, cls, round((s.x1 / s.c + s.x2 / s.c) / 2, 6) as cx, round(s.y2 / s.c - s.y1 / s.c, 6) as h, round(s.c / s.n * least(s.n, k) / k, 6) as conf, s.n as members from l, k"""
)
def weighted_fusion(spark, d):
    out = matching.weighted_boxes_fusion(boxes(spark, d).withColumnRenamed("idx", "box_idx"))
    return out.select("img", "cls", F.round("cx", 6).alias("cx"), F.round("h", 6).alias("h"), F.round("conf", 6).alias("conf"), "members")


@query(f"{STAR}, v as (select r.img, r.seed_idx, count(distinct src) as votes from r join box on box.img = r.img and box.idx = r.idx group by 1, 2) select img, seed_idx, votes, seed_idx as box_idx from v where votes >= 3")
def consensus_fixed(spark, d):
    return fusion.consensus(boxes(spark, d).withColumnRenamed("idx", "box_idx"), min_votes=3, capped=False)


@query(f"with {BOX_SQL}, a as (select * from box where src in (0, 1)), b as (select * from box where src in (2, 3)), x as (select a.*, exists (select 1 from b where a.img = b.img and {iou_sql('a', 'b')} >= 0.3) as ok from a) select img, idx as box_idx from x where ok union all select img, idx from x y where not ok and not exists (select 1 from x z where z.ok and z.img = y.img and {iou_sql('y', 'z')} > 0.5)")
def consensus_or_unique(spark, d):
    b = boxes(spark, d)
    return joins.consensus_or_unique(detector(b, 0, 1), detector(b, 2, 3)).select("img", "box_idx")


@query(f"with {BOX_SQL}, a as (select * from box where src in (0, 1)), b as (select * from box where src in (2, 3)) select img, idx as box_idx from a where cls >= 8 or exists (select 1 from b where a.img = b.img and {iou_sql('a', 'b')} >= 0.5)")
def iou_semi_exempt(spark, d):
    b = boxes(spark, d)
    return joins.overlap_filter(detector(b, 0, 1), detector(b, 2, 3), 0.5, True, strict=False, exempt=F.col("cls") >= 8).select("img", "box_idx")


@query(f"with {BOX_SQL} select img, idx as box_idx, cls from box where src in (0, 1, 2) and cls < 8 union all select img, idx, cls from box where src = 5")
def merge_labels(spark, d):
    b = boxes(spark, d)
    return fusion.merge_labels(detector(b, 0, 1, 2), detector(b, 5)).select("img", "box_idx", "cls")


@query(f"with {BOX_SQL} select img, idx, greatest(0e0, least(1e0, 1 - (cx + w / 2))) as x1, greatest(0e0, least(1e0, 1 - (cx - w / 2))) as x2, 1 - cx as flipped from box")
def flip_boxes(spark, d):
    b = boxes(spark, d)
    out = G.hflip_xyxy(G.corners(G.box_columns()))
    flipped = fusion.flip_fused(b).select("img", "idx", F.col("cx").alias("flipped"))
    return b.select("img", "idx", out[0].alias("x1"), out[2].alias("x2")).join(flipped, ["img", "idx"])


# --- boxes ------------------------------------------------------------------------------------------------------------


@query(f"with {BOX_SQL} select img, idx, 0 < least(cx, cy, w, h) and greatest(cx, cy, w, h) < 1 as open, least(w, h) > 0 and greatest(w, h) < 1 as sides, least(w, h) > 0.01 and greatest(w, h) < 0.98 as narrow, w * h >= 0.01 and w * h <= 0.3 as band, cls = 0 and w * h >= 0.05 as gate from box")
def plausible_boxes(spark, d):
    b, box = boxes(spark, d), G.box_columns()
    area = F.col("w") * F.col("h")
    return b.select("img", "idx", *[G.plausible(box, p).alias(p) for p in ("open", "sides", "narrow")], area.between(0.01, 0.3).alias("band"), ((F.col("cls") == 0) & (area >= 0.05)).alias("gate"))


UNITS = "case idx % 4 when 0 then [cx, cy, w, h] when 1 then [cx * 100, cy * 100, w * 100, h * 100] when 2 then [cx * 1000, cy * 900, w * 800, h * 700] else [cx * 1500, cy * 1100, w * 400, h * 300] end"


def _units(b):
    c = [F.col(x) for x in ("cx", "cy", "w", "h")]
    at = lambda *f: F.array(*[x * k for x, k in zip(c, f, strict=True)])
    n = F.col("idx") % 4
    return F.when(n == 0, F.array(*c)).when(n == 1, at(100, 100, 100, 100)).when(n == 2, at(1000, 900, 800, 700)).otherwise(at(1500, 1100, 400, 300))


@query(f"with {BOX_SQL}, v as (select img, idx, {UNITS} as v, (case when src < 4 then 1920 else 800 end)::double as w, (case when src < 4 then 1080 else 600 end)::double as h from box), s as (select img, idx, case when list_max(v) <= 1 then v when list_max(v) <= 100 then list_transform(v, lambda x: x / 1e2) when list_max(v) <= 1000 and greatest(w, h) > 1000 then list_transform(v, lambda x: x / 1e3) else [v[1] / w, v[2] / h, v[3] / w, v[4] / h] end as s from v) select img, idx, greatest(0e0, least(1e0, s[1])) as a, greatest(0e0, least(1e0, s[4])) as d from s")
def coord_detect_sized(spark, d):
    b = boxes(spark, d)
    out = G.detect_with_size(_units(b), F.when(F.col("src") < 4, 1920.0).otherwise(800.0), F.when(F.col("src") < 4, 1080.0).otherwise(600.0))
    return b.select("img", "idx", out[0].alias("a"), out[3].alias("d"))


@query(f"with {BOX_SQL}, v as (select img, idx, {UNITS} as v from box) select img, idx, case when v[1] > 1 then v[1] / 1e2 else v[1] end as a, case when v[4] > 1 then v[4] / 1e2 else v[4] end as d from v")
def coord_detect_each(spark, d):
    b = boxes(spark, d)
    out = G.detect_each(_units(b))
    return b.select("img", "idx", out[0].alias("a"), out[3].alias("d"))


@query(f"with {BOX_SQL}, v as (select img, idx, cx * 640 as a, cy * 480 as b, w * 640 as c, h * 480 as d from box), t as (select *, a + c > 640 or b + d > 480 as two from v), s as (select img, idx, a, b, case when two then c - a else c end as w, case when two then d - b else d end as h from t) select img, idx, (a + w / 2) / 640e0 as cx, (b + h / 2) / 480e0 as cy, w / 640e0 as w, h / 480e0 as h from s")
def xywh_or_xyxy(spark, d):
    b = boxes(spark, d)
    v = F.array(F.col("cx") * 640, F.col("cy") * 480, F.col("w") * 640, F.col("h") * 480)
    out = G.xywh_or_xyxy(v, F.lit(640.0), F.lit(480.0))
    return b.select("img", "idx", *[out[k].alias(n) for k, n in enumerate(("cx", "cy", "w", "h"))])


# --- scalar functions -------------------------------------------------------------------------------------------------

LABELS = "case event_id % 6 when 0 then ' Class 3: Cotton ' when 1 then 'class 12:' || event_type when 2 then 'CROP_row' when 3 then upper(event_type) when 5 then 'Field_crop' end"


def _labels():
    n = F.col("event_id") % 6
    return F.when(n == 0, " Class 3: Cotton ").when(n == 1, F.concat(F.lit("class 12:"), "event_type")).when(n == 2, "CROP_row").when(n == 3, F.upper("event_type")).when(n == 5, "Field_crop")


@query(f"with l as (select event_id, {LABELS} as l from events), k as (select event_id, trim(regexp_replace(lower(trim(l)), '^class\\s*\\d+\\s*:\\s*', '')) as k from l) select event_id, coalesce(k, 'unknown') as name, case when k in ('crop', 'cotton') or contains(k, 'crop') then 1 else 0 end as cls from k")
def norm_class(spark, d):
    return table(spark, d, "events").select("event_id", X.class_name(_labels()).alias("name"), X.class_binary(_labels()).alias("cls"))


NAMES, ALIASES = ("Click", "View", "Purchase order"), {"bought": "Purchase order", "row view": "View"}


@query("with l as (select event_id, case event_id % 6 when 0 then 'View ' when 1 then 'BOUGHT' when 2 then 'row_view' when 3 then event_type when 4 then 'purchase' else 'nothing of it' end as l from events), k as (select event_id, trim(l) as s, replace(lower(trim(l)), '_', ' ') as k from l) select event_id, (case when s = 'Click' then 0 when s = 'View' then 1 when s = 'Purchase order' then 2 when k = 'bought' then 2 when k = 'row view' then 1 when contains(k, 'click') or contains('click', k) then 0 when contains(k, 'view') or contains('view', k) then 1 when contains(k, 'purchase order') or contains('purchase order', k) then 2 else 0 end)::int as cls from k")
def label_alias(spark, d):
    n = F.col("event_id") % 6
    said = F.when(n == 0, "View ").when(n == 1, "BOUGHT").when(n == 2, "row_view").when(n == 3, F.col("event_type")).when(n == 4, "purchase").otherwise("nothing of it")
    return table(spark, d, "events").select("event_id", X.class_index(said, NAMES, ALIASES).alias("cls"))


@query("with s as (select doc_id, case doc_id % 4 when 0 then 'gh_' when 1 then 'kg_' when 2 then 'rf_' else '' end || coalesce(source, '') as slug, lower(coalesce(text, '')) as t from documents), x as (select doc_id, slug, list_filter([case when contains(t, 'the') then 'english' end, case when contains(t, 'une') or contains(t, 'les') then 'french' end], lambda x: x is not null) as f from s) select doc_id, case left(slug, 3) when 'gh_' then 'github' when 'kg_' then 'kaggle' when 'rf_' then 'roboflow' else 'huggingface' end as origin, case when len(f) > 0 then array_to_string(f, ',') else 'Unclassified' end as tags from x")
def slug_classify(spark, d):
    n = F.col("doc_id") % 4
    slug = F.concat(F.when(n == 0, "gh_").when(n == 1, "kg_").when(n == 2, "rf_").otherwise(""), F.coalesce("source", F.lit("")))
    tags = X.tags(F.coalesce("text", F.lit("")), {"english": ("the",), "french": ("une", "les")})
    return table(spark, d, "documents").select("doc_id", X.slug_source(slug).alias("origin"), F.array_join(tags, ",").alias("tags"))


@query("select page_id, case when page_id % 5 = 0 then 'task' when page_id % 5 in (1, 2) then 'tag' when page_id % 5 = 3 then 'file' end as hint from pages")
def metadata_hint(spark, d):
    n = F.col("page_id") % 5
    task = F.when(n == 0, "Object-Detection").otherwise("classification")
    tags = F.when(n == 1, F.array(F.lit("YOLO"))).when(n == 2, F.array(F.lit("Bounding-Box"), F.lit("x"))).otherwise(F.array(F.lit("images")))
    files = F.when(n == 3, F.array(F.lit("a/labels/x.txt"))).otherwise(F.array(F.col("url")))
    return table(spark, d, "pages").filter("url is not null").select("page_id", corpus.box_hint(task, tags, files).alias("hint"))


@query("select event_id, case try_cast(regexp_extract(v, '(\\d)', 1) as int) when 1 then 'scan' when 2 then 'aim' when 3 then 'fire' end as action, left(v, 4) as short, sha1(event_type || '/' || event_id) as key, regexp_full_match(v, '[A-Za-z0-9_.-]+') as safe, regexp_full_match(v, '[A-Za-z0-9_. -]+\\.(jpg|png|JPG|PNG)') as file, replace(replace(v, ':', '_'), '/', '_') || '__' || event_type as exp from (select *, case event_id % 4 when 0 then 'do ' || (event_id % 9) when 1 then 'none' when 2 then 'a b.jpg' else 'x:y/z' end as v from events)")
def text_rules(spark, d):
    n = F.col("event_id") % 4
    v = F.when(n == 0, F.concat(F.lit("do "), F.col("event_id") % 9)).when(n == 1, "none").when(n == 2, "a b.jpg").otherwise("x:y/z")
    return table(spark, d, "events").select(
        "event_id", X.first_digit(v, ("scan", "aim", "fire")).alias("action"), X.truncated(v, 4).alias("short"), X.cache_key(F.col("event_type"), F.col("event_id").cast("string")).alias("key"),
        X.safe_name(v).alias("safe"), X.safe_name(v, ("jpg", "png")).alias("file"), X.experiment_id(v, F.col("event_type")).alias("exp"),
    )


@query("select event_id, coalesce(json_extract_string(doc, '$.a.b'), '-1') as deep, json_extract_string(doc, '$.a.none') as missing from (select event_id, case when event_id % 3 = 0 then '{\"a\": {\"c\": 1}}' else '{\"a\": {\"b\": ' || event_id || '}}' end as doc from events)")
def dotted_path(spark, d):
    doc = F.when(F.col("event_id") % 3 == 0, '{"a": {"c": 1}}').otherwise(F.concat(F.lit('{"a": {"b": '), "event_id", F.lit("}}")))
    return table(spark, d, "events").select("event_id", X.at_path(doc, "a.b", F.lit("-1")).alias("deep"), X.at_path(doc, "a.none").alias("missing"))


@query("select event_id, case when event_id % 3 = 0 then (event_id % 50)::varchar else '60' end as epochs, case when event_id % 3 = 0 then 'brain_proposed' else 'brain_fallback' end as name, '0.3' as consensus_iou from events")
def strategy_json(spark, d):
    n = F.col("event_id") % 3
    full = F.concat(F.lit('Sure: {"vlm_models": ["a"], "min_votes": 2, "lr": 0.1, "replay_ratio": 0.2, "epochs": '), F.col("event_id") % 50, F.lit("} as asked"))
    s = X.strategy(F.when(n == 0, full).when(n == 1, '{"vlm_models": ["a"]}').otherwise("no idea"))
    return table(spark, d, "events").select("event_id", s["epochs"].alias("epochs"), s["name"].alias("name"), s["consensus_iou"].alias("consensus_iou"))


@query("select p_partkey, contains(lower(p_name), 'ar') or contains(lower(p_name), 'brass') or split_part(trim(lower(p_name)), ' ', 1) in ('ar', 'brass') as known from part")
def species_test(spark, d):
    return table(spark, d, "part").select("p_partkey", X.known_species(F.col("p_name"), ("ar", "brass")).alias("known"))


@query("select doc_id, list_sum(list_transform(range(0, 64), lambda k: ((doc_id * (k + 3) // 7) % 2)::hugeint * (1::hugeint << (63 - k)::int)))::decimal(20, 0) as bits from documents")
def dhash_bits(spark, d):
    k = F.col("doc_id")
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda n: F.floor(k * (n + 3) / 7).cast("long") % 2)
    return table(spark, d, "documents").select("doc_id", X.hash_bits(bits).alias("bits"))


@query("select s_suppkey, greatest(0, least(4095, trunc((s_suppkey * 131 % 2400 - 200) / 1920e0 * 4095)::int)) as dac from supplier")
def linear_fallback(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", G.linear_map(F.col("s_suppkey") * 131 % 2400 - 200, 1920.0).alias("dac"))


@query("with k as (select s_suppkey, case s_suppkey % 3 when 0 then 'cross' when 1 then 'zigzag' else 'dot' end as kind, s_suppkey % 4000 as cx, s_suppkey * 7 % 4000 as cy from supplier), p as (select s_suppkey, cx + v as x, cy + 0 as y from k, (select (k * 160 // 7) - 80 as v from range(0, 8) t(k)) where kind = 'cross' union all select s_suppkey, cx, cy + v from k, (select (k * 160 // 7) - 80 as v from range(0, 8) t(k)) where kind = 'cross' union all select s_suppkey, cx + e, cy + least(80, r * 26 - 80) from k, range(0, 7) t(r), (values (-80), (80)) s(e) where kind = 'zigzag' union all select s_suppkey, cx, cy from k where kind = 'dot') select s_suppkey, count(*) as points, sum(x)::bigint as sx, sum(y)::bigint as sy, min(x)::bigint as lx, max(y)::bigint as hy, 1000 as filled from p group by 1")
def pattern_points(spark, d):
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "cross").when(k % 3 == 1, "zigzag").otherwise("dot")
    # A row's pattern is much work, and a small file is one task: rows are dealt first.
    dealt = table(spark, d, "supplier").select("s_suppkey").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    rows = dealt.select("s_suppkey", G.pattern(kind, k % 4000, k * 7 % 4000).alias("p"))
    out = rows.select("s_suppkey", F.size(G.fill_frame(F.col("p"))).alias("filled"), F.explode("p").alias("p")).groupBy("s_suppkey", "filled")
    return out.agg(F.count("*").alias("points"), F.sum("p.x").alias("sx"), F.sum("p.y").alias("sy"), F.min("p.x").alias("lx"), F.max("p.y").alias("hy"))


# --- readers and writers ----------------------------------------------------------------------------------------------

IMAGES = "i as (select 'im' || s_suppkey as img, 640 + s_suppkey % 5 * 10 as width, 480 as height, s_suppkey from supplier union all select 'em' || s_suppkey, 640, 480, s_suppkey from supplier where s_suppkey % 10 = 3), ib as (select 'im' || l_suppkey as img, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 as box_idx, (l_partkey % 12)::int as cls, (l_partkey % 40 + 30) / 1e2 as cx, (l_orderkey % 40 + 30) / 1e2 as cy, 0.2::double + l_quantity / 1e2 as w, 0.3::double + 4 * l_tax as h, 1 - 5 * l_discount as conf from lineitem)"


def _image_boxes(spark, d):
    """Images by supplier, with all its line items as boxes, and for every tenth one more image, without boxes."""
    n = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    b = table(spark, d, "lineitem").select(
        F.concat(F.lit("im"), "l_suppkey").alias("img"), n.cast("long").alias("box_idx"), (F.col("l_partkey") % 12).cast("int").alias("cls"), ((F.col("l_partkey") % 40 + 30) / F.lit(100.0)).alias("cx"),
        ((F.col("l_orderkey") % 40 + 30) / F.lit(100.0)).alias("cy"), (F.lit(0.2) + F.col("l_quantity") / 100.0).alias("w"), (F.lit(0.3) + 4 * F.col("l_tax")).alias("h"), (1 - 5 * F.col("l_discount")).alias("conf"),
    )
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    own = s.select(F.concat(F.lit("im"), k).alias("img"), (640 + k % 5 * 10).alias("width"), F.lit(480).alias("height"))
    return b, own.unionByName(s.filter(k % 10 == 3).select(F.concat(F.lit("em"), k).alias("img"), F.lit(640).cast(own.schema["width"].dataType).alias("width"), F.lit(480).alias("height")))


@query(f"with {IMAGES} select img, box_idx::int as box_idx, cls, round(cx, 4) as cx, round(cy, 4) as cy, round(w, 4) as w, round(h, 4) as h, 0.9::double as conf from ib")
def yolo_round_trip(spark, d):
    """One file per image written, all files read back."""
    b, images = _image_boxes(spark, d)
    path = fresh(spark, "yolo")
    sinks.write_yolo(b, path, images)
    return labels.yolo(spark, path).select("img", "box_idx", "cls", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "w", "h")], "conf")


@query(f"with {IMAGES}, c as (select img, count(*) as n from ib group by 1) select i.img, coalesce(n, 0)::int as lines from i left join c on c.img = i.img")
def label_file_counts(spark, d):
    """Label files and their lines, files of images without boxes included."""
    b, images = _image_boxes(spark, d)
    path = fresh(spark, "yolo")
    sinks.write_yolo(b, path, images)
    return labels.label_files(spark, path).select("img", F.col("lines").cast("int").alias("lines"))


@query(f"with {IMAGES}, n as (select *, row_number() over (order by img) as id from i) select n.id as image_id, ib.cls as category_id, round((cx - w / 2) * width, 4) + 0e0 as x, round((cy - h / 2) * height, 4) + 0e0 as y, round(w * width, 4) as bw, round(h * height, 4) as bh, conf as score from ib join n on n.img = ib.img")
def coco_results(spark, d):
    b, images = _image_boxes(spark, d)
    out = sinks.coco_results(b, images)
    return out.select("image_id", "category_id", *[F.round(F.col("bbox")[k], 4).alias(n) for k, n in enumerate(("x", "y", "bw", "bh"))], "score")


@query(f"with {IMAGES}, n as (select *, row_number() over (order by img) as id from i) select n.img, n.width, (select count(*) from ib where ib.img = n.img) as boxes, (select round(sum(w * width * h * height), 2) from ib where ib.img = n.img) as area from n where exists (select 1 from ib where ib.img = n.img)")
def coco_round_trip(spark, d):
    """A COCO document per image written as JSON and read back."""
    b, images = _image_boxes(spark, d)
    ids, ann = sinks.coco_tables(b, images)
    a = F.struct(F.monotonically_increasing_id().alias("id"), "image_id", "category_id", "bbox", "area", "iscrowd").alias("a")
    docs = ids.join(ann.select("image_id", a).groupBy("image_id").agg(F.collect_list("a").alias("annotations")), F.col("id") == F.col("image_id"))
    docs = docs.select(F.array(F.struct("id", "file_name", F.col("width").cast("int").alias("width"), "height")).alias("images"), "annotations")
    path = fresh(spark, "coco")
    docs.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    schema = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int>>"
    read = spark.read.schema(schema).json(path)
    im, an = read.select(F.inline("images")), read.select(F.inline("annotations"))
    sums = an.groupBy("image_id").agg(F.count("*").alias("boxes"), F.round(F.sum("area"), 2).alias("area"))
    return im.join(sums, F.col("id") == F.col("image_id")).select(F.col("file_name").alias("img"), F.col("width").cast("long").alias("width"), "boxes", "area")


@query(f"with {IMAGES} select img, box_idx::int as box_idx, cls::varchar as label, round((greatest(0e0, cx - w / 2) + least(1e0, cx + w / 2)) / 2, 6) as cx, round(least(1e0, cy + h / 2) - greatest(0e0, cy - h / 2), 6) as h from ib where least(1e0, cx + w / 2) > greatest(0e0, cx - w / 2) and least(1e0, cy + h / 2) > greatest(0e0, cy - h / 2)")
def polygon_round_trip(spark, d):
    """LabelMe documents written, one file per image, and read back."""
    b, images = _image_boxes(spark, d)
    rows = b.join(images, "img")
    x1, y1, x2, y2 = ((F.col("cx") - F.col("w") / 2) * F.col("width"), (F.col("cy") - F.col("h") / 2) * F.col("height"), (F.col("cx") + F.col("w") / 2) * F.col("width"), (F.col("cy") + F.col("h") / 2) * F.col("height"))
    shape = F.struct("box_idx", F.col("cls").cast("string").alias("label"), F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2)).alias("points"))
    docs = rows.groupBy("img", "width", "height").agg(F.sort_array(F.collect_list(shape)).alias("shapes"))
    text = F.to_json(F.struct(F.col("width").alias("imageWidth"), F.col("height").alias("imageHeight"), "shapes"))
    path = fresh(spark, "labelme")
    sinks.write_texts(docs.select("img", text.alias("text")), path, ".json")
    return labels.labelme(spark, path).select("img", "box_idx", "label", F.round("cx", 6).alias("cx"), F.round("h", 6).alias("h"))


@query(f"with {IMAGES} select img, box_idx::int as box_idx, cls::varchar as label, round((round(greatest(0e0, cx - w / 2) * width) / width + round(least(1e0, cx + w / 2) * width) / width) / 2, 8) as cx from ib join i using (img)")
def voc_round_trip(spark, d):
    """Pascal VOC files written, one per image, and read back."""
    b, images = _image_boxes(spark, d)
    rows = b.join(images, "img")
    at = lambda low, high, c, s, side: F.greatest(F.lit(0.0), F.col(c) - F.col(s) / 2) * F.col(side) if low else F.least(F.lit(1.0), F.col(c) + F.col(s) / 2) * F.col(side)
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), F.round(value).cast("int"), F.lit(f"</{name}>"))
    box = F.concat(tag("xmin", at(1, 0, "cx", "w", "width")), tag("ymin", at(1, 0, "cy", "h", "height")), tag("xmax", at(0, 1, "cx", "w", "width")), tag("ymax", at(0, 1, "cy", "h", "height")))
    item = F.struct("box_idx", F.concat(F.lit("<object><name>"), "cls", F.lit("</name><bndbox>"), box, F.lit("</bndbox></object>")).alias("x"))
    docs = rows.groupBy("img", "width", "height").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda o: o["x"]), "").alias("o"))
    text = F.concat(F.lit("<annotation><filename>"), "img", F.lit(".jpg</filename><size><width>"), "width", F.lit("</width><height>"), "height", F.lit("</height></size>"), "o", F.lit("</annotation>"))
    path = fresh(spark, "voc")
    sinks.write_texts(docs.select("img", text.alias("text")), path, ".xml")
    return labels.voc(spark, path).select("img", "box_idx", "label", F.round("cx", 8).alias("cx"))


@query(f"with {IMAGES} select img, round(cx, 6) as cx, round(w, 6) as w, 0.5::double as conf from ib where box_idx % 3 = 0 union all select img, round(cx, 6), round(w, 6), 0.6::double from ib where box_idx % 3 = 1 and cx - w / 2 >= 0 and cy - h / 2 >= 0 and cx + w / 2 <= 1 and cy + h / 2 <= 1")
def prediction_documents(spark, d):
    """Detection documents with YOLO lines, with corners in percent, and with something unreadable."""
    b, _ = _image_boxes(spark, d)
    line = F.format_string("%d %.9f %.9f %.9f %.9f", "cls", "cx", "cy", "w", "h")
    c = [x * 100 for x in G.corners(G.box_columns())]
    n = F.col("box_idx") % 3
    docs = b.select(F.concat("img", F.lit(".jpg")).alias("image"), F.lit(1.0).alias("time_s"), F.when(n == 1, F.to_json(F.array(F.struct(F.lit("w").alias("label"), F.lit("Medium").alias("confidence"), F.array(*c).alias("bbox"))))).when(n == 2, "sorry").alias("detections"), F.when(n == 0, F.array(line)).alias("yolo_labels"))
    return labels.predictions(docs).select("img", F.round("cx", 6).alias("cx"), F.round("w", 6).alias("w"), F.round("conf", 6).alias("conf"))


@query("select user_id::varchar as source, 'go' as action, case when event_id % 2 = 0 then 'since ' || event_id end as reasoning from events")
def action_log(spark, d):
    """Log lines with an action for every event, and a reason after every other one."""
    e = table(spark, d, "events")
    lines = e.select(F.col("user_id").cast("string").alias("source"), F.posexplode(F.array(F.lit("Action: go"), F.lit("noise"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Reasoning: since "), "event_id")))).alias("k", "value"), "event_id")
    lines = lines.filter("value is not null").select("source", (F.col("event_id") * 3 + F.col("k")).alias("line_no"), "value")
    return labels.action_log(lines).select("source", "action", "reasoning")


@query("select 'k' || event_id as name, event_id::varchar as v from events where event_id % 3 <> 2")
def first_json(spark, d):
    """Documents that are JSON, that have more after it, braces included, and that hold none."""
    n, k = F.col("event_id") % 3, F.col("event_id")
    text = F.when(n == 0, F.concat(F.lit('{"v": '), k, F.lit("}"))).when(n == 1, F.concat(F.lit('{"v": '), k, F.lit(', "o": {"p": 1}}\n\x1b[0m } {"v": 0}'))).otherwise("{broken")
    rows = table(spark, d, "events").select(F.concat(F.lit("k"), k).alias("name"), labels.first_json(text).alias("json"))
    return rows.filter("json is not null").select("name", F.get_json_object("json", "$.v").alias("v"))


@query(f"with {IMAGES} select (select count(*) from ib where ib.img = i.img) > 0 as detected, count(*) as n from i group by 1")
def split_by_detection(spark, d):
    b, images = _image_boxes(spark, d)
    path = fresh(spark, "split")
    sinks.split_by_detection(images, b, path)
    return spark.read.parquet(path).groupBy(F.col("detected").cast("boolean").alias("detected")).agg(F.count("*").alias("n"))


@query("select 'd' || (s_suppkey % 7) as dataset, case s_suppkey % 7 % 3 when 0 then 'a|b c' when 1 then 'x|y' else 'weed' end as names, count(*) as n from supplier group by 1, 2")
def yaml_class_names(spark, d):
    k = F.col("s_suppkey") % 7
    text = F.when(k % 3 == 0, "train: x\nnames: ['a', \"b c\"]\n").when(k % 3 == 1, "nc: 2\nnames:\n  0: x\n  1: \"y\"\nval: z\n").otherwise("train: x\n")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("d"), k).alias("dataset"), F.coalesce(labels.yaml_names(text), F.array(F.lit("weed"))).alias("names"))
    return rows.groupBy("dataset", F.array_join("names", "|").alias("names")).agg(F.count("*").alias("n"))


def _files(spark, d):
    """A listing: images of every supplier, labels in one of three places or nowhere, and YAML files."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k, F.concat(F.lit("r/d"), k % 7).alias("root"), F.concat(F.lit("s"), k).alias("stem"))
    img = s.select("s_suppkey", "root", "stem", F.concat("root", F.lit("/train/images/"), "stem", F.lit(".jpg")).alias("image"))
    label = F.when(k % 4 == 0, F.concat("root", F.lit("/train/labels/"), "stem", F.lit(".txt"))).when(k % 4 == 1, F.concat("root", F.lit("/train/images/"), "stem", F.lit(".txt"))).when(k % 4 == 2, F.concat("root", F.lit("/labels/"), "stem", F.lit(".txt")))
    return img, img.select(F.explode(F.array_compact(F.array("image", label))).alias("path"))


@query("select s_suppkey, case s_suppkey % 4 when 0 then 'r/d' || (s_suppkey % 7) || '/train/labels/s' || s_suppkey || '.txt' when 1 then 'r/d' || (s_suppkey % 7) || '/train/images/s' || s_suppkey || '.txt' when 2 then 'r/d' || (s_suppkey % 7) || '/labels/s' || s_suppkey || '.txt' end as label from supplier")
def resolve_labels(spark, d):
    img, files = _files(spark, d)
    return joins.first_existing(img, files, joins.label_candidates(F.col("image")), "label").select("s_suppkey", "label")


@query("select 'd' || (s_suppkey % 7) as dataset, 'train' as split, count(*) as images, count(*) filter (s_suppkey % 4 = 0) as labels from supplier group by 1")
def split_info(spark, d):
    return labels.split_info(_files(spark, d)[1]).filter("split = 'train'")


@query("with c as (select s_suppkey % 7 as k, count(*) filter (s_suppkey % 4 = 0) as train_labels from supplier group by 1) select 'r/d' || k || '/train' as root from c where train_labels >= 3 union select 'r/d' || k from c where k in (2, 5)")
def dataset_roots(spark, d):
    files = _files(spark, d)[1].withColumn("text", F.lit(None).cast("string"))
    yaml = spark.createDataFrame([("r/d2/data.yaml", ""), ("r/d5/more.yaml", "Train: a\nNC: 3"), ("r/d6/else.yaml", "train: a")], "path string, text string")
    return labels.dataset_roots(files.unionByName(yaml), least=3).filter("root like '%/train' or root in ('r/d2', 'r/d5', 'r/d6')")


# --- joins, registry, experiments -------------------------------------------------------------------------------------


@query("with src as (select s_nationkey as dataset, (s_suppkey % 9)::int as cls, case s_suppkey % 9 % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' else 'z' end as name from supplier group by all) select dataset, cls as src_cls, case name when 'a' then 0 when 'b' then 1 else 2 end as dst_cls from src where name <> 'z'")
def class_map_by_name(spark, d):
    k = (F.col("s_suppkey") % 9).cast("int")
    name = F.when(k % 4 == 0, "a").when(k % 4 == 1, "b").when(k % 4 == 2, "c").otherwise("z")
    src = table(spark, d, "supplier").select(F.col("s_nationkey").alias("dataset"), k.alias("cls"), name.alias("name")).distinct()
    return joins.class_map_by_name(src, spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "cls int, name string"))


@query(f"with {POINTS}, t as (select qid as id, qx - 900 as vx, qy - 500 as vy from q), m as (select pid as id, px - 900 as vx, py - 500 as vy from pts where pid % 10 = 1), s as (select *, sqrt(vx * vx + vy * vy) as speed from t), u as (select *, sqrt(vx * vx + vy * vy) as speed from m) select id from s where exists (select 1 from u where u.id <> s.id and abs(s.speed - u.speed) < 15 and s.speed > 0 and u.speed > 0 and (s.vx * u.vx + s.vy * u.vy) / (s.speed * u.speed) > 0.85)")
def similar_tracks(spark, d):
    q, p = _points(spark, d)
    t = q.select(F.col("qid").alias("id"), (F.col("qx") - 900).alias("vx"), (F.col("qy") - 500).alias("vy"))
    m = p.filter("pid % 10 = 1").select(F.col("pid").alias("id"), (F.col("px") - 900).alias("vx"), (F.col("py") - 500).alias("vy"))
    return joins.similar_tracks(t, m).select("id")


@query("with o as (select s_suppkey as k, s_nationkey as a, s_name as b from supplier where s_suppkey % 3 <> 0), n as (select s_suppkey as k, case when s_suppkey % 2 = 0 then 99 end as a from supplier where s_suppkey % 5 <> 0) select coalesce(o.k, n.k) as k, coalesce(n.a, o.a)::int as a, b from o full join n on o.k = n.k")
def registry_upsert(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    old = s.filter(k % 3 != 0).select(k.alias("k"), F.col("s_nationkey").alias("a"), F.col("s_name").alias("b"))
    return joins.upsert(old, s.filter(k % 5 != 0).select(k.alias("k"), F.when(k % 2 == 0, 99).alias("a")), ["k"])


@query("select n_nationkey as model, r_regionkey as dataset from nation cross join region where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_suppkey % 5 = r_regionkey)")
def remaining_experiments(spark, d):
    done = table(spark, d, "supplier").select(F.col("s_nationkey").alias("model"), (F.col("s_suppkey") % 5).cast("int").alias("dataset"))
    return joins.remaining(table(spark, d, "nation").select(F.col("n_nationkey").alias("model")), table(spark, d, "region").select(F.col("r_regionkey").alias("dataset")), done)


REG = "reg as (select 'g' || s_suppkey as slug, case s_suppkey % 3 when 0 then 'yolo' when 1 then 'coco' else 'none' end as annotation, case when s_suppkey % 4 < 2 then 'downloaded' else 'found' end as status, (s_suppkey % 50)::bigint as local_images, case when s_suppkey % 6 = 0 then null else s_suppkey % 6 = 1 end as used from supplier)"


def _registry(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("g"), k).alias("slug"), F.when(k % 3 == 0, "yolo").when(k % 3 == 1, "coco").otherwise("none").alias("annotation"), F.when(k % 4 < 2, "downloaded").otherwise("found").alias("status"),
        (k % 50).cast("long").alias("local_images"), F.when(k % 6 != 0, k % 6 == 1).alias("used_for_training"),
    )


@query(f"with {REG} select count(*) as datasets, count(*) filter (status = 'downloaded') as downloaded, sum(local_images)::bigint as images, count(*) filter (annotation <> 'none') as box_datasets, (sum(local_images) filter (annotation <> 'none'))::bigint as box_images from reg")
def registry_summary(spark, d):
    return registry.summary(_registry(spark, d))


@query(f"with {REG} select slug from reg where status = 'downloaded' and not coalesce(used, false) and slug[2:]::int % 8 <> 0")
def registry_unused(spark, d):
    r = _registry(spark, d)
    flags = r.filter("int(substring(slug, 2)) % 4 = 0").select("slug", F.lit("fine").alias("flag"), F.lit(1).alias("ts"))
    bad = r.filter("int(substring(slug, 2)) % 8 = 0").select("slug", F.lit("garbage").alias("flag"), F.lit(2).alias("ts"))
    return registry.unused(r, flags.unionByName(bad)).select("slug")


@query(f"with {RUNS} select iteration, (case when old_f1 < 0.9 then new_f1 * 0.5 else new_f1 + 0.1 * old_f1 end)::double as score, case when new_f1 < 0.5 then 'critical' when new_f1 < 0.7 then 'weak' when new_f1 < 0.85 then 'moderate' else 'good' end as bucket, greatest(0.2::double, least(0.8::double, new_f1)) as clamped, array_to_string(list_filter([case when new_f1 > 0.8 then 'high' end, case when old_f1 < 0.9 then 'forgets' end], lambda x: x is not null), ',') as rules from runs")
def experiment_rules(spark, d):
    r = runs(spark, d)
    new, old = F.col("new_f1"), F.col("old_f1")
    return r.select("iteration", experiments.strategy_score(new, old, old < 0.9).alias("score"), experiments.bucket(new).alias("bucket"), experiments.clamp(new, 0.2, 0.8).alias("clamped"), F.array_join(experiments.violations({"high": new > 0.8, "forgets": old < 0.9}), ",").alias("rules"))


@query(f"with {RUNS} select iteration, new_f1 as f1, 0.25::double as map50, coalesce(case when iteration % 2 = 0 then old_f1 end, -1) as old from runs")
def flatten_experiments(spark, d):
    rows = runs(spark, d).select("iteration", F.struct(F.struct(F.col("new_f1").alias("f1"), F.lit(None).cast("double").alias("map50")).alias("new"), F.when(F.col("iteration") % 2 == 0, F.col("old_f1")).alias("old")).alias("result"))
    return experiments.flatten(rows, {"f1": ("result.new.f1", 0.0), "map50": ("result.new.map50", 0.25), "old": ("result.old", -1.0)})


@query(f"with {RUNS} select iteration, family, count(*) over w = 4 and sum((new_f1 * 100)::int % 2) over w = 0 as idle from runs window w as (partition by family order by iteration rows between 3 preceding and current row)")
def idle_guard(spark, d):
    r = runs(spark, d).withColumn("harvested", F.round(F.col("new_f1") * 100).cast("int") % 2)
    return experiments.idle(r, by=("family",), n=4).select("iteration", "family", "idle")


@query("with r as (select o_orderkey, o_custkey, sum(o_orderkey % 9) over (partition by o_custkey order by o_orderkey) as run from orders) select o_orderkey from r where run <= 20")
def budget_prefix(spark, d):
    o = table(spark, d, "orders").withColumn("size", F.col("o_orderkey") % 9)
    return experiments.budget(o, ("o_orderkey",), "size", 20, by=("o_custkey",)).select("o_orderkey")


@query("select 'fam' || (s_suppkey % 9) as family, max('fam' || (s_suppkey % 9) || '_iter' || lpad(s_suppkey::varchar, 6, '0')) as name from supplier group by 1")
def latest_family(spark, d):
    k = F.col("s_suppkey")
    return experiments.latest_family(table(spark, d, "supplier").select(F.concat(F.lit("fam"), k % 9, F.lit("_iter"), F.lpad(k.cast("string"), 6, "0")).alias("name")))


@query("with n as (select doc_id, row_number() over (order by md5('42|' || doc_id), doc_id) - 1 as nth, count(*) over () as n from documents) select doc_id, case when nth < floor(n * 0.65)::int then 'train' when nth < floor(n * 0.65)::int + floor(n * 0.2)::int then 'valid' else 'test' end as split from n")
def hash_split(spark, d):
    return corpus.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", (("train", 0.65), ("valid", 0.2), ("test", 0.15)))


# --- events and state -------------------------------------------------------------------------------------------------


@query(f"with {EVENT_SQL}, subs as (select * from (values ('a', 'click'), ('b', '*'), ('c', 'purchase'), ('c', '*'), ('d', 'view')) s(subscriber, wanted)) select distinct event_id, subscriber from ev join subs on wanted = event_type or wanted = '*'")
def route_events(spark, d):
    subs = spark.createDataFrame([("a", "click"), ("b", "*"), ("c", "purchase"), ("c", "*"), ("d", "view"), ("d", "view")], "subscriber string, event_type string")
    return E.route(events(spark, d), subs).select("event_id", "subscriber")


@query(f"with {EVENT_SQL}, w as (select *, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as w from ev), n as (select *, row_number() over (partition by w order by ts, event_id) as n from w) select event_id from n where n <= 3")
def first_of_window(spark, d):
    return E.first_of_window(events(spark, d), "6 hours", 3).select("event_id")


@query(f"with {EVENT_SQL}, m as (select *, map([chr(97 + k % 3 * 2), 'b'], [k, 40]) as params, lag(map([chr(97 + k % 3 * 2), 'b'], [k, 40])) over (partition by user_id order by ts, event_id) as old from ev), x as (select event_id, user_id, unnest(map_keys(params)) as param, params, old from m) select event_id, user_id, param, params[param]::int as value, old[param]::int as old_value from x where params[param] is distinct from old[param]")
def param_change_log(spark, d):
    rows = events(spark, d).withColumn("params", F.create_map(F.char(97 + F.col("k") % 3 * 2), F.col("k"), F.lit("b"), F.lit(40)))
    return E.param_changes(rows, ("user_id",)).select("event_id", "user_id", "param", "value", "old_value")


@query(f"with {EVENT_SQL} select event_id, case when k % 5 = 0 then null when k % 7 = 0 then 'SWC' when k % 3 = 0 then 'SWA' when k % 2 = 0 then 'SWB' else 'IDLE' end as mode from ev")
def switch_modes(spark, d):
    k = F.col("k")
    sw = lambda on: F.when(on, 2000).otherwise(1000)
    s = F.when(k % 5 != 0, F.create_map(F.lit("SwA"), sw(k % 3 == 0), F.lit("SwB"), sw(k % 2 == 0), F.lit("SwC"), sw(k % 7 == 0))).otherwise(F.create_map().cast("map<string,int>"))
    return events(spark, d).select("event_id", E.mode(s).alias("mode"))


@query(f"with recursive {EVENT_SQL}, o as (select *, row_number() over (partition by user_id order by ts, event_id) as n from ev), r as (select user_id, event_id, n, greatest(0.2::double, least(3e0, 0.8::double * 1e0 + 0.2::double * (value / 100))) as s from o where n = 1 union all select o.user_id, o.event_id, o.n, greatest(0.2::double, least(3e0, 0.8::double * r.s + 0.2::double * (o.value / 100))) from r join o on o.user_id = r.user_id and o.n = r.n + 1) select event_id, round(s, 6) as smoothed from r")
def smoothed_delay(spark, d):
    e = events(spark, d).withColumn("delay", F.col("value") / 100).select("event_id", "user_id", "ts", "delay")
    return E.smoothed(e, "delay", ("user_id",)).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query(f"with {EVENT_SQL} select event_id, ts from ev where chr(97 + k % 4) = 'b'")
def addressed_updates(spark, d):
    return E.addressed(events(spark, d).withColumn("target_agent", F.char(97 + F.col("k") % 4)), "b").select("event_id", "ts")


@query(f"with {EVENT_SQL}, m as (select user_id as id, max_by(value, ts) as speed, max(ts) as t from ev where event_type = 'view' group by 1) select event_id, coalesce(speed, 0) as speed, case when m.id is null then false else speed > 20 end as is_moving from ev left join m on m.id = ev.user_id where event_type = 'click'")
def enrich_detections(spark, d):
    e = events(spark, d)
    motion = e.filter("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("ts").alias("t"), F.col("value").alias("speed"), (F.col("value") > 20).alias("is_moving"), F.lit(0.0).alias("consistency"), F.lit(0.0).alias("confidence"))
    return tracking.enrich(e.filter("event_type = 'click'").select("event_id", F.col("user_id").alias("id")), motion).select("event_id", "speed", "is_moving")


POS = f"{EVENT_SQL}, pos as (select event_id, user_id as key, epoch_us(ts) / 3.6e9 as t, value as x, k::double as y, row_number() over (partition by user_id order by ts, event_id) as n from ev)"


def _positions(spark, d):
    return events(spark, d).select("event_id", F.col("user_id").alias("key"), (F.unix_micros("ts") / 3.6e9).alias("t"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


@query(
    f"""with recursive {POS}, r as (
  select key, event_id, n, t, x, y, [{{'id': 1, 'x': x, 'y': y, 't': t}}] as tr, 1 as next, 1 as track_id from pos where n = 1
  union all
  select key, event_id, n, t, x, y, case when got is null then list_append(live, {{'id': next + 1, 'x': x, 'y': y, 't': t}}) else list_transform(live, lambda k: case when k.id = got then {{'id': k.id, 'x': x, 'y': y, 't': t}} else k end) end,
    case when got is null then next + 1 else next end, coalesce(got, next + 1)
  from (select key, event_id, n, t, x, y, live, next, list_filter(live, lambda k: sqrt((x - k.x) * (x - k.x) + (y - k.y) * (y - k.y)) < 50)[1].id as got
    from (select p.key, p.event_id, p.n, p.t, p.x, p.y, list_filter(r.tr, lambda k: p.t - k.t < 10) as live, r.next from r join pos p on p.key = r.key and p.n = r.n + 1)))
select event_id, key, track_id::bigint as track_id from r"""
)
def track_objects(spark, d):
    return tracking.batch(_positions(spark, d), "track").select("event_id", "key", "track_id")


@query(f"with {POS}, l as (select event_id, key, (n // 4) as track_id, t from pos) select key, track_id::bigint as track_id, min(t) as new_at, max(t) + 10.0 as lost_at from l group by 1, 2")
def new_and_lost(spark, d):
    n = F.row_number().over(W.partitionBy("key").orderBy("t", "event_id"))
    return tracking.new_and_lost(_positions(spark, d).withColumn("track_id", F.floor(n / 4).cast("long")))


def _weights(n: str, a: str) -> str:
    """The mean of list n's component a with weights exp(-1..0)."""
    w = f"exp(-1 + (i - 1) / (len({n}) - 1))"
    return f"(list_sum(list_transform({n}, lambda p, i: {w} * p.{a})) / list_sum(list_transform({n}, lambda p, i: {w})))"


@query(
    f"""with recursive {POS}, r as (
  select key, event_id, n, x as fx, y as fy, [{{'x': x, 'y': y}}] as raw, []::struct(x double, y double)[] as vel from pos where n = 1
  union all
  select key, event_id, n, case when n < 3 then x else (1 - kept) * sx + kept * lx end, case when n < 3 then y else (1 - kept) * sy + kept * ly end, list_append(raw, {{'x': x, 'y': y}})[-5:],
    case when n < 3 or size <= 3 then vel when len(vel) = 0 then [{{'x': dx, 'y': dy}}] else list_append(vel, {{'x': 0.3::double * dx + 0.7::double * vel[-1].x, 'y': 0.3::double * dy + 0.7::double * vel[-1].y}})[-3:] end
  from (select *, case when size < 3 then 0.3::double * 1.5 when tx is null then 0.3::double
      else 0.3::double * (1 - 0.8::double * case when tsize < 0.1 or size < 0.1 then 0e0 else greatest(0e0, 1 - acos(greatest(-1e0, least(1e0, (dx / size) * (tx / tsize) + (dy / size) * (ty / tsize)))) / pi()) end) end as kept
    from (select *, sx - lx as dx, sy - ly as dy, sqrt((sx - lx) * (sx - lx) + (sy - ly) * (sy - ly)) as size, sqrt(tx * tx + ty * ty) as tsize
      from (select *, {_weights('past', 'x')} as sx, {_weights('past', 'y')} as sy
        from (select *, list_append(raw, {{'x': case when far then lx + coalesce(tx * 0.1::double, 0) else x end, 'y': case when far then ly + coalesce(ty * 0.1::double, 0) else y end}}) as past
          from (select p.key, p.event_id, p.n, p.x, p.y, r.fx as lx, r.fy as ly, r.raw, r.vel, sqrt((p.x - r.fx) * (p.x - r.fx) + (p.y - r.fy) * (p.y - r.fy)) > 50 as far,
              list_avg(list_transform(r.vel, lambda v: v.x)) as tx, list_avg(list_transform(r.vel, lambda v: v.y)) as ty from r join pos p on p.key = r.key and p.n = r.n + 1))))))
select event_id, key, round(fx, 6) as fx, round(fy, 6) as fy from r"""
)
def noise_filter(spark, d):
    return tracking.batch(_positions(spark, d), "filter").select("event_id", "key", F.round("fx", 6).alias("fx"), F.round("fy", 6).alias("fy"))


@query(
    f"""with {POS}, l as (select *, lag(t) over o as t0, x - lag(x) over o as dx, y - lag(y) over o as dy from pos window o as (partition by key order by n)),
v as (select *, case when t > t0 then case when sqrt(dx * dx + dy * dy) > 2 then {{'x': dx / (t - t0), 'y': dy / (t - t0)}} else {{'x': 0e0, 'y': 0e0}} end end as v, coalesce(t > t0 and sqrt(dx * dx + dy * dy) > 2, false) as moved from l),
s as (select *, list({{'t': t, 'x': x, 'y': y}}) over (partition by key order by n rows between 19 preceding and current row) as seen, (list(v) filter (v is not null) over (partition by key order by n rows unbounded preceding))[-20:] as vel from v),
f as (select *, list_filter(vel, lambda a: sqrt(a.x * a.x + a.y * a.y) > 0.5) as fast, moved and len(vel) > 1 as fresh, seen[-1].t - seen[1].t as lasted, sqrt((seen[-1].x - seen[1].x) ** 2 + (seen[-1].y - seen[1].y) ** 2) as way from s),
c as (select *, case when fresh and len(fast) > 1 then {{'x': list_avg(list_transform(fast, lambda a: a.x)), 'y': list_avg(list_transform(fast, lambda a: a.y))}} end as mean,
    case when fresh and len(fast) > 2 then greatest(0e0, 1 - list_avg(list_transform(range(1, len(fast)), lambda i: acos(greatest(-1e0, least(1e0, (fast[i].x * fast[i + 1].x + fast[i].y * fast[i + 1].y) / (sqrt(fast[i].x ** 2 + fast[i].y ** 2) * sqrt(fast[i + 1].x ** 2 + fast[i + 1].y ** 2))))))) / pi()) end as cons,
    case when len(seen) < 3 then 1e0 else list_avg(list_transform(seen[2:-2], lambda p: greatest(0e0, 1 - sqrt((p.x - seen[1].x - (seen[-1].x - seen[1].x) / lasted * (p.t - seen[1].t)) ** 2 + (p.y - seen[1].y - (seen[-1].y - seen[1].y) / lasted * (p.t - seen[1].t)) ** 2) / 30))) end as straight from f),
k as (select *, coalesce(last_value(cons ignore nulls) over o, 0e0) as consistency, last_value(mean ignore nulls) over o as m, case when fresh and lasted >= 0.8 and way > 10 then least(1e0, lasted) * least(1e0, way / 50) * straight * 0.8::double end as quick from c window o as (partition by key order by n rows unbounded preceding)),
z as (select *, case when fresh then case when quick > 0.4 then least(0.9::double, quick) else greatest(0.1::double, least(1e0, least(1e0, lasted) * least(1e0, len(seen) / 8) * (0.5 + 0.5 * consistency) * 0.8::double)) end end as conf, case when quick > 0.4 then {{'x': (seen[-1].x - seen[1].x) / lasted, 'y': (seen[-1].y - seen[1].y) / lasted}} end as w from k)
select event_id, key, round(coalesce(m.x, 0), 6) as vx, round(coalesce(m.y, 0), 6) as vy, bool_or(moved) over o as is_moving, round(consistency, 5) as consistency, round(coalesce(last_value(conf ignore nulls) over o, 0), 5) as confidence, round(coalesce((last_value(w ignore nulls) over o).x, m.x, 0), 6) as way_x from z window o as (partition by key order by n rows unbounded preceding)"""
)
def trajectory_fit(spark, d):
    out = tracking.batch(_positions(spark, d), "fit")
    return out.select("event_id", "key", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"), "is_moving", F.round("consistency", 5).alias("consistency"), F.round("confidence", 5).alias("confidence"), F.round("way_x", 6).alias("way_x"))


@query(f"with {POS}, f as (select event_id, x, y, x / 10 - 5 as vx, y / 10 as vy, event_id % 4 <> 0 as moves from pos where n % 3 <> 0) select event_id, k::int as k, round(case when moves then x + vx * (1 + k * 0.1::double) else x end, 6) as x from f, range(0, 11) t(k) where (moves and sqrt(vx * vx + vy * vy) >= 1) or (not moves and k = 0)")
def trajectory_points(spark, d):
    n = F.row_number().over(W.partitionBy("key").orderBy("t", "event_id"))
    fits = _positions(spark, d).withColumn("n", F.when(n % 3 == 0, 1).otherwise(2)).select("event_id", "x", "y", (F.col("x") / 10 - 5).alias("way_x"), (F.col("y") / 10).alias("way_y"), (F.col("event_id") % 4 != 0).alias("is_moving"), "n")
    return tracking.predict_points(fits).select("event_id", "k", F.round("x", 6).alias("x"))
