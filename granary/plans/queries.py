"""Registered queries of the engine's own operators, each with its SQL for the oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import geometry as G
from granary.functions import text as X
from granary.operators import corpus, experiments, fusion, joins, matching, metrics
from granary.operators import events as E
from granary.plans.views import BOX_SQL, EVENT_SQL, boxes, detector, events, greedy_sql, iou_sql, predicted, table, true_boxes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


PG = "p as (select img, idx as pred_idx, cls, conf, cx, cy, w, h from box where role = 0), g as (select img, idx as gt_idx, cls, cx, cy, w, h from box where role = 1)"
GREEDY = f"with recursive {BOX_SQL}, {PG}, {greedy_sql('m', 'p', 'g', 0.5, 'conf desc, pred_idx')}"
PRF = "case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0e0 end as recall"
F1 = "case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end as f1"


def both(spark, d):
    b = boxes(spark, d)
    return predicted(b), true_boxes(b)


def matched(spark, d, thresholds=(0.5,), **how):
    p, g = both(spark, d)
    return matching.greedy_match(p, g, thresholds, **how), g


# --- overlap joins and matching ---------------------------------------------------------------------------------------


@query(f"with {BOX_SQL}, {PG} select p.img, p.pred_idx, g.gt_idx, {iou_sql('p', 'g')} as iou from p join g on p.img = g.img where {iou_sql('p', 'g')} >= 0.5")
def iou_pairs(spark, d):
    p, g = both(spark, d)
    return matching.iou_pairs(p, g, 0.5).drop("conf")


SEMI = f"with {BOX_SQL}, a as (select img, idx as box_idx, cx, cy, w, h from box where src in (0, 1)), b as (select * from box where src in (2, 3)) select a.img, a.box_idx from a where @not exists (select 1 from b where a.img = b.img and {iou_sql('a', 'b')} > 0.5)"


@query(SEMI.replace("@not", ""))
def iou_semi_confirm(spark, d):
    b = boxes(spark, d)
    return joins.overlap_filter(detector(b, 0, 1), detector(b, 2, 3), 0.5, True).select("img", "box_idx")


@query(SEMI.replace("@not", "not"))
def iou_anti_dedup(spark, d):
    b = boxes(spark, d)
    return joins.overlap_filter(detector(b, 0, 1), detector(b, 2, 3), 0.5, False).select("img", "box_idx")


@query(f"{GREEDY}, c as (select count(gt_idx) as tp, count(*) - count(gt_idx) as fp, (select count(*) from g) - count(gt_idx) as fn from m), r as (select *, {PRF} from c) select 0.5::double as threshold, *, {F1} from r")
def eval_prf_at_50(spark, d):
    m, g = matched(spark, d)
    return metrics.evaluate(m, g)


def _sweep_sql():
    parts, names = [], []
    for t in (0.3, 0.5, 0.75):
        n = f"m{int(t * 100)}"
        parts.append(greedy_sql(n, "p", "g", t, "conf desc, pred_idx"))
        names.append(f"select {t}::double as threshold, count(gt_idx) as tp, count(*) - count(gt_idx) as fp, (select count(*) from g) - count(gt_idx) as fn from {n}")
    return f"with recursive {BOX_SQL}, {PG}, {', '.join(parts)}, c as ({' union all '.join(names)}), r as (select *, {PRF} from c) select *, {F1} from r"


@query(_sweep_sql())
def eval_prf_sweep(spark, d):
    m, g = matched(spark, d, (0.3, 0.5, 0.75))
    return metrics.evaluate(m, g)


@query(f"with recursive {BOX_SQL}, {PG}, {greedy_sql('m', 'p', 'g', 0.3, 'pred_idx')} select img, pred_idx, gt_idx from m")
def match_input_order(spark, d):
    return matched(spark, d, (0.3,), by_confidence=False)[0].select("img", "pred_idx", "gt_idx")


@query(f"with recursive {BOX_SQL}, {PG}, {greedy_sql('m', 'p', 'g', 0.3, 'conf desc, pred_idx', 'img, cls')} select img, cls, pred_idx, gt_idx from m")
def match_class_aware(spark, d):
    p, g = both(spark, d)
    return matching.greedy_match(p, g, (0.3,), keys=("img", "cls")).select("img", "cls", "pred_idx", "gt_idx")


@query(f"{GREEDY}, x as (select g.cls, m.gt_idx as hit from g left join m on g.img = m.img and g.gt_idx = m.gt_idx), s as (select cls, count(*) as n_gt, count(hit) as tp from x group by grouping sets ((), (cls))) select cls, n_gt, tp, n_gt - tp as fn, tp / n_gt as recall from s")
def eval_grouping_sets(spark, d):
    m, g = matched(spark, d)
    return metrics.evaluate_by_class(m, g)


CURVE = "v as (select conf, gt_idx is not null as hit, row_number() over o as rank, sum((gt_idx is not null)::int) over o as tp from m window o as (order by conf desc, img, pred_idx)), u as (select *, tp / rank as precision, tp / (select count(*) from g) as recall from v)"


def curve(spark, d):
    m, g = matched(spark, d)
    return metrics.pr_curve(m, g.agg(F.count("*").alias("n_gt")))


@query(f"{GREEDY}, {CURVE}, e as (select *, max(precision) over (order by rank rows between current row and unbounded following) as env from u) select sum(env) / (select count(*) from g) as ap from e where hit")
def ap_all_point(spark, d):
    return metrics.ap_all_points(curve(spark, d))


@query(f"{GREEDY}, {CURVE}, t as (select unnest(range(0, 11)) / 1e1 as t), x as (select t, coalesce((select max(precision) from u where recall >= t), 0) as p from t) select sum(p) / 11 as ap from x")
def ap_11pt(spark, d):
    return metrics.ap_points(curve(spark, d), 11)


@query(f"{GREEDY}, {CURVE}, t as (select unnest(range(0, 101)) / 1e2 as t), x as (select t, coalesce((select max(precision) from u where recall >= t), 0) as p from t) select sum(p) / 101 as ap from x")
def ap_101pt(spark, d):
    return metrics.ap_points(curve(spark, d), 101)


CLS = f"""with recursive {BOX_SQL}, {PG}, {greedy_sql('m', 'p', 'g', 0.5, 'conf desc, pred_idx', 'img, cls')}, n as (select cls, count(*) as n_gt from g group by 1),
v as (select m.cls, n_gt, gt_idx is not null as hit, row_number() over o as rank, sum((gt_idx is not null)::int) over o as tp from m join n on m.cls = n.cls window o as (partition by m.cls order by conf desc, img, pred_idx)),
e as (select *, max(tp / rank) over (partition by cls order by rank rows between current row and unbounded following) as env from v)"""


def _class_ap(spark, d):
    p, g = both(spark, d)
    n = g.groupBy("cls").agg(F.count("*").alias("n_gt"))
    m = matching.greedy_match(p, g, (0.5,), keys=("img", "cls"))
    return metrics.ap_all_points(metrics.pr_curve(m, n, keys=("cls",)), keys=("cls",)), n


@query(f"{CLS} select cls, sum(env) / max(n_gt) as ap from e where hit group by cls")
def ap_per_class(spark, d):
    return _class_ap(spark, d)[0]


@query(f"{CLS}, a as (select cls, sum(env) / max(n_gt) as ap from e where hit group by cls) select avg(coalesce(ap, 0)) as map from n left join a on n.cls = a.cls")
def map_macro(spark, d):
    ap, n = _class_ap(spark, d)
    return metrics.mean_ap(ap, n, ("cls",))


def _comp_sql():
    ds = ", ".join(f"p{k} as (select img, idx as pred_idx, conf, cx, cy, w, h from box where role = 0 and src in {s})" for k, s in ((1, "(0, 1, 2)"), (2, "(3, 4, 5, 6)")))
    return f"""with recursive {BOX_SQL}, g as (select img, idx as gt_idx, cls, cx, cy, w, h from box where role = 1), {ds}, {greedy_sql('a', 'p1', 'g', 0.3, 'conf desc, pred_idx')}, {greedy_sql('b', 'p2', 'g', 0.3, 'conf desc, pred_idx')},
x as (select g.cls, exists (select 1 from a where a.img = g.img and a.gt_idx = g.gt_idx) as a, exists (select 1 from b where b.img = g.img and b.gt_idx = g.gt_idx) as b from g)
select cls, count(*) as total, count(*) filter (a and b) as "both", count(*) filter (a and not b) as a_only, count(*) filter (b and not a) as b_only, count(*) filter (not a and not b) as neither, (count(*) filter (b and not a)) / count(*) as rescue_rate
from x group by grouping sets ((), (cls))"""


@query(_comp_sql())
def complementarity(spark, d):
    rounds = [(F.col("src").isin(*s), 0.3) for s in ((0, 1, 2), (3, 4, 5, 6))]
    return metrics.complementarity_of_bits(matching.matched_bits(boxes(spark, d), rounds, carry=("cls",), truths=True))


@query(f"with {BOX_SQL}, c as (select o_orderkey as img, count(box.img) as n from orders left join box on o_orderkey = img and role = 0 group by 1) select avg(n) as mean_boxes, max(n) as max_boxes, count(*) filter (n = 0) as empty_images, (select avg(w * h) from box where role = 0) as mean_area, (select median(w * h) from box where role = 0) as median_area from c")
def box_quality(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("img"))
    return metrics.box_quality(boxes(spark, d).filter("role = 0"), images)


DRAWN = "select r, d, (u::hugeint * n) >> 52 as place from (select r, 2 * j + h as d, ('0x' || substr(md5('1|' || r || '|' || j), 1 + 16 * h, 13))::ubigint as u from range(1, 1001) x(r), range(0, (select (count(*) + 1) // 2 from k)) y(j), range(0, 2) z(h)), (select count(*) as n from k) where d < n"


@query(
    f"""{GREEDY}, mi as (select img, count(gt_idx) as tp, count(*) - count(gt_idx) as fp from m group by 1), gi as (select img, count(*) as n from g group by 1),
k as (select coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(n, 0) - coalesce(tp, 0) as fn, row_number() over (order by coalesce(tp, 0), coalesce(fp, 0), coalesce(n, 0) - coalesce(tp, 0)) - 1 as place from mi full join gi on mi.img = gi.img),
c as (select r, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from ({DRAWN}) join k using (place) group by r), pr as (select *, {PRF} from c), f as (select {F1} from pr)
select round(avg(f1), 9) as mean, round(stddev_pop(f1), 9) as std, round(quantile_cont(f1, 0.025), 9) as lo, round(quantile_cont(f1, 0.975), 9) as hi from f"""
)
def bootstrap_ci(spark, d):
    m, g = matched(spark, d)
    per = g.groupBy("img").agg(F.count("*").alias("n")).join(m.groupBy("img").agg(F.count("gt_idx").alias("tp"), F.count_if(F.col("gt_idx").isNull()).alias("fp")), "img", "full")
    per = per.select("img", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp")], (F.coalesce("n", F.lit(0)) - F.coalesce("tp", F.lit(0))).alias("fn"))
    out = metrics.bootstrap(per, rounds=1000)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


# --- fusion ----------------------------------------------------------------------------------------------------------

FUSE = f"with recursive {BOX_SQL}, p as (select img, idx as pred_idx, cls, conf, cx, cy, w, h from box where src in (0, 1, 2)), g as (select img, idx as gt_idx, cls, conf, cx, cy, w, h from box where src in (3, 4, 5)), {greedy_sql('m', 'p', 'g', 0.3, 'pred_idx')}"
REST = "select img, 'second' as src, gt_idx as box_idx, %s as conf from g where conf >= 0.6 and not exists (select 1 from m where m.img = g.img and m.gt_idx = g.gt_idx)"


def _fuse(spark, d, how, **more):
    b = boxes(spark, d)
    return fusion.fuse(detector(b, 0, 1, 2).drop("src"), detector(b, 3, 4, 5).drop("src"), how, 0.3, **more).select("img", "src", "box_idx", "conf")


@query(f"{FUSE} select img, 'first' as src, pred_idx as box_idx, conf from m union all {REST % 'conf'}")
def fuse_supplement(spark, d):
    return _fuse(spark, d, "supplement", second_conf=0.6)


@query(f"{FUSE} select img, 'first' as src, pred_idx as box_idx, conf from m where gt_idx is not null")
def fuse_filter(spark, d):
    return _fuse(spark, d, "filter")


@query(f"{FUSE} select img, 'first' as src, pred_idx as box_idx, case when img not in (select img from g) then conf when gt_idx is not null then least(1e0, 0.7::double * conf + 0.3::double) else 0.9::double * conf end as conf from m union all {REST % '0.5::double * conf'} and img in (select img from p)")
def fuse_weighted(spark, d):
    return _fuse(spark, d, "weighted", second_conf=0.6)


@query(f"""with {BOX_SQL}, p as (select img, idx, cls, cx, cy, w, h from box where src in (0, 1, 2)), g as (select img, idx, cls, cx, cy, w, h from box where src in (3, 4, 5)),
b as (select p.img, p.idx as first_idx, g.idx as second_idx, g.cls as c2, {iou_sql('p', 'g')} as iou, row_number() over (partition by p.img, p.idx order by {iou_sql('p', 'g')} desc, g.idx) as n from p join g on p.img = g.img and {iou_sql('p', 'g')} > 0.3),
f as (select p.img, p.idx as first_idx, second_idx, iou, p.cls, c2 from p left join b on p.img = b.img and p.idx = b.first_idx and n = 1)
select img, case when second_idx is null then 'first_only' else 'fused' end as source, first_idx, second_idx, iou, case when second_idx is not null then case when cls = c2 then 'agree' else 'disagree' end end as agreement, second_idx is not null and cls <> c2 as needs_review from f
union all select img, 'second_only', null, idx, null, null, true from g where not exists (select 1 from b where b.img = g.img and b.second_idx = g.idx and n = 1)""")
def fuse_rich(spark, d):
    b = boxes(spark, d)
    return fusion.fuse_rich(detector(b, 0, 1, 2), detector(b, 3, 4, 5))


STAR = f"""with recursive {BOX_SQL}, o as (select *, row_number() over (partition by img order by idx) as n, count(*) over (partition by img) as total from box),
r as (select img, 1::bigint as n, [idx] as seeds, idx, idx as seed_idx from o where n = 1
  union all select o.img, o.n, case when s is null then list_append(seeds, o.idx) else seeds end, o.idx, coalesce(s, o.idx)
  from (select r.img, r.n, r.seeds, (select min(z.idx) from o z join o y on y.img = r.img and y.n = r.n + 1 where z.img = r.img and list_contains(r.seeds, z.idx) and {iou_sql('z', 'y')} >= 0.5) as s from r) r join o on o.img = r.img and o.n = r.n + 1)"""


@query(f"{STAR} select img, idx as box_idx, seed_idx from r")
def star_cluster(spark, d):
    return matching.star_cluster(boxes(spark, d).withColumnRenamed("idx", "box_idx"), 0.5)


@query(f"{STAR}, v as (select r.img, r.seed_idx, count(distinct src) as votes from r join box on box.img = r.img and box.idx = r.idx group by 1, 2), t as (select img, count(distinct src) as present from box group by 1) select v.img, seed_idx, votes, seed_idx as box_idx from v join t on v.img = t.img where votes >= least(2, present)")
def consensus_vote(spark, d):
    return fusion.consensus(boxes(spark, d).withColumnRenamed("idx", "box_idx"))


# --- corpus ----------------------------------------------------------------------------------------------------------


@query("select doc_id from documents where not (contains(lower(coalesce(text, '')), 'licensed') or contains(lower(coalesce(text, '')), 'token')) and (contains(lower(coalesce(text, '')), 'the') or contains(lower(coalesce(text, '')), 'une'))")
def relevance_filter(spark, d):
    return table(spark, d, "documents").filter(corpus.relevant(F.col("text"), ("licensed", "token"), ("the", "une"))).select("doc_id")


@query("with f as (select text, min(doc_id) as doc_id from documents where text is not null group by 1) select doc_id from f union all select doc_id from documents where text is null")
def dedup_first_wins(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return corpus.first_wins(t, "hash", ("doc_id",)).select("doc_id")


@query("select doc_id from documents where source not in (select 'src' || item_id from benchmark where item_id < 5)")
def holdout_filter(spark, d):
    held = table(spark, d, "benchmark").filter("item_id < 5").select(F.concat(F.lit("src"), F.col("item_id")).alias("stem"))
    return corpus.without_holdout(table(spark, d, "documents").withColumnRenamed("source", "stem"), held).select("doc_id")


@query(f"with {BOX_SQL} select img, idx as box_idx, case when cls < 6 then cls * 2 else 99 end as cls from box where cls < 6 or src = 3")
def class_remap_strict(spark, d):
    b = boxes(spark, d).withColumnRenamed("idx", "box_idx").withColumn("dataset", F.col("src"))
    maps = spark.range(7).select(F.col("id").cast("int").alias("dataset"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("src_cls")).withColumn("dst_cls", F.col("src_cls") * 2)
    wild = spark.createDataFrame([(3, 99)], "dataset int, slot int")
    return corpus.remap_strict(b, maps, wild).select("img", "box_idx", "cls")


@query("select source, ((('0x' || substr(md5(source), 1, 16))::uhugeint * 18446744073709551616::uhugeint + ('0x' || substr(md5(source), 17, 16))::uhugeint) % 88 + 12)::int as slot from (select distinct source from documents where source is not null)")
def aux_slot_md5(spark, d):
    return table(spark, d, "documents").select("source").distinct().filter("source is not null").select("source", X.md5_slot(F.col("source")).alias("slot"))


MERGE = f"""with {BOX_SQL}, b as (select img % 5 as ds, img, cls from box), h as (select ds, img, img % 997 as hash from (select distinct o_orderkey % 5 as ds, o_orderkey as img from orders)),
x as (select h.*, exists (select 1 from b where b.img = h.img) as lab, exists (select 1 from b where b.img = h.img and cls < 4) as map, img % 50 = 7 as held from h),
e as (select *, case when ds = 3 then 'garbage' when ds = 4 then 'annotation' when not lab then 'no_label' when held then 'holdout' end as early from x),
w as (select *, early is null and row_number() over (partition by early is null, hash order by ds, img) = 1 as winner from e),
r as (select *, coalesce(early, case when not winner then 'duplicate' when not map then 'unmapped' else 'kept' end) as reason from w)"""


def _merge(spark, d):
    b = boxes(spark, d).select((F.col("img") % 5).cast("int").alias("dataset"), "img", "cls")
    images = table(spark, d, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("dataset"), F.col("o_orderkey").alias("img")).distinct()
    images = images.select("dataset", "img", F.col("img").alias("img_ord"), (F.col("img") % 50).alias("stem"), (F.col("img") % 997).alias("hash"))
    ds = spark.createDataFrame([(k, k, "none" if k == 4 else "yolo", False, k == 3) for k in range(5)], "dataset int, ds_ord int, annotation string, never_train boolean, garbage boolean")
    held = spark.createDataFrame([(7,)], "stem long")
    maps = spark.createDataFrame([(k, c, c) for k in range(5) for c in range(4)], "dataset int, src_cls int, dst_cls int")
    return corpus.merge_reasons(images, b, ds, held, maps)


@query(f"{MERGE} select reason, count(*) as n from r group by 1")
def merge_counters(spark, d):
    return corpus.merge_counters(_merge(spark, d))


@query(f"{MERGE} select ds::int as dataset, img, case when (row_number() over (partition by ds order by img) - 1) % 10 = 0 then 'valid' else 'train' end as split from r where reason = 'kept'")
def val_split_10th(spark, d):
    return corpus.merged(_merge(spark, d))


@query(f"with {BOX_SQL}, c as (select cls, count(*) as instances, count(distinct img) as files from box group by 1), t as (select max(instances) as target from c) select cls, instances, files, least(10, ((target - instances) / greatest(instances / files * files, 1e0))::decimal(18, 6)::double // 1 + 1)::int as copies from c, t where instances < target")
def oversample_plan(spark, d):
    """Over all boxes, up to the size of the largest class."""
    return corpus.oversample_plan(boxes(spark, d), target=None)


@query(f"with {BOX_SQL}, i as (select img, bool_or(cls in (8, 9)) as h, bool_or(cls in (0, 1, 2, 5)) as t from box group by 1), s as (select img, case when h then 'holdout' when t then 'train' end as split from i where h or t) select box.img, idx as box_idx, (case when split = 'holdout' then cls else case cls when 0 then 0 when 1 then 1 when 2 then 2 when 5 then 3 end end)::int as cls, split from box join s on box.img = s.img where split = 'holdout' or cls in (0, 1, 2, 5)")
def leave_species_out(spark, d):
    return corpus.leave_classes_out(boxes(spark, d).withColumnRenamed("idx", "box_idx"), (8, 9), (0, 1, 2, 5)).select("img", "box_idx", "cls", "split")


# --- scalar functions --------------------------------------------------------------------------------------------------


@query("select event_id, coalesce(try_cast(v as double), case lower(trim(v)) when 'high' then 0.9 when 'medium' then 0.6 when 'low' then 0.3 end, 0.5)::double as conf from (select event_id, case event_id % 5 when 0 then 'High' when 1 then 'low ' when 2 then value::int::varchar when 3 then 'x' end as v from events)")
def norm_confidence(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, "High").when(F.col("event_id") % 5 == 1, "low ").when(F.col("event_id") % 5 == 2, F.rint("value").cast("int").cast("string")).when(F.col("event_id") % 5 == 3, "x")
    return events(spark, d).select("event_id", X.confidence(v).alias("conf"))


@query("select doc_id, left(lower(replace(replace(source || '/' || lang || '-v1', '/', '__'), '-', '_')), 60) as slug from documents")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slugify(F.concat("source", F.lit("/"), "lang", F.lit("-v1"))).alias("slug"))


@query("select event_id, json_extract_string(props, '$.k')::int as k from events")
def json_extract(spark, d):
    answer = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\ndone"))
    return table(spark, d, "events").select("event_id", F.get_json_object(X.extract_json(answer), "$.k").cast("int").alias("k"))


@query("select event_id, case when contains(lower(event_type), 'pur') then 'buy' when contains(lower(event_type), 'c') then 'see' end as action from events")
def keyword_action(spark, d):
    return table(spark, d, "events").select("event_id", X.first_keyword(F.col("event_type"), (("pur", "buy"), ("c", "see"))).alias("action"))


@query("with n as (select page_id, url, regexp_extract(url, '([^/]*)$', 1) as name from pages) select page_id, case when strpos(name[2:], '.') > 0 then left(name, length(name) - strpos(reverse(name), '.')) else name end as stem, case when strpos(name[2:], '.') > 0 then right(name, strpos(reverse(name), '.')) else '' end as suffix, case when url like 'https://%' then 'https' else 'http' end as scheme from n")
def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", X.path_stem(url).alias("stem"), X.path_suffix(url).alias("suffix"), F.when(F.startswith(url, F.lit("https://")), "https").otherwise("http").alias("scheme"))


@query(f"with {BOX_SQL} select img, idx, greatest(0e0, least(1e0, cx - w / 2)) as x1, greatest(0e0, least(1e0, cy - h / 2)) as y1, greatest(0e0, least(1e0, cx + w / 2)) as x2, greatest(0e0, least(1e0, cy + h / 2)) as y2 from box")
def box_convert(spark, d):
    out = G.yolo_to_xyxy(G.box_columns())
    return boxes(spark, d).select("img", "idx", *[c.alias(n) for c, n in zip(out, ("x1", "y1", "x2", "y2"), strict=True)])


@query(f"with {BOX_SQL}, v as (select img, idx, case idx % 3 when 0 then [cx, cy, w, h] when 1 then [cx * 100, cy * 100, w * 100, h * 100] else [cx * 900, cy, w, h] end as v from box) select img, idx, case when list_max(v) <= 1 then v[1] when list_max(v) <= 100 then v[1] / 1e2 end as first from v")
def coord_detect(spark, d):
    b = boxes(spark, d)
    v = F.when(F.col("idx") % 3 == 0, F.array("cx", "cy", "w", "h")).when(F.col("idx") % 3 == 1, F.array(*[F.col(c) * 100 for c in ("cx", "cy", "w", "h")])).otherwise(F.array(F.col("cx") * 900, "cy", "w", "h"))
    return b.select("img", "idx", G.detect_without_size(v)[0].alias("first"))


# --- experiments -------------------------------------------------------------------------------------------------------

RUNS = "runs as (select s_suppkey as iteration, s_nationkey as family, (s_suppkey * 37 % 101) / 1e2 as new_f1, (s_suppkey * 53 % 20 + 80) / 1e2 as old_f1 from supplier)"


def runs(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("iteration"), F.col("s_nationkey").alias("family"), ((k * 37 % 101) / F.lit(100.0)).alias("new_f1"), ((k * 53 % 20 + 80) / F.lit(100.0)).alias("old_f1"))


@query(f"with {RUNS}, x as (select *, max(new_f1) over (partition by family order by iteration rows between unbounded preceding and 1 preceding) as top from runs where old_f1 >= 0.9) select iteration, family, new_f1 from x where top is null or new_f1 > top")
def running_best(spark, d):
    r = runs(spark, d).withColumn("forgetting", F.col("old_f1") < 0.9)
    return experiments.running_best(r, by=("family",)).select("iteration", "family", "new_f1")


@query(f"with {RUNS} select iteration, family, count(*) over w = 3 and max(new_f1) over w - min(new_f1) over w < 0.3 as plateau from runs window w as (partition by family order by iteration rows between 2 preceding and current row)")
def plateau(spark, d):
    return experiments.plateau(runs(spark, d), by=("family",), under=0.3).select("iteration", "family", "plateau")


@query(f"with {RUNS}, b as (select new_f1 as n, old_f1 as o from runs where iteration = 1) select iteration, new_f1 - n as new_delta, old_f1 - o as old_delta, new_f1 > n as improved, old_f1 < 0.9 as forgetting from runs, b")
def assess(spark, d):
    r = runs(spark, d)
    return experiments.assess(r, r.filter("iteration = 1")).select("iteration", "new_delta", "old_delta", "improved", "forgetting")


@query("with r as (select l_suppkey % 4 as model, l_returnflag as ds, min(l_quantity) as q from lineitem group by 1, 2) select model, coalesce(max(q) filter (ds = 'A')::varchar, '--') as \"ds_A\", coalesce(max(q) filter (ds = 'N')::varchar, '--') as \"ds_N\", coalesce(max(q) filter (ds = 'Z')::varchar, '--') as \"ds_Z\" from r group by 1")
def pivot_models(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("model"), F.col("l_returnflag").alias("ds"), F.col("l_quantity").alias("q"))
    return experiments.pivot_table(rows, "model", "ds", ("A", "N", "Z"), "q", "q")


@query(f"with {BOX_SQL}, a as (select cls, avg(conf) as v from box where role = 0 group by 1), b as (select cls, avg(w) as v from box where role = 1 group by 1) select a.cls, round(a.v - b.v, 6) as delta from a join b on a.cls = b.cls where abs(a.v - b.v) > 0.05")
def drift(spark, d):
    b = boxes(spark, d)
    cur, base = b.filter("role = 0").groupBy("cls").agg(F.avg("conf").alias("value")), b.filter("role = 1").groupBy("cls").agg(F.avg("w").alias("value"))
    return experiments.drift(cur, base).select("cls", F.round("delta", 6).alias("delta"))


# --- space and time ----------------------------------------------------------------------------------------------------

POINTS = "pts as (select s_suppkey as pid, (s_suppkey * 131 % 1920)::double as px, (s_suppkey * 71 % 1080)::double as py, s_suppkey * 17 % 4096 as lx from supplier), q as (select c_custkey as qid, (c_custkey * 97 % 1920)::double as qx, (c_custkey * 61 % 1080)::double as qy from customer)"
NEAR = f"with {POINTS}, n as (select qid, pid, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) as dist from q, pts), r as (select *, row_number() over (partition by qid order by dist, pid) as rank from n)"


def _points(spark, d):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    pts = table(spark, d, "supplier").select(k.alias("pid"), (k * 131 % 1920).cast("double").alias("px"), (k * 71 % 1080).cast("double").alias("py"), (k * 17 % 4096).alias("lx"))
    return table(spark, d, "customer").select(c.alias("qid"), (c * 97 % 1920).cast("double").alias("qx"), (c * 61 % 1080).cast("double").alias("qy")), pts


@query(f"{NEAR} select qid, pid, dist, rank::int as rank from r where rank <= 5")
def knn_topk(spark, d):
    q, p = _points(spark, d)
    return joins.nearest(q, p.drop("lx"), 5)


@query(f"{NEAR}, w as (select qid, lx, 1 / greatest(dist, 1e-9) ** 2 as w from r join pts on r.pid = pts.pid where rank <= 5) select qid, greatest(0, least(4095, trunc(sum(w * lx) / sum(w) + 1e-9)::int)) as lx from w group by 1")
def idw_transform(spark, d):
    q, p = _points(spark, d)
    near = joins.nearest(q, p.drop("lx"), 5)
    return joins.inverse_distance(near, p.select("pid", "lx"), ["lx"])


@query(f"with {POINTS} select qid as id from q where qid not in (select pid from pts where pid % 20 = 0) and not exists (select 1 from pts where pid % 20 = 0 and sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) < 150)")
def radius_exclusion(spark, d):
    q, p = _points(spark, d)
    struck = p.filter("pid % 20 = 0").select(F.col("pid").alias("id"), F.col("px").alias("x"), F.col("py").alias("y"))
    return joins.radius_exclusion(q.select(F.col("qid").alias("id"), F.col("qx").alias("x"), F.col("qy").alias("y")), struck, 150.0).select("id")


@query(f"with {POINTS} select qid from q where (qx >= 100 and qx <= 900 and qy >= 50 and qy <= 700)")
def polygon_region(spark, d):
    q, _ = _points(spark, d)
    return q.filter(G.inside_polygon(F.col("qx"), F.col("qy"), [(100, 50), (900, 50), (900, 700), (100, 700)])).select("qid")


@query(f"with {EVENT_SQL}, c as (select user_id, ts, event_id from ev where event_type = 'click'), p as (select user_id, ts, event_id from ev where event_type = 'purchase'), j as (select p.event_id, (select max(struct_pack(ts := c.ts, event_id := c.event_id)) from c where c.user_id = p.user_id and c.ts <= p.ts) as b from p) select event_id, b.event_id as asof_click_id from j")
def asof_latest(spark, d):
    e = events(spark, d)
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    out = joins.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ("user_id",), "ts", "click_ts", ("click_id",))
    return out.select("event_id", "asof_click_id")


@query(f"with {EVENT_SQL}, r as (select user_id as rid, ts from ev where event_type = 'click'), s as (select user_id as rid, ts, event_id from ev where event_type = 'purchase'), j as (select r.rid, r.ts, s.ts as t2, s.event_id from r left join s on r.rid = s.rid and s.ts >= r.ts and s.ts <= r.ts + interval 6 hours) select rid as request_id, epoch_us(ts) as ts_us, epoch_us(min(t2)) as response_us from j group by rid, ts")
def correlate_request(spark, d):
    e = events(spark, d)
    req, res = e.filter("event_type = 'click'").select(F.col("user_id").alias("request_id"), "ts"), e.filter("event_type = 'purchase'").select(F.col("user_id").alias("request_id"), "ts", F.col("event_id").alias("data"))
    out = joins.correlate(req, res, "6 hours")
    return out.select("request_id", F.unix_micros("ts").alias("ts_us"), F.unix_micros("response_ts").alias("response_us"))


@query(f"with {EVENT_SQL} select epoch_us(time_bucket(interval 1 day, ts, timestamp '1970-01-01')) as start_us, count(*) as events, count(*) filter (event_type = 'click') as n_click, count(*) filter (event_type = 'purchase') as n_purchase, round(avg(nullif(value, 0)), 6) as avg_latency from ev group by 1")
def tumbling_summary(spark, d):
    out = E.tumbling_summary(events(spark, d), ("click", "purchase"), "1 day")
    return out.select(F.unix_micros("window_start").alias("start_us"), "events", "n_click", "n_purchase", F.round("avg_latency", 6).alias("avg_latency"))


@query(f"with {EVENT_SQL} select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 99 preceding and current row), 9) as avg_last from ev")
def sliding_avg_100(spark, d):
    return E.sliding_average(events(spark, d), "value", ("user_id",)).select("event_id", F.round("avg_last", 9).alias("avg_last"))


@query(f"with {EVENT_SQL}, a as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 21600000000 then 0 else 1 end as n from ev), s as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as grp from a) select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 6 hours) as end_us, count(*) as events from s group by user_id, grp")
def session_heartbeat(spark, d):
    out = E.sessions(events(spark, d), ("user_id",), "6 hours")
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "events")


@query(f"with {EVENT_SQL}, l as (select *, lag(event_type) over o as old_state, row_number() over o as n from ev window o as (partition by user_id order by ts, event_id)) select event_id, old_state from l where n = 1 or old_state is distinct from event_type")
def mode_changes(spark, d):
    return E.changes(events(spark, d), "event_type", ("user_id",)).select("event_id", "old_state")


@query(f"with recursive {EVENT_SQL}, o as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from ev), r as (select user_id, n, event_id, ts as last, true as pass from o where n = 1 union all select o.user_id, o.n, o.event_id, case when o.ts - r.last >= interval 12 hours then o.ts else r.last end, o.ts - r.last >= interval 12 hours from r join o on o.user_id = r.user_id and o.n = r.n + 1) select user_id, event_id from r where pass")
def rate_limit(spark, d):
    return E.rate_limit(events(spark, d), ("user_id",), 12 * 3600.0).select("user_id", "event_id")


@query(f"with {EVENT_SQL}, r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as n from ev) select event_type, event_id from r where n <= 20")
def last_n(spark, d):
    return E.last_n(events(spark, d), 20, ("event_type",)).select("event_type", "event_id")


@query(f"with {EVENT_SQL}, l as (select event_id, value as x, k::double as y, ts, lag(value) over o as px, lag(k) over o as py, lag(ts) over o as pt from ev window o as (partition by user_id order by ts, event_id)), v as (select *, (epoch_us(ts) - epoch_us(pt)) / 1e6 as dt from l) select event_id, round(case when dt > 0 then case when sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 2 then 0 else (x - px) / dt end end, 9) as vx from v")
def velocity_lag(spark, d):
    p = events(spark, d).select("event_id", "user_id", "ts", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))
    return E.velocity(p, ("user_id",)).select("event_id", F.round("vx", 9).alias("vx"))


CAND = "c as (select event_id as id, user_id, event_type = 'click' as targeted, k % 2 = 0 as is_moving, value as speed, 0.5::double as consistency, (k % 10) / 1e1 as confidence, (k % 4)::double as age from ev)"


@query(f"with {EVENT_SQL}, {CAND}, s as (select id, user_id, case when is_moving then speed * consistency * confidence * least(1e0, age / 3) else confidence * least(1e0, age / 0.5::double) end as priority from c where not targeted and age >= 0.5), r as (select *, row_number() over (partition by user_id order by priority desc, id) as n from s) select user_id, id, priority from r where n = 1")
def target_rank(spark, d):
    e = events(spark, d)
    c = e.select(F.col("event_id").alias("id"), "user_id", (F.col("event_type") == "click").alias("targeted"), (F.col("k") % 2 == 0).alias("is_moving"), F.col("value").alias("speed"), F.lit(0.5).alias("consistency"), ((F.col("k") % 10) / F.lit(10.0)).alias("confidence"), F.lit(0.0).alias("first_seen"), (F.col("k") % 4).cast("double").alias("now"))
    return E.rank_targets(c, by=("user_id",))


# --- sets --------------------------------------------------------------------------------------------------------------


@query("select source, min(doc_id) as first_at from documents group by 1")
def distinct_first(spark, d):
    return experiments.distinct_first(table(spark, d, "documents"), "source", "doc_id")


@query("select lang, count(*) as n, count(distinct source) as sources from documents group by 1")
def category_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("(select o_custkey as k from orders intersect select c_custkey from customer where c_nationkey < 10) except select s_suppkey from supplier")
def set_ops(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("k"))
    return o.intersect(c).subtract(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query(f"with {BOX_SQL}, s as (select img % 5 as dataset, src, avg(conf) as p, avg(w) as r from box group by 1, 2), b as (select dataset, arg_max(src, p) as best_precision from s group by 1) select b.dataset::int as dataset, best_precision, (select src from s where s.dataset = b.dataset and src <> best_precision order by r desc limit 1) as best_recall from b")
def top2_sources(spark, d):
    s = boxes(spark, d).groupBy((F.col("img") % 5).cast("int").alias("dataset"), "src").agg(F.avg("conf").alias("precision"), F.avg("w").alias("recall"))
    return experiments.top_sources(s, by=("dataset",))
