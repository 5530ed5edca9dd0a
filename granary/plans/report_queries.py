"""Registered queries of readers of small files, samples, reports and rules that other queries do not reach, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import corpus, experiments, fusion, matching, metrics
from granary.operators import events as E
from granary.plans.edge_queries import ORACLE, QUERIES
from granary.plans.more_queries import IMAGES, _image_boxes
from granary.plans.queries import F1, FUSE, PG, PRF, both, query
from granary.plans.views import BOX_SQL, EVENT_SQL, boxes, detector, events, greedy_sql, table
from granary.sources import labels, registry, sinks
from granary.storage import fresh

__all__ = ["ORACLE", "QUERIES"]

# --- boxes -------------------------------------------------------------------------------------------------------------


@query(f"with recursive {BOX_SQL}, p as (select img, idx as pred_idx, 0 as cls, conf, cx, cy, w, h from box where role = 0 and cls < 8 and conf >= 0.7), g as (select img, idx as gt_idx, 0 as cls, cx, cy, w, h from box where role = 1 and cls < 8), {greedy_sql('m', 'p', 'g', 0.5, 'conf desc, pred_idx', 'img, cls')}, c as (select count(gt_idx) as tp, count(*) - count(gt_idx) as fp, (select count(*) from g) - count(gt_idx) as fn from m), r as (select *, {PRF} from c) select 0.5::double as threshold, *, {F1} from r")
def eval_binary_confident(spark, d):
    """All classes but the negative ones as one, confident predictions alone."""
    p, g = (metrics.collapsed(x, negative=(8, 9, 10, 11)) for x in both(spark, d))
    return metrics.evaluate(matching.greedy_match(metrics.confident(p, 0.7), g, keys=("img", "cls")), g)


@query(f"with {BOX_SQL}, {PG}, n as (select img % 5 as ds, count(*) as n from g group by 1), q as (select img % 5 as ds, count(*) as m from p group by 1) select 0e0 as threshold_tp, n.ds::int as ds, 0::bigint as tp, 0::bigint as fp, n.n as fn, 0e0 as precision, 0e0 as recall, 0e0 as f1 from n where n.ds = 0 union all select 0e0, 1, 0, 0, 0, 0e0, 0e0, 0e0")
def eval_empty(spark, d):
    """No predictions for one data set, no true boxes for another: nothing is found, and false positives are not counted."""
    p, g = both(spark, d)
    own = lambda x, k: x.filter(F.col("img") % 5 == k)
    none, out = F.lit(False), None
    for k, (pp, gg) in enumerate(((own(p, 0).filter(none), own(g, 0)), (own(p, 1), own(g, 1).filter(none)))):
        row = metrics.evaluate_or_zero(matching.greedy_match(pp, gg), gg).select(F.lit(0.0).alias("threshold_tp"), F.lit(k).alias("ds"), "tp", "fp", "fn", "precision", "recall", "f1")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {BOX_SQL}, n as (select r::int as cls, 'class ' || r as name from range(0, 15) t(r)) select n.cls, name, count(box.cls) as boxes, count(distinct img) as images from n left join box on box.cls = n.cls and role = 1 group by 1, 2")
def class_counts(spark, d):
    """Classes without boxes have a row as well."""
    names = spark.range(15).select(F.col("id").cast("int").alias("cls"), F.concat(F.lit("class "), "id").alias("name"))
    return metrics.class_counts(boxes(spark, d).filter("role = 1"), names)


@query(f"{FUSE}, o as (select 'first' as src from p union all select 'second' from g where conf >= 0.6 and not exists (select 1 from m where m.img = g.img and m.gt_idx = g.gt_idx)) select src, count(*) as n from o group by 1")
def fused_sources(spark, d):
    b = boxes(spark, d)
    fused = fusion.fuse(detector(b, 0, 1, 2).drop("src"), detector(b, 3, 4, 5).drop("src"), "supplement", 0.3, second_conf=0.6)
    return fusion.source_counts(fused)


@query(f"with {IMAGES} select img, box_idx::int as box_idx, cls, round(cx, 4) as cx, round(cy, 4) as cy, round(w * 2, 4) as w, round(h, 4) as h, 0.5::double as conf from ib where round(w * 2, 6) < 1")
def yolo_sane_boxes(spark, d):
    """Boxes wider than the image are left out on reading; 0.5 where no confidence is given."""
    b, images = _image_boxes(spark, d)
    path = fresh(spark, "yolo")
    sinks.write_yolo(b.withColumn("w", F.col("w") * 2), path, images)
    return labels.yolo(spark, path, default_conf=0.5, sane=True).select("img", "box_idx", "cls", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "w", "h")], "conf")


# --- small files -------------------------------------------------------------------------------------------------------


@query("select s_nationkey || '_r' || (s_suppkey % 10) as name, '{\"k\": ' || max(s_suppkey) || '}' as json from supplier where s_suppkey % 10 <> 7 group by s_nationkey, s_suppkey % 10")
def result_tree(spark, d):
    """JSON files below folders; those that hold none are skipped."""
    path, k = fresh(spark, "results"), F.col("s_suppkey")
    rows = table(spark, d, "supplier").groupBy("s_nationkey", (k % 10).alias("r")).agg(F.max("s_suppkey").alias("k"))
    text = F.when(F.col("r") == 7, "no object").otherwise(F.format_string('{"k": %d} trailing }', "k"))
    sinks.write_texts(rows.select(F.concat("s_nationkey", F.lit("/r"), "r").alias("img"), text.alias("text")), path, ".json")
    return labels.results(spark, path).select("name", "json")


@query("with s as (select 's' || s_suppkey as slug, case when s_suppkey % 3 = 0 then 'downloaded' else 'candidate' end as status, s_suppkey % 50 as images from supplier), f as (select 's' || s_suppkey as slug, 'downloaded' as status, s_suppkey % 7 as local_images from supplier where s_suppkey % 4 = 0 union all select 'x' || s_suppkey, 'downloaded', 1 from supplier where s_suppkey % 9 = 0) select coalesce(s.slug, f.slug) as slug, coalesce(f.status, s.status) as status, s.images::bigint as images, f.local_images::bigint as local_images from s full join f using (slug)")
def registry_merge(spark, d):
    """Registry files of up to 100 entries read, entries found on disk merged in, a snapshot written and read back."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    entry = F.struct(F.when(k % 3 == 0, "downloaded").otherwise("candidate").alias("status"), (k % 50).alias("images"))
    path = fresh(spark, "registry")
    doc = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), k), entry))).alias("datasets")))
    sinks.write_texts(s.groupBy(F.floor(k / 100).alias("n")).agg(doc.alias("text")).select(F.col("n").cast("string").alias("img"), "text"), path, ".json")
    found = s.filter(k % 4 == 0).select(F.concat(F.lit("s"), k).alias("slug"), F.lit("downloaded").alias("status"), (k % 7).cast("long").alias("local_images"))
    found = found.unionByName(s.filter(k % 9 == 0).select(F.concat(F.lit("x"), k).alias("slug"), F.lit("downloaded").alias("status"), F.lit(1).cast("long").alias("local_images")))
    at = registry.snapshot(registry.merged(registry.read(spark, path), found), fresh(spark, "snapshots"), 1)
    return spark.read.parquet(at).select("slug", "status", "images", "local_images")


@query("select s_nationkey as model, max(s_suppkey) as epoch, arg_max(s_suppkey % 89 / 89e0, s_suppkey) as value from supplier group by 1")
def last_metrics(spark, d):
    """Metric files, one per model: the last row's value of the column that holds the metric."""
    path = fresh(spark, "metrics")
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("epoch"), ((F.col("s_suppkey") * 3) % 10).alias(" loss"), (F.col("s_suppkey") % 89 / F.lit(89.0)).alias("  metrics/mAP50-95(B)"))
    s.repartition("s_nationkey").write.partitionBy("s_nationkey").option("header", True).csv(path)
    out = labels.metrics_csv(spark, path)
    return out.select(F.regexp_extract("file", "s_nationkey=([0-9]+)", 1).cast("int").alias("model"), F.col("epoch").cast("long").alias("epoch"), "value")


@query("select (s_suppkey % 640)::double as camera_x, (s_suppkey % 480)::double as camera_y, (s_suppkey * 7 % 4096)::int as laser_x, (s_suppkey * 11 % 4096)::int as laser_y from supplier")
def calibration_points(spark, d):
    """Both layouts of calibration files, of up to 100 points."""
    path, k = fresh(spark, "calibration"), F.col("s_suppkey")
    point = F.struct((k % 640).cast("double").alias("camera_x"), (k % 480).cast("double").alias("camera_y"), (k * 7 % 4096).alias("laser_x"), (k * 11 % 4096).alias("laser_y"))
    rows = table(spark, d, "supplier").groupBy(F.floor(k / 100).alias("n")).agg(F.collect_list(point).alias("p"))
    doc = F.when(F.col("n") % 2 == 0, F.to_json(F.struct(F.col("p").alias("points")))).otherwise(F.to_json(F.struct(F.col("p").alias("calibration_points"))))
    sinks.write_texts(rows.select(F.col("n").cast("string").alias("img"), doc.alias("text")), path, ".json")
    return registry.calibration(spark, path)


# --- texts, samples, usage ---------------------------------------------------------------------------------------------


@query("select page_id, case when page_id % 3 = 0 then 'a/labels/train/' when page_id % 3 = 1 then 'labels/' else 'a/pics/' end || 'p.' || page_id || '.txt' as path from pages")
def label_paths(spark, d):
    k = F.col("page_id")
    folder = F.when(k % 3 == 0, "a/images/train/").when(k % 3 == 1, "images/").otherwise("a/pics/")
    return table(spark, d, "pages").select("page_id", X.label_path(F.concat(folder, F.lit("p."), k, F.lit(".jpg"))).alias("path"))


@query("with t as (select page_id, lower(url) || case when page_id % 3 = 0 then '/Weed' when page_id % 4 = 0 then '/Plant' else '' end as t from pages) select page_id, case when contains(lower(t), 'weed') then 'weed' when contains(lower(t), 'plant') then 'plant' else 'unknown' end as label, contains(t, 'Plant') or contains(t, '/Weed') as mentions from t")
def path_labels(spark, d):
    t = F.concat(F.lower("url"), F.when(F.col("page_id") % 3 == 0, "/Weed").when(F.col("page_id") % 4 == 0, "/Plant").otherwise(""))
    return table(spark, d, "pages").select("page_id", X.first_keyword(t, (("weed", "weed"), ("plant", "plant")), "unknown").alias("label"), X.has_any(t, ("Plant", "/Weed")).alias("mentions"))


@query("with o as (select text from documents where doc_id % 2 = 0), n as (select text, min(doc_id) as first_id from documents where doc_id % 2 = 1 and text is not null group by 1) select first_id from n where not exists (select 1 from o where o.text = n.text)")
def new_lessons(spark, d):
    """Lessons whose exact text is not known yet, each once."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    known, new = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1")
    return corpus.new_texts(new, known, "text", "doc_id").select(F.col("doc_id").alias("first_id"))


@query("with r as (select source, doc_id, row_number() over (partition by source order by md5('42|' || doc_id), doc_id) as n from documents) select source, doc_id from r where n <= 6")
def sample_per_source(spark, d):
    return corpus.sample_each(table(spark, d, "documents").select("source", "doc_id"), ("source",), "doc_id", 6)


@query("select doc_id from documents order by md5('42|' || doc_id), doc_id limit 49")
def replay_sample(spark, d):
    """Rows for a replay buffer, without replacement: a third of a batch with 100 new ones, cut off to 49."""
    n = spark.range(1).select(corpus.replay_size(100, 1 / 3)).first()[0]
    return corpus.sample_n(table(spark, d, "documents").select("doc_id"), "doc_id", n)


@query(f"with {EVENT_SQL} select event_type as tool, count(*) as calls, round(sum(value), 4) as seconds, case when event_type <> 'error' then round(count(*) / sum(count(*)) filter (event_type <> 'error') over (), 9) end as share from ev group by 1")
def tool_usage(spark, d):
    """Calls and time of each tool, and its share of the calls of tools that do something."""
    log = events(spark, d).select(F.col("event_type").alias("tool"), F.col("value").alias("seconds"))
    return experiments.tool_usage(log, meta=("error",)).select("tool", "calls", F.round("seconds", 4).alias("seconds"), F.round("share", 9).alias("share"))


@query(f"with {EVENT_SQL} select event_id, least(1e0, value / 25) as done from ev")
def firing_progress(spark, d):
    return events(spark, d).select("event_id", E.progress(F.col("value"), F.lit(25.0)).alias("done"))
