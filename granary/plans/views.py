"""Stand-in relations over the test tables, in Spark and as SQL for the oracle. Both sides must agree to the bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, idx, role (1 true box, 0 prediction), src, cls, conf, cx, cy, w, h from line items; several per order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    # Numbered before anything is worked out: the shuffle has the table's columns alone, and boxes are then known to lie by img.
    t = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))
    return t.select(
        F.col("l_orderkey").alias("img"), (F.col("n") - 1).cast("long").alias("idx"), (F.col("l_linenumber") % 2).cast("int").alias("role"), (F.col("l_suppkey") % 7).cast("int").alias("src"),
        (F.col("l_partkey") % 12).cast("int").alias("cls"), (1 - 5 * F.col("l_discount")).alias("conf"), ((F.col("l_partkey") % 40 + 30) / F.lit(100.0)).alias("cx"), ((F.col("l_suppkey") % 40 + 30) / F.lit(100.0)).alias("cy"),
        (F.lit(0.2) + F.col("l_quantity") / 100.0).alias("w"), (F.lit(0.3) + 4 * F.col("l_tax")).alias("h"),
    )


def true_boxes(b: DataFrame) -> DataFrame:
    return b.filter("role = 1").withColumnRenamed("idx", "gt_idx").drop("role", "src", "conf")


def predicted(b: DataFrame) -> DataFrame:
    return b.filter("role = 0").withColumnRenamed("idx", "pred_idx").drop("role", "src")


def detector(b: DataFrame, *src: int) -> DataFrame:
    return b.filter(F.col("src").isin(*src)).withColumnRenamed("idx", "box_idx").drop("role")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as a timestamp (UTC) and k from props."""
    t = table(spark, sf_dir, "events")
    return t.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


BOX_SQL = """box as (
  select l_orderkey as img, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as idx,
    (l_linenumber % 2)::int as role, (l_suppkey % 7)::int as src, (l_partkey % 12)::int as cls, 1 - 5 * l_discount as conf,
    (l_partkey % 40 + 30) / 1e2 as cx, (l_suppkey % 40 + 30) / 1e2 as cy, 0.2::double + l_quantity / 1e2 as w, 0.3::double + 4 * l_tax as h
  from lineitem)"""


def iou_sql(a: str, b: str) -> str:
    """The overlap of boxes a and b, in the order of operations that the Spark side has."""
    x1, y1, x2, y2 = (lambda t: (f"({t}.cx - {t}.w / 2)", f"({t}.cy - {t}.h / 2)", f"({t}.cx + {t}.w / 2)", f"({t}.cy + {t}.h / 2)"))(a)
    u1, v1, u2, v2 = (lambda t: (f"({t}.cx - {t}.w / 2)", f"({t}.cy - {t}.h / 2)", f"({t}.cx + {t}.w / 2)", f"({t}.cy + {t}.h / 2)"))(b)
    i = f"(greatest(0e0, least({x2}, {u2}) - greatest({x1}, {u1})) * greatest(0e0, least({y2}, {v2}) - greatest({y1}, {v1})))"
    union = f"(({x2} - {x1}) * ({y2} - {y1}) + ({u2} - {u1}) * ({v2} - {v1}) - {i})"
    return f"case when {union} > 0 then {i} / {union} else 0e0 end"


def greedy_sql(name: str, pred: str, gt: str, threshold: float, order: str, keys: str = "img", best: str | None = None) -> str:
    """CTEs that end in `name`(keys, pred_idx, conf, gt_idx): greedy matching as a recursion over the predictions of an
    image in order; `best` orders the boxes that one may take."""
    best = best or f"{iou_sql('p', 'g')} desc, g.gt_idx"
    ks = keys.split(", ")
    on = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    pk = lambda t: ", ".join(f"{t}.{k}" for k in ks)
    return f"""{name}_p as (select *, row_number() over (partition by {keys} order by {order}) as n from {pred}),
{name}_c as (select {pk('p')}, p.n, list(g.gt_idx order by {best}) as l from {name}_p p join {gt} g on {on('p', 'g')} and {iou_sql('p', 'g')} >= {threshold} group by {pk('p')}, p.n),
{name}_q as (select p.*, coalesce(c.l, []) as l from {name}_p p left join {name}_c c on {on('c', 'p')} and c.n = p.n),
{name}_r as (
  select {keys}, n, pred_idx, conf, l[1] as gt_idx, case when l[1] is null then [] else [l[1]] end as used from {name}_q where n = 1
  union all
  select {pk('q')}, q.n, q.pred_idx, q.conf, list_filter(q.l, lambda x: not list_contains(r.used, x))[1],
    case when list_filter(q.l, lambda x: not list_contains(r.used, x))[1] is null then r.used else list_append(r.used, list_filter(q.l, lambda x: not list_contains(r.used, x))[1]) end
  from {name}_r r join {name}_q q on {on('q', 'r')} and q.n = r.n + 1),
{name} as (select {keys}, pred_idx, conf, gt_idx from {name}_r)"""


EVENT_SQL = "ev as (select event_id, ts, user_id, event_type, value, (props->>'$.k')::int as k from events)"
