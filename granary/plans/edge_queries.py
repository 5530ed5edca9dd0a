"""Registered queries of edge devices' frames and packets, agents, struck targets, dwell and rules, pictures, discovery and
agreement across data sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import frames, pixels
from granary.operators import agents, joins, metrics
from granary.operators import events as E
from granary.plans.more_queries import ORACLE, QUERIES
from granary.plans.queries import PG, both, query
from granary.plans.views import BOX_SQL, EVENT_SQL, events, iou_sql, table
from granary.streaming import struck, tracking

__all__ = ["ORACLE", "QUERIES"]

# --- struck targets, dwell, rules --------------------------------------------------------------------------------------

SEEN = f"""{EVENT_SQL}, seen as (select event_id, user_id as key, epoch_us(ts) / 3.6e9 as t, case when event_type = 'purchase' then 'strike' else 'sight' end as kind, k % 30 as id, value * 9 as x, k * 9e0 as y,
  case when k % 5 <> 0 then value - 20 end as vx, case when k % 5 <> 0 then k - 50e0 end as vy from ev),
s as (select *, sqrt(vx * vx + vy * vy) as speed from seen where kind = 'strike'), q as (select *, sqrt(vx * vx + vy * vy) as speed from seen where kind = 'sight'),
m as (select *, lead({{'t': t, 'e': event_id}}) over (partition by key, id order by t, event_id) as next from s where speed > 0),
b as (select *, case when speed > 0 then x + vx / speed * 20 else x end as px, case when speed > 0 then y + vy / speed * 20 else y end as py, case when speed > 0 then -vy / speed else 1e0 end as bx, case when speed > 0 then vx / speed else 0e0 end as b_y
  from s qualify row_number() over (partition by key order by t, event_id) = 1)"""


def _seen(spark, d):
    k, v = F.col("k"), F.col("value")
    moving = k % 5 != 0
    return events(spark, d).select(
        "event_id", F.col("user_id").alias("key"), (F.unix_micros("ts") / 3.6e9).alias("t"), F.when(F.col("event_type") == "purchase", "strike").otherwise("sight").alias("kind"), (k % 30).cast("long").alias("id"),
        (v * 9).alias("x"), (k * F.lit(9.0)).alias("y"), F.when(moving, v - 20).alias("vx"), F.when(moving, k - F.lit(50.0)).alias("vy"),
    )


@query(
    f"""with {SEEN} select event_id, key, id, case
  when exists (select 1 from s where s.key = q.key and s.id = q.id and (s.t < q.t or (s.t = q.t and s.event_id < q.event_id))) then 'id'
  when exists (select 1 from s where s.key = q.key and (s.t < q.t or (s.t = q.t and s.event_id < q.event_id)) and q.t - s.t < 20 and sqrt((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y)) < 150) then 'zone'
  when exists (select 1 from m where m.key = q.key and m.id <> q.id and (m.t < q.t or (m.t = q.t and m.event_id < q.event_id)) and (m.next is null or not (m.next.t < q.t or (m.next.t = q.t and m.next.e < q.event_id)))
    and q.speed > 0 and (q.vx * m.vx + q.vy * m.vy) / (q.speed * m.speed) > 0.85 and abs(q.speed - m.speed) < 15) then 'trajectory'
  when exists (select 1 from b where b.key = q.key and (b.t < q.t or (b.t = q.t and b.event_id < q.event_id)) and abs((q.y - b.py) * b.bx - (q.x - b.px) * b.b_y) < 80 and abs((q.x - b.px) * b.bx + (q.y - b.py) * b.b_y) < 100) then 'baseline' end as reason from q"""
)
def struck_memory(spark, d):
    return struck.struck_before(_seen(spark, d))


@query(
    f"""with recursive {EVENT_SQL}, p as (select user_id as key, k % 3 as id, epoch_us(ts) / 3.6e9 as t, value as x, k / 4e0 as y from ev), o as (select *, row_number() over (partition by key, id order by t, x, y) as n from p),
r as (select key, id, n, t as t0, x as x0, y as y0, null::double as fire from o where n = 1
  union all select o.key, o.id, o.n, case when far then o.t else r.t0 end, case when far then o.x else r.x0 end, case when far then o.y else r.y0 end, coalesce(r.fire, case when not far and o.t - r.t0 >= 3 then o.t end)
  from r join o on o.key = r.key and o.id = r.id and o.n = r.n + 1, lateral (select sqrt((o.x - r.x0) * (o.x - r.x0) + (o.y - r.y0) * (o.y - r.y0)) > 12 as far))
select key, id, max(fire) as fire_at from r where fire is not null group by key, id"""
)
def stationary_dwell(spark, d):
    p = events(spark, d).select(F.col("user_id").alias("key"), (F.col("k") % 3).cast("long").alias("id"), (F.unix_micros("ts") / 3.6e9).alias("t"), F.col("value").alias("x"), (F.col("k") / F.lit(4.0)).alias("y"))
    return tracking.dwell(p, radius=12.0, timeout=3.0)


@query(
    f"""with recursive {EVENT_SQL}, a as (select user_id, event_id, ts, avg(value) over w as l, avg(k) over w as n, row_number() over (partition by user_id order by ts, event_id) as i from ev window w as (partition by user_id order by ts, event_id rows between 99 preceding and current row)),
r as (select user_id, i, event_id, ts as last, true as pass from a where i = 1 union all select a.user_id, a.i, a.event_id, case when a.ts - r.last >= interval 12 hours then a.ts else r.last end, a.ts - r.last >= interval 12 hours from r join a on a.user_id = r.user_id and a.i = r.i + 1),
z as (select a.* from a join r using (user_id, event_id) where r.pass)
select user_id, event_id, 'decrease' as direction from z where l > 21.0123::double union all select user_id, event_id, 'increase' from z where n > 49.0123::double"""
)
def rule_suggestions(spark, d):
    e = E.sliding_average(events(spark, d), "value", ("user_id",)).withColumnRenamed("avg_last", "avg_latency")
    e = E.sliding_average(e, "k", ("user_id",)).withColumnRenamed("avg_last", "avg_detections")
    return E.suggestions(e, ("user_id",), 21.0123, 49.0123, 12 * 3600.0).select("user_id", "event_id", "direction")


# --- frames and packets ------------------------------------------------------------------------------------------------

#: Frames of events as hex digits: a video frame's time is made of digits of md5, so that all its bits count.
FRAME = "case k % 6 when 1 then '01' || case k % 4 when 0 then '40' when 1 then '41' when 2 then 'c0' else '3f' end || substr(md5(event_id::varchar), 1, 14 + 2 * (k % 9)) when 3 then '03' || hex(encode((value)::varchar)) when 5 then '05ff' when 0 then '00' || hex(encode('{\"k\": ' || k || '}')) when 2 then '02' || hex(encode('{\"v\": ' || k || '}')) else '04' || hex(encode('{}')) end"


@query(
    f"""with {EVENT_SQL}, f as (select event_id, lower({FRAME}) as h from ev), p as (select event_id, h, substr(h, 1, 2) as tag, substr(h, 3) as rest from f),
n as (select *, ('0x' || substr(rest, 1, 4))::ubigint as head, ('0x0' || substr(rest, 4, 13))::ubigint as m from p where tag = '01'),
v as (select event_id, case when head >> 15 = 1 then -1e0 else 1e0 end * (4503599627370496 + m)::double * pow(2e0, (((head >> 4) & 2047)::int - 1075)) as taken_at from n)
select p.event_id, case tag when '00' then 'json' when '01' then 'video' when '02' then 'sensor_data' when '03' then 'heartbeat' when '04' then 'remote_control' end as kind, v.taken_at,
  case when tag = '01' then length(h) // 2 - 9 end as size, case when tag = '03' then decode(unhex(rest))::double end as latency_ms, case when tag in ('00', '02', '04') then decode(unhex(rest)) end as json from p left join v on v.event_id = p.event_id"""
)
def edge_frames(spark, d):
    k, e = F.col("k"), F.col("event_id").cast("string")
    first = F.when(k % 4 == 0, "40").when(k % 4 == 1, "41").when(k % 4 == 2, "c0").otherwise("3f")
    said = lambda tag, text: F.concat(F.lit(tag), F.hex(F.encode(text, "UTF-8")))
    digits = (
        F.when(k % 6 == 1, F.concat(F.lit("01"), first, F.substring(F.md5(e), F.lit(1), 14 + 2 * (k % 9)))).when(k % 6 == 3, said("03", F.col("value").cast("string")))
        .when(k % 6 == 5, F.lit("05ff")).when(k % 6 == 0, said("00", F.format_string('{"k": %d}', k))).when(k % 6 == 2, said("02", F.format_string('{"v": %d}', k))).otherwise(said("04", F.lit("{}")))
    )
    return frames.frames(events(spark, d).select("event_id", F.unhex(digits).alias("data")), keep=("event_id",))


LINE = "case when k % 7 = 0 then '{\"channels\": [' || k || ', 1500], \"switches\": [true, false]}' when k % 7 = 1 then 'noise ' || k else 'DATA ' || event_id || ' CH1:' || k || ' CH10:' || (1000 + k) || ' CH1:' || case when k % 2 = 0 then 'x' else (k + 1)::varchar end || ' SW:' || case when k % 3 = 0 then '01' else '000' || (k % 2) || '010' end end"


@query(
    f"""with {EVENT_SQL}, l as (select event_id, k, {LINE} as line from ev)
select event_id, case when k % 7 = 0 then k when k % 7 > 1 then case when k % 2 = 0 then k else k + 1 end end as ch1, case when k % 7 = 0 then 1500 end as ch2, case when k % 7 > 1 then 1000 + k end as ch10,
  case when k % 7 = 0 then 'true,false' when k % 7 > 1 and k % 3 <> 0 then 'false,false,false,' || (k % 2 = 1)::varchar || ',false,true,false' end as switches from l"""
)
def control_packets(spark, d):
    k = F.col("k")
    s = lambda c: c.cast("string")
    line = F.concat(F.lit("DATA "), s(F.col("event_id")), F.lit(" CH1:"), s(k), F.lit(" CH10:"), s(1000 + k), F.lit(" CH1:"), F.when(k % 2 == 0, "x").otherwise(s(k + 1)), F.lit(" SW:"), F.when(k % 3 == 0, "01").otherwise(F.concat(F.lit("000"), s(k % 2), F.lit("010"))))
    line = F.when(k % 7 == 0, F.concat(F.lit('{"channels": ['), s(k), F.lit(', 1500], "switches": [true, false]}'))).when(k % 7 == 1, F.concat(F.lit("noise "), s(k))).otherwise(line)
    p = events(spark, d).select("event_id", frames.control_packet(line).alias("p"))
    return p.select("event_id", *[F.get("p.channels", F.lit(c - 1)).alias(f"ch{c}") for c in (1, 2, 10)], F.array_join(F.transform("p.switches", lambda x: x.cast("string")), ",").alias("switches"))


# --- agents ------------------------------------------------------------------------------------------------------------

AGENTS = f"""{EVENT_SQL}, log as (select user_id as agent, ts, event_id, case when event_type = 'click' then 'register' when event_type = 'error' then 'unregister' else 'heartbeat' end as kind, [chr(97 + k % 5), chr(97 + k % 3)] as caps from ev),
t as (select max(ts) as now from log), j as (select agent, max({{'ts': ts, 'e': event_id}}) filter (kind = 'register') as j, max({{'ts': ts, 'e': event_id}}) filter (kind = 'unregister') as w from log group by 1),
on_ as (select * from j where j is not null and (w is null or j > w)),
reg as (select o.agent, c.caps, o.j.ts as registered_at, (select count(*) from log l where l.agent = o.agent and kind = 'register' and (w is null or {{'ts': l.ts, 'e': l.event_id}} > w) and {{'ts': l.ts, 'e': l.event_id}} < j) as replaced,
  (select max(l.ts) from log l where l.agent = o.agent and kind = 'heartbeat' and {{'ts': l.ts, 'e': l.event_id}} > j) as last_seen from on_ o join log c on c.agent = o.agent and c.event_id = o.j.e),
a as (select *, (epoch_us(now) - epoch_us(coalesce(last_seen, registered_at))) / 1e6 < 86400 as healthy from reg, t)"""


def _agents(spark, d):
    e, k = events(spark, d), F.col("k")
    kind = F.when(F.col("event_type") == "click", "register").when(F.col("event_type") == "error", "unregister").otherwise("heartbeat")
    log = e.select(F.col("user_id").alias("agent"), "ts", "event_id", kind.alias("kind"), F.array(F.char(97 + k % 5), F.char(97 + k % 3)).alias("capabilities"))
    return agents.registry(log, timeout=86400.0)


@query(f"with {AGENTS} select agent, caps[1] || caps[2] as capabilities, epoch_us(registered_at) as registered_us, replaced, epoch_us(last_seen) as seen_us, healthy from a")
def agent_registry(spark, d):
    a = _agents(spark, d)
    return a.select("agent", F.array_join("capabilities", "").alias("capabilities"), F.unix_micros("registered_at").alias("registered_us"), "replaced", F.unix_micros("last_seen").alias("seen_us"), "healthy")


@query(f"with {AGENTS}, c as (select distinct agent, healthy, unnest(caps) as capability from a) select capability, count(*) as n, string_agg(agent::varchar, ',' order by agent) as agents, count(*) filter (healthy) as healthy from c group by 1")
def capability_index(spark, d):
    return agents.capability_index(_agents(spark, d)).select("capability", "n", F.array_join(F.transform("agents", lambda x: x.cast("string")), ",").alias("agents"), "healthy")


# --- pictures and data sets --------------------------------------------------------------------------------------------


@query(
    r"""with d as (select doc_id, hex(encode(text)) as h, octet_length(encode(text)) // 384 as rows from documents where text is not null),
p as (select doc_id, unnest(range(rows * 128)) as i, h from d where rows > 0),
c as (select doc_id, ('0x' || substr(h, 6 * i + 1, 2))::int as b, ('0x' || substr(h, 6 * i + 3, 2))::int as g, ('0x' || substr(h, 6 * i + 5, 2))::int as r from p),
v as (select *, greatest(b, g, r) as v, greatest(b, g, r) - least(b, g, r) as w from c),
s as (select doc_id, v, case when v > 0 then (w * round_even(255 * 4096 / v, 0)::bigint + 2048) >> 12 else 0 end as s,
  case when w > 0 then ((case when v = r then g - b when v = g then b - r + 2 * w else r - g + 4 * w end) * round_even(30 * 4096 / w, 0)::bigint + 2048 + 4096 * 180) >> 12 else 180 end - 180 as h from v),
f as (select doc_id, count(*) filter (case when h < 0 then h + 180 else h end between 35 and 85 and s > 50 and v > 30) / count(*) as green from s group by 1)
select documents.doc_id, f.green, coalesce(f.green >= 0.2::double, false) as keep from documents left join f on f.doc_id = documents.doc_id"""
)
def green_pixels(spark, d):
    """Texts' bytes as pictures of 128 pixels a row."""
    data = F.encode("text", "UTF-8")
    p = table(spark, d, "documents").select("doc_id", data.alias("data"), F.floor(F.length(data) / 384).cast("int").alias("height"), F.lit(128).alias("width"), F.lit(3).alias("channels"))
    return pixels.curated(p).select("doc_id", "green", "keep")


FILES = "i as (select 'd/' || s_nationkey || '/img.' || s_suppkey as stem, s_suppkey as k from supplier), ann as (select stem || '.json' as path from i where k % 3 = 0 union all select stem || '.xml' from i where k % 2 = 0)"


@query(f"with {FILES} select stem || '.jpg' as image, case when k % 3 = 0 then stem || '.json' when k % 2 = 0 then stem || '.xml' end as annotation, case when k % 3 = 0 then 'json' when k % 2 = 0 then 'xml' end as ann_type, 'img.' || k as stem from i")
def annotated_images(spark, d):
    k = F.col("s_suppkey")
    i = table(spark, d, "supplier").select(F.concat(F.lit("d/"), "s_nationkey", F.lit("/img."), k).alias("stem"), k.alias("k"))
    ann = i.filter("k % 3 = 0").select(F.concat("stem", F.lit(".json")).alias("path")).unionByName(i.filter("k % 2 = 0").select(F.concat("stem", F.lit(".xml")).alias("path")))
    return joins.annotated(i.select(F.concat("stem", F.lit(".jpg")).alias("image")), ann)


HITS = "h{n} as (select distinct p.img, min(g.gt_idx) as gt_idx from p join g on p.img = g.img and {iou} >= 0.5 where p.pred_idx % 4 in ({on}) group by p.img, p.pred_idx)"


@query(
    f"""with {BOX_SQL}, {PG}, {HITS.format(n=1, iou=iou_sql('p', 'g'), on='1, 2')}, {HITS.format(n=2, iou=iou_sql('p', 'g'), on='3, 0')},
r as (select g.cls, a.img is not null as a, b.img is not null as b from g left join h1 a on a.img = g.img and a.gt_idx = g.gt_idx left join h2 b on b.img = g.img and b.gt_idx = g.gt_idx)
select cls, count(*) as total, count(*) filter (a and b) as both, count(*) filter (a and not b) as a_only, count(*) filter (b and not a) as b_only, count(*) filter (not a and not b) as neither, count(*) filter (b and not a) / count(*) as rescue_rate from r group by grouping sets ((), (cls))"""
)
def complementarity_shared(spark, d):
    p, g = both(spark, d)
    one, two = (metrics.first_hits(p.filter((F.col("pred_idx") % 4).isin(*on)), g) for on in ((1, 2), (3, 0)))
    return metrics.complementarity(one, two, g)
