"""Mixing sources to target weights by weighted reservoir keys (Efraimidis and Spirakis, 2006).

Native: only DataFrame expressions, so every step runs in the JVM.

The plan has no per-source task: keys are cut into ranges (the root of the number of rows), ranges are summed with
map-side partial aggregation, and only the one range per source in which the budget ends is ordered row by row. A source that holds a third of all rows
costs no more than any other rows do.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.llm.util import stored, words_of

#: The weights of sources in code point order, repeating.
SOURCE_WEIGHTS = (3, 1, 2)
#: The weight of a document by its quality label; the last is for unlabelled documents.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5, None: 1.0}


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources from (source, source_size): share of all sizes dealt by weight, no target above cap times its
    source's size, the excess dealt anew by weight until none is above. One row per source, so the unpartitioned
    windows see as many rows as there are sources.

    Dealing anew until it settles ends at target = least(cap, level * weight) with one level for all; ordering the
    sources by cap / weight gives that level in one pass.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    ranked = ranked.withColumn("final", F.min_by(fits, F.when(fits.isNotNull(), F.col("nth"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    labels: DataFrame | None = None,
    weights=SOURCE_WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    quality=QUALITY_WEIGHTS,
    seed: int = 17,
    ranges: int | None = None,
) -> DataFrame:
    """How many words of each document the mix takes.

    A source with target t and size s is taken floor(t / s) whole epochs; of the rest of its budget, documents are
    taken in the order of -ln(u) / w (u: a hash of seed, doc_id and size; w: quality weight), so heavier documents tend
    to come first; ties go by doc_id, then size. Texts are counted whole, however long. The document in which the budget ends is taken in part, so each source gives floor(target) words.

    Returns doc_id, size, source_size, target, taken: one row per row of `docs`, repeated rows included (each is a
    document of its own; equal rows may share one budget end in either order, which leaves equal rows). Null text has
    size 0; a null source is a source, ordered last; a null doc_id counts as an empty id in the hash; labels with null
    or repeated ids count once, by their largest quality; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
        F.col("source"),
        words_of(F.col("text")).alias("size"),
    )
    if labels is not None:
        q = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("lab_id")).agg(F.max("quality").alias("q"))
        base = base.join(q, F.col("doc_id") == F.col("lab_id"), "left")
    else:
        base = base.withColumn("q", F.lit(None).cast("int"))
    w = F.when(F.col("q") == 1, quality[1]).when(F.col("q") == 0, quality[0]).otherwise(quality[None])
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    base = base.withColumn("w", w).withColumn("key", -F.log(u) / F.col("w"))
    base = stored(base.select("doc_id", "skey", "source", "size", "key"))
    # As many ranges as rows in a range, so that both the sums of ranges and the one range that is ordered stay small.
    ranges = ranges or max(4096, math.isqrt(base.count()))
    base = base.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("int"))

    sizes = base.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes.select("source", "source_size"), weights, share, cap)
    plan = plan.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    bins = base.groupBy("skey", "bin").agg(F.sum("size").alias("bin_size"))
    bins = bins.withColumn("upto", F.sum("bin_size").over(W.partitionBy("skey").orderBy("bin")))
    ends = (
        bins.join(plan.select("skey", "rest"), "skey")
        .filter(F.col("upto") > F.col("rest"))
        .groupBy("skey")
        .agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before")), "bin").alias("end"))
    )
    plan = plan.join(ends, "skey", "left").select(
        "skey", "source_size", "target", "epochs", "rest", F.coalesce("end.bin", F.lit(2**31 - 1)).alias("end_bin"), F.coalesce("end.before", F.lit(0)).alias("before")
    )
    plan = stored(plan, 1)  # a row per source: its size on disk decides whether the join broadcasts it

    rows = base.join(plan, "skey")
    whole = rows.filter(F.col("bin") != F.col("end_bin")).withColumn("part", F.when(F.col("bin") < F.col("end_bin"), F.col("size")).otherwise(F.lit(0)))
    at_end = rows.filter(F.col("bin") == F.col("end_bin"))
    run = F.sum("size").over(W.partitionBy("skey").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    at_end = at_end.withColumn("run", F.col("before") + run - F.col("size"))
    at_end = at_end.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("run")))).drop("run")
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return whole.unionByName(at_end).select("doc_id", "size", "source_size", "target", taken)


ORACLE = r"""
with q as (select doc_id as lab_id, max(quality) as q from labels where doc_id is not null group by 1),
b as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         case when q.q = 1 then 2.0::double when q.q = 0 then 0.5::double else 1.0::double end as w
  from documents d left join q on d.doc_id = q.lab_id),
k as (select *, -ln((('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '') || '|' || size::varchar), 1, 13))::bigint::double + 0.5)
                    / 4503599627370496.0::double) / w as key from b),
s as (select source, sum(size)::bigint as source_size from k group by 1),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from s),
x as (select *, case rank % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, source_size * 2.0::double as cap from r),
l as (select *, row_number() over o as nth,
        ((sum(source_size) over ())::bigint * 1.5::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0.0))
        / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0.0)) as level
      from x window o as (order by cap / weight, rank)),
f as (select arg_min(level, nth) as final from l where cap / weight >= level),
t as (select source, source_size, least(cap, coalesce(final * weight, cap)) as target from l, f),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
p as (select k.*, e.source_size, e.target, e.epochs, floor(e.target)::bigint - e.epochs * e.source_size as rest
      from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, rest - (sum(size) over (partition by source order by key, doc_id, size rows unbounded preceding) - size))))::bigint as taken
from p
"""
