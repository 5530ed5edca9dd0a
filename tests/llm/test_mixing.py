import math

import pytest
from pyspark.sql import functions as F

from granary.llm import mixing as M


def deal(sizes, share=1.5, cap=2.0):
    """Dealing anew until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.SOURCE_WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target | fixed
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 1000}, {"a": 1, "b": 1, None: 50, "z": 7, "é": 900}, {"a": 0, "b": 10}, {"x": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    want = deal(sizes)
    assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


def test_mix(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 9 + 1), "ab"[k % 10 == 0]) for k in range(500)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 500, 3)] + [(None, 1), (3, 0)], "doc_id long, quality int")
    rows = M.mix_sources(docs, labels).collect()
    assert len(rows) == 500 and all(0 <= r.taken <= 2 * r.size for r in rows)
    for s, t in {(r.source_size, r.target) for r in rows}:
        assert sum(r.taken for r in rows if r.source_size == s) == math.floor(t)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix_sources(docs.repartition(3), labels, ranges=16).collect()))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix_sources(docs, labels, ranges=1).collect()))


def test_heavier_documents_come_first(spark):
    docs = spark.createDataFrame([(k, "a b c d", "big") for k in range(4000)] + [(9000 + k, "a b c d", "other") for k in range(12000)], "doc_id long, text string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    part = M.mix_sources(docs, labels, weights=(1, 9)).filter("doc_id < 9000").groupBy((F.col("doc_id") % 2).alias("q")).agg(F.sum("taken").alias("t")).orderBy("q").collect()
    assert part[1].t > 1.2 * part[0].t


def test_odd_rows(odd, none, spark):
    assert M.mix_sources(none).count() == 0
    rows = M.mix_sources(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert sum(r.size for r in rows if r.doc_id in (2, 3, 4)) == 0
