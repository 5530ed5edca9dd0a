from collections import Counter

import pyarrow.parquet as pq

from granary.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_class_is_counted_whole(spark):
    rows = pq.read_table(f"{DATA}/lineitem.parquet", columns=["l_orderkey", "l_partkey"]).to_pylist()
    held, files = Counter(r["l_partkey"] % 12 for r in rows), {}
    for r in rows:
        files.setdefault(r["l_partkey"] % 12, set()).add(r["l_orderkey"])
    most = max(held.values())
    got = {(r.cls, r.instances, r.files, r.copies) for r in QUERIES["oversample_plan"](spark, DATA).collect()}
    assert got == {(c, n, len(files[c]), min(10, (most - n) // n + 1)) for c, n in held.items() if n < most}
