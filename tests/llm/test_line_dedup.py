import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import line_dedup as L


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    counts = rng.integers(1, 2**33, len(keys))
    h = L.PerfectHash.unpack(*L.PerfectHash.build(keys, counts).pack())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert (h.lookup(keys) == counts).all()
    others = np.setdiff1d(rng.integers(0, 2**63, 500, dtype=np.uint64), keys)
    assert not h.lookup(others).any()


def brute(rows, least):
    docs = [(t or "").split("\n") for t in rows]
    held = {}
    for k, lines in enumerate(docs):
        for x in lines:
            held.setdefault(L.line_key(x), set()).add(k)
    return ["\n".join(x for x in lines if not (L.line_key(x) and len(held[L.line_key(x)]) >= least)) for lines in docs]


def test_equals_brute_force_with_a_hot_line(spark):
    texts = [f"line {k % 7}\n Common LINE \t\n\nown {k}\n" for k in range(60)] + [None, "", "common line", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.dedup_lines(df, min_docs=9).collect()}
    want = brute(texts, 9)
    for k, t in enumerate(texts):
        assert got[k].kept == want[k]
        assert got[k].n_lines == len((t or "").split("\n")) and got[k].n_lines - got[k].n_dropped == (want[k].count("\n") + 1 if want[k] or got[k].n_dropped < got[k].n_lines else 0)


def test_odd_rows(odd, none):
    assert L.dedup_lines(none).count() == 0
    got = L.dedup_lines(odd, min_docs=2)
    assert got.count() == odd.count()
    assert {r.kept for r in got.filter("doc_id = 1").collect()} == {"", "another text under the same id"}
    assert got.filter("doc_id is null").first().kept == "a text without an id"


def test_hash_is_sparks(spark):
    for s in ["", "a", "ünïcode line", "x" * 100]:
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] == L._signed(s)
