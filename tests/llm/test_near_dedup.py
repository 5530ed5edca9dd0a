import itertools
import random

import numpy as np
import pytest

from granary.llm import near_dedup as N
from granary.llm.graph import components


def sets(text, words):
    w = N.WORD.findall((text or "").translate(N.TO_LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, percent):
    own = {d: sets(t, words) for d, t in rows}
    root = {d: d for d in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(own), 2):
        x, y = own[a], own[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {d: (len(own[d]), find(d)) for d in own}


def group(rng, n, size, edits):
    base = [f"v{rng.randrange(5000)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize(("words", "percent", "few"), [(3, 85, 32), (5, 80, 2)])
def test_equals_brute_force(spark, words, percent, few, monkeypatch):
    """Also where most shingles that members meet by have too many holders to list pairs, cut into several blocks."""
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "BLOCK", 4 if few == 2 else 16)
    rng = random.Random(9)
    texts = [*group(rng, 60, 150, 14), *group(rng, 40, 40, 3), *group(rng, 20, 300, 25), "a b", "a b", "A  b", "a", "", None, "\x0b"]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + " shared line of words that many have in common" for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, words, percent).collect()}
    assert got == brute(rows, words, percent)


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, N.SLOTS)
    for percent in (80, 85, 100):
        for _ in range(300):
            n = int(rng.integers(1, 60))
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)]))
            if len(y) and N.linked(x, y, percent):
                assert len(np.intersect1d(N.prefix(x, counts, percent), N.prefix(y, counts, percent)))


def test_half_alike_documents_do_not_meet(spark):
    """A template of 60 words with 60 words of its own in each of 400 documents, and some near copies: the first share
    many buckets, but none of their rarest shingles, so hardly any pair is looked at."""
    rng = random.Random(11)
    stock = [f"s{k}" for k in range(60)]
    texts = [" ".join(stock + [f"o{rng.randrange(10**7)}" for _ in range(60)]) for _ in range(400)]
    texts += [t + " more" for t in texts[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, 5, 80).collect()}
    assert got == {d: (len(sets(t, 5)), d - 400 if d >= 400 else d) for d, t in enumerate(texts)}
    own = spark.createDataFrame([(k, k, bytearray(N.Shingler(5)(t).tobytes())) for k, t in enumerate(texts[:400])], "rep long, comp long, set binary")
    counts = spark.sparkContext.broadcast(N.slot_counts(own))
    assert N.prefixes(own, counts, 80).groupBy("key").count().filter("count > 1").count() < 20


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_ids_link_through_each_of_their_texts(spark, parts):
    """Brute force on repeated ids: each row has its own set; rows of one id are in one component."""
    rng = random.Random(20 + parts)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (9, " ".join(c)), (5, near(c)), (9, near(b)), (7, "x y"), (7, None), (7, " ".join(a)), (8, "x y"), (8, "x y")]
    rng.shuffle(rows)
    got = {(r.doc_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
    assert got == {(k, 1) for k in (1, 2, 3, 5, 7, 8, 9)} | {(7, 7)}  # the row without text is linked with nothing


def test_pairs_within_the_limit_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 2**16, N.PLACES).astype(np.uint16)
        b = a.copy()
        b[rng.choice(N.PLACES, N.LIMIT, replace=False)] ^= 1
        x, y = N.keys_of(a[None, :])[0], N.keys_of(b[None, :])[0]
        assert (x == y).any()


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 140)}


def test_odd_rows(odd, none):
    assert N.near_duplicates(none).count() == 0
    rows = N.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in rows if r.doc_id in (2, 3, 4))
