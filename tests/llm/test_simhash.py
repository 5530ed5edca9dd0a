import itertools
import random

import pytest
import xxhash

from granary.llm import simhash as S
from granary.llm.line_dedup import TO_LOWER
from granary.llm.near_dedup import WORD


def plain(text, words):
    w = WORD.findall((text or "").translate(TO_LOWER))
    sh = [" ".join(w)] if 0 < len(w) < words else [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, distance):
    """doc_id -> smallest reachable, from (doc_id, fp) rows."""
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(fps, 2):
        if (x ^ y).bit_count() <= distance:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {d: find(d) for d in root}


def test_fingerprints_equal_the_plain_form():
    rng = random.Random(4)
    for n in [0, 1, 2, 3, 4, 7, 40, 700]:
        text = " ".join(rng.choice(["Ab", "é", "x" * 40, "fox", "\x1f", "DOG."]) for _ in range(n))
        for words in (1, 3, 5):
            assert S.fingerprint(S.hashes(text, words)) == plain(text, words)
    assert S.fingerprint(S.hashes(None, 3)) == 0
    long = " ".join(f"w{k % 977}" for k in range(40_000))
    assert S.fingerprint(S.hashes(long, 3)) == plain(long, 3)


def clusters(rng, n):
    """Fingerprints in clusters: some share a whole segment, some lie just beyond the distance, some are equal."""
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fp = base
            for _ in range(rng.randrange(5)):
                fp ^= 1 << rng.choice([rng.randrange(64), rng.randrange(32), 32 + rng.randrange(32)])
            out.append(fp)
    hot = rng.getrandbits(32)
    for _ in range(150):  # buckets with many members in either segment
        out.append(hot << 32 | sum(1 << b for b in rng.sample(range(32), rng.randrange(3))))
        out.append(sum(1 << b for b in rng.sample(range(32), rng.randrange(4))) << 32 | hot)
    return out


@pytest.mark.parametrize(("bucket", "distance"), [(0, 2), (3, 1), (3, 3), (64, 0), (64, 2)])
def test_links_equal_all_pairs(spark, bucket, distance, monkeypatch):
    """Also where every bucket, or those over three, are searched by enumerating the rest of the ball."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    fps = sorted({x - (x >> 63 << 64) for x in clusters(random.Random(8), 25)})
    classes = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {tuple(sorted((r.a, r.b))) for r in S.links_of(classes, distance).collect()}
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    assert got == want


def test_components_equal_brute_force(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([20, 200, 900]))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += ["", None, " \n", "one", "One", "a b", *texts[:5]]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 2).collect()}
    fps = [(d, plain(t, 3)) for d, t in rows]
    comp = brute(fps, 2)
    assert got == {d: (f"{fp:016x}", comp[d]) for d, fp in fps}


def test_odd_rows(spark, odd, none):
    got = S.simhash_components(odd, 3).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id == 1} == {1} and len({r.fingerprint for r in got if r.doc_id == 1}) == 2
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (2, 3, 4)} == {("0" * 16, 2)}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert S.simhash_components(none, 3).count() == 0
    with pytest.raises(ValueError):
        S.simhash_components(odd, 3, 4)
