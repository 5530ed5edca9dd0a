import random
import re
from collections import Counter

import pytest

from granary.llm import collocations as C
from granary.llm.line_dedup import TO_LOWER


def brute(rows, max_words=3, least=10, absorbed=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(TO_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                own.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if a >= least and " " in p}
        rows = []
        for p, a in candidates.items():
            w = p.split(" ")
            inside = lambda q, p=p: f" {p} " in f" {q} "
            if any(len(q.split(" ")) > len(w) and inside(q) and 100 * b >= absorbed * a for q, b in candidates.items()):
                continue
            cuts = [(1_000_000 * a * a // (own[" ".join(w[:k])] * own[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, p.encode(), p, own[" ".join(w[:k])], own[" ".join(w[k:])]))
        for rank, (s, a, _, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p, -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(rng, n):
    words = [f"w{k}" for k in range(40)] + ["ü", "É", "'", "a-b", " "]
    fixed = ["new york city", "of the", "tip of the iceberg", "Deep sea", "a a a a"]
    for _ in range(n):
        tokens = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        yield rng.choice(["en", "de", None, "und"]), "".join(t + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for t in tokens)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("max_words", "least", "top"), [(3, 10, 2000), (2, 5, 7), (4, 4, 25)])
def test_equals_brute_force(spark, max_words, least, top):
    rows = list(corpus(random.Random(max_words), 250))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(7)
    assert result(C.collocations(df, max_words, least, top=top)) == brute(rows, max_words, least, top=top)


def test_the_walk_is_depth_first_and_counts_prefixes():
    pointers = [("en", ["a", "b"], 2), ("en", ["a", "b", "c"], 3), ("en", ["a", "b", "d"], 1), ("en", ["a", "c", "c"], 4), ("fr", ["a", "c"], 4)]
    got = list(C.grow(iter(pointers), 3))
    assert got == [("en", ["a", "b", "c"], 3), ("en", ["a", "b"], 6), ("en", ["a", "c", "c"], 4), ("en", ["a", "c"], 4), ("fr", ["a", "c"], 4)]


def test_ties_of_cuts_and_large_counts(spark):
    """All cuts score alike: the first counts. Products of counts pass 64 bits in the same expression."""
    df = spark.createDataFrame([(k, "en", "x y z.") for k in range(10)], "doc_id long, lang string, text string")
    assert result(C.collocations(df)) == [("en", 1, "x y z", 10, 10, 10, 30, 1_000_000)]
    a = 3 * 10**13
    big = spark.createDataFrame([(a, 2 * a, 3 * a + 1)], "a long, l long, r long")
    assert big.select(C.score().alias("s")).first().s == 1_000_000 * a * a // (2 * a * (3 * a + 1))


def test_odd_rows(spark, odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert result(C.collocations(odd)) == brute(rows)
    hot = odd.select("lang", C.F.lit("very hot pair of words").alias("text")).crossJoin(spark.range(200).select("id"))
    assert result(C.collocations(hot.withColumn("part", C.F.lit(1)))) == brute([(r.lang, r.text) for r in hot.collect()])
    assert C.collocations(none).count() == 0
