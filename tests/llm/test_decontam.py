import random
import time

import numpy as np
from pyspark.sql import functions as F

from granary.llm import bloom
from granary.llm import decontam as D


def tiled(item, doc, seed):
    """Greedy string tiling as defined: mark the longest common unmarked run, over and over."""
    a, b, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < seed:
            return total
        a[i : i + n], b[j : j + n] = [True] * n, [True] * n
        total += n


def test_tiling_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        v = rng.choice([2, 3, 5, 12])
        item, doc = ([rng.randrange(v) for _ in range(rng.randrange(low, high))] for low, high in ((1, 40), (0, 60)))
        if rng.random() < 0.5:
            k = rng.randrange(len(item))
            doc += item[k:] + doc[:3] + item[:k]
        seed = rng.choice([1, 2, 3, 5])
        assert D.tiled(*(np.array(x, np.uint64) * 7919 + 5 for x in (item, doc)), seed) == tiled(item, doc, seed)


def test_equal_tokens_take_little_time():
    for item, doc in ((100, 4000), (5000, 20_000)):
        began = time.time()
        assert D.coverage(np.full(item, 9, np.uint64), np.full(doc, 9, np.uint64), 5, 0.5) == 1
        assert time.time() - began < 1


def words_of(text):
    """Tokens by the definition: letters and digits; Han letters one by one."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if "一" <= c <= "鿿" or not c.isalnum():
            out += [word] * bool(word) + [c] * ("一" <= c <= "鿿")
            word = ""
        else:
            word += c
    return out


def brute(docs, bench, seed=5, share=0.5):
    out = []
    for doc_id, text in docs:
        doc, own = words_of(text), set()
        for item_id, said in bench:
            item = words_of(said)
            if item_id is not None and item and tiled(item, doc, min(seed, len(item))) >= share * len(item):
                own.add(item_id)
        out.append((doc_id, sorted(own)))
    return sorted(out, key=repr)


def test_whole_query_equals_brute_force(spark):
    """Pieces of items in any order, items that share frequent runs, short items, texts without spaces, repeated rows."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(12)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(400)}"
    items = [[word() for _ in range(rng.randrange(12, 40))] for _ in range(25)]
    for it in items[:20]:
        it[3:11] = common[:8]  # a run that every item and most documents hold
    bench = [(k, ", ".join(it)) for k, it in enumerate(items)]
    bench += [(100, "only four tokens here"), (101, "Yes!"), (102, "我们今天一起去看大海和高山"), (102, "another text under one id that is long"), (None, " ".join(items[0])), (103, None), (104, "..."), (105, bench[3][1])]
    docs = []
    for k in range(150):
        doc = [word() for _ in range(rng.randrange(0, 60))] + common[:8]
        for it in rng.sample(items, rng.randrange(0, 3)):
            cut = rng.randrange(len(it))
            doc += it[cut : rng.randrange(cut, len(it)) + 1] + [word()] + it[:cut]
        docs.append((k % 140, " ".join(doc)))
    docs += [(200, "there were only four TOKENS here, he said"), (201, "yes"), (202, "昨天他说我们今天一起去看大海真好"), (203, None), (204, ""), (None, bench[3][1]), docs[0], (205, "c0 " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = D.contamination(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, list(r.item_ids)) for r in got), key=repr) == brute(docs, bench)
    assert all(r.contaminated == (len(r.item_ids) > 0) == (r.coverage >= 0.5) for r in got)


def test_a_very_long_text_is_read_to_its_end(spark):
    item = [f"i{k}" for k in range(60)]
    text = " ".join(f"w{k % 5000}" for k in range(300_000)) + " " + " ".join(item[30:]) + " x " + " ".join(item[:30])
    docs = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in D.contamination(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: [1], 2: []}


def test_reordered_passages_are_caught(spark):
    words = [f"word{k}" for k in range(40)]
    turned = " ".join(words[20:] + ["and"] + words[:20])
    rows = [(1, turned, "x"), (2, " ".join(words[:12]), "x"), (3, " ".join(words).upper() + "!", "x"), (4, None, None), (None, "", "x"), (3, "clean", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_ids string").withColumn("coverage", F.lit(1))
    bench = spark.createDataFrame([(7, ", ".join(words)), (8, "too short"), (None, "x " * 9), (9, None), (7, ", ".join(words))], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.contaminated, list(r.item_ids)) for r in D.contamination(docs, bench).collect())
    assert got == [(0, False, []), (1, True, [7]), (2, False, []), (3, False, []), (3, True, [7]), (4, False, [])]
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert not D.contamination(docs, bench.limit(0)).filter("contaminated").count()


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """A benchmark too large for the filter's bound lets more runs through, and that is all."""
    monkeypatch.setattr(bloom, "MOST_BITS", 2**15)
    monkeypatch.setattr(bloom, "BITS_EACH", 2**20)
    bench = spark.createDataFrame([(k, " ".join(f"q{k}w{n}" for n in range(90))) for k in range(400)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"start q{k}x " + " ".join(f"q{k}w{n}" for n in range(90))) for k in range(380, 420)], "doc_id long, text string")
    assert {r.doc_id: list(r.item_ids) for r in D.contamination(docs, bench).collect()} == {k: [k] if k < 400 else [] for k in range(380, 420)}
