import tracemalloc
import zlib

import numpy as np
import pytest

from granary.llm import langid as G

TESTDATA = "/root/testdata/sf0.01/documents.parquet"


def test_bundles_are_sums_of_bound_letters():
    enc = G.Encoder()
    s = enc.symbols("Ab, c")
    assert s.tolist() == [0, 1, 2, 0, 3, 0]
    grams = enc.trigrams(s)
    by_hand = sum(np.prod([enc.place[k][x].astype(int) for k, x in enumerate(g)], axis=0) for g in ((0, 1, 2), (1, 2, 0), (0, 3, 0)))
    assert (enc.bundles([grams])[0] == by_hand).all()


def test_many_letters_take_bounded_memory():
    """256 documents of 2000 random Han letters hold over 400 000 trigrams: their table would take over 1 GB."""
    rng, enc = np.random.default_rng(1), G.Encoder()
    docs = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 2000))) for _ in range(256)]
    grams = [enc.trigrams(enc.symbols(t)) for t in docs]
    tracemalloc.start()
    got = enc.bundles(grams)
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()
    assert all((got[k] == enc.bundle(grams[k])).all() for k in (0, 100, 255))


def triples(enc, text):
    s = enc.symbols(text).tolist()
    return list(zip(s, s[1:], s[2:]))


def predictions(rows):
    """lang_pred and score of every row (doc_id, text, lang), from prototypes that are added up letter by letter."""
    enc, total, out = G.Encoder(), {}, {}
    bound = lambda g: np.prod([enc.place[n][x].astype(int) for n, x in enumerate(g)], axis=0)
    for k, text, lang in rows:
        if text is not None and lang and zlib.crc32(str(k).encode()) % 5:
            for g in triples(enc, text):
                if g[1]:
                    total[lang] = total.get(lang, 0) + bound(g)
    for k, text, _ in rows:
        grams = [g for g in triples(enc, text or "") if g[1]]
        if not grams:
            out[k] = ("und", 0.0)
            continue
        v = sum(map(bound, grams))
        cos = {x: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for x, p in total.items()}
        best = max(sorted(cos), key=cos.get)
        out[k] = (best, max(0.0, cos[best]))
    return out


def test_whole_query_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    letters = {"xa": "abcde ", "xb": "cdefg ", "xc": "efghia "}
    rows = [(k, "".join(rng.choice(list(letters[lang]), 40)), lang) for k in range(120) for lang in [list(letters)[k % 3]]]
    rows += [(200, None, "xa"), (201, "...", "xb"), (202, "abc", None)]
    want = predictions(rows)
    got = {r.doc_id: r for r in G.langid(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert all(got[k].lang_pred == pred and abs(got[k].score - score) < 1e-5 for k, (pred, score) in want.items()) and len(got) == len(rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(TESTDATA)
    rows = G.langid(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95


def test_odd_rows(odd, none):
    assert G.langid(none).count() == 0
    rows = G.langid(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in G.langid(odd.withColumn("lang", G.F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("text", ["𐐀𐐁", "日本語", "\ud83d"])
def test_letters_beyond_the_table(text):
    assert len(G.Encoder().trigrams(G.Encoder().symbols(text))) >= 0
