import hashlib
import importlib
import math
import random
import re
from collections import Counter

import pytest
import test_decontam
import test_langid
import test_mixing
import test_near_dedup
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: clean documents, a repeated line, near copies, a leaked passage, one without letters."""
    import random

    rng, d = random.Random(2), tmp_path_factory.mktemp("tables")
    prose = lambda n: " ".join("".join(rng.choices("abdeilmnorst", k=rng.randrange(2, 9))) for _ in range(n))
    item = prose(30)
    texts = {k: prose(80) + "\nThis line is everywhere." for k in range(30)}
    texts[30] = texts[0].replace(texts[0].split()[3], "changed", 1)
    texts[31] = prose(30) + " " + item + " " + prose(30)
    texts[32] = "12345 --- 999"
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in texts.items()]
    rows.append(rows[5])
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_decide_as_planted(spark, pipeline, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = out
        seen.append(ids(docs))
    assert seen[0] == sorted([*range(32), 5])
    assert not docs.filter(F.contains("text", F.lit("everywhere"))).count()
    assert seen[2] == [*range(30), 31] and seen[3] == list(range(30))
    mixed = pipeline.run(spark, folder)
    assert ids(mixed) == list(range(30)) and mixed.filter("taken > 2 * size").count() == 0


def test_run_equals_brute_force(spark, pipeline, tmp_path):
    """The whole pipeline against plain Python, stage by stage, on a corpus with all that the stages look for."""
    rng = random.Random(31)
    letters = {"xa": "abcdeilno", "xb": "mnorstuvy"}
    word = lambda lang: "".join(rng.choices(letters[lang], k=rng.randrange(2, 9)))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(k, prose("xa", 25)) for k in range(3)]
    docs = []
    for k in range(70):
        lang = "xa" if k % 3 else "xb"
        text = prose(lang, rng.randrange(30, 90)) + "\n" + ("A line that is everywhere." if k % 4 else "Another one.") + "\n" + prose(lang, 5)
        docs.append([k, text, lang, f"s{k % 4}" if k % 9 else None, len(text)])
    for k in range(70, 85):  # copies, exact and near
        words = docs[k - 60][1].split(" ")
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        docs.append([k, " ".join(words), docs[k - 60][2], "s1", 0])
    docs += [[90, prose("xa", 20) + " " + items[1][1] + " " + prose("xa", 20), "xa", "s2", 0], [91, "12 34 --", "xa", "s2", 0], [92, None, None, "s2", None], [93, "", "xb", "s3", 0], [94, "zzzz qqqq wwww " * 20, None, "s3", 0]]
    labelled = {k: k % 2 for k in range(0, 90, 3)}
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in labelled.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    named = test_langid.predictions([(d[0], d[1], d[2]) for d in docs])
    kept = {d[0]: (d[1], d[3]) for d in docs if named[d[0]][0] != "und" and named[d[0]][1] >= pipeline.LEAST_SCORE}
    assert 94 not in kept or named[94][1] >= pipeline.LEAST_SCORE
    white = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(white))
    often = Counter(x for t, _ in kept.values() for x in {key(line) for line in t.split("\n")} if x)
    kept = {k: ("\n".join(line for line in t.split("\n") if often[key(line)] < 10), s) for k, (t, s) in kept.items()}
    root = test_near_dedup.brute([(k, t) for k, (t, _) in kept.items()], 5, 80)
    kept = {k: v for k, v in kept.items() if root[k][1] == k}
    clean = {k for k, found in test_decontam.brute([(k, t) for k, (t, _) in kept.items()], items) if not found}
    kept = {k: v for k, v in kept.items() if k in clean}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, (t, _) in kept.items()}
    sources = {}
    for k, (_, s) in kept.items():
        sources[s] = sources.get(s, 0) + size[k]
    target, want = test_mixing.deal(sources), {}
    for s, total in sources.items():
        left, own = math.floor(target[s] + 1e-9), [k for k in kept if kept[k][1] == s]
        u = {k: (int(hashlib.md5(f"17|{k}|{size[k]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for k in own}
        times = math.floor(target[s] / total)
        left -= times * total
        for k in sorted(own, key=lambda k: -math.log(u[k]) / {1: 2.0, 0: 0.5}.get(labelled.get(k), 1.0)):
            part = max(0, min(size[k], left))
            left -= part
            want[k] = times * size[k] + part
    got = {r.doc_id: (r.size, r.taken) for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {k: (size[k], want[k]) for k in kept}
    assert 50 < len(kept) < 75  # the stages had something to do


def test_odd_rows(spark, pipeline, folder, odd, none):
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, folder)
        assert out.count() >= 1, name
        if name != "source_mixing":
            assert out.columns == odd.columns
        assert stage(spark, none, folder).count() == 0
