import random
import textwrap
import time

from granary.llm import substring_dedup as S

ENDS, CLAUSES, CLOSERS = ".!?…。！？", ",;:、，；：", "\"'”’)]」』）"


def tokens(text):
    """(start, word) by the definition: runs without white space, characters of scripts without spaces one by one."""
    out, at = [], None
    for k, c in enumerate(text):
        bare = any(low <= ord(c) <= high for low, high in S.BARE) or ord(c) >= 0x20000
        if c.isspace() or bare:
            at = None
            if bare:
                out.append([k, c])
        elif at is None:
            at = k
            out.append([k, c])
        else:
            out[-1][1] += c
    return [(k, "".join(c.lower()[0] for c in w)) for k, w in out]


def sentences(text, lines, content):
    """The first words of sentences, by the definition, character by character."""
    words, out = tokens(text), [0]
    for k in range(1, len(words)):
        before = text[: words[k][0]]
        gap = before[len(before.rstrip()) :]
        said = before.rstrip()
        bare = said.rstrip(CLOSERS)
        if (bare and bare[-1] in ENDS) or said[-1] in CLAUSES or gap.count("\n") >= lines or content(words[k - 1][1], words[k][1]):
            out.append(k)
    return out if words else []


def content(a, b):
    """Whether two words are parted: the one thing that brute force takes from the module, a hash of both."""
    words = S.Words(f"{a} {b}")
    return bool(S.spread(words.hashes[:-1] * S.np.uint64(3) + words.hashes[1:])[0] % S.np.uint64(S.PLACES) == 0)


def brute(rows, min_words):
    """Every run against every other, on words."""
    seen, out = {}, {}
    for d, text in sorted(rows):
        words, gone, runs = tokens(text), set(), set()
        for lines in (1, 2):
            first = [*sentences(text, lines, content), len(words)]
            for i in range(len(first) - 1):
                j = next((j for j in range(i + 2, len(first)) if first[j] - first[i] >= min_words), None)
                if j:
                    runs.add((first[i], first[j]))
                k = next((k for k in range(i - 1, -1, -1) if first[i + 1] - first[k] >= min_words), None)
                if k is not None:
                    runs.add((first[k], first[i + 1]))
        for a, b in sorted(runs):
            key = tuple(w for _, w in words[a:b])
            if seen.setdefault(key, (d, a)) != (d, a):
                gone |= set(range(a, b))
        units = [*sentences(text, 1, content), len(words)]
        place = [0, *[words[k][0] for k in units[1:-1]], len(text)] if words else [0]
        cut = [units[n] in gone for n in range(len(units) - 1)]
        out[d] = ("".join(text[place[n] : place[n + 1]] for n, c in enumerate(cut) if not c), sum(cut)) if any(cut) else (text, 0)
    return out


def sentence(rng, n=None):
    return " ".join(rng.choice("lorem ipsum dolor sit amet eros vel nam".split()) + str(rng.randrange(30)) for _ in range(n or rng.randrange(1, 14))) + rng.choice([". ", "! ", "?\n", ", ", ".\n\n", '.") '])


def test_words_and_sentences_equal_the_definition():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choices(["a", "Bc", " ", "\n", ".", ",", '"', ")", "。", "」", "我", "é", "İ", "\x1c", "\U00020001", "x1 y2", "  "], k=rng.randrange(40)))
        words = S.Words(text)
        assert words.starts.tolist() == [k for k, _ in tokens(text)]
        assert all((words.hashes[a] == words.hashes[b]) == (x[1] == y[1]) for a, x in enumerate(tokens(text)) for b, y in enumerate(tokens(text)))
        for lines in (1, 2):
            assert words.sentences(lines).tolist() == sentences(text, lines, content), repr(text)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    passages = ["".join(sentence(rng) for _ in range(rng.randrange(4, 12))) for _ in range(4)] + [sentence(rng, 60)]
    rows = [(k, "".join(rng.choice(passages) if rng.random() < 0.3 else sentence(rng) for _ in range(rng.randrange(1, 12)))) for k in range(60)]
    rows += [(100, "Go on. " * 40), (101, textwrap.fill(passages[0] + passages[1], 40)), (102, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.kept, r.n_removed) for r in S.dedup_spans(df, min_words=20).collect()} == brute(rows, 20)
    assert {r.doc_id: (r.kept, r.n_removed) for r in S.dedup_spans(df).collect()} == brute(rows, 30)


def test_a_passage_of_over_fifty_words_goes_whole(spark):
    rng = random.Random(8)
    passage = "".join(sentence(rng, 9) for _ in range(7)).rstrip(' ,"\n)') + " "
    rows = [(1, "First words here. " + passage + "Last words here."), (2, "Quite another start. " + passage + "Quite another end."), (3, "Nothing shared at all here. Not a bit of it.")]
    got = {r.doc_id: r.kept for r in S.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert " ".join(got[2].split()) == "Quite another start. Quite another end."


def test_odd_rows(odd, none):
    assert S.dedup_spans(none).count() == 0
    rows = S.dedup_spans(odd).collect()
    assert len(rows) == odd.count()
    assert {r.kept for r in rows if r.doc_id == 2} == {None} and all(r.n_removed == 0 for r in rows if r.doc_id in (2, 3, 4))


def shared_inside(spark, a, b, passage, other=None):
    """What is left of a second text that holds `passage`, or `other` in its place, inside."""
    rows = [(1, a[0] + passage + a[1]), (2, b[0] + (other or passage) + b[1])]
    got = {r.doc_id: r.kept for r in S.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1]
    return got[2]


def plain(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet eros vel nam".split()) + str(rng.randrange(90)) for _ in range(n))


def test_a_passage_inside_a_long_sentence(spark):
    rng = random.Random(9)
    passage = ", ".join(plain(rng, 8) for _ in range(9))
    left = shared_inside(spark, ("First words that come before it ", " and more"), ("Other words that come before it ", " and others"), passage)
    assert left.startswith("Other") and left.endswith("others") and len(left.split()) < 8 + 30


def test_a_passage_inside_text_without_punctuation(spark):
    rng = random.Random(11)
    ends = [plain(rng, 60) for _ in range(4)]
    left = shared_inside(spark, (ends[0] + " ", " " + ends[1]), (ends[2] + " ", " " + ends[3]), plain(rng, 300))
    assert left.startswith(ends[2]) and left.endswith(ends[3]) and len(left.split()) < 120 + 60


def test_a_passage_wrapped_at_other_widths(spark):
    rng = random.Random(12)
    text = plain(rng, 300)
    left = shared_inside(spark, ("A start.\n", ""), ("Another start.\n", ""), textwrap.fill(text, 80), textwrap.fill(text, 50))
    assert len(left.split()) < 60
    text = "".join(sentence(rng, 12) for _ in range(20)).replace("\n", " ")
    left = shared_inside(spark, ("", ""), ("Another start.\n", ""), textwrap.fill(text, 80), textwrap.fill(text, 50))
    assert len(left.split()) < 30


def test_a_passage_without_spaces(spark):
    rng = random.Random(13)
    signs = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    left = shared_inside(spark, (signs(60), signs(60)), (signs(60), signs(60)), signs(300))
    assert len(left) < 120 + 60
    passage = "".join(signs(15) + "。" for _ in range(10))
    left = shared_inside(spark, (signs(12) + "。", signs(12)), (signs(12) + "。", signs(12)), passage)
    assert len(left) == 25


def test_a_sentence_of_forty_words(spark):
    rng = random.Random(14)
    left = shared_inside(spark, ("One start. ", ". One end."), ("Another start. ", ". Another end."), plain(rng, 45))
    assert left == "Another start. Another end."


def test_a_mark_reaches_over_many_closing_quotes_in_linear_time():
    took = []
    for n in (20_000, 320_000):
        began = time.time()
        words = S.Words("one ab." + '"' * n + " cd" + ")" * n + " ef")
        took.append(time.time() - began)
        assert words.cuts.tolist()[1] and len(words.starts) == 4
    assert took[1] < 40 * took[0] + 1
